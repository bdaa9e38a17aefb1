"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.archives import archive_folder, capture_key, find_captures, write_archive, write_index
from spanloom.llm.classifier import score_quality, train
from spanloom.llm.decontaminate import find_benchmark_words, hit_words
from spanloom.llm.hosts import UrlRule, filter_urls
from spanloom.llm.lexical import search
from spanloom.llm.licenses import scan_licenses
from spanloom.llm.mixing import mix, text_words
from spanloom.llm.near_dups import near_duplicates
from spanloom.llm.negatives import mine_hard_negatives
from spanloom.llm.packing import pack_sequences, token_ids
from spanloom.llm.quality import base_failed, measured, quality_verdict
from spanloom.llm.sharding import shuffle_into_shards
from spanloom.llm.substrings import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_benchmark_words(table(spark, folder, "documents"), table(spark, folder, "benchmark"), returned=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents"), returned=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = measured(table(spark, folder, "documents").select("doc_id", "text"))
    failed = base_failed()
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & quality_verdict()).alias("kept"),
    )


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = shuffle_into_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


URL_RULES = [
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
]


@query
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of the document with a page's id are the page's outcome."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = filter_urls(table(spark, folder, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates(table(spark, folder, "documents"), words=2)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "documents").select("doc_id", "source", text_words(F.col("text")).alias("size"))
    rows = mix(units).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, by a search for the key of its url."""
    place, pages = archive_folder(spark), table(spark, folder, "pages")
    lines = write_archive(pages, place)
    records = find_captures(write_index(lines, place), place, pages.select(capture_key(F.col("url")).alias("key")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"), returned=["doc_id"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("notices", lambda n: n["label"])
    starts = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        "score",
    )


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    labels = table(spark, folder, "labels").where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, train(docs, labels), returned=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    ids = token_ids(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack_sequences(ids).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)
