"""A training corpus from raw documents: the stages in order, and their run.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`, which is what the stage
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.decontaminate import drop_contaminated
from spanloom.llm.mixing import take_mix
from spanloom.llm.near_dups import keep_one_of_each
from spanloom.llm.quality import keep_good
from spanloom.llm.sharding import shuffle_into_shards
from spanloom.runtime import materialize

SHARDS = 8
# Rows with their texts are permuted in parts of about this many.
PART_ROWS = 10_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 80 %) stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document comes as often as the mix takes it."""
    return take_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uniform shuffle into shards of equal size; adds shard and slot."""
    keys = [F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.col("source")]
    return shuffle_into_shards(docs, keys, SHARDS, part_rows=PART_ROWS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Min-hash candidates and balanced sampling are not SQL; the run is tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
