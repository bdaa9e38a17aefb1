"""Model confidence from token log-probabilities found in output payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import find_key, lenient_json, probability
from spanloom.schemas import LOGPROBS_TYPE


def token_logprobs(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per token: the first `logprobs` object inside a span's output payload. Model
    completions are decoded first, since their values are JSON texts."""
    keys = keys or ["session_id"]
    decoded = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                F.map_values("completions"),
                lambda v: F.when(lenient_json(v).isNotNull(), v).otherwise(F.lit("null")),
            ),
            ",",
        ),
        F.lit("]"),
    )
    text = F.when(F.col("entity_type") == "llm", decoded).otherwise(F.col("output_payload"))
    mentioned = F.when(
        F.col("entity_type") == "llm", F.exists(F.map_values("completions"), lambda v: v.contains("logprobs"))
    ).otherwise(F.col("output_payload").contains("logprobs"))
    held = spans.filter(mentioned).select(
        *keys, "span_id", find_key(text, "logprobs", "own_first").alias("_json")
    )
    parsed = held.withColumn("_t", F.from_json("_json", LOGPROBS_TYPE))
    return parsed.select(*keys, "span_id", F.explode("_t.content").alias("x")).select(
        *keys, "span_id", F.col("x.token").alias("token"), F.col("x.logprob").alias("logprob")
    )


def confidence(tokens: DataFrame, entities: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average, minimum and maximum confidence per entity; -1 without log-probabilities. The
    average is over spans of each span's mean, so that long answers do not outweigh others."""
    keys = keys or ["session_id"]
    per_span = tokens.groupBy(*keys, "span_id").agg(
        F.avg("logprob").alias("_mean"), F.min("logprob").alias("_min"), F.max("logprob").alias("_max")
    )
    per_entity = per_span.groupBy(*keys).agg(
        probability(F.avg("_mean")).alias("average_confidence"),
        probability(F.min("_min")).alias("minimum_confidence"),
        probability(F.max("_max")).alias("maximum_confidence"),
    )
    known = entities.select(*keys).distinct()
    return known.join(per_entity, keys, "left").select(
        *keys,
        *[
            F.coalesce(c, F.lit(-1.0)).alias(c)
            for c in ("average_confidence", "minimum_confidence", "maximum_confidence")
        ],
    )
