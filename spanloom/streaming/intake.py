"""Continuous intake of spans into the trace table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.reads import promoted
from spanloom.schemas import SPAN_SCHEMA
from spanloom.sources.traces import TRACE_TABLE_SCHEMA

_KEYS = ["TraceId", "SpanId"]


def landing_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Spans from Parquet files that a collector drops into a folder."""
    return spark.readStream.schema(SPAN_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """For pipelines that stay in memory: a span delivered twice within the delay is kept
    once, and state expires with the watermark. Spans later than the delay are dropped, so
    the stored intake below does not use it."""
    return stream.withWatermark("Timestamp", delay).dropDuplicatesWithinWatermark(_KEYS)


def store_batch(batch: DataFrame, table: str) -> None:
    """Append the spans of a batch that the table does not hold yet. Only the days that occur in
    the batch are read for that, late spans are stored like others, and a replayed batch adds
    nothing."""
    spark = batch.sparkSession
    rows = promoted(batch).withColumn("day", F.to_date("Timestamp")).dropDuplicates(_KEYS).persist()
    try:
        # As many as the batch has days; they prune the partitions that are read.
        days = [r["day"] for r in rows.select("day").distinct().collect()]
        if not days:
            return
        stored = spark.read.schema(TRACE_TABLE_SCHEMA).parquet(table)
        near = F.col("day").isin([d for d in days if d is not None])
        near = near | F.col("day").isNull() if None in days else near
        held = stored.filter(near).select(*[F.col(k).alias(f"_held_{k}") for k in _KEYS])
        # A span without an id is a span like others, so ids are equal where both are missing.
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in _KEYS])
        fresh = rows.join(held, same, "left_anti")
        fresh.select(*TRACE_TABLE_SCHEMA.names).write.mode("append").partitionBy("day").parquet(table)
    finally:
        rows.unpersist()


def start_intake(
    spark: SparkSession, landing: str, table: str, checkpoint: str, once: bool = False, files_per_trigger: int = 100
) -> StreamingQuery:
    """Append landing files to the day-partitioned trace table, each span once."""
    empty = spark.createDataFrame([], TRACE_TABLE_SCHEMA)
    empty.write.mode("append").partitionBy("day").parquet(table)
    writer = (
        landing_stream(spark, landing, files_per_trigger)
        .writeStream.foreachBatch(lambda batch, _id: store_batch(batch, table))
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()
