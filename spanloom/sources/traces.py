"""Reading and laying out span tables, span files and histogram points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.constants import DEFAULT_FILE_SESSION
from spanloom.functions.values import truthy, uuid_part
from spanloom.operators.ordered import numbered
from spanloom.operators.parse import session_id
from spanloom.operators.reads import PROMOTED, promoted
from spanloom.sources.json_pieces import json_objects
from spanloom.schemas import HISTOGRAM_SCHEMA, SPAN_FILE_SCHEMA, SPAN_SCHEMA


# How spans are stored: the promoted attributes as columns, partitioned by day.
TRACE_TABLE_SCHEMA = T.StructType(
    [
        *SPAN_SCHEMA.fields,
        *[T.StructField(c, T.StringType()) for c in PROMOTED.values()],
        T.StructField("day", T.DateType()),
    ]
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """The raw trace table, with the promoted columns and the day where it was stored with them
    (`write_trace_table`), so that filters reach the scan."""
    have = set(spark.read.parquet(path).columns)
    stored = [f for f in TRACE_TABLE_SCHEMA.fields if f.name in have or f in SPAN_SCHEMA.fields]
    return spark.read.schema(T.StructType(stored)).parquet(path)


def read_histogram(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """Histogram points of one metric; the name filter reaches the scan."""
    return spark.read.schema(HISTOGRAM_SCHEMA).parquet(path).filter(F.col("MetricName") == metric)


def read_trace_file(spark: SparkSession, path: str, layout: str = "any") -> DataFrame:
    """Spans from JSON files. With `any`, each file may be an array of spans, one span, or spans one
    after the other, and a large one is read by many tasks whatever its layout; a span that does
    not parse is a row of nulls. `lines` is the shorter way for files known to hold a span a line."""
    if layout not in ("any", "lines"):
        raise ValueError(f"layout must be 'any' or 'lines', got {layout!r}")
    if layout == "lines":
        return spark.read.schema(SPAN_FILE_SCHEMA).option("mode", "PERMISSIVE").json(path)
    parsed = json_objects(spark, path).select(F.from_json("json", SPAN_FILE_SCHEMA).alias("span"))
    return parsed.select("span.*")


def file_spans(rows: DataFrame) -> DataFrame:
    """File rows in the shape of the trace table. Times keep their text in `ts_raw`, since a
    timestamp holds microseconds only; both spellings of the event columns are read."""
    have = set(rows.columns)
    source: dict[str, Column] = {c: F.col(f"`{c}`") for c in have}
    source["ts_raw"] = F.col("Timestamp").cast("string")
    source["Timestamp"] = F.col("Timestamp").try_cast("timestamp")
    for plain, dotted in [("EventsName", "Events.Name"), ("EventsAttributes", "Events.Attributes")]:
        if dotted in have:
            source[plain] = F.coalesce(F.col(f"`{dotted}`"), F.col(plain))
    shaped = [
        source.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SPAN_SCHEMA.fields
    ]
    extra = [F.col(c) for c in ("session_id", "sessionId") if c in have]
    return rows.select(*shaped, *extra)


def stated_session(df: DataFrame) -> Column:
    """Session of a span: its attributes, else a top-level field where the file has one."""
    fields = [truthy(F.col(c)) for c in ("session_id", "sessionId") if c in df.columns]
    return F.coalesce(truthy(session_id()), *fields)


def keyed_by_session(raw: DataFrame) -> DataFrame:
    """Store-shaped spans: session key (uuid part, or a default), full session id, start in
    epoch seconds, duration in ms, numeric status and upper-case framework kind."""
    full = stated_session(raw)
    kind = F.try_element_at("SpanAttributes", F.lit("traceloop.span.kind"))
    return raw.select(
        "*",
        F.coalesce(uuid_part(full), F.lit(DEFAULT_FILE_SESSION)).alias("session_key"),
        truthy(session_id()).alias("full_session_id"),
        (F.unix_micros("Timestamp") / 1e6).alias("start_epoch"),
        (F.col("Duration") * 0.000001).alias("duration_raw_ms"),
        status_number().alias("status_number"),
        F.upper(F.coalesce(kind, F.lit(""))).alias("framework_kind"),
    )


def status_number() -> Column:
    failed = F.col("StatusCode").isin("Error", "STATUS_CODE_ERROR")
    return F.when(failed, 2).otherwise(0)


def one_session_per_row(rows: DataFrame, order: list[str]) -> DataFrame:
    """Population from a file: the row's own session field, else a generated session named
    by the row's place in the file (`order` is the file order)."""
    placed = numbered(rows, [F.col(o).asc_nulls_last() for o in order], "_row")
    generated = F.concat(F.lit("file_session_"), F.col("_row").cast("string"))
    return placed.withColumn(
        "population_session", F.coalesce(truthy(F.col("session_id")), generated)
    ).drop("_row")


def write_trace_table(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Store raw spans with the attributes that reads filter on promoted out of the maps, and
    partitioned by day, so that filters and pruning reach the scan."""
    (
        # Few files per day, and a busy day over many, by sizes met in the shuffle: bounds of ranges
        # would be sampled, for which all spans are made a second time. Files are in time order.
        # Attributes are copied out of the maps behind the shuffle, so as not to be moved twice.
        raw.withColumn("day", F.to_date("Timestamp"))
        .hint("rebalance", "day")
        .transform(promoted)
        .sortWithinPartitions("day", "Timestamp", "SpanId")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def dump_session(raw: DataFrame, session: str, path: str) -> None:
    """Write one session's spans as JSON lines."""
    raw.filter(session_id() == session).write.mode("errorifexists").json(path)
