"""The table of computed metrics: rows in, rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.constants import STORED_SCOPES
from spanloom.functions.values import truthy
from spanloom.operators.results import with_bucket
from spanloom.schemas import DERIVED_METRIC_SCHEMA

_RESPONSE = ["ID", "SpanId", "TraceId", "SessionId", "Timestamp", "Metrics", "AppName", "AppId"]
_REQUIRED = ["SpanId", "TraceId", "SessionId", "AppName", "AppId", "Metrics", "Scope"]


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DERIVED_METRIC_SCHEMA).parquet(path)


def with_scope(rows: DataFrame, scope: str) -> DataFrame:
    if scope not in STORED_SCOPES:
        raise ValueError(f"scope must be one of {STORED_SCOPES}, got {scope!r}")
    return rows.withColumn("Scope", F.lit(scope))


def complete_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a row missing any required field is not stored."""
    gaps = F.filter(
        F.array(*[F.when(truthy(F.col(c)).isNull(), F.lit(c)) for c in _REQUIRED]),
        lambda x: x.isNotNull(),
    )
    marked = rows.withColumn("missing", gaps)
    accepted = marked.filter(F.size("missing") == 0).drop("missing")
    return accepted, marked.filter(F.size("missing") > 0)


def append_metrics(rows: DataFrame, path: str) -> DataFrame:
    """Append complete rows, each under a new id and the current time. Returns the rejected
    rows, with what they lack."""
    accepted, rejected = complete_rows(rows)
    stamped = accepted.withColumn("ID", F.expr("uuid()")).withColumn(
        "Timestamp", F.current_timestamp()
    )
    stamped.select([f.name for f in DERIVED_METRIC_SCHEMA.fields]).write.mode("append").partitionBy(
        "Scope"
    ).parquet(path)
    return rejected


def storage_rows(results: DataFrame, trace_id=None, app_id=None) -> DataFrame:
    """Metric results as store rows; ids that are missing get the default names."""
    given = lambda c, default: F.coalesce(truthy(c), F.lit(default))
    text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
    body = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    return results.select(
        given(F.col("span_id"), "default_span_id").alias("SpanId"),
        given(text(trace_id), "default_trace_id").alias("TraceId"),
        given(F.col("session_id"), "default_session_id").alias("SessionId"),
        body.alias("Metrics"),
        given(F.col("app_name"), "default_app_name").alias("AppName"),
        given(text(app_id), "default_app_id").alias("AppId"),
        F.when(F.col("aggregation_level") == "span", "span").otherwise("session").alias("Scope"),
    )


def storable(results: DataFrame) -> DataFrame:
    """Results worth storing: span, session and agent rows that are not in the failed bucket and
    were not read back from the store. An unsuccessful row with a value is worth storing."""
    return with_bucket(results).filter(
        F.col("bucket").isin("span", "session", "agent") & ~F.coalesce("from_cache", F.lit(False))
    ).select(*results.columns)


def response_rows(rows: DataFrame) -> DataFrame:
    """Store rows as answered to a caller: everything but the scope."""
    return rows.select(*_RESPONSE)


def for_session(rows: DataFrame, session: str, scope: str) -> DataFrame:
    return rows.filter((F.col("SessionId") == session) & (F.col("Scope") == scope))


def for_span(rows: DataFrame, span: str, scope: str) -> DataFrame:
    return rows.filter((F.col("SpanId") == span) & (F.col("Scope") == scope))


def _field(name: str):
    return F.get_json_object("Metrics", f"$.{name}")


def metric_names(rows: DataFrame, session: str | None = None) -> DataFrame:
    """Distinct metric names, of the sessions whose id contains the text."""
    kept = rows if session is None else rows.filter(F.col("SessionId").contains(session))
    return kept.select(_field("metric_name").alias("metric_name")).distinct()


def metric_percent(rows: DataFrame, session: str | None = None, metric: str | None = None) -> DataFrame:
    """Values times 100 of a metric in the sessions whose id contains the text."""
    kept = rows
    if session is not None:
        kept = kept.filter(F.col("SessionId").contains(session))
    if metric is not None:
        kept = kept.filter(_field("metric_name") == metric)
    return kept.select(
        "SessionId",
        _field("metric_name").alias("metric_name"),
        (_field("value_num").try_cast("double") * 100).alias("value"),
    )


def sessions_of_app(rows: DataFrame, app: str) -> DataFrame:
    return rows.filter(F.col("AppName").contains(app)).select("SessionId").distinct()


def already_stored(rows: DataFrame) -> DataFrame:
    """Rows whose body names level, category and metric."""
    return rows.filter(
        _field("aggregation_level").isNotNull()
        & _field("category").isNotNull()
        & F.coalesce(_field("name"), _field("metric_name")).isNotNull()
    )
