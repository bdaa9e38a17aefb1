"""Registration of queries with their SQL twins, and the span tables they read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.parse import in_sessions, parse_spans
from spanloom.operators.tree import unique_spans
from spanloom.plans.build import Frames
from spanloom.runtime import materialize, scratch_root
from spanloom.sources import derived
from spanloom.sources.traces import read_histogram, read_traces, write_trace_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_tables: dict[tuple[str, str, str], DataFrame] = {}
_frames: dict[tuple[str, str], Frames] = {}
_histograms: dict[tuple[str, str], str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table built once per application and folder, then read from storage."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _tables:
        _tables[key] = materialize(build(), name)
    return _tables[key]


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """The derived trace table, stored by the intake's own layout and read back as a user would."""
    key = (spark.sparkContext.applicationId, folder, "traces")
    if key not in _tables:
        path = scratch(spark, "traces")
        write_trace_table(derived.spans(spark, folder), path)
        _tables[key] = read_traces(spark, path)
    return _tables[key]


def typed(spark: SparkSession, folder: str) -> DataFrame:
    """Typed spans of all sessions, parsed from the trace table once."""
    return _stored(spark, folder, "typed", lambda: unique_spans(in_sessions(parse_spans(raw(spark, folder)))))


def histogram(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """Points of one histogram metric, read from the stored points."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _histograms:
        _histograms[key] = scratch(spark, "histogram")
        derived.histogram_points(spark, folder).write.parquet(_histograms[key])
    return read_histogram(spark, _histograms[key], metric)


def frames(spark: SparkSession, folder: str) -> Frames:
    """The frames that several operators share, built on the typed spans once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _frames:
        _frames[key] = Frames(typed(spark, folder))
    return _frames[key]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/spanloom/{label}-{uuid.uuid4().hex}"


def r6(c: str | Column) -> Column:
    """Doubles are compared to six places."""
    name = c if isinstance(c, str) else None
    rounded = F.round(F.col(c) if name else c, 6)
    return rounded.alias(name) if name else rounded


def micros(c: str) -> Column:
    return F.unix_micros(c)
