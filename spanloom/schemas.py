"""Explicit schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _fields(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in spec])


# Raw OpenTelemetry span, one row per span. Event and link columns are parallel arrays.
SPAN_SCHEMA = _fields(
    [
        ("Timestamp", T.TimestampType()),
        ("ts_raw", T.StringType()),
        ("TraceId", T.StringType()),
        ("SpanId", T.StringType()),
        ("ParentSpanId", T.StringType()),
        ("TraceState", T.StringType()),
        ("SpanName", T.StringType()),
        ("SpanKind", T.StringType()),
        ("ServiceName", T.StringType()),
        ("ResourceAttributes", _STRING_MAP),
        ("ScopeName", T.StringType()),
        ("ScopeVersion", T.StringType()),
        ("SpanAttributes", _STRING_MAP),
        ("Duration", T.LongType()),
        ("StatusCode", T.StringType()),
        ("StatusMessage", T.StringType()),
        ("EventsTimestamp", T.ArrayType(T.TimestampType())),
        ("EventsName", T.ArrayType(T.StringType())),
        ("EventsAttributes", T.ArrayType(_STRING_MAP)),
        ("LinksTraceId", T.ArrayType(T.StringType())),
        ("LinksSpanId", T.ArrayType(T.StringType())),
        ("LinksTraceState", T.ArrayType(T.StringType())),
        ("LinksAttributes", T.ArrayType(_STRING_MAP)),
    ]
)

# The columns of a span file. Times stay text there (nanoseconds would be cut otherwise).
SPAN_FILE_SCHEMA = _fields(
    [
        ("Timestamp", T.StringType()),
        ("TraceId", T.StringType()),
        ("SpanId", T.StringType()),
        ("ParentSpanId", T.StringType()),
        ("TraceState", T.StringType()),
        ("SpanName", T.StringType()),
        ("SpanKind", T.StringType()),
        ("ServiceName", T.StringType()),
        ("ResourceAttributes", _STRING_MAP),
        ("ScopeName", T.StringType()),
        ("ScopeVersion", T.StringType()),
        ("SpanAttributes", _STRING_MAP),
        ("Duration", T.LongType()),
        ("StatusCode", T.StringType()),
        ("StatusMessage", T.StringType()),
        ("EventsName", T.ArrayType(T.StringType())),
        ("EventsAttributes", T.ArrayType(_STRING_MAP)),
        ("Events.Name", T.ArrayType(T.StringType())),
        ("Events.Attributes", T.ArrayType(_STRING_MAP)),
        ("session_id", T.StringType()),
        ("sessionId", T.StringType()),
    ]
)

HISTOGRAM_SCHEMA = _fields(
    [
        ("MetricName", T.StringType()),
        ("ResourceAttributes", _STRING_MAP),
        ("Sum", T.DoubleType()),
        ("Min", T.DoubleType()),
        ("Max", T.DoubleType()),
    ]
)

DERIVED_METRIC_SCHEMA = _fields(
    [
        ("ID", T.StringType()),
        ("SpanId", T.StringType()),
        ("TraceId", T.StringType()),
        ("SessionId", T.StringType()),
        ("Timestamp", T.TimestampType()),
        ("Metrics", T.StringType()),
        ("AppName", T.StringType()),
        ("AppId", T.StringType()),
        ("Scope", T.StringType()),
    ]
)

METRIC_RESULT_SCHEMA = _fields(
    [
        ("metric_name", T.StringType()),
        ("aggregation_level", T.StringType()),
        ("category", T.StringType()),
        ("app_name", T.StringType()),
        ("agent_id", T.StringType()),
        ("session_id", T.StringType()),
        ("span_id", T.StringType()),
        ("value_num", T.DoubleType()),
        ("value_json", T.StringType()),
        ("description", T.StringType()),
        ("reasoning", T.StringType()),
        ("unit", T.StringType()),
        ("source", T.StringType()),
        ("metadata", T.StringType()),
        ("label", T.StringType()),
        ("success", T.BooleanType()),
        ("error_message", T.StringType()),
        ("from_cache", T.BooleanType()),
    ]
)

JUDGE_REPLY_SCHEMA = _fields(
    [
        ("request_id", T.StringType()),
        ("judge_no", T.IntegerType()),
        ("reply", T.StringType()),
    ]
)

SCORER_REPLY_SCHEMA = _fields(
    [
        ("case_id", T.StringType()),
        ("score", T.DoubleType()),
        ("threshold", T.DoubleType()),
        ("reason", T.StringType()),
        ("success", T.BooleanType()),
        ("error", T.StringType()),
        ("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

LOGPROBS_TYPE = T.StructType(
    [
        T.StructField(
            "content",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("token", T.StringType()),
                        T.StructField("logprob", T.DoubleType()),
                    ]
                )
            ),
        )
    ]
)
