"""Raw spans to typed spans: one projection, no shuffle (tool definitions are a join, and
only made when asked for)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.constants import DEFAULT_APP_NAME
from spanloom.functions.values import (
    attr,
    error_words_in_payload,
    lenient_json,
    map_has_error_words,
    payload,
    truthy,
)

def _attrs(key: str) -> Column:
    return attr(F.col("SpanAttributes"), key)


def entity_type() -> Column:
    """Type by span name; later rules of the reference order win, so they are tested first."""
    low = F.lower(F.coalesce(F.col("SpanName"), F.lit("")))
    has_tool_triple = (
        _attrs("tool_name").isNotNull()
        & _attrs("tool_args").isNotNull()
        & _attrs("tool_description").isNotNull()
    )
    chain = (
        F.when(has_tool_triple, "tool")
        .when(low.contains("autogen create"), "workflow")
        .when(low.contains("autogen process"), "agent")
    )
    for suffix, kind in [
        (".task", "task"),
        (".graph", "graph"),
        (".workflow", "workflow"),
        (".agent", "agent"),
        (".tool", "tool"),
        (".chat", "llm"),
    ]:
        chain = chain.when(low.endswith(suffix), kind)
    return chain


def session_id() -> Column:
    return F.coalesce(truthy(_attrs("session.id")), _attrs("execution.id"))


def span_app_name() -> Column:
    """Service, resource, then attribute names; 'unknown' is passed over in the first two."""
    known = lambda c: F.nullif(truthy(c), F.lit("unknown"))
    keys = [
        "app.name",
        "service.name",
        "application.name",
        "traceloop.workflow.name",
        "ioa_workflow.name",
    ]
    return F.coalesce(
        known(F.col("ServiceName")),
        known(attr(F.col("ResourceAttributes"), "service.name")),
        *[truthy(_attrs(k)) for k in keys],
        F.lit(DEFAULT_APP_NAME),
    )


def _entity_name() -> Column:
    kind, name = F.col("entity_type"), F.col("SpanName")
    observed, traced = _attrs("ioa_observe.entity.name"), _attrs("traceloop.entity.name")
    unknown = F.lit("unknown")
    stated = F.coalesce(F.nullif(observed, unknown), traced, unknown)
    by_pattern = F.coalesce(
        truthy(F.regexp_extract(name, r"autogen process (\w+)_", 1)),
        truthy(F.split_part(F.replace(name, F.lit("autogen process "), F.lit("")), F.lit("_"), F.lit(1))),
        unknown,
    )
    agent = F.coalesce(truthy(_attrs("agent_id")), stated)
    agent = F.when((agent == unknown) & name.contains("autogen process"), by_pattern).otherwise(agent)
    return (
        F.when(kind == "tool", F.coalesce(truthy(observed), truthy(traced), unknown))
        .when(kind == "agent", agent)
        .when(kind == "llm", F.coalesce(_attrs("gen_ai.response.model"), unknown))
        .when(kind == "task", F.coalesce(traced, unknown))
        .otherwise(F.coalesce(_attrs("ioa_observe.workflow.name"), unknown))
    )


def _numbered_functions() -> Column:
    """All numbered tool definitions on one model span, by number."""
    pattern = r"^llm\.request\.functions\.([0-9]+)\.name$"
    attrs = F.col("SpanAttributes")
    listed = F.sort_array(
        F.transform(
            F.filter(F.map_keys(attrs), lambda k: k.rlike(pattern)),
            lambda k: F.regexp_extract(k, pattern, 1).cast("int"),
        )
    )
    field = lambda n, f: F.try_element_at(
        attrs, F.concat(F.lit("llm.request.functions."), n.cast("string"), F.lit("." + f))
    )
    return F.transform(
        listed,
        lambda n: F.struct(
            n.alias("idx"),
            field(n, "name").alias("name"),
            field(n, "description").alias("description"),
            F.when(lenient_json(field(n, "parameters")).isNotNull(), field(n, "parameters")).alias("parameters"),
        ),
    )


def _first_exception() -> Column:
    """Message and stack trace of the first exception event that has attributes."""
    paired = F.filter(
        F.arrays_zip(F.col("EventsName").alias("n"), F.col("EventsAttributes").alias("a")),
        lambda z: (z["n"] == "exception") & z["a"].isNotNull(),
    )
    first = F.try_element_at(paired, F.lit(1))
    text = lambda key: F.coalesce(attr(first["a"], key), F.lit(""))
    return F.when(
        first.isNotNull(),
        F.struct(
            text("exception.message").alias("error_name"),
            text("exception.stacktrace").alias("error_trace"),
        ),
    )


# Attributes that become columns of their own and are not stored twice.
_MOVED_PREFIXES = ["gen_ai.prompt", "gen_ai.completion", "llm.request.functions."]
_MOVED_KEYS = [f"{source}.entity.{side}" for source in ("traceloop", "ioa_observe") for side in ("input", "output")]


def parse_spans(raw: DataFrame, with_tool_definitions: bool = False) -> DataFrame:
    """Typed spans from raw ones; spans of no recognised type are dropped. Model spans keep
    their payloads as the text maps `prompts` and `completions`, others as JSON objects in
    `input_payload` and `output_payload`; `attrs` holds the remaining attributes."""
    attrs = F.col("SpanAttributes")
    kind = F.col("entity_type")
    typed = raw.withColumn("entity_type", entity_type()).filter(kind.isNotNull())
    is_llm = kind == "llm"
    family = lambda prefix: F.when(is_llm, F.map_filter(attrs, lambda k, v: k.startswith(prefix)))
    side = lambda name: F.when(kind == "agent", _attrs(f"ioa_observe.entity.{name}")).when(
        ~is_llm, _attrs(f"traceloop.entity.{name}")
    )
    staged = typed.withColumns(
        {
            "_in": side("input"),
            "_out": side("output"),
            "prompts": family("gen_ai.prompt"),
            "completions": family("gen_ai.completion"),
            "_start": _attrs("ioa_start_time").try_cast("double"),
        }
    ).withColumn("_parsed_out", lenient_json(F.col("_out")).isNotNull())
    has_duration = F.coalesce(F.col("Duration"), F.lit(0)) != 0
    failed_output = F.when(is_llm, map_has_error_words(F.col("completions"))).otherwise(
        error_words_in_payload(F.col("_out"), F.col("_parsed_out"), kind)
    )
    contains_error = (
        F.coalesce(F.lower("StatusCode") == "error", F.lit(False))
        | truthy(_attrs("traceloop.entity.error")).isNotNull()
        | failed_output
    )
    kept = F.map_filter(
        attrs,
        lambda k, v: ~(
            k.isin(*_MOVED_KEYS) | k.startswith(_MOVED_PREFIXES[0]) | k.startswith(_MOVED_PREFIXES[1])
            | k.startswith(_MOVED_PREFIXES[2])
        ),
    )
    flagged = staged.withColumn("contains_error", contains_error)
    out = flagged.select(
        "entity_type",
        F.col("SpanId").alias("span_id"),
        _entity_name().alias("entity_name"),
        span_app_name().alias("app_name"),
        _attrs("agent_id").alias("agent_id"),
        payload(F.col("_in"), lenient_json(F.col("_in")).isNotNull()).alias("input_payload"),
        payload(F.col("_out"), F.col("_parsed_out")).alias("output_payload"),
        "prompts",
        "completions",
        F.lit(None).cast("string").alias("expected_output"),
        _attrs("traceloop.entity.message").alias("message"),
        "contains_error",
        F.when(F.col("contains_error"), _first_exception()).alias("error_data"),
        F.col("Timestamp").alias("timestamp"),
        "ts_raw",
        F.col("ParentSpanId").alias("parent_span_id"),
        F.col("TraceId").alias("trace_id"),
        session_id().alias("session_id"),
        F.col("_start").alias("start_time"),
        F.when(has_duration, F.col("_start") + F.col("Duration") / 1e9).alias("end_time"),
        F.when(has_duration, F.col("Duration") / 1e6).alias("duration_ms"),
        F.when(
            is_llm,
            F.struct(
                _attrs("gen_ai.request.model").alias("model_name"),
                _attrs("gen_ai.response.model").alias("model_name_response"),
                _attrs("gen_ai.request.temperature").alias("model_temperature"),
                _attrs("gen_ai.usage.cache_read_input_tokens").alias("cache_tokens"),
                _attrs("gen_ai.usage.prompt_tokens").alias("input_tokens"),
                _attrs("gen_ai.usage.completion_tokens").alias("output_tokens"),
                _attrs("llm.usage.total_tokens").alias("total_tokens"),
            ),
        ).alias("llm"),
        F.when(is_llm, _numbered_functions()).alias("functions"),
        kept.alias("attrs"),
        F.col("ServiceName").alias("service_name"),
        F.col("ResourceAttributes").alias("resource_attributes"),
        F.col("EventsName").alias("events_name"),
        F.col("EventsAttributes").alias("events_attributes"),
        F.col("StatusCode").alias("status_code"),
    )
    return attach_tool_definitions(out) if with_tool_definitions else out


def input_text() -> Column:
    """The input payload of any typed span as JSON text."""
    return F.coalesce(F.col("input_payload"), F.to_json("prompts"))


def output_text() -> Column:
    """The output payload of any typed span as JSON text."""
    return F.coalesce(F.col("output_payload"), F.to_json("completions"))


def tool_definitions(spans: DataFrame) -> DataFrame:
    """One definition per (session, tool name): the first in session order wins. Of each span
    the definitions 0, 1, ... count, up to the first missing number."""
    listed = spans.filter(F.col("entity_type") == "llm").select(
        "session_id", "timestamp", "ts_raw", "span_id", F.explode(F.filter("functions", lambda f, i: f["idx"] == i)).alias("f")
    )
    first = F.min_by(
        F.struct("f.description", "f.parameters"),
        F.struct("timestamp", F.coalesce("ts_raw", F.lit("")), "span_id", "f.idx"),
    )
    return (
        listed.filter(truthy(F.col("f.name")).isNotNull())
        .groupBy("session_id", F.col("f.name").alias("tool"))
        .agg(first.alias("tool_definition"))
    )


def attach_tool_definitions(spans: DataFrame) -> DataFrame:
    """Give every tool span the definition its session's models were shown."""
    defs = tool_definitions(spans)
    keyed = spans.withColumn(
        "_tool", F.when(F.col("entity_type") == "tool", F.col("entity_name"))
    )
    return (
        keyed.alias("s")
        .join(
            defs.alias("d"),
            F.col("s.session_id").eqNullSafe(F.col("d.session_id")) & (F.col("s._tool") == F.col("d.tool")),
            "left",
        )
        .select("s.*", "d.tool_definition")
        .drop("_tool")
    )


def in_sessions(spans: DataFrame) -> DataFrame:
    """Spans that belong to a session."""
    return spans.filter(F.col("session_id").isNotNull())


def of_types(spans: DataFrame, types: list[str]) -> DataFrame:
    return spans.filter(F.col("entity_type").isin(*types))


def span_validity(spans: DataFrame) -> DataFrame:
    """Mark spans that lack an id or a type, with the reason."""
    return spans.withColumn(
        "invalid_reason",
        F.when(truthy(F.col("span_id")).isNull(), "Missing span_id").when(
            truthy(F.col("entity_type")).isNull(), "Missing entity_type"
        ),
    )
