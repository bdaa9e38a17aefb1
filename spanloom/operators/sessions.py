"""Spans grouped into sessions. Every measure is a map-side-combined aggregate, so a session
of any size costs one small row per task; spans stay in their own long frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.constants import DEFAULT_APP_NAME
from spanloom.functions.values import attr, truthy, utc_bound, whole_number
from spanloom.operators.ordered import OrderedGroups

SESSION_ORDER = ["timestamp", "ts_order", "span_id"]


def with_order(spans: DataFrame) -> DataFrame:
    """Add the tie-breaker that makes session order total."""
    return spans.withColumn("ts_order", F.coalesce("ts_raw", F.lit("")))


def order_struct() -> Column:
    """Session order as one comparable value: unparsable times last."""
    return F.struct(
        F.col("timestamp").isNull().alias("u"),
        F.col("timestamp").alias("t"),
        F.coalesce("ts_raw", F.lit("")).alias("r"),
        F.col("span_id").alias("s"),
    )


def tokens(field: str) -> Column:
    return whole_number(F.col(f"llm.{field}"))


def app_name_candidate() -> Column:
    """The app name a span offers its session, or null."""
    known = lambda c: F.nullif(truthy(c), F.lit("unknown"))
    attrs = F.col("attrs")
    return F.coalesce(
        F.lower(truthy(attr(attrs, "application_id"))),
        known(F.col("service_name")),
        known(attr(F.col("resource_attributes"), "service.name")),
    )


def _is(kind: str) -> Column:
    return F.col("entity_type") == kind


def session_measures() -> dict[str, Column]:
    """Counters, durations and token sums of a session."""
    total = lambda kind, v: F.coalesce(F.sum(F.when(_is(kind), v)), F.lit(0))
    failed = F.col("contains_error")
    return {
        "llm_calls": F.count_if(_is("llm")),
        "llm_fails": F.count_if(_is("llm") & failed),
        "tool_calls": F.count_if(_is("tool")),
        "tool_fails": F.count_if(_is("tool") & failed),
        "tool_duration": total("tool", F.col("duration_ms")).cast("double"),
        "llm_duration": total("llm", F.col("duration_ms")).cast("double"),
        "llm_input_tokens": total("llm", tokens("input_tokens")),
        "llm_output_tokens": total("llm", tokens("output_tokens")),
        "llm_total_tokens": total("llm", tokens("total_tokens")),
    }


def sessions(spans: DataFrame) -> DataFrame:
    """One row per session: time range, duration, size, app name and counters."""
    app = app_name_candidate()
    span_range = (F.max("end_time") - F.min("start_time")) * 1000
    clock_range = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1000.0
    measures = {
        "start_timestamp": F.min("timestamp"),
        "end_timestamp": F.max("timestamp"),
        "first_span_id": F.min_by("span_id", order_struct()),
        "n_spans": F.count("*"),
        "duration_ms": F.coalesce(span_range, clock_range),
        "app_name": F.coalesce(
            F.min_by(app, F.when(app.isNotNull(), order_struct())), F.lit(DEFAULT_APP_NAME)
        ),
        **session_measures(),
    }
    graph = F.min_by(graph_struct(), F.when(_is("graph"), order_struct()))
    return (
        spans.groupBy("session_id")
        .agg(*[c.alias(n) for n, c in measures.items()], graph.alias("_graph"))
        .select("session_id", *measures, "_graph.*")
    )


def entity_names(spans: DataFrame, kind: str) -> DataFrame:
    """Distinct names per session, one row each."""
    return (
        spans.filter(_is(kind) & truthy(F.col("entity_name")).isNotNull())
        .select("session_id", "entity_name")
        .distinct()
    )


def type_counts(spans: DataFrame) -> DataFrame:
    """Spans per session and entity type."""
    return spans.groupBy("session_id", "entity_type").agg(F.count("*").alias("n_spans"))


def session_summary(spans: DataFrame, kinds: list[str]) -> DataFrame:
    """Time range, span count and one count column per entity type."""
    return spans.groupBy("session_id").agg(
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
        F.count("*").alias("n_spans"),
        *[F.count_if(_is(k)).alias(f"n_{k}") for k in kinds],
    )


# --- filters over sessions -----------------------------------------------------------------


def by_criteria(
    spans: DataFrame,
    types: list[str] | None = None,
    has_errors: bool | None = None,
    min_spans: int | None = None,
) -> DataFrame:
    """Ids of the sessions that have any of the types, errors or none, at least n spans."""
    groups = spans.groupBy("session_id").agg(
        F.bool_or(F.col("entity_type").isin(*(types or ["-"]))).alias("_type"),
        F.bool_or("contains_error").alias("_errors"),
        F.count("*").alias("n_spans"),
    )
    kept = groups
    if types is not None:
        kept = kept.filter("_type")
    if has_errors is not None:
        kept = kept.filter(F.col("_errors") == F.lit(has_errors))
    if min_spans is not None:
        kept = kept.filter(F.col("n_spans") >= min_spans)
    return kept.select("session_id", "n_spans")


def by_id(session_frame: DataFrame, session: str) -> DataFrame:
    return session_frame.filter(F.col("session_id") == session)


def by_id_text(session_frame: DataFrame, text: str) -> DataFrame:
    """The first session, in id order, whose id equals or contains the text."""
    hits = session_frame.filter(F.col("session_id").contains(text))
    return hits.orderBy("session_id").limit(1)


def overlapping(session_frame: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions whose time range overlaps the given one; either end may be open."""
    kept = session_frame
    if start is not None:
        kept = kept.filter(F.col("end_timestamp") >= F.lit(utc_bound(start)).cast("timestamp"))
    if end is not None:
        kept = kept.filter(F.col("start_timestamp") <= F.lit(utc_bound(end)).cast("timestamp"))
    return kept


def add_sessions(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def remove_sessions(session_frame: DataFrame, ids: DataFrame) -> DataFrame:
    return session_frame.join(ids.select("session_id"), "session_id", "left_anti")


# --- enrichments -----------------------------------------------------------------------------


def graph_struct() -> Column:
    """Determinism, dynamism and graph as a span states them."""
    a = F.col("attrs")
    return F.struct(
        attr(a, "gen_ai.ioa.graph_determinism_score").try_cast("double").alias("graph_determinism"),
        attr(a, "gen_ai.ioa.graph_dynamism").try_cast("double").alias("graph_dynamism"),
        attr(a, "gen_ai.ioa.graph").alias("graph"),
    )


def graph_attributes(spans: DataFrame) -> DataFrame:
    """Graph attributes of each session's first graph span."""
    picked = F.min_by(graph_struct(), order_struct())
    return spans.filter(_is("graph")).groupBy("session_id").agg(picked.alias("g")).select("session_id", "g.*")


def _in_pattern(spans: DataFrame, kind: str, name: str, largest: int | None) -> DataFrame:
    """Spans of one type with their place in the session and among those of their name."""
    rows = with_order(spans.filter(_is(kind))).withColumn(name, F.col("entity_name"))
    rows = rows.select(
        "session_id", name, *SESSION_ORDER, "start_time", "end_time", "input_payload", "output_payload",
        F.col("contains_error").alias("has_error"), "parent_span_id",
    )
    placed = OrderedGroups(rows, ["session_id"], SESSION_ORDER, largest=largest).positions("position")
    placed = OrderedGroups(placed, ["session_id", name], SESSION_ORDER, largest=largest).positions(f"{name}_position")
    return placed.drop("ts_order")


def workflow_runs(spans: DataFrame, largest: int | None = None) -> DataFrame:
    """One row per workflow execution, with its place (from 0) in the session's pattern and
    among the executions of that workflow. `largest`: spans of the largest session, where known."""
    return _in_pattern(spans, "workflow", "workflow", largest)


def workflow_summary(spans: DataFrame) -> DataFrame:
    return (
        spans.filter(_is("workflow"))
        .groupBy("session_id", F.col("entity_name").alias("workflow"))
        .agg(F.count("*").alias("total_executions"), F.bool_or("contains_error").alias("has_errors"))
    )


def workflow_totals(spans: DataFrame) -> DataFrame:
    """Distinct workflows and executions per session."""
    return (
        workflow_summary(spans)
        .groupBy("session_id")
        .agg(F.count("*").alias("total_workflows"), F.sum("total_executions").alias("total_executions"), F.bool_or("has_errors").alias("has_errors"))
    )


def workflow_query(payload: Column) -> Column:
    """First chat-history message, else the second item of the first message pair."""
    at = lambda p: F.get_json_object(payload, p)
    return F.coalesce(at("$.inputs.chat_history[0].message"), at("$.inputs.messages[0][1]"), F.lit(""))


_MESSAGES = "array<struct<kwargs:struct<content:string>>>"


def _contents(payload: Column) -> Column:
    listed = F.from_json(F.get_json_object(payload, "$.outputs.messages"), _MESSAGES)
    return F.transform(listed, lambda m: m["kwargs"]["content"])


def workflow_response(payload: Column) -> Column:
    """Content of the last message that has any, else the messages as text, else ''."""
    filled = F.filter(_contents(payload), lambda c: truthy(c).isNotNull())
    return F.coalesce(
        F.try_element_at(filled, F.lit(-1)), F.get_json_object(payload, "$.outputs.messages"), F.lit("")
    )


def workflow_responses(payload: Column) -> Column:
    """Every non-empty message content after the first, joined by blank lines."""
    listed = _contents(payload)
    later = F.filter(listed, lambda c, i: (i > 0) & truthy(c).isNotNull())
    return F.coalesce(F.array_join(later, "\n\n"), F.lit(""))


def workflow_exchange(spans: DataFrame) -> DataFrame:
    """Query and response of each session's latest workflow span."""
    last = F.max_by(F.struct("input_payload", "output_payload"), order_struct())
    return (
        spans.filter(_is("workflow"))
        .groupBy("session_id")
        .agg(last.alias("w"))
        .select(
            "session_id",
            workflow_query(F.col("w.input_payload")).alias("query"),
            workflow_response(F.col("w.output_payload")).alias("response"),
            workflow_responses(F.col("w.output_payload")).alias("responses"),
        )
    )


def tool_calls(spans: DataFrame, largest: int | None = None) -> DataFrame:
    """One row per tool call, with its place (from 0) in the session's usage pattern and among
    the calls of that tool."""
    return _in_pattern(spans, "tool", "tool", largest).withColumn("success", ~F.col("has_error"))


def tool_usage(spans: DataFrame) -> DataFrame:
    """Calls and failures per session and tool."""
    return (
        spans.filter(_is("tool"))
        .groupBy("session_id", F.col("entity_name").alias("tool"))
        .agg(F.count("*").alias("total_calls"), F.count_if("contains_error").alias("failed_calls"))
    )


def tool_usage_summary(spans: DataFrame) -> DataFrame:
    """Per session: calls, failures, distinct tools and success rate."""
    return (
        tool_usage(spans)
        .groupBy("session_id")
        .agg(
            F.sum("total_calls").alias("total_tool_calls"),
            F.count("*").alias("unique_tools"),
            F.sum("failed_calls").alias("failed_calls"),
        )
        .withColumn(
            "success_rate",
            (F.col("total_tool_calls") - F.col("failed_calls")) / F.col("total_tool_calls"),
        )
    )
