"""Reads over the raw trace table: listings, look-ups, paging, top lists, call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.constants import TRANSPORT_METRIC_NAMES
from spanloom.functions.values import attr, second_part, truthy, utc_bound, whole_number
from spanloom.operators.ordered import OrderedGroups


# Attributes that listings filter and group on. Stored as columns of their own they reach
# the scan (pushed filters, no map column read); see `promoted`.
PROMOTED = {
    "session.id": "session_attr",
    "execution.id": "execution_attr",
    "gen_ai.prompt.0.role": "first_prompt_role",
    "gen_ai.prompt.0.content": "first_prompt_content",
    "llm.usage.total_tokens": "total_tokens_attr",
}


def promoted(raw: DataFrame) -> DataFrame:
    """Raw spans with the listing attributes as columns: the layout to store."""
    return raw.withColumns({c: attr(F.col("SpanAttributes"), k) for k, c in PROMOTED.items()})


def _stated(raw: DataFrame, key: str) -> Column:
    """An attribute: its promoted column where the table has one, else the map entry."""
    name = PROMOTED[key]
    return F.col(name) if name in raw.columns else attr(F.col("SpanAttributes"), key)


def _session(raw: DataFrame) -> Column:
    return _stated(raw, "session.id")


def _has_session(raw: DataFrame) -> Column:
    session = _session(raw)
    return session.isNotNull() & (session != "")


def _between(c: Column, start: str, end: str) -> Column:
    lower, upper = (F.lit(utc_bound(b)).cast("timestamp") for b in (start, end))
    return (c >= lower) & (c <= upper)


def _span_between(raw: DataFrame, start: str, end: str) -> Column:
    """Spans in a time range; where the table is kept by day, only these days are read."""
    inside = _between(F.col("Timestamp"), start, end)
    if "day" not in raw.columns:
        return inside
    lower, upper = (F.to_date(F.lit(utc_bound(b)).cast("timestamp")) for b in (start, end))
    return inside & F.col("day").between(lower, upper)


def _is_root() -> Column:
    return truthy(F.col("ParentSpanId")).isNull()


# --- look-ups --------------------------------------------------------------------------


def spans_of_session(raw: DataFrame, session_suffix: str) -> DataFrame:
    """Spans whose session id ends with the text (taken literally)."""
    return raw.filter(_session(raw).endswith(session_suffix))


def spans_of_sessions(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """Spans of every requested session (`ids.session_id`); blanks dropped, no limit."""
    wanted = ids.select(truthy(F.trim("session_id")).alias("_id")).filter("_id is not null").distinct()
    return raw.withColumn("_s", _session(raw)).join(wanted, F.col("_s") == F.col("_id"), "left_semi").drop("_s")


def one_span(raw: DataFrame, session_suffix: str, span_id: str) -> DataFrame:
    found = raw.filter((F.col("SpanId") == span_id) & _session(raw).endswith(session_suffix))
    return found.orderBy("Timestamp", "SpanId").limit(1)


def trace_sample(raw: DataFrame, n: int = 10) -> DataFrame:
    return raw.limit(n)


def span_listing(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Session id and time of every span in the range, newest first."""
    return (
        raw.filter(_has_session(raw) & _span_between(raw, start, end))
        .select(_session(raw).alias("session_id"), "Timestamp")
        .orderBy(F.desc("Timestamp"), "session_id")
    )


def spans_of_trace(raw: DataFrame, trace_id: str) -> DataFrame:
    return raw.filter(F.col("TraceId") == trace_id).orderBy(F.desc("Timestamp"), "SpanId")


def transport_metrics(raw: DataFrame, execution: str, names: list[str] | None = None) -> DataFrame:
    """Transport-metric spans of the services whose name contains the id, oldest first."""
    return (
        raw.filter(F.col("ServiceName").contains(execution) & F.col("SpanName").isin(*(names or TRANSPORT_METRIC_NAMES)))
        .select(F.col("SpanName").alias("metric_name"), F.col("SpanAttributes").alias("attributes"), "Timestamp")
        .orderBy("Timestamp", "metric_name")
    )


# --- requested ids -----------------------------------------------------------------------


def match_requested(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Give each session id the first requested id (`ids`: request_no, session_id) that equals
    it or is its suffix, else itself.

    A requested id of 2 ** k to 2 ** (k + 1) - 1 characters is joined by its last 2 ** k, and a session id
    asks once for each k it is long enough for; what joins is then compared whole. So a session
    meets the requests that share at least half of their own length with it, in a handful
    of rows, whatever lengths there are."""
    digits = lambda c: F.length(F.bin(F.length(c))) - 1
    tail = lambda c, k: F.right(F.col(c), F.pow(F.lit(2), k).cast("int"))
    wanted = ids.select("request_no", F.trim("session_id").alias("requested")).filter("requested <> ''")
    wanted = wanted.withColumn("k", digits(F.col("requested"))).withColumn("tail", tail("requested", F.col("k")))
    found = sessions.select("session_id").distinct()
    asking = found.filter("session_id <> ''").select("session_id", F.explode(F.sequence(F.lit(0), digits(F.col("session_id")))).alias("k"))
    hits = asking.withColumn("tail", tail("session_id", F.col("k"))).join(wanted, ["k", "tail"]).filter(F.endswith("session_id", "requested"))
    first = hits.groupBy("session_id").agg(F.min_by("requested", "request_no").alias("first_id"))
    return found.join(first, "session_id", "left").select("session_id", F.coalesce("first_id", "session_id").alias("matched_id"))


def requested_but_missing(ids: DataFrame, matched: DataFrame) -> DataFrame:
    """Requested ids that no session was matched to."""
    wanted = ids.select(F.trim("session_id").alias("matched_id")).filter("matched_id <> ''").distinct()
    return wanted.join(matched.select("matched_id"), "matched_id", "left_anti")


# --- session listings ----------------------------------------------------------------------


def sessions_started(raw: DataFrame, start: str, end: str, prompts: bool = False) -> DataFrame:
    """Sessions whose first span lies in the range, newest first. The range is tested after
    the grouping: a session may have begun earlier."""
    kept = raw.filter(_has_session(raw))
    first = F.min("Timestamp").alias("start_timestamp")
    aggregates = [first]
    if prompts:
        kept = kept.filter(_stated(raw, "gen_ai.prompt.0.role") == "user")
        aggregates.append(_first_prompt(raw))
    return (
        kept.groupBy(_session(raw).alias("session_id"))
        .agg(*aggregates)
        .filter(_between(F.col("start_timestamp"), start, end))
        .orderBy(F.desc("start_timestamp"), "session_id")
    )


def _first_prompt(raw: DataFrame) -> Column:
    prompt = F.coalesce(_stated(raw, "gen_ai.prompt.0.content"), F.lit(""))
    return F.min_by(prompt, F.struct("Timestamp", "SpanId")).alias("prompt")


def session_pages(
    raw: DataFrame, start: str, end: str, name_prefix: str | None = None, prompts: bool = False
) -> DataFrame:
    """Sessions by id part with the row-level time filter, newest first: the frame that
    `page` cuts and whose count is the total."""
    kept = raw.filter(_has_session(raw) & _span_between(raw, start, end))
    if prompts:
        kept = kept.filter(_stated(raw, "gen_ai.prompt.0.role") == "user")
    if name_prefix:
        kept = kept.filter(_session(raw).startswith(name_prefix))
    aggregates = [F.min("Timestamp").alias("start_timestamp")] + ([_first_prompt(raw)] if prompts else [])
    return (
        kept.groupBy(second_part(_session(raw)).alias("session_id"))
        .agg(*aggregates)
        .orderBy(F.desc("start_timestamp"), "session_id")
    )


def page(ordered: DataFrame, page_no: int, size: int) -> DataFrame:
    return ordered.offset(page_no * size).limit(size)


def page_after(ordered: DataFrame, last_start: str, last_id: str, size: int) -> DataFrame:
    """The page after a known row: no skipped rows to sort, for deep paging."""
    last = F.lit(last_start).cast("timestamp")
    beyond = (F.col("start_timestamp") < last) | (
        (F.col("start_timestamp") == last) & (F.col("session_id") > last_id)
    )
    return ordered.filter(beyond).limit(size)


def traces_of_session(raw: DataFrame, id_part: str | None = None) -> DataFrame:
    """Distinct traces per session part, newest first."""
    kept = raw.filter(_has_session(raw))
    if id_part is not None:
        kept = kept.filter(second_part(_session(raw)) == id_part)
    return (
        kept.groupBy(second_part(_session(raw)).alias("session_id"), F.col("TraceId").alias("trace_id"))
        .agg(F.max("Timestamp").alias("last_timestamp"))
        .orderBy(F.desc("last_timestamp"), "trace_id")
    )


def select_sessions(
    raw: DataFrame,
    start: str | None = None,
    end: str | None = None,
    count: int | None = None,
    name_prefix: str | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Sessions by time range and/or count and/or name prefix, or by explicit ids (not both).
    Without bounds the last seven days are taken."""
    ranged = any(v is not None for v in (start, end, count, name_prefix))
    if ranged and ids is not None:
        raise ValueError("choose sessions by range or by ids, not both")
    if (start is None) != (end is None):
        raise ValueError("a time range needs both bounds")
    firsts = (
        raw.filter(_has_session(raw))
        .groupBy(_session(raw).alias("session_id"))
        .agg(F.min("Timestamp").alias("start_timestamp"))
    )
    if ids is not None:
        return firsts.join(ids.select(F.trim("session_id").alias("session_id")).distinct(), "session_id", "left_semi")
    if start is not None and end is not None:
        picked = firsts.filter(_between(F.col("start_timestamp"), start, end))
    else:
        picked = firsts.filter(F.col("start_timestamp") >= F.current_timestamp() - F.expr("interval 7 days"))
    if name_prefix:
        picked = picked.filter(F.col("session_id").startswith(name_prefix))
    newest = picked.orderBy(F.desc("start_timestamp"), "session_id")
    return newest if count is None else newest.limit(count)


def population(raw: DataFrame, selected: DataFrame, requested: DataFrame | None = None):
    """(spans of the selected sessions, requested ids that have none)."""
    chosen = raw.withColumn("session_id", _session(raw)).join(
        selected.select("session_id"), "session_id", "left_semi"
    )
    if requested is None:
        return chosen, selected.select("session_id").limit(0)
    return chosen, requested_but_missing(requested, match_requested(selected, requested))


# --- statistics --------------------------------------------------------------------------


def frequent_root_names(raw: DataFrame, n: int = 10) -> DataFrame:
    return (
        raw.filter(_is_root())
        .groupBy(F.col("SpanName").alias("span_name"))
        .agg(F.count("*").alias("usage_count"))
        .orderBy(F.desc("usage_count"), "span_name")
        .limit(n)
    )


def tokens_per_service(raw: DataFrame) -> DataFrame:
    """Total tokens per service; text that is no whole number counts 0."""
    tokens = _stated(raw, "llm.usage.total_tokens")
    return (
        raw.filter(tokens.isNotNull() & (tokens != ""))
        .groupBy(F.col("ServiceName").alias("service_name"))
        .agg(F.sum(F.coalesce(whole_number(tokens), F.lit(0))).alias("total_tokens"))
        .orderBy(F.desc("total_tokens"), "service_name")
    )


def latency_per_service(points: DataFrame) -> DataFrame:
    """Request count and latency in seconds per service, slowest average first."""
    return (
        points.groupBy(attr(F.col("ResourceAttributes"), "service.name").alias("service_name"))
        .agg(
            F.count("*").alias("total_requests"),
            (F.sum("Sum") / 1000).alias("total_latency"),
            (F.avg("Sum") / 1000).alias("avg_latency"),
            (F.max("Max") / 1000).alias("max_latency"),
            (F.min("Min") / 1000).alias("min_latency"),
        )
        .orderBy(F.desc("avg_latency"), "service_name")
    )


def call_graph(raw: DataFrame, execution: str | None = None) -> DataFrame:
    """Root spans with the root before and after them, per execution; START and END at the
    ends. With a text, only services whose name contains it."""
    roots = raw.filter(_is_root())
    if execution is not None:
        roots = roots.filter(F.col("ServiceName").contains(execution))
    steps = roots.select(
        F.coalesce(_stated(raw, "execution.id"), F.lit("")).alias("execution_id"),
        F.col("ServiceName").alias("service_name"),
        "Timestamp",
        F.col("SpanId").alias("span_id"),
        F.col("SpanName").alias("current_span"),
    )
    linked = OrderedGroups(steps, ["service_name", "execution_id"], ["Timestamp", "span_id"]).neighbours(
        {"previous_span": "current_span"}, {"next_span": "current_span"}
    )
    return linked.withColumns(
        {
            "previous_span": F.coalesce("previous_span", F.lit("START")),
            "next_span": F.coalesce("next_span", F.lit("END")),
        }
    )
