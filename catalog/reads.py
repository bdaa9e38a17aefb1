"""Sources, look-ups, listings and store statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import histogram, micros, query, r6, raw
from catalog.base_sql import uuid_sql, with_base
from spanloom.functions.values import attr, utc_time
from spanloom.operators import reads
from spanloom.operators.parse import session_id
from spanloom.sources import derived, traces

_START, _END = "2024-01-03T00:00:00Z", "2024-01-20T00:00:00Z"
_S = "epoch_us(TIMESTAMP '2024-01-03 00:00:00')"
_E = "epoch_us(TIMESTAMP '2024-01-20 00:00:00')"


def _attr(key):
    return attr(F.col("SpanAttributes"), key)


@query(
    "S01_trace_scan",
    with_base("SELECT span AS span_id, tid AS trace_id, parent AS parent_id, ts AS ts_us, span_name, svc AS service, status, dur AS duration_ns FROM raw"),
)
def _(spark, d):
    return raw(spark, d).select(
        F.col("SpanId").alias("span_id"),
        F.col("TraceId").alias("trace_id"),
        F.nullif(F.col("ParentSpanId"), F.lit("")).alias("parent_id"),
        micros("Timestamp").alias("ts_us"),
        F.col("SpanName").alias("span_name"),
        F.col("ServiceName").alias("service"),
        F.col("StatusCode").alias("status"),
        F.col("Duration").alias("duration_ns"),
    )


@query(
    "S03_keyed_by_session",
    with_base(
        f"""SELECT span AS span_id, coalesce(CASE WHEN src = 'c' THEN substr(sid, 6) ELSE split_part(sid, '_', 2) END, 'file_session_default') AS session_key,
        sid AS full_session_id, round(ts / 1e6, 6) AS start_epoch, round(dur * 1e-6, 6) AS duration_ms,
        CASE WHEN status IN ('Error','STATUS_CODE_ERROR') THEN 2 ELSE 0 END AS status_number FROM raw"""
    ),
)
def _(spark, d):
    return traces.keyed_by_session(raw(spark, d)).select(
        F.col("SpanId").alias("span_id"),
        "session_key",
        "full_session_id",
        r6("start_epoch"),
        r6(F.col("duration_raw_ms")).alias("duration_ms"),
        "status_number",
    )


@query(
    "S04_one_session_per_row",
    "SELECT doc_id, CASE WHEN source = 'src0' THEN 'src0' ELSE 'file_session_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS population_session FROM documents",
)
def _(spark, d):
    docs = derived.table(spark, d, "documents", "doc_id bigint, source string")
    rows = docs.withColumn("session_id", F.when(F.col("source") == "src0", F.col("source")))
    return traces.one_session_per_row(rows, ["doc_id"]).select("doc_id", "population_session")


_REQUESTED = f"""req AS (SELECT cast(s AS bigint) AS request_no, CASE WHEN s % 7 = 3 THEN 'nowhere' || s ELSE {uuid_sql('s')} END AS id
  FROM (SELECT DISTINCT s FROM ev))"""


def _requested(spark, d):
    """Requested ids: the uuid part of sessions, some of which do not exist."""
    e = derived.table(spark, d, "events", "event_id bigint")
    s = F.floor(F.col("event_id") / 16).cast("bigint")
    ids = e.select(s.alias("request_no")).distinct()
    return ids.select(
        "request_no",
        F.when(F.col("request_no") % 7 == 3, F.concat(F.lit("nowhere"), F.col("request_no").cast("string")))
        .otherwise(derived._uuid(F.col("request_no")))
        .alias("session_id"),
    )


_MATCHED = """hit AS (SELECT sid_attr AS sid, coalesce((SELECT arg_min(r.id, r.request_no) FROM req r WHERE ends_with(x.sid_attr, r.id)), sid_attr) AS mid
  FROM (SELECT DISTINCT sid_attr FROM raw WHERE sid_attr IS NOT NULL) x)"""


@query(
    "S05_population_from_store",
    with_base(
        "SELECT sid_attr AS session_id, count(*) AS n_spans FROM raw WHERE sid_attr IN (SELECT sid FROM hit WHERE mid IN (SELECT id FROM req)) GROUP BY 1",
        _REQUESTED,
        _MATCHED,
    ),
)
def _(spark, d):
    t, ids = raw(spark, d), _requested(spark, d)
    sessions = t.select(_attr("session.id").alias("session_id")).filter("session_id is not null").distinct()
    matched = reads.match_requested(sessions, ids)
    chosen = matched.join(ids.select(F.col("session_id").alias("matched_id")), "matched_id", "left_semi")
    spans, _missing = reads.population(t, chosen)
    return spans.groupBy("session_id").agg(F.count("*").alias("n_spans"))


@query(
    "J04_requested_to_session_ids",
    with_base("SELECT sid AS session_id, mid AS matched_id FROM hit", _REQUESTED, _MATCHED),
)
def _(spark, d):
    t = raw(spark, d)
    sessions = t.select(_attr("session.id").alias("session_id")).filter("session_id is not null").distinct()
    return reads.match_requested(sessions, _requested(spark, d))


@query(
    "J05_requested_but_missing",
    with_base("SELECT id AS matched_id FROM req WHERE id NOT IN (SELECT mid FROM hit)", _REQUESTED, _MATCHED),
)
def _(spark, d):
    t, ids = raw(spark, d), _requested(spark, d)
    sessions = t.select(_attr("session.id").alias("session_id")).filter("session_id is not null").distinct()
    return reads.requested_but_missing(ids, reads.match_requested(sessions, ids))


@query(
    "S06_histogram_scan",
    "SELECT 'app' || ((event_id // 16) % 5) AS service, round(value, 6) AS total FROM events WHERE event_type <> 'view'",
)
def _(spark, d):
    points = histogram(spark, d, "response_latency")
    return points.select(attr(F.col("ResourceAttributes"), "service.name").alias("service"), r6(F.col("Sum")).alias("total"))




@query("F01_spans_of_session_suffix", with_base(f"SELECT span AS span_id FROM raw WHERE ends_with(sid_attr, {uuid_sql('4')})"))
def _(spark, d):
    import hashlib

    h = hashlib.md5(b"4").hexdigest()
    suffix = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    return reads.spans_of_session(raw(spark, d), suffix).select(F.col("SpanId").alias("span_id"))


@query(
    "F02_spans_of_sessions",
    with_base(
        "SELECT span AS span_id, sid_attr AS session_id FROM raw WHERE sid_attr IN (SELECT 'app' || (request_no % 5) || '_' || id FROM req)",
        _REQUESTED,
    ),
)
def _(spark, d):
    ids = _requested(spark, d).select(
        F.concat(F.lit(" app"), (F.col("request_no") % 5).cast("string"), F.lit("_"), F.col("session_id"), F.lit(" ")).alias("session_id")
    )
    found = reads.spans_of_sessions(raw(spark, d), ids)
    return found.select(F.col("SpanId").alias("span_id"), _attr("session.id").alias("session_id"))


@query("F03_one_span", with_base(f"SELECT span AS span_id, span_name FROM raw WHERE span = 'sp65' AND ends_with(sid_attr, {uuid_sql('4')}) LIMIT 1"))
def _(spark, d):
    import hashlib

    tail = hashlib.md5(b"4").hexdigest()[20:]
    return reads.one_span(raw(spark, d), tail, "sp65").select(F.col("SpanId").alias("span_id"), F.col("SpanName").alias("span_name"))


@query("F04_trace_sample", with_base("SELECT count(*) AS n FROM (SELECT * FROM raw LIMIT 10)"))
def _(spark, d):
    return reads.trace_sample(raw(spark, d)).agg(F.count("*").alias("n"))


@query(
    "F05_span_listing",
    with_base(f"SELECT sid_attr AS session_id, ts AS ts_us FROM raw WHERE sid_attr IS NOT NULL AND ts BETWEEN {_S} AND {_E}"),
)
def _(spark, d):
    return reads.span_listing(raw(spark, d), _START, _END).select("session_id", micros("Timestamp").alias("ts_us"))


@query("F06_spans_of_trace", with_base("SELECT span AS span_id, ts AS ts_us FROM raw WHERE tid = 'tr9'"))
def _(spark, d):
    return reads.spans_of_trace(raw(spark, d), "tr9").select(F.col("SpanId").alias("span_id"), micros("Timestamp").alias("ts_us"))


_NAMES = ["http.request_0", "openai.chat", "onboard.graph"]


@query(
    "F09_transport_metrics",
    with_base("SELECT span_name AS metric_name, ts AS ts_us FROM raw WHERE svc LIKE '%app%' AND span_name IN ('http.request_0','openai.chat','onboard.graph')"),
)
def _(spark, d):
    return reads.transport_metrics(raw(spark, d), "app", _NAMES).select("metric_name", micros("Timestamp").alias("ts_us"))


@query(
    "F10_time_bounds",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS bound_us FROM events""",
)
def _(spark, d):
    e = derived.table(spark, d, "events", "event_id bigint, ts timestamp")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stated = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("+02:00"))).otherwise(F.concat(text, F.lit("Z")))
    return e.select("event_id", F.unix_micros(utc_time(stated)).alias("bound_us"))


_FIRST = f"""SELECT sid_attr AS session_id, min(ts) AS start_us{{extra}} FROM raw {{where}} GROUP BY 1 HAVING min(ts) BETWEEN {_S} AND {_E}"""


@query("A01_sessions_started", with_base(_FIRST.format(extra="", where="WHERE sid_attr IS NOT NULL")))
def _(spark, d):
    return reads.sessions_started(raw(spark, d), _START, _END).select("session_id", micros("start_timestamp").alias("start_us"))


# First prompt of a span whose prompt 0 is the user's: only conversation calls have one.
_P0 = """p0 AS (SELECT sid, span, ts, r, t FROM cp WHERE n = 0)"""
_FEB = ("2024-02-01T00:00:00Z", "2024-02-01T01:00:00Z")
_FS, _FE = "epoch_us(TIMESTAMP '2024-02-01 00:00:00')", "epoch_us(TIMESTAMP '2024-02-01 01:00:00')"


@query(
    "A02_sessions_started_with_prompt",
    with_base(
        f"SELECT sid AS session_id, min(ts) AS start_us, arg_min(t, ts) AS prompt FROM p0 WHERE r = 'user' GROUP BY 1 HAVING min(ts) BETWEEN {_FS} AND {_FE}",
        _P0,
    ),
)
def _(spark, d):
    return reads.sessions_started(raw(spark, d), *_FEB, prompts=True).select(
        "session_id", micros("start_timestamp").alias("start_us"), "prompt"
    )


@query(
    "A03_session_page",
    with_base(
        f"""SELECT split_part(sid_attr, '_', 2) AS session_id, min(ts) AS start_us FROM raw
        WHERE sid_attr LIKE 'app%' AND ts BETWEEN {_S} AND {_E} GROUP BY 1 ORDER BY start_us DESC, session_id OFFSET 20 LIMIT 20"""
    ),
)
def _(spark, d):
    pages = reads.session_pages(raw(spark, d), _START, _END, "app")
    return reads.page(pages, 1, 20).select("session_id", micros("start_timestamp").alias("start_us"))


@query(
    "A03_session_page_total",
    with_base(f"SELECT count(DISTINCT split_part(sid_attr, '_', 2)) AS total FROM raw WHERE sid_attr LIKE 'app%' AND ts BETWEEN {_S} AND {_E}"),
)
def _(spark, d):
    return reads.session_pages(raw(spark, d), _START, _END, "app").agg(F.count("*").alias("total"))


@query(
    "A04_session_page_with_prompt",
    with_base(
        f"""SELECT split_part(sid, '_', 2) AS session_id, min(ts) AS start_us, arg_min(t, ts) AS prompt FROM p0
        WHERE r = 'user' AND ts BETWEEN {_FS} AND {_FE} GROUP BY 1 ORDER BY start_us DESC, session_id LIMIT 10""",
        _P0,
    ),
)
def _(spark, d):
    pages = reads.session_pages(raw(spark, d), *_FEB, "chat_", prompts=True)
    return reads.page(pages, 0, 10).select("session_id", micros("start_timestamp").alias("start_us"), "prompt")


@query(
    "O02_keyset_page",
    with_base(
        f"""SELECT split_part(sid_attr, '_', 2) AS session_id, min(ts) AS start_us FROM raw
        WHERE sid_attr LIKE 'app%' AND ts BETWEEN {_S} AND {_E} GROUP BY 1
        HAVING min(ts) < epoch_us(TIMESTAMP '2024-01-10 00:00:00') ORDER BY start_us DESC, session_id LIMIT 25"""
    ),
)
def _(spark, d):
    pages = reads.session_pages(raw(spark, d), _START, _END, "app")
    return reads.page_after(pages, "2024-01-10 00:00:00", "~", 25).select("session_id", micros("start_timestamp").alias("start_us"))


@query(
    "A05_traces_of_sessions",
    with_base("SELECT split_part(sid_attr, '_', 2) AS session_id, tid AS trace_id, max(ts) AS last_us FROM raw WHERE sid_attr IS NOT NULL GROUP BY 1, 2"),
)
def _(spark, d):
    return reads.traces_of_session(raw(spark, d)).select("session_id", "trace_id", micros("last_timestamp").alias("last_us"))


@query(
    "A06_frequent_root_names",
    with_base("SELECT span_name, count(*) AS usage_count FROM raw WHERE parent IS NULL GROUP BY 1 ORDER BY usage_count DESC, span_name LIMIT 10"),
)
def _(spark, d):
    return reads.frequent_root_names(raw(spark, d))


@query(
    "A07_tokens_per_service",
    with_base("SELECT svc AS service_name, cast(sum(coalesce(try_cast(tot_tok AS bigint), 0)) AS bigint) AS total_tokens FROM raw WHERE tot_tok IS NOT NULL GROUP BY 1"),
)
def _(spark, d):
    return reads.tokens_per_service(raw(spark, d))


@query(
    "A08_latency_per_service",
    """SELECT 'app' || ((event_id // 16) % 5) AS service_name, count(*) AS total_requests, round(sum(value) / 1000, 6) AS total_latency,
    round(avg(value) / 1000, 6) AS avg_latency, round(max(value * 2) / 1000, 6) AS max_latency, round(min(value / 2) / 1000, 6) AS min_latency
    FROM events WHERE event_type <> 'view' GROUP BY 1""",
)
def _(spark, d):
    points = histogram(spark, d, "response_latency")
    out = reads.latency_per_service(points)
    return out.select("service_name", "total_requests", *[r6(c) for c in ("total_latency", "avg_latency", "max_latency", "min_latency")])


@query(
    "W01_call_graph",
    with_base(
        """SELECT span AS span_id, coalesce(lag(span_name) OVER w, 'START') AS previous_span, span_name AS current_span,
        coalesce(lead(span_name) OVER w, 'END') AS next_span FROM raw WHERE parent IS NULL
        WINDOW w AS (PARTITION BY svc, coalesce(exec_attr, '') ORDER BY ts, span)"""
    ),
)
def _(spark, d):
    return reads.call_graph(raw(spark, d)).select("span_id", "previous_span", "current_span", "next_span")


@query(
    "F22_session_selection",
    with_base(
        f"""SELECT sid_attr AS session_id, min(ts) AS start_us FROM raw WHERE sid_attr IS NOT NULL GROUP BY 1
        HAVING min(ts) BETWEEN {_S} AND {_E} AND sid_attr LIKE 'app1%' ORDER BY start_us DESC, session_id LIMIT 50"""
    ),
)
def _(spark, d):
    picked = reads.select_sessions(raw(spark, d), _START, _END, 50, "app1")
    return picked.select("session_id", micros("start_timestamp").alias("start_us"))


@query("F22_session_selection_by_ids", with_base(
    "SELECT sid_attr AS session_id, min(ts) AS start_us FROM raw WHERE sid_attr IN (SELECT 'app' || (request_no % 5) || '_' || id FROM req) GROUP BY 1", _REQUESTED))
def _(spark, d):
    ids = _requested(spark, d).select(
        F.concat(F.lit("app"), (F.col("request_no") % 5).cast("string"), F.lit("_"), F.col("session_id")).alias("session_id")
    )
    return reads.select_sessions(raw(spark, d), ids=ids).select("session_id", micros("start_timestamp").alias("start_us"))


@query(
    "P14_session_id_and_F12_in_session",
    with_base("SELECT span AS span_id, sid AS session_id FROM raw WHERE sid IS NOT NULL"),
)
def _(spark, d):
    return raw(spark, d).select(F.col("SpanId").alias("span_id"), session_id().alias("session_id")).filter("session_id is not null")
