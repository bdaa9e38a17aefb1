"""The span parser, column by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, r6, raw, typed
from catalog.base_sql import with_base
from spanloom.functions import filters, values
from spanloom.operators import parse
from spanloom.sources import derived, traces


def _parsed(spark, d):
    return parse.parse_spans(raw(spark, d))


@query("P01_entity_type_and_F11", with_base("SELECT span AS span_id, etype AS entity_type FROM typ"))
def _(spark, d):
    return _parsed(spark, d).select("span_id", "entity_type")


@query("P02_span_app_name", with_base("SELECT span AS span_id, app AS app_name FROM typ"))
def _(spark, d):
    return _parsed(spark, d).select("span_id", "app_name")


@query(
    "P03_lenient_json",
    with_base("SELECT span AS span_id, coalesce(json_valid(tool_out), false) AS parsed FROM evt WHERE etype = 'tool'"),
)
def _(spark, d):
    tools = raw(spark, d).filter(parse.entity_type() == "tool")
    out = values.attr(F.col("SpanAttributes"), "traceloop.entity.output")
    return tools.select(F.col("SpanId").alias("span_id"), values.lenient_json(out).isNotNull().alias("parsed"))


@query("P04_entity_name", with_base("SELECT span AS span_id, name AS entity_name FROM typ"))
def _(spark, d):
    return _parsed(spark, d).select("span_id", "entity_name")


@query(
    "P05_model_payloads",
    with_base(
        """SELECT span AS span_id, 'Please calculate item ' || k AS prompt, completion, CASE WHEN k % 3 > 0 THEN 'assistant' END AS role, 4 AS n_prompt_keys
        FROM evt WHERE etype = 'llm'
        UNION ALL SELECT span, CASE WHEN held >= 2 THEN second_text END, text0, 'assistant', held * 2 FROM ch"""
    ),
)
def _(spark, d):
    calls = _parsed(spark, d).filter("entity_type = 'llm'")
    at = lambda m, k: values.attr(F.col(m), k)
    return calls.select(
        "span_id",
        at("prompts", "gen_ai.prompt.1.content").alias("prompt"),
        at("completions", "gen_ai.completion.0.content").alias("completion"),
        at("completions", "gen_ai.completion.0.role").alias("role"),
        F.size("prompts").cast("bigint").alias("n_prompt_keys"),
    )


@query(
    "P06_model_attributes",
    with_base(
        """SELECT span AS span_id, CASE WHEN src = 'e' THEN 'model-a' END AS model_name, nullif(name, 'unknown') AS model_name_response,
        CASE WHEN src = 'e' THEN '0.5' END AS temperature, in_tok AS input_tokens, out_tok AS output_tokens, tot_tok AS total_tokens FROM typ WHERE etype = 'llm'"""
    ),
)
def _(spark, d):
    calls = _parsed(spark, d).filter("entity_type = 'llm'")
    return calls.select(
        "span_id", "llm.model_name", "llm.model_name_response", F.col("llm.model_temperature").alias("temperature"),
        "llm.input_tokens", "llm.output_tokens", "llm.total_tokens",
    )


_OUT = """CASE WHEN tool_out IS NULL THEN NULL WHEN NOT json_valid(tool_out) THEN '{"value":"' || tool_out || '"}'
  WHEN tool_out LIKE '{%' THEN tool_out ELSE '{"value":' || tool_out || '}' END"""


@query("P07_payloads", with_base(f"SELECT span AS span_id, tool_in AS input_payload, {_OUT} AS output_payload FROM evt WHERE etype = 'tool'"))
def _(spark, d):
    return _parsed(spark, d).filter("entity_type = 'tool'").select("span_id", "input_payload", "output_payload")


@query(
    "P08_workflow_and_agent_payloads",
    with_base(
        """SELECT span AS span_id, CASE WHEN kind = 'autoagent' THEN NULL WHEN kind = 'agent' THEN '{"value":"Plan step ' || k || '"}'
          WHEN k % 2 = 0 THEN '{"inputs": {"chat_history": [{"message": "Query ' || k || '"}]}}' ELSE '{"inputs": {"messages": [["user", "Ask ' || k || '"]]}}' END AS input_payload,
          CASE WHEN kind = 'autoagent' THEN NULL WHEN kind = 'agent' THEN CASE WHEN k % 2 = 0 THEN '{"value": "Agent reply ' || k || ' done"}' ELSE '{"answer": ' || k || '}' END
          WHEN k % 4 = 3 THEN '{"value":"flow text ' || k || '"}'
          ELSE '{"outputs": {"messages": [{"kwargs": {"content": "first"}}, {"kwargs": {"content": "Answer ' || k || '"}}, {"kwargs": {"content": "End ' || k || '"}}]}}' END AS output_payload
        FROM evt WHERE etype IN ('agent','workflow')"""
    ),
)
def _(spark, d):
    kept = _parsed(spark, d).filter("entity_type in ('workflow', 'agent')")
    return kept.select("span_id", "input_payload", "output_payload")


@query(
    "P09_P10_timing",
    with_base("SELECT span AS span_id, round(start_s, 6) AS start_time, round(end_s, 6) AS end_time, round(dur_ms, 6) AS duration_ms FROM typ"),
)
def _(spark, d):
    return _parsed(spark, d).select("span_id", r6("start_time"), r6("end_time"), r6("duration_ms"))


@query("P11_error_flag", with_base("SELECT span AS span_id, err AS contains_error FROM typ"))
def _(spark, d):
    return _parsed(spark, d).select("span_id", "contains_error")


@query(
    "P12_error_words_in_values",
    """SELECT doc_id, regexp_matches(lower(text), 'traceback|exception|httperror') OR doc_id % 9 = 4 AS found FROM documents""",
)
def _(spark, d):
    docs = derived.table(spark, d, "documents", "doc_id bigint, text string")
    body = F.to_json(
        F.struct(
            F.col("text").alias("exception"),
            F.array(F.struct(F.when(F.col("doc_id") % 9 == 4, "HTTPError 500").otherwise("fine").alias("traceback"))).alias("deep"),
        )
    )
    return docs.select("doc_id", values.json_has_error_words(body).alias("found"))


@query(
    "P13_exception_details",
    with_base("SELECT span AS span_id, 'boom ' || k AS error_name, 'at step ' || k AS error_trace FROM evt WHERE etype IS NOT NULL AND et = 'error'"),
)
def _(spark, d):
    failed = _parsed(spark, d).filter("error_data is not null")
    return failed.select("span_id", "error_data.error_name", "error_data.error_trace")


_DEFS = """defs AS (
  SELECT sid, 'tool_' || (k % 4) AS tool, ts, span, 0 AS idx, 'desc ' || k AS description, '{"type": "object", "n": ' || k || '}' AS parameters FROM evt WHERE kind = 'llm' AND sid IS NOT NULL
  UNION ALL SELECT sid, 'tool_3', ts, span, 1, NULL, NULL FROM evt WHERE kind = 'llm' AND sid IS NOT NULL AND k % 3 = 0),
first AS (SELECT sid, tool, description, parameters FROM (SELECT *, row_number() OVER (PARTITION BY sid, tool ORDER BY ts, span, idx) AS rn FROM defs) WHERE rn = 1)"""


@query(
    "P15_W07_tool_definitions",
    with_base("SELECT sid AS session_id, tool, description, parameters FROM first", _DEFS),
)
def _(spark, d):
    defs = parse.tool_definitions(typed(spark, d))
    return defs.select("session_id", "tool", "tool_definition.description", "tool_definition.parameters")


@query(
    "J03_tools_with_definitions",
    with_base(
        "SELECT span AS span_id, description, parameters FROM sp LEFT JOIN first ON first.sid = sp.sid AND tool = name AND etype = 'tool'", _DEFS
    ),
)
def _(spark, d):
    out = parse.attach_tool_definitions(typed(spark, d))
    return out.select("span_id", "tool_definition.description", "tool_definition.parameters")


@query(
    "P16_P17_P18_P19_raw_measures",
    with_base(
        """SELECT span AS span_id, round(ts / 1e6, 6) AS start_epoch, round(dur * 1e-6, 6) AS duration_ms,
        CASE WHEN status IN ('Error', 'STATUS_CODE_ERROR') THEN 2 ELSE 0 END AS status_number,
        CASE WHEN k % 3 = 0 THEN '' ELSE upper(CASE kind WHEN 'autoflow' THEN 'workflow' WHEN 'autoagent' THEN 'agent' ELSE kind END) END AS framework_kind
        FROM evr UNION ALL SELECT span, round(ts / 1e6, 6), round(dur * 1e-6, 6), 0, '' FROM ch"""
    ),
)
def _(spark, d):
    out = traces.keyed_by_session(raw(spark, d))
    return out.select(
        F.col("SpanId").alias("span_id"), r6("start_epoch"), r6(F.col("duration_raw_ms")).alias("duration_ms"),
        "status_number", "framework_kind",
    )


@query(
    "P20_P21_P22_session_id_parts",
    with_base(
        f"""SELECT DISTINCT sid AS session_id, split_part(sid, '_', 2) AS uuid_part, split_part(sid, '_', 2) AS last_part,
        split_part(sid, '_', 1) AS app_part, split_part(sid, '_', 2) AS second_part FROM raw WHERE sid IS NOT NULL"""
    ),
)
def _(spark, d):
    ids = typed(spark, d).select("session_id").distinct()
    last, app = values.split_session_id(F.col("session_id"))
    return ids.select(
        "session_id", values.uuid_part(F.col("session_id")).alias("uuid_part"), last.alias("last_part"),
        app.alias("app_part"), values.second_part(F.col("session_id")).alias("second_part"),
    )


@query(
    "P20_P21_on_sources",
    "SELECT DISTINCT source || '_' || lang AS id, source || '_' || lang AS uuid_part, lang AS last_part, source AS app_part, lang AS second_part FROM documents "
    "UNION SELECT DISTINCT source, source, source, 'unknown-app', '' FROM documents",
)
def _(spark, d):
    docs = derived.table(spark, d, "documents", "lang string, source string")
    ids = docs.select(F.explode(F.array(F.concat_ws("_", "source", "lang"), F.col("source"))).alias("id")).distinct()
    last, app = values.split_session_id(F.col("id"))
    return ids.select(
        "id", values.uuid_part(F.col("id")).alias("uuid_part"), last.alias("last_part"), app.alias("app_part"),
        values.second_part(F.col("id")).alias("second_part"),
    )


_STATUS = """CASE WHEN tool_out IS NULL OR NOT json_valid(tool_out) THEN NULL ELSE
  CASE WHEN et = 'error' AND k % 2 = 0 THEN NULL WHEN k % 20 = 6 THEN NULL WHEN k % 20 = 11 THEN 'clean' WHEN k % 5 = 0 THEN 'ok' WHEN k % 5 = 1 THEN 'failed' WHEN k % 5 = 3 THEN 'partial' END END"""


@query("P23_nested_key", with_base(f"SELECT span AS span_id, {_STATUS} AS status FROM evt WHERE etype = 'tool' AND sid IS NOT NULL"))
def _(spark, d):
    tools = typed(spark, d).filter("entity_type = 'tool'")
    found = values.find_key(F.col("output_payload"), "status")
    return tools.select("span_id", F.get_json_object(F.concat(F.lit('{"v":'), found, F.lit("}")), "$.v").alias("status"))


@query(
    "P24_judge_reply_cleanup",
    """SELECT 'doc' || doc_id AS request_id, 1 AS judge_no, quality AS score FROM labels UNION ALL
    SELECT 'doc' || doc_id, 2, CASE WHEN doc_id % 5 > 1 AND doc_id % 10 = 7 THEN NULL ELSE toxic END FROM labels""",
)
def _(spark, d):
    from spanloom.operators.judge import parsed_replies

    out = parsed_replies(derived.judge_replies(spark, d))
    return out.select("request_id", "judge_no", F.col("metric_score").cast("int").alias("score"))


@query(
    "F17_spans_of_types",
    with_base("SELECT span AS span_id, etype AS entity_type FROM sp WHERE etype IN ('agent','tool')"),
)
def _(spark, d):
    return parse.of_types(typed(spark, d), ["agent", "tool"]).select("span_id", "entity_type")


@query(
    "F18_span_validity",
    with_base("SELECT span AS span_id, CASE WHEN k % 25 = 24 THEN 'Missing span_id' WHEN k % 25 = 23 THEN 'Missing entity_type' END AS reason FROM sp"),
)
def _(spark, d):
    events = derived.table(spark, d, "events", "event_id bigint, props string")
    k = events.select(
        F.concat(F.lit("sp"), F.col("event_id").cast("string")).alias("sid_"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"),
    )
    # Spans of conversations have no event and stay as they are.
    spans = typed(spark, d).join(k, F.col("span_id") == F.col("sid_"), "left").withColumn("k", F.coalesce("k", F.lit(0)))
    broken = spans.select(
        F.col("span_id").alias("orig"),
        F.when(F.col("k") % 25 != 24, F.col("span_id")).alias("span_id"),
        F.when(F.col("k") % 25 != 23, F.col("entity_type")).alias("entity_type"),
    )
    return parse.span_validity(broken).select(F.col("orig").alias("span_id"), F.col("invalid_reason").alias("reason"))


_CONTROL = """(x.t LIKE '{"next":%' OR length(x.t) < 10 OR l LIKE '%text contains%' OR l LIKE 'the word %' OR (l LIKE 'the %' AND length(x.t) < 50 AND (l LIKE '%next%' OR l LIKE '%finish%'))
  OR l IN ('next','finish') OR l LIKE '% is mentioned.' OR l LIKE '% is present.' OR (l LIKE '%mentioned%' AND length(x.t) < 100 AND (l LIKE '%next%' OR l LIKE '%finish%')))"""


@query(
    "F23_control_messages",
    with_base(f"SELECT span AS span_id, {_CONTROL} AS control FROM (SELECT span, completion AS t, lower(completion) AS l FROM evt WHERE kind = 'llm' UNION ALL SELECT span, text0, lower(text0) FROM ch) x"),
)
def _(spark, d):
    calls = _parsed(spark, d).filter("entity_type = 'llm'")
    text = values.attr(F.col("completions"), "gen_ai.completion.0.content")
    return calls.select("span_id", filters.is_control_message(text, 10).alias("control"))


@query(
    "F24_system_content",
    with_base(
        """SELECT span AS span_id, (t LIKE '{"next":%' OR length(t) < 10 OR l LIKE '%text contains%' OR l LIKE 'the word %' OR (l LIKE '%mentioned%' AND (l LIKE '%next%' OR l LIKE '%finish%'))) AS system_text
        FROM (SELECT span, trim(completion) AS t, lower(trim(completion)) AS l FROM evt WHERE kind = 'llm' UNION ALL SELECT span, trim(text0), lower(trim(text0)) FROM ch)"""
    ),
)
def _(spark, d):
    calls = _parsed(spark, d).filter("entity_type = 'llm'")
    text = values.attr(F.col("completions"), "gen_ai.completion.0.content")
    return calls.select("span_id", filters.is_system_content(text).alias("system_text"))


@query(
    "P26_redacted_images",
    """SELECT page_id, '{"image_url": "REDACTED", "page": ' || page_id || '}' AS redacted FROM pages""",
)
def _(spark, d):
    from spanloom.operators.cases import redact_images

    pages = derived.table(spark, d, "pages", "page_id bigint, url string")
    body = F.concat(F.lit('{"image_url": "'), F.col("url"), F.lit('", "page": '), F.col("page_id").cast("string"), F.lit("}"))
    return pages.select("page_id", redact_images(F.create_map(F.lit("c"), body))["c"].alias("redacted"))


@query(
    "P39_logprob_to_probability",
    "SELECT event_id, round(exp(-value / 100), 6) AS probability FROM events",
)
def _(spark, d):
    e = derived.table(spark, d, "events", "event_id bigint, value double")
    return e.select("event_id", r6(values.probability(-F.col("value") / 100)).alias("probability"))

