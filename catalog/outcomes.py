"""Evaluation cases, metric results, the metric store, user metrics, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog.metrics  # noqa: F401 - whose twins the runs are compared with
from catalog.base import ORACLES, frames, query, raw, scratch, typed
from catalog.base_sql import with_base
from catalog.parsing import _DEFS
from catalog.sessions import _SES
from catalog.talk import _EL, _ORD, _OUTJ, _SENDS
from spanloom.operators import cases, metrics, results
from spanloom.operators.parse import parse_spans
from spanloom.plans import build, registry
from spanloom.schemas import SPAN_FILE_SCHEMA, SPAN_SCHEMA
from spanloom.sources import derived, metric_store, traces
from spanloom.streaming import intake

# --- evaluation cases ---------------------------------------------------------------------------

_PJ = """pj AS (SELECT span, '{' || string_agg(kv, ',' ORDER BY ord) || '}' AS p FROM (
  SELECT span, idx * 2 AS ord, '"gen_ai.prompt.' || idx || '.role":' || to_json(role) AS kv FROM el WHERE source = 0 AND side = 0
  UNION ALL SELECT span, idx * 2 + 1, '"gen_ai.prompt.' || idx || '.content":' || to_json(content) FROM el WHERE source = 0 AND side = 0) GROUP BY 1)"""


@query("E01_span_cases", with_base("SELECT span AS span_id, p AS input FROM pj", _EL, _PJ))
def _(spark, d):
    return cases.span_cases(typed(spark, d), "BiasMetric").select("span_id", "input")


_BOTH = "nullif(q, '') IS NOT NULL AND nullif(a, '') IS NOT NULL"


@query("E02_task_cases", with_base(f"SELECT sid AS session_id, q AS input, a AS actual_output FROM endss WHERE {_BOTH}", _EL, _SENDS))
def _(spark, d):
    return cases.task_cases(typed(spark, d))[0].select("session_id", "input", "actual_output")


_TJ = f"""tj AS (SELECT sid, count(*) AS n, '[' || string_agg('{{' || array_to_string(list_filter([
    '"name":' || to_json(name), '"description":' || to_json(description), '"input_parameters":' || to_json(i), '"output":' || to_json(o)], lambda x: x IS NOT NULL), ',') || '}}', ',' ORDER BY ts, span) || ']' AS j
  FROM (SELECT evt.sid, span, ts, name, tool_in AS i, {_OUTJ} AS o, description FROM evt LEFT JOIN first ON first.sid = evt.sid AND first.tool = evt.name WHERE etype = 'tool' AND evt.sid IS NOT NULL) GROUP BY 1)"""


@query("E02_session_tools", with_base("SELECT sid AS session_id, 0::BIGINT AS part, n AS n_tools, j AS tools_called FROM tj", _DEFS, _TJ))
def _(spark, d):
    return cases.session_tools(typed(spark, d))


_TURNS = f"""tu AS (SELECT sid, count(*) AS n, '[' || string_agg('{{"role":' || to_json(CASE WHEN role IN ('user','assistant') THEN role ELSE 'assistant' END) || ',"content":' || to_json(content) || '}}', ',' ORDER BY {_ORD}) || ']' AS j FROM el GROUP BY 1)"""


@query("E03_conversation_cases", with_base("SELECT sid AS session_id, 0::BIGINT AS part, n AS n_turns, j AS turns FROM tu", _EL, _TURNS))
def _(spark, d):
    return cases.conversation_cases(typed(spark, d), "RoleAdherenceMetric").select("session_id", "part", "n_turns", "turns")


@query(
    "E04_answer_relevancy_cases",
    with_base(
        """SELECT span AS span_id, '[{"name":"tool_' || (k % 4) || '","description":"desc ' || k || '","parameters":' || to_json('{"type": "object", "n": ' || k || '}') || '},' || CASE WHEN k % 3 = 0 THEN '{"name":"tool_3"},' ELSE '' END || '{"name":"tool_gap"}]' AS tools, 'Please calculate item ' || k AS question FROM sp WHERE kind = 'llm'
        UNION ALL SELECT span, '[]', CASE WHEN held >= 2 THEN second_text END FROM ch"""
    ),
)
def _(spark, d):
    c = cases.answer_relevancy_cases(typed(spark, d))
    defs = F.get_json_object("input", "$.tool_definitions")
    chat = F.from_json(F.get_json_object("input", "$.chat_payload"), "map<string,string>")
    return c.select(
        "span_id", defs.alias("tools"),
        F.try_element_at(chat, F.lit("gen_ai.prompt.1.content")).alias("question"),
    )


_SYS = """(trim(content) LIKE '{"next":%' OR length(trim(content)) < 10 OR lower(content) LIKE '%text contains%' OR lower(trim(content)) LIKE 'the word %' OR (lower(content) LIKE '%mentioned%' AND (lower(content) LIKE '%next%' OR lower(content) LIKE '%finish%')))"""


@query(
    "E05_session_relevancy_cases",
    with_base(
        f"""SELECT ses.sid AS session_id, coalesce(nullif(q, ''), u, '[FALLBACK] No meaningful user input found in session data') AS input,
        coalesce(nullif(a, ''), v, '[FALLBACK] No meaningful final response found in session data') AS actual_output FROM ses LEFT JOIN endss ON endss.sid = ses.sid
        LEFT JOIN (SELECT sid, first(content ORDER BY {_ORD}) FILTER (role = 'user') AS u, last(content ORDER BY {_ORD}) FILTER (role = 'assistant') AS v FROM el WHERE NOT {_SYS} GROUP BY 1) f ON f.sid = ses.sid""",
        _SES, _EL, _SENDS,
    ),
)
def _(spark, d):
    return cases.session_relevancy_cases(typed(spark, d)).select("session_id", "input", "actual_output")


_TOOLS = """'[{"name":"tool_' || (k % 4) || '","description":"desc ' || k || '","parameters":' || to_json('{"type": "object", "n": ' || k || '}') || '},' || CASE WHEN k % 3 = 0 THEN '{"name":"tool_3"},' ELSE '' END || '{"name":"tool_gap"}]'"""
# Messages as JSON, with all fields: the prompts of a model, and its completion.
_WHOLE = """asked AS (SELECT span, '[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(content) || CASE WHEN role = 'assistant' THEN ',"tool_calls":[]' ELSE '' END || '}', ',' ORDER BY idx) || ']' AS j
  FROM el WHERE source = 0 AND side = 0 GROUP BY 1),
said AS (SELECT sp.span, '[{' || CASE WHEN sp.src = 'c' OR sp.k % 3 > 0 THEN '"role":"assistant",' ELSE '' END || '"content":' || to_json(content)
  || CASE WHEN sp.k % 16 = 5 AND sp.k % 3 = 0 THEN ',"tool_calls.0.arguments":' || to_json('{"q": ' || sp.k || '}') || ',"tool_calls.0.name":"tool_1"'
    WHEN sp.k % 16 = 5 THEN ',"tool_calls":[{"name":"tool_1","arguments":{"q": ' || sp.k || '}}]'
    WHEN sp.src = 'c' OR sp.k % 3 > 0 THEN ',"tool_calls":[]' ELSE '' END || '}]' AS j FROM sp JOIN el ON el.span = sp.span WHERE source = 0 AND side = 1)"""


@query(
    "E06_answer_correctness_cases",
    with_base(
        f"""SELECT sp.span AS span_id, '{{"tool_definitions":' || CASE WHEN sp.src = 'e' THEN {_TOOLS.replace("k %", "sp.k %").replace("|| k ||", "|| sp.k ||")} ELSE '[]' END || ',"chat_payload":' || coalesce(asked.j, '[]') || '}}' AS input, said.j AS actual_output, '' AS expected_output
        FROM sp LEFT JOIN asked ON asked.span = sp.span JOIN said ON said.span = sp.span""",
        _EL, _WHOLE,
    ),
)
def _(spark, d):
    return cases.answer_correctness_cases(typed(spark, d)).select("span_id", "input", "actual_output", "expected_output")


@query("E07_style_cases", with_base("SELECT span AS span_id, '{}' AS input, j AS actual_output FROM said", _EL, _WHOLE))
def _(spark, d):
    return cases.style_cases(typed(spark, d)).select("span_id", "input", "actual_output")


_AGIO = """ag AS (SELECT span, kind, k FROM sp WHERE etype = 'agent')"""


_COMPLETIONS = """cj AS (SELECT el.span, '{' || CASE WHEN sp.src = 'c' OR sp.k % 3 > 0 THEN '"gen_ai.completion.0.role":"assistant",' ELSE '' END || '"gen_ai.completion.0.content":' || to_json(content)
  || CASE WHEN sp.k % 16 = 5 THEN ',"gen_ai.completion.0.tool_calls.0.name":"tool_1","gen_ai.completion.0.tool_calls.0.arguments":' || to_json('{"q": ' || sp.k || '}') ELSE '' END || '}' AS c
  FROM el JOIN sp ON sp.span = el.span WHERE source = 0 AND side = 1)"""


@query(
    "E08_span_parameters",
    with_base(
        """SELECT span AS span_id, CASE WHEN kind = 'agent' THEN '{"value":"Plan step ' || k || '"}' END AS input, CASE WHEN kind <> 'agent' THEN NULL WHEN k % 2 = 0 THEN '{"value": "Agent reply ' || k || ' done"}' ELSE cast(k AS varchar) END AS output FROM ag
        UNION ALL SELECT sp.span, p, c FROM sp LEFT JOIN pj ON pj.span = sp.span LEFT JOIN cj ON cj.span = sp.span WHERE etype = 'llm'""",
        _AGIO, _EL, _PJ, _COMPLETIONS,
    ),
)
def _(spark, d):
    """Models, which is the default, and agents."""
    both = cases.span_parameter_cases(typed(spark, d)).unionByName(cases.span_parameter_cases(typed(spark, d), ["agent"]))
    return both.select("span_id", "input", "output")


@query(
    "E09_session_parameters",
    with_base("SELECT coalesce(tu.sid, tj.sid) AS session_id, tu.j AS conversation, q AS user_input, a AS final_response, tj.j AS tools_used FROM tu FULL JOIN tj ON tu.sid = tj.sid LEFT JOIN endss ON endss.sid = coalesce(tu.sid, tj.sid)", _EL, _TURNS, _DEFS, _TJ, _SENDS),
)
def _(spark, d):
    return cases.session_parameter_cases(typed(spark, d)).select("session_id", "conversation", "user_input", "final_response", "tools_used")


@query(
    "E10_hallucination_parameters",
    """SELECT doc_id, 'Q' || doc_id AS input, text AS output, CASE doc_id % 3 WHEN 0 THEN 'one|two' WHEN 1 THEN 'ctx ' || doc_id END AS context FROM documents""",
)
def _(spark, d):
    docs = derived.table(spark, d, "documents", "doc_id bigint, text string")
    i = F.col("doc_id").cast("string")
    context = F.when(F.col("doc_id") % 3 == 0, F.lit(', "documents": ["one", "two"]')).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit(', "knowledge_base": "ctx '), i, F.lit('"'))
    ).otherwise("")
    spans = docs.select(
        F.lit("agent").alias("entity_type"), F.lit("s").alias("session_id"), i.alias("span_id"),
        F.concat(F.lit('{"question": "Q'), i, F.lit('"'), context, F.lit("}")).alias("input_payload"),
        F.to_json(F.struct(F.col("text").alias("answer"))).alias("output_payload"),
        F.lit(None).cast("map<string,string>").alias("prompts"), F.lit(None).cast("map<string,string>").alias("completions"),
    )
    out = cases.hallucination_cases(spans, ["agent"])
    return out.select(F.col("span_id").cast("bigint").alias("doc_id"), "input", "output", F.array_join("context", "|").alias("context"))


@query(
    "E11_topic_messages",
    with_base(
        """SELECT sid AS session_id, span AS span_id, CASE WHEN side = 1 THEN 'ai' WHEN role = 'user' THEN 'human' ELSE 'ai' END AS message_type, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content
        FROM el WHERE source = 0 AND ((side = 1 AND idx = 0) OR (side = 0 AND role IN ('user','assistant'))) AND regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''""",
        _EL,
    ),
)
def _(spark, d):
    return cases.topic_messages(typed(spark, d)).select("session_id", "span_id", "message_type", "content")


@query(
    "E11_topic_cases",
    with_base(
        "SELECT sid AS session_id, count(*) AS n_messages, 'technology,science,business,math' AS reference_topics, 'f1' AS mode FROM el WHERE source = 0 AND ((side = 1 AND idx = 0) OR (side = 0 AND role IN ('user','assistant'))) GROUP BY 1", _EL
    ),
)
def _(spark, d):
    return cases.topic_cases(typed(spark, d), "f1").select("session_id", "n_messages", "reference_topics", "mode")


@query(
    "E12_catalogue_applied",
    with_base(
        """SELECT span AS span_id, m AS metric_name FROM sp, (SELECT unnest(['AnswerRelevancyMetric','BiasMetric','CoherenceMetric','GroundednessMetric','TonalityMetric','ToxicityMetric','AnswerCorrectnessMetric','GeneralStructureAndStyleMetric','Hallucination','Sentiment']) AS m) WHERE etype = 'llm'"""
    ),
)
def _(spark, d):
    return results.match_span_metrics(typed(spark, d), cases.catalog(spark)).select("span_id", "metric_name")


@query(
    "F20_F21_widened_span_metrics",
    with_base(
        """SELECT span AS span_id, m AS metric_name FROM sp, (SELECT unnest(['AnswerRelevancyMetric','BiasMetric','ToxicityMetric','Hallucination','Sentiment']) AS m) WHERE etype IN ('agent','tool')
        UNION ALL SELECT span, m FROM sp, (SELECT unnest(['CoherenceMetric','GroundednessMetric','TonalityMetric','AnswerCorrectnessMetric','GeneralStructureAndStyleMetric']) AS m) WHERE etype = 'llm'"""
    ),
)
def _(spark, d):
    return results.match_span_metrics(typed(spark, d), cases.catalog(spark, "agent, Tool, robot")).select("span_id", "metric_name")


@query(
    "F27_assessed_spans",
    with_base(
        f"""SELECT span AS span_id, etype IN ('llm','tool') AND has_in AND has_out AS valid FROM (SELECT span, etype, CASE WHEN etype = 'llm' THEN true WHEN kind = 'tool' THEN tool_in IS NOT NULL ELSE false END AS has_in,
        CASE WHEN etype = 'llm' THEN true WHEN kind = 'tool' THEN tool_out IS NOT NULL ELSE false END AS has_out FROM evt WHERE etype IS NOT NULL AND sid IS NOT NULL UNION ALL SELECT span, 'llm', true, true FROM ch)"""
    ),
)
def _(spark, d):
    out = cases.assess_spans(typed(spark, d), "Hallucination", ["llm", "tool"], ["input_payload", "output_payload"])
    return out.select("span_id", "valid")


@query("F27_assessed_sessions", with_base("SELECT sid AS session_id, bool_or(etype IN ('llm')) AS valid FROM sp GROUP BY 1"))
def _(spark, d):
    return cases.assess_sessions(typed(spark, d), "TopicAdherenceScore", ["llm"]).select("session_id", "valid")


def _scorer_replies(spark, d):
    """One scorer reply per model span, scored from its id, or an error."""
    c = cases.span_cases(typed(spark, d), "ToxicityMetric")
    n = F.regexp_extract("span_id", r"([0-9]+)$", 1).cast("bigint")
    c = c.select("case_id", n.alias("n"))
    return c.select(
        "case_id",
        F.when(F.col("n") % 5 != 4, (F.col("n") % 11) / 10).alias("score"),
        F.lit(0.7).alias("threshold"),
        F.concat(F.lit("n "), F.col("n").cast("string")).alias("reason"),
        F.lit(True).alias("success"),
        F.when(F.col("n") % 5 == 4, "scorer failed").alias("error"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


@query(
    "E13_P37_scored_results",
    with_base(
        """SELECT span AS span_id, round(CASE WHEN n % 5 = 4 THEN -1e0 ELSE (n % 11) / 10e0 END, 6) AS value_num, CASE WHEN n % 5 <> 4 AND n % 11 >= 7 THEN 'toxic' ELSE 'not_toxic' END AS label,
        CASE WHEN n % 5 = 4 THEN 'failed' ELSE 'span' END AS bucket FROM (SELECT span, cast(regexp_extract(span, '([0-9]+)$', 1) AS bigint) AS n FROM sp WHERE etype = 'llm')"""
    ),
)
def _(spark, d):
    scored = cases.scored_results(cases.span_cases(typed(spark, d), "ToxicityMetric"), _scorer_replies(spark, d), "deepeval")
    return results.with_bucket(results.with_labels(scored)).select("span_id", F.round("value_num", 6).alias("value_num"), "label", "bucket")


# --- labels -------------------------------------------------------------------------------------


@query(
    "P37_grade_labels",
    "SELECT 'doc' || doc_id AS session_id, 'Groundedness' AS metric_name, CASE WHEN quality = 1 THEN 'grounded' ELSE 'not_grounded' END AS label FROM labels "
    "UNION ALL SELECT 'doc' || doc_id, 'ToxicityMetric', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'not_toxic' END FROM labels",
)
def _(spark, d):
    graded = derived.table(spark, d, "labels", "doc_id bigint, quality int, toxic int")
    doc = graded.withColumn("session_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    ours = results.result_rows(doc, "Groundedness", "session", F.col("quality"))
    theirs = results.result_rows(doc, "ToxicityMetric", "session", F.col("toxic"), metadata=F.lit('{"threshold": 0.5}'))
    return results.with_labels(ours.unionByName(theirs)).select("session_id", "metric_name", "label")


@query(
    "P38_sentiment_labels",
    """SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'neg' WHEN b >= c THEN 'neu' ELSE 'pos' END AS label
    FROM (SELECT event_id, event_id % 7 AS a, event_id % 5 AS b, event_id % 3 AS c FROM events)""",
)
def _(spark, d):
    e = derived.table(spark, d, "events", "event_id bigint").withColumn("span_id", F.col("event_id").cast("string"))
    meta = F.to_json(F.struct(*[(F.col("event_id") % n).alias(m) for m, n in (("neg", 7), ("neu", 5), ("pos", 3))]))
    out = results.with_labels(results.result_rows(e, "Sentiment", "span", F.lit(0.0), metadata=meta))
    return out.select(F.col("span_id").cast("bigint").alias("event_id"), "label")


# --- results --------------------------------------------------------------------------------------


def _all_results(spark, d):
    """Session rates, span statuses (with failures) and one population result."""
    f = frames(spark, d)
    rate = results.result_rows(metrics.tool_error_rate(f.spans), "ToolErrorRate", "session", F.col("tool_error_rate"), app_name="unnamed")
    status = metrics.tool_status(f.spans)
    error = F.when(F.col("status").isNull(), "no tool status")
    spans = results.result_rows(status, "ToolError", "span", value_json=F.to_json(F.struct("status")), error=error, app_name="unnamed")
    whole = f.sessions.agg(F.count("*").alias("n"))
    return rate.unionByName(spans).unionByName(results.result_rows(whole, "SessionCount", "population", F.col("n")))


_RES = """st AS (SELECT sp.sid, sp.span, CASE WHEN tool_out IS NULL OR NOT json_valid(tool_out) THEN NULL WHEN et = 'error' AND evr.k % 2 = 0 THEN NULL WHEN evr.k % 20 = 6 THEN NULL
  WHEN evr.k % 20 = 11 THEN 'clean' WHEN evr.k % 5 = 0 THEN 'ok' WHEN evr.k % 5 = 1 THEN 'failed' WHEN evr.k % 5 = 3 THEN 'partial' END AS status FROM sp JOIN evr ON evr.span = sp.span WHERE etype = 'tool'),
rt AS (SELECT sid, coalesce(100.0 * count(*) FILTER (etype = 'tool' AND err) / nullif(count(*) FILTER (etype = 'tool'), 0), 0) AS v FROM sp GROUP BY 1),
res AS (SELECT 'ToolErrorRate' AS m, 'session' AS lvl, sid, NULL AS span, v, true AS ok FROM rt UNION ALL SELECT 'ToolError', 'span', sid, span, CASE WHEN status IS NULL THEN -1 END, status IS NOT NULL FROM st
  UNION ALL SELECT 'SessionCount', 'population', NULL, NULL, (SELECT count(*) FROM rt), true)"""


@query("A33_result_buckets", with_base("SELECT m AS metric_name, CASE WHEN ok THEN lvl ELSE 'failed' END AS bucket, count(*) AS n FROM res GROUP BY 1, 2", _RES))
def _(spark, d):
    return results.with_bucket(_all_results(spark, d)).groupBy("metric_name", "bucket").agg(F.count("*").alias("n"))




@query(
    "A34_results_by_entity",
    with_base(
        f"""SELECT lvl AS aggregation_level, id AS entity_id, count(*) FILTER (s = 'e') AS n_evaluated, count(*) FILTER (s = 'f') AS n_failed, count(*) FILTER (s = 's') AS n_skipped,
        coalesce(string_agg(DISTINCT m, ',' ORDER BY m) FILTER (s = 'e'), '') AS evaluated FROM (
          SELECT lvl, CASE lvl WHEN 'span' THEN span WHEN 'session' THEN sid ELSE 'all' END AS id, m, CASE WHEN ok THEN 'e' ELSE 'f' END AS s FROM res
          UNION ALL SELECT 'span', span, 'ALL', 's' FROM sp WHERE etype <> 'tool') GROUP BY 1, 2""",
        _RES,
    ),
)
def _(spark, d):
    skipped = results.unmatched_spans(typed(spark, d), _tool_catalog(spark))
    out = results.results_by_entity(_all_results(spark, d), skipped)
    return out.select("aggregation_level", "entity_id", "n_evaluated", "n_failed", "n_skipped", "evaluated")


def _tool_catalog(spark):
    return spark.createDataFrame([("ToolError", "span", ["tool"])], "metric_name string, aggregation_level string, entity_types array<string>")


@query("A35_distinct_failures", with_base("SELECT span AS span_id, m AS metric_name FROM res WHERE NOT ok", _RES))
def _(spark, d):
    failed = results.with_bucket(_all_results(spark, d)).filter("bucket = 'failed'")
    return results.distinct_failures(failed.unionByName(failed)).select("span_id", "metric_name")


@query("A36_unmatched_spans", with_base("SELECT span AS entity_id, etype AS entity_type, 'no_matching_metrics' AS skip_category FROM sp WHERE etype <> 'tool'"))
def _(spark, d):
    return results.unmatched_spans(typed(spark, d), _tool_catalog(spark)).select("entity_id", "entity_type", "skip_category")


@query(
    "F19_missing_requirements",
    with_base(
        """SELECT ses.sid AS session_id, 'TaskCompletionMetric' AS metric_name, concat_ws(',', CASE WHEN tool_calls = 0 THEN 'tool_calls' END, CASE WHEN nullif(q, '') IS NULL THEN 'input_query' END,
        CASE WHEN nullif(a, '') IS NULL THEN 'final_response' END) AS missing FROM ses LEFT JOIN endss ON endss.sid = ses.sid
        UNION ALL SELECT ses.sid, 'RoleAdherenceMetric', CASE WHEN e.sid IS NULL THEN 'conversation_elements' ELSE '' END FROM ses LEFT JOIN (SELECT DISTINCT sid FROM el) e ON e.sid = ses.sid""",
        _SES, _EL, _SENDS,
    ),
)
def _(spark, d):
    needs = {m: list(n) for m, _s, _l, _t, n in cases.CATALOG if m in ("TaskCompletionMetric", "RoleAdherenceMetric")}
    out = results.missing_requirements(build.with_session_inputs(frames(spark, d)), needs)
    return out.select("session_id", "metric_name", F.array_join("missing", ",").alias("missing"))


@query("J07_results_with_app", with_base("SELECT sid AS session_id, app AS app_name FROM ses", _SES))
def _(spark, d):
    f = frames(spark, d)
    rate = _all_results(spark, d).filter("metric_name = 'ToolErrorRate'")
    return results.with_session_app(rate, f.sessions).select("session_id", "app_name")


def _stored_and_wanted(spark, d):
    rate = _all_results(spark, d).filter("metric_name = 'ToolErrorRate'")
    stored = rate.filter("value_num > 0")
    wanted = frames(spark, d).sessions.select("session_id").withColumn("metric_name", F.lit("ToolErrorRate"))
    return (rate, *results.split_work(wanted, stored))


@query("J06_work_left", with_base("SELECT sid AS session_id FROM rt WHERE v = 0", _RES))
def _(spark, d):
    return _stored_and_wanted(spark, d)[1].select("session_id")


_AGENTS = "ag AS (SELECT DISTINCT sid, agent FROM sp WHERE agent IS NOT NULL)"


def _agent_work(spark, d, stored_agents):
    """Agent rows stored for the given agents, each twice, and one of an agent the session lacks."""
    f = frames(spark, d)
    who = f.agent_stats.filter(stored_agents)
    rows = who.union(who).unionByName(who.withColumn("agent", F.lit("nobody")))
    stored = results.result_rows(rows, "ToolErrorRate", "agent", F.col("tool_fails"))
    wanted = f.agent_stats.select("session_id", F.col("agent").alias("agent_id")).withColumn("metric_name", F.lit("ToolErrorRate"))
    return results.split_work(wanted, stored, agent_level=True)


@query(
    "J06_agent_work_left",
    with_base("SELECT sid AS session_id, agent AS agent_id FROM ag WHERE sid NOT IN (SELECT sid FROM ag GROUP BY 1 HAVING bool_and(agent = 'lead_agent'))", _AGENTS),
)
def _(spark, d):
    return _agent_work(spark, d, "agent = 'lead_agent'")[0].select("session_id", "agent_id")


@query("J06_agents_reused", with_base("SELECT sid AS session_id, agent AS agent_id, true AS from_cache FROM ag WHERE sid IN (SELECT sid FROM ag GROUP BY 1 HAVING bool_and(agent <> 'lead_agent'))", _AGENTS))
def _(spark, d):
    return _agent_work(spark, d, "agent <> 'lead_agent'")[1].select("session_id", "agent_id", "from_cache")


@query("U05_reused_and_new", with_base("SELECT sid AS session_id, v > 0 AS from_cache FROM rt", _RES))
def _(spark, d):
    rate, todo, reuse = _stored_and_wanted(spark, d)
    fresh = rate.join(todo.select("session_id"), "session_id", "left_semi").select(*rate.columns)
    return results.reused_and_new(reuse.select(*rate.columns), fresh).select("session_id", "from_cache")


# --- the store --------------------------------------------------------------------------------------


def _store_rows(spark, d):
    return metric_store.storage_rows(results.with_session_app(_all_results(spark, d), frames(spark, d).sessions))


_STORE = f"""stor AS (SELECT coalesce(span, 'default_span_id') AS span, coalesce(res.sid, 'default_session_id') AS sid, m, v, lvl, ok, CASE WHEN lvl = 'population' THEN 'default_app_name' ELSE app END AS app,
  CASE WHEN lvl = 'span' THEN 'span' ELSE 'session' END AS scope FROM res LEFT JOIN ses ON ses.sid = res.sid)"""


@query(
    "S10_S11_storage_rows",
    with_base(
        "SELECT span AS span_id, 'default_trace_id' AS trace_id, sid AS session_id, app AS app_name, 'default_app_id' AS app_id, scope, m AS metric_name, round(v, 6) AS value FROM stor", _SES, _RES, _STORE
    ),
)
def _(spark, d):
    out = _store_rows(spark, d)
    j = lambda k: F.get_json_object("Metrics", f"$.{k}")
    return out.select(
        F.col("SpanId").alias("span_id"), F.col("TraceId").alias("trace_id"), F.col("SessionId").alias("session_id"),
        F.col("AppName").alias("app_name"), F.col("AppId").alias("app_id"), F.col("Scope").alias("scope"),
        j("metric_name").alias("metric_name"), F.round(j("value_num").cast("double"), 6).alias("value"),
    )


@query("S12_storable_results", with_base("SELECT m AS metric_name, count(*) AS n FROM res WHERE ok AND lvl <> 'population' AND NOT (m = 'ToolErrorRate' AND v > 50) GROUP BY 1", _RES))
def _(spark, d):
    marked = _all_results(spark, d).withColumn("from_cache", F.coalesce((F.col("metric_name") == "ToolErrorRate") & (F.col("value_num") > 50), F.lit(False)))
    return metric_store.storable(marked).groupBy("metric_name").agg(F.count("*").alias("n"))


@query("S09_rejected_rows", with_base("SELECT sid AS session_id, 'AppName' AS missing FROM stor WHERE app = 'app1'", _SES, _RES, _STORE))
def _(spark, d):
    rows = _store_rows(spark, d).withColumn("AppName", F.when(F.col("AppName") != "app1", F.col("AppName")).otherwise(""))
    _accepted, rejected = metric_store.complete_rows(rows)
    return rejected.select(F.col("SessionId").alias("session_id"), F.array_join("missing", ",").alias("missing"))


def _stored_table(spark, d):
    path = scratch(spark, "metric-store")
    metric_store.append_metrics(_store_rows(spark, d), path)
    return metric_store.read_metrics(spark, path)


@query("S07_S08_append_and_scan", with_base("SELECT sid AS session_id, span AS span_id, scope, true AS has_id FROM stor", _SES, _RES, _STORE))
def _(spark, d):
    t = _stored_table(spark, d)
    has_id = F.col("ID").isNotNull() & F.col("Timestamp").isNotNull()
    return t.select(F.col("SessionId").alias("session_id"), F.col("SpanId").alias("span_id"), F.col("Scope").alias("scope"), has_id.alias("has_id"))


@query("S14_response_rows", with_base("SELECT sid AS session_id, span AS span_id, 8 AS n_columns FROM stor", _SES, _RES, _STORE))
def _(spark, d):
    out = metric_store.response_rows(_stored_table(spark, d))
    return out.select(F.col("SessionId").alias("session_id"), F.col("SpanId").alias("span_id"), F.lit(len(out.columns)).alias("n_columns"))


_SID1 = "app1_c4ca4238-a0b9-2382-0dcc-509a6f75849b"


@query("F07_metrics_of_session", with_base(f"SELECT m AS metric_name, round(v, 6) AS value FROM stor WHERE sid = '{_SID1}' AND scope = 'session'", _SES, _RES, _STORE))
def _(spark, d):
    rows = metric_store.for_session(_store_rows(spark, d), _SID1, "session")
    return rows.select(F.get_json_object("Metrics", "$.metric_name").alias("metric_name"), F.round(F.get_json_object("Metrics", "$.value_num").cast("double"), 6).alias("value"))


@query("F08_metrics_of_span", with_base("SELECT span AS span_id, m AS metric_name FROM stor WHERE span = (SELECT min(span) FROM st) AND scope = 'span'", _SES, _RES, _STORE))
def _(spark, d):
    rows = _store_rows(spark, d)
    first = rows.filter("Scope = 'span'").agg(F.min("SpanId")).first()[0]
    return metric_store.for_span(rows, first, "span").select(F.col("SpanId").alias("span_id"), F.get_json_object("Metrics", "$.metric_name").alias("metric_name"))


@query("F26_already_stored", with_base("SELECT m AS metric_name, count(*) AS n FROM stor GROUP BY 1", _SES, _RES, _STORE))
def _(spark, d):
    rows = metric_store.already_stored(_store_rows(spark, d))
    return rows.groupBy(F.get_json_object("Metrics", "$.metric_name").alias("metric_name")).agg(F.count("*").alias("n"))


@query("A38_metric_names", with_base("SELECT DISTINCT m AS metric_name FROM stor WHERE sid LIKE '%app1_%'", _SES, _RES, _STORE))
def _(spark, d):
    return metric_store.metric_names(_store_rows(spark, d), "app1_")


@query("A39_metric_percent", with_base("SELECT sid AS session_id, round(v * 100, 4) AS value FROM stor WHERE m = 'ToolErrorRate' AND contains(sid, 'app')", _SES, _RES, _STORE))
def _(spark, d):
    out = metric_store.metric_percent(_store_rows(spark, d), "app", "ToolErrorRate")
    return out.select(F.col("SessionId").alias("session_id"), F.round("value", 4).alias("value"))


@query("A40_sessions_of_app", with_base("SELECT DISTINCT sid AS session_id FROM stor WHERE contains(app, 'pp2')", _SES, _RES, _STORE))
def _(spark, d):
    return metric_store.sessions_of_app(_store_rows(spark, d), "pp2").select(F.col("SessionId").alias("session_id"))


# --- files and intake ------------------------------------------------------------------------------


_FILE_SPANS = with_base("SELECT span AS span_id, etype AS entity_type, sid AS session_id, err AS contains_error, ts AS ts_us FROM typ")


def _to_file(spark, d):
    source = raw(spark, d).select(*[c for c in SPAN_FILE_SCHEMA.names if c in SPAN_SCHEMA.names])
    return source.withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def _from_file(rows):
    spans = parse_spans(traces.file_spans(rows))
    return spans.select("span_id", "entity_type", "session_id", "contains_error", F.unix_micros("timestamp").alias("ts_us"))


@query("S02_trace_file_lines", _FILE_SPANS)
def _(spark, d):
    path = scratch(spark, "span-file")
    _to_file(spark, d).write.json(path)
    return _from_file(traces.read_trace_file(spark, path, "lines"))


@query("S02_trace_file_array", _FILE_SPANS)
def _(spark, d):
    """Files of one array each, of some 20,000 spans; the last member is a null."""
    path, source = scratch(spark, "span-array"), _to_file(spark, d)
    files = source.count() // 20_000 + 1
    members = source.select(F.pmod(F.xxhash64("TraceId", "SpanId"), F.lit(files)).alias("file"), F.lit(1).alias("at"), F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("line"))
    ends = spark.range(files).select(F.col("id").alias("file"), F.explode(F.create_map(F.lit(0), F.lit("["), F.lit(2), F.lit("null]"))).alias("at", "line"))
    lines = members.unionByName(ends).repartition("file").sortWithinPartitions("file", "at")
    lines.select("file", "line").write.partitionBy("file").text(path)
    return _from_file(traces.read_trace_file(spark, path))


@query("S02_trace_file_objects", _FILE_SPANS)
def _(spark, d):
    """Objects one after the other, each over several lines."""
    path = scratch(spark, "span-objects")
    _to_file(spark, d).select(F.to_json(F.struct("*"), {"pretty": "true"})).write.text(path)
    return _from_file(traces.read_trace_file(spark, path))


@query("S13_session_dump", with_base(f"SELECT span AS span_id, span_name FROM raw WHERE sid = '{_SID1}'"))
def _(spark, d):
    path = scratch(spark, "dump")
    traces.dump_session(raw(spark, d), _SID1, path)
    return spark.read.schema("SpanId string, SpanName string").json(path).select(F.col("SpanId").alias("span_id"), F.col("SpanName").alias("span_name"))


@query("X01_stream_intake", with_base("SELECT span AS span_id, sid AS session_id, ts AS ts_us FROM raw"))
def _(spark, d):
    landing, table, mark = (scratch(spark, n) for n in ("landing", "trace-table", "intake-state"))
    source = raw(spark, d).select(*SPAN_SCHEMA.names)
    source.write.parquet(landing)
    # A second delivery of every span: intake keeps one.
    source.write.mode("append").parquet(landing)
    intake.start_intake(spark, landing, table, mark, once=True, files_per_trigger=10).awaitTermination()
    stored = spark.read.schema(intake.TRACE_TABLE_SCHEMA).parquet(table)
    session = F.coalesce("session_attr", "execution_attr").alias("session_id")
    return stored.select(F.col("SpanId").alias("span_id"), session, F.unix_micros("Timestamp").alias("ts_us"))


# --- user metrics ---------------------------------------------------------------------------------------


@query(
    "V01_V02_V03_V04_user_metric_run",
    with_base(
        """SELECT 'session' AS aggregation_level, sid AS session_id, NULL AS agent_id, cast(count(*) FILTER (etype = 'task') AS double) AS value_num FROM sp GROUP BY 2
        UNION ALL SELECT 'agent', sid, agent, cast(count(*) FILTER (etype = 'task') AS double) FROM sp WHERE agent IS NOT NULL GROUP BY 2, 3"""
    ),
)
def _(spark, d):
    own = registry.Registry()

    def per_agent(f):
        from spanloom.operators.agents import with_agent

        n = with_agent(f.spans).filter("agent is not null").groupBy("session_id", "agent")
        return results.result_rows(n.agg(F.count_if(F.col("entity_type") == "task").alias("n")), "TaskCount", "agent", F.col("n"))

    @own.metric("TaskCount", "session", agent=per_agent)
    def task_count(f):
        n = f.spans.groupBy("session_id").agg(F.count_if(F.col("entity_type") == "task").alias("n"))
        return results.result_rows(n, "TaskCount", "session", F.col("n"))

    out = registry.run_metrics(frames(spark, d), ["TaskCount"], ["session", "agent"], own)
    return out.select("aggregation_level", "session_id", "agent_id", "value_num")


def _numbers(metric, level, source, value, agent="NULL", ok="true", key="NULL"):
    return f"SELECT '{metric}' AS metric_name, '{level}' AS aggregation_level, session_id, NULL AS span_id, {agent} AS agent_id, {key} AS key, round(cast({value} AS double), 6) AS value, NULL AS text, {ok} AS success FROM ({ORACLES[source]})"


def _all_native_sql():
    sessions = f"(SELECT session_id FROM ({ORACLES['M10_workflow_efficiency']}))"
    parts = [
        _numbers("ToolErrorRate", "session", "M01_tool_error_rate", "tool_error_rate"),
        _numbers("ToolErrorRate", "agent", "M02_agent_tool_error_rate", "tool_error_rate", "agent"),
        f"SELECT 'CyclesCount', 'session', session_id, NULL, NULL, NULL, coalesce(cycles, 0), NULL, true FROM {sessions} LEFT JOIN ({ORACLES['M03_cycles']}) USING (session_id)",
        _numbers("CyclesCount", "agent", "M04_agent_cycles", "cycles", "agent"),
        f"SELECT 'AgentToAgentInteractions', 'session', session_id, NULL, NULL, transition, n, NULL, true FROM {sessions} LEFT JOIN ({ORACLES['M05_agent_to_agent_counts']}) USING (session_id)",
        f"SELECT 'AgentToToolInteractions', 'session', session_id, NULL, NULL, interaction, n, NULL, NOT coalesce(failed, false) FROM {sessions} LEFT JOIN ({ORACLES['M06_agent_to_tool']}) USING (session_id)",
        f"SELECT 'GraphDeterminismScore', 'population', NULL, NULL, NULL, NULL, path_variance, NULL, true FROM ({ORACLES['M07_J08_path_variance']})",
        _numbers("WorkflowEfficiency", "session", "M10_workflow_efficiency", "efficiency"),
        _numbers("SpanCounter", "session", "M17_span_counts", "n_spans"),
        f"SELECT 'ToolError', 'span', session_id, span_id, NULL, CASE WHEN status IS NOT NULL THEN 'status' END, CASE WHEN status IS NULL THEN -1 END, status, status IS NOT NULL FROM ({ORACLES['M16_tool_status']}) JOIN (SELECT span AS span_id, sid AS session_id FROM ({with_base('SELECT span, sid FROM sp')})) USING (span_id)",
        f"SELECT 'PassiveEvalApp', 'session', session_id, NULL, NULL, 'app_name', NULL, app_name, true FROM ({ORACLES['M08_passive_app']})",
    ]
    for n in metrics.PASSIVE_APP:
        parts.append(_numbers("PassiveEvalApp", "session", "M08_passive_app", f"eval_app_{n}", key=f"'eval_app_{n}'") + f" WHERE eval_app_{n} IS NOT NULL")
        if not n.startswith("graph"):
            parts.append(_numbers("PassiveEvalAgents", "session", "M09_passive_agents", f"eval_agent_{n}", "agent", key=f"'eval_agent_{n}'") + f" WHERE eval_agent_{n} IS NOT NULL")
    for kind in ("Average", "Minimum", "Maximum"):
        for level, source, agent in (("session", "M11_M12_M13_session_confidence", "NULL"), ("agent", "M15_agent_confidence", "agent")):
            parts.append(_numbers(f"LLM{kind}Confidence", level, source, f"{kind.lower()}_confidence", agent, f"{kind.lower()}_confidence <> -1"))
    return " UNION ALL ".join(parts)


def _flat(out):
    """Every value of every result: numbers, and the members of maps."""
    members = F.explode_outer(F.when(F.col("value_json").isNotNull(), F.from_json("value_json", "map<string,string>"))).alias("key", "member")
    rows = out.select("metric_name", "aggregation_level", "session_id", "span_id", "agent_id", "value_num", "success", members)
    number = F.col("member").try_cast("double")
    return rows.select(
        "metric_name", "aggregation_level", "session_id", "span_id", "agent_id", "key",
        F.round(F.coalesce(number, "value_num"), 6).alias("value"), F.when(number.isNull(), F.col("member")).alias("text"), "success",
    )


@query("V04_native_metric_run", _all_native_sql())
def _(spark, d):
    """All thirteen native metrics at all their levels in one run, by value."""
    return _flat(registry.run_metrics(frames(spark, d), levels=["session", "agent", "span", "population"]))


@query(
    "V04_run_with_failures",
    with_base(
        """SELECT 'SpanCounter' AS metric_name, sid AS session_id, cast(count(*) AS double) AS value_num, true AS success, NULL AS problem FROM sp GROUP BY 2
        UNION ALL SELECT 'NeedsTools', sid, cast(count(*) AS double), true, NULL FROM sp GROUP BY 2 HAVING count(*) FILTER (etype = 'tool') > 0
        UNION ALL SELECT 'FailsInATask', NULL, -1e0, false, 'a session has spans'
        UNION ALL SELECT 'FailsAtPlanning', NULL, -1e0, false, 'no such column'
        UNION ALL SELECT 'Nowhere', NULL, -1e0, false, 'unknown metric'"""
    ),
)
def _(spark, d):
    """One metric that works, one that some sessions lack inputs for, one that fails when planned,
    one that fails in its tasks, one that nobody knows."""
    own = registry.Registry()
    counted = lambda f: f.spans.groupBy("session_id").agg(F.count("*").alias("n"))

    @own.metric("SpanCounter", "session")
    def spans(f):
        return results.result_rows(counted(f), "SpanCounter", "session", F.col("n"))

    @own.metric("NeedsTools", "session", requires=("tool_calls",))
    def needs_tools(f):
        return results.result_rows(counted(f), "NeedsTools", "session", F.col("n"))

    @own.metric("FailsAtPlanning", "session")
    def at_planning(f):
        return f.spans.select("no such column")

    @own.metric("FailsInATask", "session")
    def in_a_task(f):
        bad = F.when(F.col("n") > 0, F.raise_error(F.lit("a session has spans"))).otherwise(F.col("n"))
        return results.result_rows(counted(f), "FailsInATask", "session", bad.cast("double"))

    names = ["SpanCounter", "FailsInATask", "NeedsTools", "FailsAtPlanning", "Nowhere"]
    out = registry.run_metrics(frames(spark, d), names, registry=own)
    known = [F.when(F.col("error_message").contains(t), t) for t in ("a session has spans", "no such column", "unknown metric")]
    return out.select("metric_name", "session_id", "value_num", "success", F.coalesce(*known).alias("problem"))


@query("V05_V07_build_with_steps", with_base("SELECT sid AS session_id, count(*) AS n_spans, count(*) FILTER (etype = 'tool') AS n_marked FROM sp GROUP BY 1"))
def _(spark, d):
    marked = build.build_sessions(raw(spark, d), steps=[lambda s: s.withColumn("is_tool", F.col("entity_type") == "tool")])
    return marked.spans.groupBy("session_id").agg(F.count("*").alias("n_spans"), F.count_if("is_tool").alias("n_marked"))


@query("V06_result_documents", with_base("SELECT lvl || '_metrics' AS level, m AS metric_name, sid AS session_id, span AS span_id, ok AS success FROM res", _RES))
def _(spark, d):
    field = lambda name: F.get_json_object("document", f"$.{name}").alias(name)
    docs = results.result_documents(_all_results(spark, d))
    return docs.select("level", field("metric_name"), field("session_id"), field("span_id"), field("success").cast("boolean").alias("success"))



