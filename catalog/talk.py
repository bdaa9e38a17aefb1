"""Conversations, roles, judge requests and replies, evaluation cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import frames, query, r6, scratch, typed
from catalog.base_sql import with_base
from catalog.sessions import _AST, _OWN, _SES
from spanloom.operators import agents, conversation, judge, results, roles
from spanloom.operators.conversation import ELEMENT_ORDER
from spanloom.sources import derived

# Conversation elements: (source, side, idx) order inside a span, as the library keeps them.
_EL = """el AS (
  SELECT sid, span, ts, 0 AS source, 0 AS side, 0 AS idx, 'system' AS role, 'You are a careful helper.' AS content FROM sp WHERE kind = 'llm'
  UNION ALL SELECT sid, span, ts, 0, 0, 1, 'user', 'Please calculate item ' || k FROM sp WHERE kind = 'llm'
  UNION ALL SELECT sid, span, ts, 0, 1, 0, 'assistant', completion FROM evr WHERE kind = 'llm' AND sid IS NOT NULL
  UNION ALL SELECT sid, span, ts, 0, 0, n, r, t FROM cp
  UNION ALL SELECT sid, span, ts, 0, 1, 0, 'assistant', text0 FROM ch
  UNION ALL SELECT sid, span, ts, 1, 0, 0, 'user', 'Plan step ' || k FROM sp WHERE kind = 'agent'
  UNION ALL SELECT sid, span, ts, 1, 1, 0, 'assistant', 'Agent reply ' || k || ' done' FROM sp WHERE kind = 'agent' AND k % 2 = 0)"""
_ORD = "ts, source, span, side, idx"
_OUTJ = """CASE WHEN tool_out IS NULL THEN NULL WHEN NOT json_valid(tool_out) THEN '{"value":"' || tool_out || '"}' WHEN tool_out LIKE '{%' THEN tool_out ELSE '{"value":' || tool_out || '}' END"""
# Elements with tool rows, per owning agent.
_AEL = f"""tel AS (
  SELECT sid, span, ts, 2 AS source, 0 AS side, 0 AS idx, 'tool_input' AS role, 'Tool call to ' || name || ': ' || tool_in AS content FROM evt WHERE kind = 'tool' AND sid IS NOT NULL
  UNION ALL SELECT sid, span, ts, 2, 1, 0, 'tool_output', 'Tool ' || name || ' result: ' || {_OUTJ} FROM evt WHERE kind = 'tool' AND sid IS NOT NULL AND tool_out IS NOT NULL),
ael AS (SELECT own.sid, own.agent, x.* EXCLUDE (sid) FROM own JOIN (SELECT * FROM el UNION ALL SELECT * FROM tel) x ON x.sid = own.sid AND x.span = own.span),
aline AS (SELECT *, CASE role WHEN 'user' THEN 'User: ' || content WHEN 'assistant' THEN 'Assistant: ' || content WHEN 'system' THEN 'System: ' || content ELSE '[' || content || ']' END AS line FROM ael)"""
_AGENT_TALK = (_EL, _OWN, _AEL)


@query(
    "U01_O05_conversation_elements",
    with_base(f"SELECT sid AS session_id, span AS span_id, role, content, row_number() OVER (PARTITION BY sid ORDER BY {_ORD}) - 1 AS position FROM el", _EL),
)
def _(spark, d):
    from spanloom.operators.ordered import OrderedGroups

    f = frames(spark, d)
    groups = OrderedGroups(f.elements, ["session_id"], ELEMENT_ORDER, largest=f.largest_conversation)
    return groups.positions().select("session_id", "span_id", "role", "content", "position")


@query(
    "U01_tool_calls_of_models",
    with_base("""SELECT sid AS session_id, span AS span_id, '{"q": ' || k || '}' AS data FROM sp WHERE kind = 'llm' AND k % 16 = 5"""),
)
def _(spark, d):
    return conversation.tool_call_records(typed(spark, d)).select("session_id", "span_id", "data")


@query(
    "U01_conversation_totals",
    with_base(
        """SELECT a.sid AS session_id, a.n AS total_elements, coalesce(b.n, 0) AS total_tool_calls FROM (SELECT sid, count(*) AS n FROM el GROUP BY 1) a
        LEFT JOIN (SELECT sid, count(*) AS n FROM sp WHERE kind = 'llm' AND k % 16 = 5 GROUP BY 1) b ON a.sid = b.sid""",
        _EL,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    return conversation.conversation_totals(conversation.conversation_elements(t), conversation.tool_call_records(t))


@query(
    "A19_U02_agent_conversation",
    with_base("SELECT sid AS session_id, agent, span AS span_id, role, content FROM ael", *_AGENT_TALK),
)
def _(spark, d):
    owned = frames(spark, d).owned
    el = conversation.conversation_elements(owned, ["session_id", "agent"], tools=True)
    return el.select("session_id", "agent", "span_id", "role", "content")


@query(
    "P35_agent_transcripts",
    with_base(f"SELECT sid AS session_id, agent, 0::BIGINT AS part, string_agg(line, chr(10) ORDER BY {_ORD}) AS text FROM aline GROUP BY 1, 2", *_AGENT_TALK),
)
def _(spark, d):
    f = frames(spark, d)
    return f.agent_transcripts


@query(
    "P32_agent_exchanges",
    with_base(
        """SELECT sid AS session_id, 0::BIGINT AS part, string_agg('INPUT: ' || i || chr(10) || 'OUTPUT: ' || o, chr(10) || chr(10) ORDER BY ts, span) AS conversation FROM (
        SELECT sid, ts, span, CASE WHEN kind = 'agent' THEN '{"value":"Plan step ' || k || '"}' ELSE 'None' END AS i,
          CASE WHEN kind <> 'agent' THEN 'None' WHEN k % 2 = 0 THEN '{"value": "Agent reply ' || k || ' done"}' ELSE '{"answer": ' || k || '}' END AS o FROM sp WHERE etype = 'agent') GROUP BY 1"""
    ),
)
def _(spark, d):
    return conversation.agent_exchanges(typed(spark, d))


@query(
    "P25_chat_history",
    with_base(
        f"SELECT span AS span_id, count(*) AS n_messages, string_agg(role || '|' || content, '~' ORDER BY idx) AS history FROM el WHERE source = 0 AND side = 0 GROUP BY 1", _EL
    ),
)
def _(spark, d):
    h = conversation.chat_history(typed(spark, d), "prompts")
    shown = F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"]))
    return h.select("span_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(shown, "~").alias("history"))


@query(
    "P25_chat_history_tool_calls",
    with_base("""SELECT span AS span_id, 'tool_1' AS tool, '{"q": ' || k || '}' AS arguments FROM sp WHERE kind = 'llm' AND k % 16 = 5 AND k % 3 > 0"""),
)
def _(spark, d):
    h = conversation.chat_history(typed(spark, d), "completions")
    calls = h.select("span_id", F.explode("messages").alias("m")).select("span_id", F.explode("m.tool_calls").alias("c"))
    return calls.select("span_id", F.col("c.name").alias("tool"), "c.arguments")


@query(
    "P25_chat_history_whole",
    with_base(
        """SELECT sp.span AS span_id, '[{' || CASE WHEN sp.src = 'c' OR sp.k % 3 > 0 THEN '"role":"assistant",' ELSE '' END || '"content":' || to_json(content) || ',"finish_reason":' || to_json(sp.name)
        || CASE WHEN sp.k % 16 = 5 AND sp.k % 3 = 0 THEN ',"tool_calls.0.arguments":' || to_json('{"q": ' || sp.k || '}') || ',"tool_calls.0.name":"tool_1","tool_calls.0.type":"function"'
          WHEN sp.k % 16 = 5 THEN ',"tool_calls":[{"name":"tool_1","arguments":{"q": ' || sp.k || '},"type":"function"}]'
          WHEN sp.src = 'c' OR sp.k % 3 > 0 THEN ',"tool_calls":[]' ELSE '' END || '}]' AS messages FROM sp JOIN el ON el.span = sp.span WHERE source = 0 AND side = 1""",
        _EL,
    ),
)
def _(spark, d):
    """Completions with fields of their own beside the usual ones."""
    called = F.try_element_at("completions", F.lit("gen_ai.completion.0.tool_calls.0.name")).isNotNull()
    kind = F.map_filter(F.create_map(F.lit("gen_ai.completion.0.tool_calls.0.type"), F.lit("function")), lambda k, v: called)
    more = F.map_concat("completions", F.create_map(F.lit("gen_ai.completion.0.finish_reason"), F.col("entity_name")), kind)
    h = conversation.chat_history(typed(spark, d).withColumn("completions", more), "completions")
    return h.select("span_id", conversation.messages_json(F.col("messages")).alias("messages"))


_CTRL = """(t LIKE '{"next":%' OR length(t) < LEN OR lower(t) LIKE '%text contains%' OR lower(t) LIKE 'the word %'
  OR (lower(t) LIKE 'the %' AND length(t) < 50 AND (lower(t) LIKE '%next%' OR lower(t) LIKE '%finish%')) OR lower(t) IN ('next','finish')
  OR lower(t) LIKE '% is mentioned.' OR lower(t) LIKE '% is present.' OR (lower(t) LIKE '%mentioned%' AND length(t) < 100 AND (lower(t) LIKE '%next%' OR lower(t) LIKE '%finish%')))"""


def _ends(name: str, keys: str, source: str, length: int) -> str:
    """Query of the latest call and the last acceptable answer, per group."""
    control = _CTRL.replace("LEN", str(length))
    return f"""calls{name} AS (SELECT {keys}, x.ts, x.span, 'Please calculate item ' || x.k AS q, regexp_replace(e.completion, '^\\s+|\\s+$', '', 'g') AS t
  FROM {source} x JOIN evr e ON e.span = x.span WHERE x.kind = 'llm'
  UNION ALL SELECT {keys}, x.ts, x.span, (SELECT first(content ORDER BY idx) FROM el WHERE el.span = x.span AND side = 0 AND role <> 'system'), regexp_replace(c.text0, '^\\s+|\\s+$', '', 'g')
  FROM {source} x JOIN ch c ON c.span = x.span WHERE x.src = 'c'),
ends{name} AS (SELECT {keys.replace('x.', '')}, arg_max(q, (ts, span)) AS q, arg_max(t, (ts, span)) FILTER (NOT {control}) AS a FROM calls{name} x GROUP BY ALL)"""


_SENDS = _ends("s", "x.sid", "sp", 10)
_AENDS = _ends("a", "x.sid, x.owner", "ow", 3)


@query("W04_session_endpoints", with_base("SELECT sid AS session_id, q AS input_query, a AS final_response FROM endss", _EL, _SENDS))
def _(spark, d):
    return conversation.endpoints(typed(spark, d))


@query(
    "W04_agent_endpoints",
    with_base("SELECT sid AS session_id, owner AS agent, q AS input_query, a AS final_response FROM endsa", _EL, _OWN, _AENDS),
)
def _(spark, d):
    return conversation.endpoints(frames(spark, d).owned, ["session_id", "agent"], 3)


# --- roles -----------------------------------------------------------------------------------


def _flags(words, column):
    return " + ".join(f"""coalesce(max(CASE WHEN contains({column}, '{w}') THEN 1 ELSE 0 END), 0)""" for w in words)


_BEH = f"""said AS (SELECT sid, agent, {_flags(roles.COORDINATION_WORDS, 'lower(txt)')} AS co, {_flags(roles.PROCESSING_WORDS, 'lower(txt)')} AS pr, {_flags(roles.JSON_MARKS, 'txt')} AS js, max(length(txt)) AS len
  FROM (SELECT sid, agent, string_agg(line, chr(10) ORDER BY {_ORD}) AS txt FROM aline GROUP BY 1, 2) GROUP BY 1, 2),
reps AS (SELECT sid, agent, count(*) AS n, sum(length(r)) AS chars, count(*) FILTER (length(r) < 100) AS short FROM (
  SELECT sid, agent, regexp_replace(u.r, '^\\s+|\\s+$', '', 'g') AS r FROM (SELECT sid, agent, string_agg(line, chr(10) ORDER BY {_ORD}) AS txt FROM aline GROUP BY 1, 2) z, unnest(string_split(txt, chr(10))) AS u(r))
  WHERE r LIKE 'Assistant:%' GROUP BY 1, 2),
beh AS (SELECT a.sid, a.agent, a.llm_calls, a.tool_calls, a.llm_input_tokens AS it, a.llm_output_tokens AS ot, coalesce(len, 0) AS len, coalesce(co, 0) AS co, coalesce(pr, 0) AS pr, coalesce(js, 0) AS js,
  coalesce(n, 0) AS n, coalesce(chars / n, 0) AS al, coalesce(short / n, 0) AS sr FROM ast a LEFT JOIN said ON said.sid = a.sid AND said.agent = a.agent LEFT JOIN reps ON reps.sid = a.sid AND reps.agent = a.agent)"""
_ROLE = """sc AS (SELECT *, CASE WHEN co >= 3 THEN 3 WHEN co >= 1 THEN 1 ELSE 0 END + CASE WHEN sr > 0.8 AND tool_calls = 0 AND co >= 2 THEN 3 ELSE 0 END AS cs,
  CASE WHEN tool_calls > 0 THEN 4 ELSE 0 END + CASE WHEN pr >= 3 THEN 2 WHEN pr >= 1 THEN 1 ELSE 0 END + CASE WHEN al > 200 THEN 2 WHEN al > 100 THEN 1 ELSE 0 END + CASE WHEN ot > it THEN 1 ELSE 0 END AS ps FROM beh),
rl AS (SELECT *, CASE WHEN ps >= 4 AND ps > cs THEN 'processor' WHEN cs >= 4 AND cs > ps THEN 'coordinator' WHEN abs(cs - ps) <= 1 THEN 'mixed' ELSE 'unknown' END AS role,
  CASE WHEN cs + ps > 0 THEN abs(cs - ps) / (cs + ps) ELSE 0 END AS conf FROM sc),
sk AS (SELECT *, role = 'coordinator' OR (role = 'mixed' AND NOT (pr >= 2 OR tool_calls >= 2 OR al >= 150)) AS skip FROM rl)"""


def _behaviour(spark, d):
    t = typed(spark, d)
    el = conversation.conversation_elements(frames(spark, d).owned, ["session_id", "agent"], tools=True)
    return roles.agent_behaviour(el, agents.agent_stats(t), agents.agent_tools(t))


@query(
    "A25_agent_behaviour",
    with_base(
        """SELECT sid AS session_id, agent, len AS conversation_length, co AS coordination_signals, pr AS processing_signals, js AS json_signals, n AS assistant_responses,
        round(al, 6) AS avg_response_length, round(sr, 6) AS short_response_ratio FROM beh""",
        *_AGENT_TALK, _AST, _BEH,
    ),
)
def _(spark, d):
    return _behaviour(spark, d).select(
        "session_id", "agent", "conversation_length", "coordination_signals", "processing_signals", "json_signals",
        "assistant_responses", r6("avg_response_length"), r6("short_response_ratio"),
    )


@query(
    "A26_agent_roles",
    with_base("SELECT sid AS session_id, agent, cs AS coordinator_score, ps AS processor_score, role, round(conf, 6) AS confidence FROM rl", *_AGENT_TALK, _AST, _BEH, _ROLE),
)
def _(spark, d):
    out = roles.agent_roles(_behaviour(spark, d))
    return out.select("session_id", "agent", "coordinator_score", "processor_score", "role", r6("confidence"))


@query("F25_skipped_coordinators", with_base("SELECT sid AS session_id, agent, skip FROM sk", *_AGENT_TALK, _AST, _BEH, _ROLE))
def _(spark, d):
    return roles.skip_coordinators(roles.agent_roles(_behaviour(spark, d))).select("session_id", "agent", "skip")


# --- judge requests -----------------------------------------------------------------------------


def _prompt_sql(metric: str, **fields: str) -> str:
    c = judge.CRITERIA[metric]
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [lit(c.question)]
    for f in c.fields:
        parts += [lit(f"\n{f}:\n"), f"coalesce({fields[f]}, '')"]
    return " || ".join([*parts, lit(judge.ANSWER_FORMAT)])


_ELJSON = f"""ej AS (SELECT sid, '[' || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(content) || '}}', ',' ORDER BY {_ORD}) || ']' AS j FROM el GROUP BY 1)"""


def _session_request(key: str, metric: str):
    @query(
        key,
        with_base(f"SELECT ses.sid AS session_id, {_prompt_sql(metric, conversation='j')} AS prompt FROM ses LEFT JOIN ej ON ej.sid = ses.sid", _SES, _EL, _ELJSON),
    )
    def _(spark, d):
        f = frames(spark, d)
        asked = judge.conversation_requests(metric, f.conversations, f.sessions)
        return asked.select("session_id", "prompt")


def _agent_request(key: str, metric: str):
    skip = judge.CRITERIA[metric].skip_coordinators
    keep = "WHERE NOT EXISTS (SELECT 1 FROM sk WHERE sk.sid = z.sid AND sk.agent = z.agent AND sk.skip)" if skip else ""
    ctes = (*_AGENT_TALK, _AST, _BEH, _ROLE) if skip else _AGENT_TALK

    @query(
        key,
        with_base(
            f"SELECT z.sid AS session_id, z.agent, {_prompt_sql(metric, conversation='txt')} AS prompt FROM (SELECT sid, agent, string_agg(line, chr(10) ORDER BY {_ORD}) AS txt FROM aline GROUP BY 1, 2) z {keep}",
            *ctes,
        ),
    )
    def _(spark, d):
        f = frames(spark, d)
        asked = judge.agent_conversation_requests(metric, f.agent_transcripts, f.roles)
        return asked.select("session_id", "agent", "prompt")


for _key, _metric in [
    ("K02_groundedness", "Groundedness"),
    ("K03_component_conflict", "ComponentConflictRate"),
    ("K04_consistency", "Consistency"),
    ("K05_context_preservation", "ContextPreservation"),
    ("K06_information_retention", "InformationRetention"),
    ("K07_response_completeness", "ResponseCompleteness"),
    ("K08_workflow_cohesion", "WorkflowCohesionIndex"),
]:
    _session_request(f"{_key}_session", _metric)
    if "agent" in judge.CRITERIA[_metric].levels:
        _agent_request(f"{_key}_agent", _metric)


_TRUTH = "truth AS (SELECT DISTINCT 'Please calculate item ' || k AS query, 'The answer is ' || (k * k) AS answer FROM ev)"


_KNOWN = "coalesce(answer, 'No ground truth available')"


def _truth(spark, d):
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    e = derived.table(spark, d, "events", "props string").select(k.alias("k")).distinct()
    return e.select(
        F.concat(F.lit("Please calculate item "), F.col("k").cast("string")).alias("query"),
        F.concat(F.lit("The answer is "), (F.col("k") * F.col("k")).cast("string")).alias("answer"),
    )


@query(
    "P34_ground_truth",
    with_base("SELECT sid AS session_id, coalesce(answer, 'No ground truth available') AS ground_truth FROM endss LEFT JOIN truth ON truth.query = endss.q", _EL, _SENDS, _TRUTH),
)
def _(spark, d):
    ends = conversation.endpoints(typed(spark, d)).withColumnRenamed("input_query", "query")
    return judge.with_ground_truth(ends, _truth(spark, d)).select("session_id", "ground_truth")


@query(
    "K09_goal_success_session",
    with_base(
        f"SELECT sid AS session_id, {_prompt_sql('GoalSuccessRate', query='q', response='a', ground_truth=_KNOWN)} AS prompt FROM endss LEFT JOIN truth ON truth.query = endss.q",
        _EL, _SENDS, _TRUTH,
    ),
)
def _(spark, d):
    asked, _errors = judge.endpoint_requests("GoalSuccessRate", conversation.endpoints(typed(spark, d)), "session", _truth(spark, d))
    return asked.select("session_id", "prompt")


@query(
    "K10_intent_recognition_agent",
    with_base(
        f"SELECT sid AS session_id, owner AS agent, {_prompt_sql('IntentRecognitionAccuracy', query='q', response='a')} AS prompt FROM endsa WHERE nullif(q, '') IS NOT NULL AND nullif(a, '') IS NOT NULL",
        _EL, _OWN, _AENDS,
    ),
)
def _(spark, d):
    ends = conversation.endpoints(frames(spark, d).owned, ["session_id", "agent"], 3)
    return judge.endpoint_requests("IntentRecognitionAccuracy", ends, "agent")[0].select("session_id", "agent", "prompt")


@query(
    "K09_goal_success_agent_errors",
    with_base(
        "SELECT sid AS session_id, owner AS agent_id, -1.0::double AS value_num FROM endsa WHERE nullif(q, '') IS NULL OR nullif(a, '') IS NULL", _EL, _OWN, _AENDS
    ),
)
def _(spark, d):
    ends = conversation.endpoints(frames(spark, d).owned, ["session_id", "agent"], 3)
    return judge.endpoint_requests("GoalSuccessRate", ends, "agent", _truth(spark, d))[1].select("session_id", "agent_id", "value_num")


@query(
    "K10_intent_recognition_session",
    with_base(f"SELECT sid AS session_id, {_prompt_sql('IntentRecognitionAccuracy', query='q', response='a')} AS prompt FROM endss", _EL, _SENDS),
)
def _(spark, d):
    ends = conversation.endpoints(typed(spark, d))
    return judge.endpoint_requests("IntentRecognitionAccuracy", ends, "session")[0].select("session_id", "prompt")


@query(
    "K11_tool_utilization",
    with_base(f"SELECT span AS span_id, tool_in AS tool_input, {_OUTJ} AS tool_output FROM evt WHERE kind = 'tool' AND sid IS NOT NULL AND tool_out IS NOT NULL"),
)
def _(spark, d):
    from spanloom.operators.parse import attach_tool_definitions

    t = typed(spark, d)
    asked = judge.tool_use_requests(attach_tool_definitions(t)).select("span_id", "prompt")
    field = lambda a, b: F.regexp_extract("prompt", rf"(?s)\n{a}:\n(.*)\n{b}", 1)
    return asked.select("span_id", field("tool_input", "tool_output:").alias("tool_input"), field("tool_output", "Answer with one").alias("tool_output"))


@query(
    "K12_task_delegation",
    with_base(
        "SELECT span AS span_id, "
        + _prompt_sql(
            "TaskDelegationAccuracy",
            agent_input="""CASE WHEN kind = 'agent' THEN '{"value":"Plan step ' || k || '"}' END""",
            agent_output="""CASE WHEN kind <> 'agent' THEN NULL WHEN k % 2 = 0 THEN '{"value": "Agent reply ' || k || ' done"}' ELSE '{"answer": ' || k || '}' END""",
        )
        + " AS prompt FROM sp WHERE etype = 'agent'"
    ),
)
def _(spark, d):
    return judge.delegation_requests(typed(spark, d)).select("span_id", "prompt")


@query(
    "K01_P33_request_rendering",
    with_base(
        "SELECT span AS span_id, sha256('TaskDelegationAccuracy|span|' || sid || '|' || span) AS request_id FROM sp WHERE etype = 'agent'"
    ),
)
def _(spark, d):
    return judge.delegation_requests(typed(spark, d)).select("span_id", "request_id")


_REP = """rep AS (SELECT 'doc' || doc_id AS id, 1 AS no, quality AS sc, 'doc ' || doc_id AS why FROM labels UNION ALL
  SELECT 'doc' || doc_id, 2, CASE WHEN doc_id % 5 > 1 AND doc_id % 10 = 7 THEN NULL ELSE toxic END,
  CASE WHEN doc_id % 5 = 1 THEN 'lit ' || doc_id WHEN doc_id % 5 > 1 AND doc_id % 10 = 7 THEN NULL ELSE 'doc ' || doc_id END FROM labels)"""


@query(
    "A37_judge_consensus",
    f"""WITH {_REP} SELECT id AS request_id, CASE WHEN count(*) FILTER (sc IS NULL) = 0 THEN round(avg(sc), 6) END AS score,
    CASE WHEN count(*) FILTER (sc IS NULL) = 0 THEN arg_max(why, no) END AS reasoning, count(*) FILTER (sc IS NULL) > 0 AS failed FROM rep GROUP BY 1""",
)
def _(spark, d):
    agreed = judge.consensus(judge.parsed_replies(derived.judge_replies(spark, d)))
    return agreed.select("request_id", r6("score"), "reasoning", F.col("error").isNotNull().alias("failed"))


@query(
    "A37_judged_results",
    with_base(
        """SELECT span AS span_id, 'TaskDelegationAccuracy' AS metric_name, 'span' AS aggregation_level, round(n % 2 * 1e0, 6) AS value_num,
        CASE WHEN n % 2 = 1 THEN 'delegation_accurate' ELSE 'delegation_not_accurate' END AS label, 'why ' || n AS reasoning
        FROM (SELECT span, cast(regexp_extract(span, '([0-9]+)$', 1) AS bigint) AS n FROM sp WHERE etype = 'agent')"""
    ),
)
def _(spark, d):
    asked = judge.delegation_requests(typed(spark, d))
    n = F.regexp_extract("span_id", r"([0-9]+)$", 1).cast("bigint")
    reply = F.to_json(F.struct((n % 2).alias("metric_score"), F.concat(F.lit("why "), n.cast("string")).alias("score_reasoning")))
    path = scratch(spark, "replies")
    asked.select("request_id", F.lit(1).alias("judge_no"), reply.alias("reply")).write.json(path)
    agreed = judge.consensus(judge.parsed_replies(judge.read_replies(spark, path)))
    out = results.with_labels(judge.judged_results(asked, agreed))
    return out.select("span_id", "metric_name", "aggregation_level", r6("value_num"), "label", "reasoning")
