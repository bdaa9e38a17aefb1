"""The native metrics and model confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import frames, query, r6, typed
from catalog.base_sql import TREE, with_base
from catalog.sessions import _AM, _AST, _OWN, _POP, _PRE, _SES
from spanloom.operators import agents, confidence, metrics, population, sessions


@query(
    "M01_tool_error_rate",
    with_base(
        """SELECT sid AS session_id, count(*) FILTER (etype = 'tool') AS tool_calls, count(*) FILTER (etype = 'tool' AND err) AS tool_errors,
        round(coalesce(100.0 * count(*) FILTER (etype = 'tool' AND err) / nullif(count(*) FILTER (etype = 'tool'), 0), 0), 6) AS tool_error_rate FROM sp GROUP BY 1"""
    ),
)
def _(spark, d):
    return metrics.tool_error_rate(typed(spark, d)).withColumn("tool_error_rate", F.round("tool_error_rate", 6))


@query("M01_error_spans", with_base("SELECT sid AS session_id, span AS span_id FROM sp WHERE etype = 'tool' AND err"))
def _(spark, d):
    return metrics.tool_error_spans(typed(spark, d))


@query(
    "M02_agent_tool_error_rate",
    with_base(
        """SELECT sid AS session_id, owner AS agent, count(*) FILTER (etype = 'tool') AS tool_calls, count(*) FILTER (etype = 'tool' AND err) AS tool_errors,
        round(coalesce(100.0 * count(*) FILTER (etype = 'tool' AND err) / nullif(count(*) FILTER (etype = 'tool'), 0), 0), 6) AS tool_error_rate FROM ow GROUP BY 1, 2""",
        _OWN,
    ),
)
def _(spark, d):
    out = metrics.agent_tool_error_rate(frames(spark, d).owned)
    return out.withColumn("tool_error_rate", F.round("tool_error_rate", 6))


def _cycle_sql(source: str, keys: str) -> str:
    """Greedy scan in SQL: step by the smallest repeat length, else by one."""
    return f"""seqs AS ({source}),
scan AS (
  SELECT {keys}, names, len(names) AS n, 1 AS i, 0::BIGINT AS cycles FROM seqs
  UNION ALL
  SELECT {keys}, names, n, i + coalesce(k, 1), cycles + CASE WHEN k IS NULL THEN 0 ELSE 1 END FROM (
    SELECT *, list_min([x FOR x IN range(2, (n - i + 1) // 2 + 1) IF names[i:i + x - 1] = names[i + x:i + 2 * x - 1]]) AS k FROM scan WHERE i <= n))"""




@query(
    "M03_cycles",
    with_base(
        "SELECT sid AS session_id, max(n) AS n_events, max(cycles) AS cycles FROM scan GROUP BY 1",
        _cycle_sql("SELECT sid, list(name ORDER BY ts, span) AS names FROM sp WHERE etype IN ('agent','tool') GROUP BY 1", "sid"),
    ),
)
def _(spark, d):
    return metrics.cycles(typed(spark, d), frames(spark, d).largest_session)


@query(
    "M04_agent_cycles",
    with_base(
        "SELECT sid AS session_id, owner AS agent, max(n) AS n_events, max(cycles) AS cycles FROM scan GROUP BY 1, 2",
        _OWN,
        _PRE.removeprefix(TREE + ", "),
        _cycle_sql(
            "SELECT ow.sid, owner, list(ow.name ORDER BY pos) AS names FROM ow JOIN pre ON pre.sid = ow.sid AND pre.span = ow.span WHERE ow.etype IN ('agent','tool') GROUP BY 1, 2",
            "sid, owner",
        ),
    ),
)
def _(spark, d):
    return metrics.agent_cycles(frames(spark, d).owned)


# Agent spans carry an event that names the agent; error spans' first event does not.
_TRANS = """ment AS (SELECT sid, span, ts, CASE WHEN k % 7 = 0 THEN 'lead_agent' ELSE ['planner_agent','research_agent','writer_agent'][k % 3 + 1] END AS a FROM sp WHERE kind = 'agent'),
prev AS (SELECT *, lag(a) OVER (PARTITION BY sid ORDER BY ts, span) AS p FROM ment),
tr AS (SELECT sid, span, p || ' -> ' || a AS transition FROM prev WHERE p <> a),
trc AS (SELECT sid, transition, count(*) AS n FROM tr GROUP BY 1, 2)"""


@query("W02_agent_transitions", with_base("SELECT sid AS session_id, span AS span_id, transition FROM tr", _TRANS))
def _(spark, d):
    return metrics.agent_transitions(typed(spark, d), frames(spark, d).largest_session)


@query("M05_agent_to_agent_counts", with_base("SELECT sid AS session_id, transition, n FROM trc", _TRANS))
def _(spark, d):
    return metrics.transition_counts(metrics.agent_transitions(typed(spark, d), frames(spark, d).largest_session))


@query(
    "M05_agent_to_agent",
    with_base(
        """SELECT ses.sid AS session_id, coalesce('{' || string_agg('"' || transition || '":' || n, ',' ORDER BY transition) || '}', '{}') AS value_json, 0::BIGINT AS part,
        cast(coalesce(sum(n), 0) AS bigint) AS total_transitions, count(transition) AS unique_transitions FROM ses LEFT JOIN trc ON trc.sid = ses.sid GROUP BY 1""",
        _SES, _TRANS,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    counts = metrics.transition_counts(metrics.agent_transitions(t, frames(spark, d).largest_session))
    return metrics.agent_to_agent(counts, sessions.sessions(t))


_TOOLFLOW = """tf AS (SELECT sp.sid, CASE WHEN evr.tool_flow IS NULL THEN NULL ELSE '(Agent: ' || evr.tool_flow || ') -> (Tool: ' || sp.name || ')' END AS interaction
  FROM sp JOIN evr ON evr.span = sp.span WHERE etype = 'tool'),
bad AS (SELECT DISTINCT sid FROM tf WHERE interaction IS NULL)"""


@query(
    "M06_agent_to_tool",
    with_base(
        """SELECT sid AS session_id, interaction, count(*) AS n, false AS failed FROM tf WHERE sid NOT IN (SELECT sid FROM bad) GROUP BY 1, 2
        UNION ALL SELECT sid, NULL, -1, true FROM bad""",
        _TOOLFLOW,
    ),
)
def _(spark, d):
    out = metrics.agent_to_tool(typed(spark, d))
    return out.select("session_id", "interaction", "n", F.col("error").isNotNull().alias("failed"))


_STEPS = """steps AS (SELECT sid, source, target FROM (SELECT sid, lag(name) OVER w AS source, lag(span) OVER w AS b, name AS target FROM sp WHERE etype IN ('agent','tool')
  WINDOW w AS (PARTITION BY sid ORDER BY ts, span)) WHERE b IS NOT NULL),
edges AS (SELECT DISTINCT sid, source, target FROM steps)"""


@query("W03_path_edges", with_base("SELECT sid AS session_id, source, target FROM edges", _STEPS))
def _(spark, d):
    return metrics.path_edges(typed(spark, d), frames(spark, d).largest_session)


_PAIR = ("app1_c4ca4238-a0b9-2382-0dcc-509a6f75849b", "app2_c81e728d-9d4c-2f63-6f06-7f89cc14862c")


@query(
    "U04_edge_difference",
    with_base(
        f"""(SELECT source, target FROM edges WHERE sid = '{_PAIR[0]}' EXCEPT SELECT source, target FROM edges WHERE sid = '{_PAIR[1]}')
        UNION ALL (SELECT source, target FROM edges WHERE sid = '{_PAIR[1]}' EXCEPT SELECT source, target FROM edges WHERE sid = '{_PAIR[0]}')""",
        _STEPS,
    ),
)
def _(spark, d):
    return metrics.edge_difference(metrics.path_edges(typed(spark, d), frames(spark, d).largest_session), *_PAIR)


@query(
    "M07_J08_path_variance",
    with_base(
        """SELECT (SELECT count(*) FROM ses) AS n_sessions, round((SELECT avg((SELECT count(*) FROM edges e WHERE e.sid = a.sid) + (SELECT count(*) FROM edges e WHERE e.sid = b.sid)
          - 2 * coalesce(c.n, 0)) FROM ses a JOIN ses b ON a.sid < b.sid
          LEFT JOIN (SELECT x.sid AS s1, y.sid AS s2, count(*) AS n FROM edges x JOIN edges y ON x.source = y.source AND x.target = y.target AND x.sid < y.sid GROUP BY 1, 2) c
          ON c.s1 = a.sid AND c.s2 = b.sid), 6) AS path_variance""",
        _SES, _STEPS,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    out = metrics.path_variance(metrics.path_edges(t, frames(spark, d).largest_session), t.select("session_id").distinct())
    return out.select("n_sessions", r6("path_variance"))


_APP = {n: c for n, c in metrics.PASSIVE_APP.items()}


@query(
    "M08_passive_app",
    with_base(
        "SELECT sid AS session_id, app AS app_name, " + ", ".join(f"round(cast({c} AS double), 6) AS eval_app_{n}" for n, c in _APP.items()) + " FROM sm", *_POP
    ),
)
def _(spark, d):
    out = metrics.passive_app(frames(spark, d).session_metrics)
    return out.select("session_id", "app_name", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns if c.startswith("eval")])


_AGENT = {n: ("duration" if n == "duration" else c) for n, c in _APP.items() if not n.startswith("graph")}


@query(
    "M09_passive_agents",
    with_base(
        "SELECT ses.sid AS session_id, a.agent, " + ", ".join(f"round(cast(coalesce(am.{c}, 0) AS double), 6) AS eval_agent_{n}" for n, c in _AGENT.items())
        + " FROM ses, (SELECT DISTINCT agent FROM am) a LEFT JOIN am ON am.sid = ses.sid AND am.agent = a.agent",
        _SES, _AST, _AM,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    grid = population.aligned_agent_measures(population.agent_metrics(agents.agent_stats(t)), sessions.sessions(t))
    out = metrics.passive_agents(grid)
    return out.select("session_id", "agent", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns if c.startswith("eval")])


@query(
    "M10_workflow_efficiency",
    with_base(
        """SELECT ses.sid AS session_id, count(transition) AS unique_transitions, round(CASE WHEN count(transition) <= 2 THEN 1e0 ELSE greatest(0e0, 1e0 - (count(transition) - 2) * 0.2e0) END, 6) AS efficiency
        FROM ses LEFT JOIN trc ON trc.sid = ses.sid GROUP BY 1""",
        _SES, _TRANS,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    counts = metrics.transition_counts(metrics.agent_transitions(t, frames(spark, d).largest_session))
    return metrics.workflow_efficiency(counts, sessions.sessions(t)).select("session_id", "unique_transitions", r6("efficiency"))


_LOGS = """lp AS (SELECT sid, span, 'a' AS token, cast('-0.' || lpad(cast(k AS varchar), 2, '0') AS double) AS logprob FROM sp WHERE kind = 'llm' AND k % 5 = 2
  UNION ALL SELECT sid, span, 'b', cast('-1.' || lpad(cast(99 - k AS varchar), 2, '0') AS double) FROM sp WHERE kind = 'llm' AND k % 5 = 2)"""


@query("M14_token_logprobs", with_base("SELECT sid AS session_id, span AS span_id, token, round(logprob, 6) AS logprob FROM lp", _LOGS))
def _(spark, d):
    return confidence.token_logprobs(typed(spark, d)).select("session_id", "span_id", "token", r6("logprob"))


_CONF = """round(coalesce(exp(avg(m)), -1), 6) AS average_confidence, round(coalesce(exp(min(lo)), -1), 6) AS minimum_confidence, round(coalesce(exp(max(hi)), -1), 6) AS maximum_confidence"""


@query(
    "M11_M12_M13_session_confidence",
    with_base(
        f"SELECT ses.sid AS session_id, {_CONF} FROM ses LEFT JOIN (SELECT sid, span, avg(logprob) AS m, min(logprob) AS lo, max(logprob) AS hi FROM lp GROUP BY 1, 2) x ON x.sid = ses.sid GROUP BY 1",
        _SES, _LOGS,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    out = confidence.confidence(confidence.token_logprobs(t), sessions.sessions(t))
    return out.select("session_id", r6("average_confidence"), r6("minimum_confidence"), r6("maximum_confidence"))


@query(
    "M15_agent_confidence",
    with_base(
        f"""SELECT a.sid AS session_id, a.agent, {_CONF} FROM ast a LEFT JOIN (SELECT ow.sid, owner, ow.span, avg(logprob) AS m, min(logprob) AS lo, max(logprob) AS hi FROM ow JOIN lp ON lp.sid = ow.sid AND lp.span = ow.span GROUP BY 1, 2, 3) x
        ON x.sid = a.sid AND x.owner = a.agent GROUP BY 1, 2""",
        _AST, _OWN, _LOGS,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    keys = ["session_id", "agent"]
    out = confidence.confidence(confidence.token_logprobs(frames(spark, d).owned, keys), agents.agent_stats(t), keys)
    return out.select(*keys, r6("average_confidence"), r6("minimum_confidence"), r6("maximum_confidence"))


@query(
    "M16_tool_status",
    with_base(
        """SELECT sp.span AS span_id, CASE WHEN tool_out IS NULL OR NOT json_valid(tool_out) THEN NULL WHEN et = 'error' AND evr.k % 2 = 0 THEN NULL WHEN evr.k % 20 = 6 THEN NULL
        WHEN evr.k % 20 = 11 THEN 'clean' WHEN evr.k % 5 = 0 THEN 'ok' WHEN evr.k % 5 = 1 THEN 'failed' WHEN evr.k % 5 = 3 THEN 'partial' END AS status
        FROM sp JOIN evr ON evr.span = sp.span WHERE etype = 'tool'"""
    ),
)
def _(spark, d):
    return metrics.tool_status(typed(spark, d)).select("span_id", "status")


@query(
    "M17_span_counts",
    with_base("SELECT sid AS session_id, count(*) AS n_spans, count(*) FILTER (etype = 'agent') AS n_agents, count(*) FILTER (etype = 'workflow') AS n_workflows FROM sp GROUP BY 1"),
)
def _(spark, d):
    return metrics.span_counts(typed(spark, d))
