"""Sessions, their filters and enrichments, the execution forest, agents, populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import frames, micros, query, r6, typed
from catalog.base_sql import TREE, num, with_base
from spanloom.operators import agents, population, sessions, tree

_RANGE = ("2024-01-05T00:00:00Z", "2024-01-06T12:00:00Z")
_RS, _RE = "epoch_us(TIMESTAMP '2024-01-05 00:00:00')", "epoch_us(TIMESTAMP '2024-01-06 12:00:00')"

# One row per session with its measures.
_SUM = lambda kind, v: f"coalesce(sum(CASE WHEN etype = '{kind}' THEN {v} END), 0)"
_SES = f"""ses AS (SELECT sid, min(ts) AS t0, max(ts) AS t1, count(*) AS n_spans,
  coalesce((max(end_s) - min(start_s)) * 1000, (max(ts) - min(ts)) / 1000.0) AS dur,
  coalesce(arg_min(app_cand, (ts, span)) FILTER (app_cand IS NOT NULL), 'unknown-app') AS app,
  arg_min(span, (ts, span)) AS first_span,
  count(*) FILTER (etype = 'llm') AS llm_calls, count(*) FILTER (etype = 'llm' AND err) AS llm_fails,
  count(*) FILTER (etype = 'tool') AS tool_calls, count(*) FILTER (etype = 'tool' AND err) AS tool_fails,
  {_SUM('tool', 'dur_ms')} AS tool_duration, {_SUM('llm', 'dur_ms')} AS llm_duration,
  cast({_SUM('llm', num('in_tok'))} AS bigint) AS llm_input_tokens, cast({_SUM('llm', num('out_tok'))} AS bigint) AS llm_output_tokens,
  cast({_SUM('llm', num('tot_tok'))} AS bigint) AS llm_total_tokens
  FROM sp GROUP BY sid)"""


@query(
    "A09_A10_sessions",
    with_base("SELECT sid AS session_id, t0 AS start_us, t1 AS end_us, n_spans, round(dur, 3) AS duration_ms, app AS app_name, first_span AS first_span_id FROM ses", _SES),
)
def _(spark, d):
    return sessions.sessions(typed(spark, d)).select(
        "session_id", micros("start_timestamp").alias("start_us"), micros("end_timestamp").alias("end_us"), "n_spans",
        F.round("duration_ms", 3).alias("duration_ms"), "app_name", "first_span_id",
    )


@query(
    "A11_A12_session_counters",
    with_base(
        """SELECT sid AS session_id, llm_calls, llm_fails, tool_calls, tool_fails, round(tool_duration, 6) AS tool_duration,
        round(llm_duration, 6) AS llm_duration, llm_input_tokens, llm_output_tokens, llm_total_tokens FROM ses""",
        _SES,
    ),
)
def _(spark, d):
    return sessions.sessions(typed(spark, d)).select(
        "session_id", "llm_calls", "llm_fails", "tool_calls", "tool_fails", r6("tool_duration"), r6("llm_duration"),
        "llm_input_tokens", "llm_output_tokens", "llm_total_tokens",
    )


@query(
    "A13_distinct_names",
    with_base("SELECT DISTINCT sid AS session_id, etype AS kind, name FROM sp WHERE etype IN ('agent','tool')"),
)
def _(spark, d):
    t = typed(spark, d)
    named = lambda k: sessions.entity_names(t, k).select("session_id", F.lit(k).alias("kind"), F.col("entity_name").alias("name"))
    return named("agent").unionByName(named("tool"))


@query("P27_session_app_name", with_base("SELECT sid AS session_id, app AS app_name FROM ses", _SES))
def _(spark, d):
    return sessions.sessions(typed(spark, d)).select("session_id", "app_name")


@query(
    "F14_sessions_by_criteria",
    with_base("SELECT sid AS session_id, count(*) AS n_spans FROM sp GROUP BY 1 HAVING bool_or(etype IN ('agent','graph')) AND NOT bool_or(err) AND count(*) >= 5"),
)
def _(spark, d):
    return sessions.by_criteria(typed(spark, d), ["agent", "graph"], False, 5)


@query("F13_session_by_text", with_base("SELECT min(sid) AS session_id FROM ses WHERE sid LIKE '%a5%'", _SES))
def _(spark, d):
    return sessions.by_id_text(sessions.sessions(typed(spark, d)).select("session_id"), "a5")


@query("F15_session_by_id", with_base("SELECT sid AS session_id, n_spans FROM ses WHERE sid = 'app1_c4ca4238-a0b9-2382-0dcc-509a6f75849b'", _SES))
def _(spark, d):
    return sessions.by_id(sessions.sessions(typed(spark, d)), "app1_c4ca4238-a0b9-2382-0dcc-509a6f75849b").select("session_id", "n_spans")


@query("F16_overlapping_sessions", with_base(f"SELECT sid AS session_id FROM ses WHERE t1 >= {_RS} AND t0 <= {_RE}", _SES))
def _(spark, d):
    return sessions.overlapping(sessions.sessions(typed(spark, d)), *_RANGE).select("session_id")


@query(
    "U06_sessions_added_and_removed",
    with_base(f"SELECT sid AS session_id FROM ses WHERE sid NOT IN (SELECT sid FROM ses WHERE t1 >= {_RS} AND t0 <= {_RE}) UNION ALL SELECT sid FROM ses WHERE t1 >= {_RS} AND t0 <= {_RE}", _SES),
)
def _(spark, d):
    every = sessions.sessions(typed(spark, d)).select("session_id", "start_timestamp", "end_timestamp")
    some = sessions.overlapping(every, *_RANGE)
    return sessions.add_sessions(sessions.remove_sessions(every, some), some).select("session_id")


@query("A32_type_counts", with_base("SELECT sid AS session_id, etype AS entity_type, count(*) AS n_spans FROM sp GROUP BY 1, 2"))
def _(spark, d):
    return sessions.type_counts(typed(spark, d))


@query(
    "A32_session_summary",
    with_base(
        """SELECT sid AS session_id, min(ts) AS start_us, max(ts) AS end_us, count(*) AS n_spans, count(*) FILTER (etype = 'agent') AS n_agent,
        count(*) FILTER (etype = 'tool') AS n_tool, count(*) FILTER (etype = 'llm') AS n_llm FROM sp GROUP BY 1"""
    ),
)
def _(spark, d):
    out = sessions.session_summary(typed(spark, d), ["agent", "tool", "llm"])
    return out.select("session_id", micros("start_timestamp").alias("start_us"), micros("end_timestamp").alias("end_us"), "n_spans", "n_agent", "n_tool", "n_llm")


@query(
    "O04_session_order",
    with_base("SELECT sid AS session_id, span AS span_id, row_number() OVER (PARTITION BY sid ORDER BY ts, span) - 1 AS position FROM sp"),
)
def _(spark, d):
    from spanloom.operators.ordered import OrderedGroups

    rows = sessions.with_order(typed(spark, d)).select("session_id", *sessions.SESSION_ORDER)
    return OrderedGroups(rows, ["session_id"], sessions.SESSION_ORDER, largest=frames(spark, d).largest_session).positions().select("session_id", "span_id", "position")


_GRAPH = """gr AS (SELECT sid, CASE WHEN k % 10 = 0 THEN cast('0.' || lpad(cast(k AS varchar), 2, '0') AS double) END AS det,
  cast('0.5' || k AS double) AS dyn, '{"nodes": ' || k || '}' AS graph FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, span) AS rn FROM sp WHERE etype = 'graph') WHERE rn = 1)"""


@query("P36_graph_attributes", with_base("SELECT sid AS session_id, round(det, 6) AS graph_determinism, round(dyn, 6) AS graph_dynamism, graph FROM gr", _GRAPH))
def _(spark, d):
    return sessions.graph_attributes(typed(spark, d)).select("session_id", r6("graph_determinism"), r6("graph_dynamism"), "graph")


@query(
    "A23_workflow_summary",
    with_base("SELECT sid AS session_id, name AS workflow, count(*) AS total_executions, bool_or(err) AS has_errors FROM sp WHERE etype = 'workflow' GROUP BY 1, 2"),
)
def _(spark, d):
    return sessions.workflow_summary(typed(spark, d))


@query(
    "A23_workflow_runs",
    with_base(
        """SELECT sid AS session_id, name AS workflow, span AS span_id, ts AS ts_us, err AS has_error, row_number() OVER (PARTITION BY sid ORDER BY ts, span) - 1 AS position,
        row_number() OVER (PARTITION BY sid, name ORDER BY ts, span) - 1 AS workflow_position FROM sp WHERE etype = 'workflow'"""
    ),
)
def _(spark, d):
    out = sessions.workflow_runs(typed(spark, d), frames(spark, d).largest_session)
    return out.select("session_id", "workflow", "span_id", micros("timestamp").alias("ts_us"), "has_error", "position", "workflow_position")


@query("A23_workflow_totals", with_base("SELECT sid AS session_id, count(DISTINCT name) AS total_workflows, count(*) AS total_executions, bool_or(err) AS has_errors FROM sp WHERE etype = 'workflow' GROUP BY 1"))
def _(spark, d):
    return sessions.workflow_totals(typed(spark, d))


@query(
    "A24_tool_calls",
    with_base(
        """SELECT sid AS session_id, name AS tool, span AS span_id, ts AS ts_us, err AS has_error, row_number() OVER (PARTITION BY sid ORDER BY ts, span) - 1 AS position,
        row_number() OVER (PARTITION BY sid, name ORDER BY ts, span) - 1 AS tool_position FROM sp WHERE etype = 'tool'"""
    ),
)
def _(spark, d):
    out = sessions.tool_calls(typed(spark, d), frames(spark, d).largest_session)
    return out.select("session_id", "tool", "span_id", micros("timestamp").alias("ts_us"), "has_error", "position", "tool_position")


@query(
    "P29_P30_P31_workflow_exchange",
    with_base(
        """SELECT sid AS session_id, CASE WHEN k % 2 = 0 THEN 'Query ' || k ELSE 'Ask ' || k END AS query, CASE WHEN k % 4 = 3 THEN '' ELSE 'End ' || k END AS response,
        CASE WHEN k % 4 = 3 THEN '' ELSE 'Answer ' || k || chr(10) || chr(10) || 'End ' || k END AS responses
        FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts DESC, span DESC) AS rn FROM sp WHERE etype = 'workflow') WHERE rn = 1"""
    ),
)
def _(spark, d):
    return sessions.workflow_exchange(typed(spark, d))


@query(
    "A24_tool_usage",
    with_base("SELECT sid AS session_id, name AS tool, count(*) AS total_calls, count(*) FILTER (err) AS failed_calls FROM sp WHERE etype = 'tool' GROUP BY 1, 2"),
)
def _(spark, d):
    return sessions.tool_usage(typed(spark, d))


@query(
    "A24_tool_usage_summary",
    with_base(
        """SELECT sid AS session_id, count(*) AS total_tool_calls, count(DISTINCT name) AS unique_tools, count(*) FILTER (err) AS failed_calls,
        round(count(*) FILTER (NOT err) / count(*), 6) AS success_rate FROM sp WHERE etype = 'tool' GROUP BY 1"""
    ),
)
def _(spark, d):
    out = sessions.tool_usage_summary(typed(spark, d))
    return out.select("session_id", "total_tool_calls", "unique_tools", "failed_calls", r6("success_rate"))


# --- the forest --------------------------------------------------------------------------------


@query(
    "J01_parents",
    with_base(
        """SELECT c.span AS span_id, p.span AS tree_parent, p.etype AS parent_type, p.name AS parent_name, p.span IS NULL AS is_root
        FROM sp c LEFT JOIN sp p ON c.sid = p.sid AND c.parent = p.span"""
    ),
)
def _(spark, d):
    return tree.parents(typed(spark, d)).select("span_id", "tree_parent", "parent_type", "parent_name", "is_root")


@query("J02_descendants", with_base(
    "SELECT t.sid AS session_id, a.anc AS start_id, t.span AS span_id FROM tree t, unnest(t.ids) AS a(anc) JOIN sp s ON s.sid = t.sid AND s.span = a.anc WHERE s.etype = 'agent'", TREE))
def _(spark, d):
    t = typed(spark, d)
    starts = t.filter("entity_type = 'agent'").select("session_id", "span_id")
    return tree.descendants(frames(spark, d).tree, starts).select("session_id", "start_id", "span_id")


_PRE = f"""{TREE}, tstart AS (SELECT sid, tid, min(ts || '/' || span) AS t0 FROM tree WHERE depth = 0 GROUP BY 1, 2),
pre AS (SELECT tree.*, row_number() OVER (PARTITION BY tree.sid ORDER BY t0, path) - 1 AS pos FROM tree JOIN tstart ON tstart.sid = tree.sid AND tstart.tid = tree.root_tid)"""


@query("W05_preorder_and_depth", with_base("SELECT sid AS session_id, span AS span_id, root AS root_id, depth, pos AS position FROM pre", _PRE))
def _(spark, d):
    return tree.labelled_tree(typed(spark, d)).select("session_id", "span_id", "root_id", "depth", F.col("enter").alias("position"))


@query("W05_interval_labels", with_base(
    "SELECT p.sid AS session_id, p.span AS span_id, p.pos AS enter, p.pos + (SELECT count(*) FROM tree t WHERE t.sid = p.sid AND list_contains(t.ids, p.span)) - 1 AS leave FROM pre p", _PRE))
def _(spark, d):
    return frames(spark, d).tree.select("session_id", "span_id", "enter", "leave")


@query(
    "A27_tree_summary",
    with_base("SELECT sid AS session_id, root_tid AS trace_id, count(DISTINCT root) AS root_count, count(*) AS flow_count FROM tree GROUP BY 1, 2", TREE),
)
def _(spark, d):
    return tree.tree_summary(frames(spark, d).tree)


@query(
    "A28_roots_of_type",
    with_base("SELECT span AS span_id FROM sp WHERE etype = 'tool' AND (parent IS NULL OR NOT EXISTS (SELECT 1 FROM sp q WHERE q.sid = sp.sid AND q.span = sp.parent))"),
)
def _(spark, d):
    return tree.roots_of_type(typed(spark, d), "tool").select("span_id")


@query(
    "A29_leaf_paths",
    with_base("SELECT span AS span_id, depth, array_to_string(ids, '>') AS path FROM tree WHERE NOT EXISTS (SELECT 1 FROM sp q WHERE q.sid = tree.sid AND q.parent = tree.span)", TREE),
)
def _(spark, d):
    out = tree.leaf_paths(typed(spark, d))
    return out.select("span_id", "depth", F.array_join("path", ">").alias("path"))


@query(
    "A30_flow_listing",
    with_base(
        "SELECT t.sid AS session_id, t.span AS span_id, t.etype || ':' || t.name AS entity, t.depth, (SELECT count(*) FROM sp q WHERE q.sid = t.sid AND q.parent = t.span) AS children_count FROM tree t",
        TREE,
    ),
)
def _(spark, d):
    return tree.flow_listing(frames(spark, d).tree)


@query(
    "A31_type_hierarchy",
    with_base(
        """SELECT a.sid AS session_id, a.etype AS entity_type, a.n AS n_spans, coalesce(b.c, '') AS contains FROM (SELECT sid, etype, count(*) AS n FROM tree GROUP BY 1, 2) a
        LEFT JOIN (SELECT p.sid, p.etype, string_agg(DISTINCT c.etype, ',' ORDER BY c.etype) AS c FROM sp c JOIN sp p ON c.sid = p.sid AND c.parent = p.span GROUP BY 1, 2) b ON a.sid = b.sid AND a.etype = b.etype""",
        TREE,
    ),
)
def _(spark, d):
    return tree.type_hierarchy(frames(spark, d).tree)


_ANC = f"""{TREE}, anc AS (SELECT t.sid, t.span, t.etype, a.anc FROM tree t, unnest(t.ids) AS a(anc) WHERE a.anc <> t.span)"""
_COST = f"""{_ANC}, tok AS (SELECT sid, span, {num('tot_tok')} AS n FROM sp WHERE etype = 'llm'),
cost AS (SELECT q.sid, q.name AS tool, cast(coalesce(sum(CASE WHEN tok.n >= 0 THEN tok.n END), 0) AS bigint) AS n FROM sp q
  LEFT JOIN anc ON anc.sid = q.sid AND anc.anc = q.span AND anc.etype = 'llm' LEFT JOIN tok ON tok.sid = anc.sid AND tok.span = anc.span
  WHERE q.etype = 'tool' GROUP BY 1, 2)"""


@query("A14_tool_token_cost", with_base("SELECT sid AS session_id, tool, n AS tool_tokens FROM cost", _COST))
def _(spark, d):
    return tree.tool_token_cost(typed(spark, d))


# --- agents ---------------------------------------------------------------------------------


@query("P28_span_agent", with_base("SELECT span AS span_id, agent FROM sp"))
def _(spark, d):
    return agents.with_agent(typed(spark, d)).select("span_id", "agent")


_POS = lambda c: f"CASE WHEN {num(c)} >= 0 THEN {num(c)} END"
_AST = f"""ast AS (SELECT sid, agent, count(*) FILTER (etype = 'llm') AS llm_calls, count(*) FILTER (etype = 'llm' AND err) AS llm_fails,
  count(*) FILTER (etype = 'tool') AS tool_calls, count(*) FILTER (etype = 'tool' AND err) AS tool_fails,
  {_SUM('tool', 'dur_ms')} AS tool_duration, {_SUM('llm', 'dur_ms')} AS llm_duration, {_SUM('agent', 'dur_ms')} AS duration,
  cast({_SUM('llm', _POS('in_tok'))} AS bigint) AS llm_input_tokens, cast({_SUM('llm', _POS('out_tok'))} AS bigint) AS llm_output_tokens,
  cast({_SUM('llm', _POS('tot_tok'))} AS bigint) AS llm_total_tokens FROM sp WHERE agent IS NOT NULL GROUP BY 1, 2),
astc AS (SELECT *, (llm_calls = 0 OR llm_fails < llm_calls) AND (tool_calls = 0 OR tool_fails < tool_calls) AS completion FROM ast)"""


@query(
    "A15_agent_stats",
    with_base(
        """SELECT sid AS session_id, agent, llm_calls, llm_fails, tool_calls, tool_fails, round(tool_duration, 6) AS tool_duration, round(llm_duration, 6) AS llm_duration,
        round(duration, 6) AS duration, llm_input_tokens, llm_output_tokens, llm_total_tokens, 0::BIGINT AS tool_total_tokens, completion FROM astc""",
        _AST,
    ),
)
def _(spark, d):
    out = agents.agent_stats(typed(spark, d)).drop("n_spans")
    return out.select(*[r6(c) if c in ("tool_duration", "llm_duration", "duration") else c for c in out.columns])


@query("A15_agent_tools", with_base("SELECT DISTINCT sid AS session_id, agent, name AS tool FROM sp WHERE etype = 'tool' AND agent IS NOT NULL"))
def _(spark, d):
    return agents.agent_tools(typed(spark, d))


@query(
    "A16_session_completion",
    with_base("SELECT ses.sid AS session_id, coalesce(bool_and(completion), true) AS completion FROM ses LEFT JOIN astc ON astc.sid = ses.sid GROUP BY 1", _SES, _AST),
)
def _(spark, d):
    t = typed(spark, d)
    return agents.session_completion(agents.agent_stats(t), sessions.sessions(t))


_OWN = f"""{_ANC}, own AS (SELECT sid, agent, span FROM sp WHERE agent IS NOT NULL
  UNION SELECT anc.sid, l.agent, anc.span FROM anc JOIN sp l ON l.sid = anc.sid AND l.span = anc.anc WHERE l.agent IS NOT NULL AND l.etype IN ('agent','task')),
ow AS (SELECT own.agent AS owner, sp.* FROM own JOIN sp ON sp.sid = own.sid AND sp.span = own.span)"""


@query("A17_U03_agent_spans", with_base("SELECT sid AS session_id, owner AS agent, span AS span_id FROM ow", _OWN))
def _(spark, d):
    return agents.agent_spans(typed(spark, d)).select("session_id", "agent", "span_id")


@query(
    "A18_agent_view",
    with_base(
        """SELECT sid AS session_id, owner AS agent, count(*) AS n_spans, count(*) FILTER (etype = 'tool') AS tool_calls, count(*) FILTER (etype = 'llm') AS llm_spans,
        count(*) FILTER (etype = 'workflow') AS workflow_spans, count(*) FILTER (etype = 'task') AS task_spans, count(*) FILTER (etype = 'tool' AND err) AS tool_errors,
        coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (etype = 'tool' AND name <> ''), '') AS tool_names,
        round(coalesce(100.0 * count(*) FILTER (etype = 'tool' AND err) / nullif(count(*) FILTER (etype = 'tool'), 0), 0), 6) AS tool_error_rate FROM ow GROUP BY 1, 2""",
        _OWN,
    ),
)
def _(spark, d):
    out = agents.agent_view(frames(spark, d).owned).withColumn("tool_names", F.array_join("tool_names", ","))
    return out.withColumn("tool_error_rate", F.round("tool_error_rate", 6))


@query(
    "A14_agent_tool_tokens",
    with_base(
        """SELECT q.sid AS session_id, q.agent, cast(sum(CASE WHEN tok.n >= 0 THEN tok.n ELSE 0 END) AS bigint) AS tool_tokens FROM sp q
        JOIN anc ON anc.sid = q.sid AND anc.anc = q.span AND anc.etype = 'llm' JOIN tok ON tok.sid = anc.sid AND tok.span = anc.span
        WHERE q.etype = 'tool' AND q.agent IS NOT NULL GROUP BY 1, 2""",
        _COST,
    ),
)
def _(spark, d):
    return agents.agent_tool_tokens(typed(spark, d))


# --- populations ------------------------------------------------------------------------------

_SM = f"""sm AS (SELECT ses.sid, ses.app, tool_calls, tool_fails, coalesce(c.n, 0) AS tool_total_tokens, tool_duration,
  coalesce(tool_duration / nullif(tool_calls, 0), 0) AS tool_duration_norm, llm_calls, llm_fails, llm_total_tokens, llm_input_tokens, llm_output_tokens,
  llm_duration, coalesce(llm_duration / nullif(llm_calls, 0), 0) AS llm_duration_norm, coalesce(det, 0) AS graph_determinism, coalesce(dyn, 0) AS graph_dynamism,
  llm_total_tokens AS total_tokens, dur AS latency, CASE WHEN coalesce(d.ok, true) THEN 1 ELSE 0 END AS completion
  FROM ses LEFT JOIN (SELECT sid, sum(n) AS n FROM cost GROUP BY 1) c ON c.sid = ses.sid LEFT JOIN gr ON gr.sid = ses.sid
  LEFT JOIN (SELECT sid, bool_and(completion) AS ok FROM astc GROUP BY 1) d ON d.sid = ses.sid)"""
_POP = (_SES, _COST, _GRAPH, _AST, _SM)
_AM = """am AS (SELECT sid, agent, tool_calls, tool_fails, 0 AS tool_total_tokens, tool_duration, coalesce(tool_duration / nullif(tool_calls, 0), 0) AS tool_duration_norm,
  llm_calls, llm_fails, llm_total_tokens, llm_input_tokens, llm_output_tokens, llm_duration, coalesce(llm_duration / nullif(llm_calls, 0), 0) AS llm_duration_norm,
  duration, CASE WHEN completion THEN 1 ELSE 0 END AS completion FROM astc)"""


@query(
    "A20_population_averages",
    with_base(
        "SELECT count(*) AS n_sessions, " + ", ".join(f"round(avg({m}), 4) AS avg_{m}" for m in population.SESSION_MEASURES) + " FROM sm", *_POP
    ),
)
def _(spark, d):
    out = population.population_averages(frames(spark, d).session_metrics)
    return out.select("n_sessions", *[F.round(c, 4).alias(c) for c in out.columns if c != "n_sessions"])


@query(
    "A20_P40_agent_averages",
    with_base(
        "SELECT agent, count(*) AS n_sessions, " + ", ".join(f"round(avg({m}), 4) AS avg_{m}" for m in population.AGENT_MEASURES) + " FROM am GROUP BY 1", _AST, _AM
    ),
)
def _(spark, d):
    out = population.agent_averages(population.agent_metrics(agents.agent_stats(typed(spark, d))))
    return out.select("agent", "n_sessions", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith("avg_")])


@query(
    "A21_session_histogram",
    with_base(
        " UNION ALL ".join(f"SELECT sid AS session_id, '{m}' AS measure, round(cast({m} AS double), 6) AS value FROM sm" for m in population.SESSION_MEASURES), *_POP
    ),
)
def _(spark, d):
    m = frames(spark, d).session_metrics
    return population.long_measures(m, ["session_id"], population.SESSION_MEASURES).withColumn("value", F.round("value", 6))


_AGM = ["tool_calls", "tool_fails", "llm_calls", "llm_total_tokens", "duration", "completion"]


@query(
    "A21_agent_histogram_aligned",
    with_base(
        "SELECT ses.sid AS session_id, a.agent, " + ", ".join(f"round(coalesce(am.{m}, 0), 6) AS {m}" for m in _AGM)
        + " FROM ses, (SELECT DISTINCT agent FROM am) a LEFT JOIN am ON am.sid = ses.sid AND am.agent = a.agent",
        _SES, _AST, _AM,
    ),
)
def _(spark, d):
    t = typed(spark, d)
    out = population.aligned_agent_measures(population.agent_metrics(agents.agent_stats(t)), sessions.sessions(t))
    return out.select("session_id", "agent", *[F.round(m, 6).alias(m) for m in _AGM])


_PERCENTS = (25, 50, 75, 90)


@query(
    "A21_agent_distribution",
    with_base(
        "SELECT agent, measure, max(n) AS n_sessions, count(*) FILTER (value = 0) AS n_zero, round(avg(value), 4) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, "
        + ", ".join(f"round(max(value) FILTER (place = ({p} * n + 99) // 100), 6) AS p{p}" for p in _PERCENTS)
        + " FROM (SELECT *, count(*) OVER (PARTITION BY agent, measure) AS n, row_number() OVER (PARTITION BY agent, measure ORDER BY value) AS place FROM grid) GROUP BY 1, 2",
        _SES, _AST, _AM,
        "grid AS (" + " UNION ALL ".join(
            f"SELECT a.agent, '{m}' AS measure, cast(coalesce(am.{m}, 0) AS double) AS value FROM ses, (SELECT DISTINCT agent FROM am) a LEFT JOIN am ON am.sid = ses.sid AND am.agent = a.agent"
            for m in population.AGENT_MEASURES
        ) + ")",
    ),
)
def _(spark, d):
    """Over all sessions; the states of two halves of them, merged."""
    f = frames(spark, d)
    measures = population.agent_metrics(f.agent_stats)
    half = F.pmod(F.xxhash64("session_id"), F.lit(2))
    states = [population.agent_sketches(measures.filter(half == n)) for n in range(2)]
    merged = population.merged_sketches(states[0].unionByName(states[1]))
    out = population.agent_distributions(merged, f.sessions.count(), _PERCENTS)
    return out.select("agent", "measure", "n_sessions", "n_zero", F.round("mean", 4).alias("mean"), *[r6(c) for c in ("least", "most", *(f"p{p}" for p in _PERCENTS))])


@query(
    "W06_agent_occurrence",
    with_base("SELECT sid AS session_id, agent, row_number() OVER (PARTITION BY agent ORDER BY sid) - 1 AS occurrence, tool_calls FROM am", _AST, _AM),
)
def _(spark, d):
    m = population.agent_metrics(agents.agent_stats(typed(spark, d)))
    return population.packed_agent_measures(m).select("session_id", "agent", "occurrence", "tool_calls")


@query("A22_population_apps", with_base("SELECT sid AS session_id, app AS app_name FROM sm", *_POP))
def _(spark, d):
    return population.session_apps(frames(spark, d).session_metrics)


@query(
    "J09_results_with_population_row",
    with_base("SELECT sid AS session_id, n_spans, tool_calls AS pop_tool_calls FROM ses", _SES),
)
def _(spark, d):
    t = typed(spark, d)
    counts = t.groupBy("session_id").agg(F.count("*").alias("n_spans"))
    stats = sessions.sessions(t).select("session_id", "app_name", F.col("tool_calls").alias("pop_tool_calls"))
    return population.with_position_in_population(counts, stats)
