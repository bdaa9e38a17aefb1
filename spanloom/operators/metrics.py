"""The native metrics. Each returns its values in a narrow frame; `results.result_rows` turns
one into result rows. Evidence (span ids) stays in long frames of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import attr, find_key, per_call, truthy
from spanloom.operators.agents import agent_view
from spanloom.operators.cycles import count_cycles_long
from spanloom.operators.ordered import OrderedGroups, packed
from spanloom.operators.sessions import SESSION_ORDER, with_order
from spanloom.runtime import max_group_rows


def _is(*kinds: str) -> Column:
    return F.col("entity_type").isin(*kinds)


# --- tool errors -----------------------------------------------------------------------------


def tool_error_rate(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of failed tool calls in percent, 0 without tool calls."""
    keys = keys or ["session_id"]
    tools = F.count_if(_is("tool"))
    errors = F.count_if(_is("tool") & F.col("contains_error"))
    return (
        spans.groupBy(*keys)
        .agg(tools.alias("tool_calls"), errors.alias("tool_errors"))
        .withColumn("tool_error_rate", per_call(F.col("tool_errors") * 100.0, F.col("tool_calls")))
    )


def tool_error_spans(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The failed tool spans behind the rate."""
    return spans.filter(_is("tool") & F.col("contains_error")).select(*(keys or ["session_id"]), "span_id")


def agent_tool_error_rate(owned: DataFrame) -> DataFrame:
    return agent_view(owned).select("session_id", "agent", "tool_calls", "tool_errors", "tool_error_rate")


def tool_status(spans: DataFrame) -> DataFrame:
    """First nested `status` in a tool span's payloads; null (an error row) without one."""
    inside = F.concat(
        F.lit("["), F.coalesce("input_payload", F.lit("null")), F.lit(","), F.coalesce("output_payload", F.lit("null")), F.lit("]")
    )
    found = find_key(inside, "status")
    plain = F.when(found.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), found, F.lit("}")), "$.v"))
    return spans.filter(_is("tool")).select(
        "session_id", "span_id", F.coalesce(plain, found).alias("status")
    )


# --- sequences ---------------------------------------------------------------------------------


def agent_mentions(spans: DataFrame) -> DataFrame:
    """Spans whose first event names an agent."""
    first = F.try_element_at("events_attributes", F.lit(1))
    return with_order(spans).select(
        "session_id", *SESSION_ORDER, attr(first, "agent_name").alias("agent_name")
    ).filter(F.col("agent_name").isNotNull())


def agent_transitions(spans: DataFrame, largest: int | None = None) -> DataFrame:
    """Changes from one named agent to the next, in session order, one row each. `largest`:
    spans of the largest session, where known."""
    groups = OrderedGroups(agent_mentions(spans), ["session_id"], SESSION_ORDER, largest=largest)
    linked = groups.neighbours(
        {"previous_agent": "agent_name"}
    )
    changed = F.col("previous_agent") != F.col("agent_name")
    return linked.filter(changed).select(
        "session_id",
        "span_id",
        F.concat_ws(" -> ", "previous_agent", "agent_name").alias("transition"),
    )


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("session_id", "transition").agg(F.count("*").alias("n"))


def count_maps(counts: DataFrame, name: str, session_frame: DataFrame) -> DataFrame:
    """Counts per session as one JSON map in name order; an empty map without any."""
    listed = packed(counts, ["session_id"], [name], F.struct(name, "n"), "_m")
    maps = listed.select("session_id", "part", F.to_json(F.map_from_entries("_m")).alias("value_json"))
    return session_frame.select("session_id").join(maps, "session_id", "left").select(
        "session_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("value_json", F.lit("{}")).alias("value_json"),
    )


def agent_to_agent(counts: DataFrame, session_frame: DataFrame) -> DataFrame:
    """Transition counts per session as JSON maps, with the totals of the session."""
    totals = counts.groupBy("session_id").agg(
        F.sum("n").alias("total_transitions"), F.count("*").alias("unique_transitions")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return count_maps(counts, "transition", session_frame).join(totals, "session_id", "left").select(
        "session_id", "part", "value_json", zero("total_transitions"), zero("unique_transitions")
    )


def agent_to_tool(spans: DataFrame) -> DataFrame:
    """Calls per session, workflow and tool. One tool span without a workflow name fails the
    metric for its whole session: such a session gets a single row with an error and -1."""
    a = F.col("attrs")
    flow = attr(a, "ioa_observe.workflow.name")
    tool = F.coalesce(attr(a, "traceloop.entity.name"), F.col("entity_name"))
    label = F.concat(F.lit("(Agent: "), flow, F.lit(") -> (Tool: "), tool, F.lit(")"))
    calls = spans.filter(_is("tool")).select("session_id", flow.alias("_flow"), label.alias("interaction"))
    counts = calls.groupBy("session_id", "interaction").agg(
        F.count("*").alias("n"), F.bool_or(F.col("_flow").isNull()).alias("_bad")
    )
    bad = counts.filter("_bad").select("session_id").distinct()
    good = counts.join(bad, "session_id", "left_anti").select(
        "session_id", "interaction", "n", F.lit(None).cast("string").alias("error")
    )
    failed = bad.select(
        "session_id",
        F.lit(None).cast("string").alias("interaction"),
        F.lit(-1).cast("bigint").alias("n"),
        F.lit("a tool span has no workflow name").alias("error"),
    )
    return good.unionByName(failed)


def workflow_efficiency(counts: DataFrame, session_frame: DataFrame) -> DataFrame:
    """1 up to two distinct transitions, then 0.2 less for each one more, not below 0."""
    distinct = counts.groupBy("session_id").agg(F.count("*").alias("unique_transitions"))
    n = F.coalesce("unique_transitions", F.lit(0))
    return session_frame.select("session_id").join(distinct, "session_id", "left").select(
        "session_id",
        n.alias("unique_transitions"),
        F.when(n <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (n - 2) * 0.2)).alias("efficiency"),
    )


def path_steps(spans: DataFrame, largest: int | None = None) -> DataFrame:
    """Consecutive agent and tool names of each session, repeats included."""
    acts = with_order(spans).filter(_is("agent", "tool")).select("session_id", "entity_name", *SESSION_ORDER)
    linked = OrderedGroups(acts, ["session_id"], SESSION_ORDER, largest=largest).neighbours(
        {"source": "entity_name", "_before": "span_id"}
    )
    return linked.filter(F.col("_before").isNotNull()).select(
        "session_id", "source", F.col("entity_name").alias("target")
    )


def path_edges(spans: DataFrame, largest: int | None = None) -> DataFrame:
    """The edge set of each session's path."""
    return path_steps(spans, largest).distinct()


def edge_difference(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Edges that only one of two sessions has."""
    pick = lambda s: edges.filter(F.col("session_id") == s).select("source", "target")
    a, b = pick(left), pick(right)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def path_variance(edges: DataFrame, session_frame: DataFrame) -> DataFrame:
    """Mean size of the edge-set difference over all pairs of sessions; -1 below two
    sessions. With n sessions, E edges in all and f sessions per edge the sum over pairs is
    (n-1)·E - Σ f(f-1), so no pair is formed."""
    n = session_frame.agg(F.count("*").alias("n"))
    per_edge = edges.groupBy("source", "target").agg(F.count("*").cast("decimal(38,0)").alias("f"))
    sums = per_edge.agg(F.sum("f").alias("e"), F.sum(F.col("f") * (F.col("f") - 1)).alias("shared"))
    count, e, shared = F.col("n"), F.col("e").cast("double"), F.col("shared").cast("double")
    total = (count - 1) * F.coalesce(e, F.lit(0.0)) - F.coalesce(shared, F.lit(0.0))
    # Two one-row aggregates become one row by union, not by a join.
    parts = n.unionByName(sums, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in ("n", "e", "shared")]).select(
        count.alias("n_sessions"),
        F.when(count < 2, -1.0).otherwise(2.0 * total / (count * (count - 1))).alias("path_variance"),
        F.when(count < 2, "needs at least two sessions").alias("error"),
    )


def count_cycles(names: list, shortest: int = 2) -> int:
    """Contiguous repeats in a sequence, taken greedily, the shortest length first."""
    if len(names) <= 64:
        return _count_cycles_short(names, shortest)
    code = {name: i for i, name in enumerate(dict.fromkeys(names))}
    seq = np.array([code[name] for name in names], dtype=np.int64)
    places = [np.flatnonzero(seq == c) for c in range(len(code))]
    # Prefix hashes (wrapping) rule lengths out many at a time; hits are compared in full.
    n, wrap, base = len(seq), (1 << 64) - 1, 0x9E3779B97F4A7C15
    prefix, power = [0], [1]
    for c in seq.tolist():
        prefix.append((prefix[-1] * base + c + 1) & wrap)
        power.append((power[-1] * base) & wrap)
    h, p = np.array(prefix, dtype=np.uint64), np.array(power, dtype=np.uint64)
    at, cycles = 0, 0
    while at < n:
        step = 1
        # A repeat of length k starts with the same name k places on.
        same = places[seq[at]]
        first, last = np.searchsorted(same, [at + shortest, at + (n - at) // 2 + 1])
        nexts = same[first:last]
        if len(nexts):
            ks = nexts - at
            ahead, behind = h[nexts] - h[at] * p[ks], h[nexts + ks] - h[nexts] * p[ks]
            for k in ks[ahead == behind].tolist():
                if np.array_equal(seq[at : at + k], seq[at + k : at + 2 * k]):
                    cycles, step = cycles + 1, k
                    break
        at += step
    return cycles


def _count_cycles_short(names: list, shortest: int) -> int:
    """The same for a few names, where plain lists are quicker than arrays."""
    n, at, cycles = len(names), 0, 0
    while at + 2 * shortest <= n:
        lengths = (
            k
            for k in range(shortest, (n - at) // 2 + 1)
            if names[at] == names[at + k] and names[at : at + k] == names[at + k : at + 2 * k]
        )
        k = next(lengths, 0)
        cycles += k > 0
        at += k or 1
    return cycles


# The array scan is quadratic at worst; longer sequences go to the join form.
_MAX_SCANNED = 20_000


def _cycles(df: DataFrame, keys: list[str], order: list[str], largest: int | None = None) -> DataFrame:
    """Cycles per group. Groups within the row limit are scanned as one array each; larger
    ones are solved by joins (operators.cycles)."""
    limit = min(max_group_rows(df.sparkSession), _MAX_SCANNED)
    groups = OrderedGroups(df, keys, order, limit, largest)

    @F.pandas_udf("bigint")
    def scan(sequences: pd.Series) -> pd.Series:
        return sequences.map(lambda s: count_cycles(list(s)))

    if not groups.split:
        rows, long_groups = df, None
    else:
        rows, long_groups = groups.small_groups(), groups.large_groups()
    item = F.struct(*[F.struct(F.col(o).isNull(), F.col(o)) for o in order], F.col("entity_name"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    names = F.transform("_l", lambda x: x["entity_name"])
    counted = listed.select(*keys, F.size("_l").cast("bigint").alias("n_events"), scan(names).alias("cycles"))
    if long_groups is None:
        return counted
    return counted.unionByName(count_cycles_long(long_groups, keys, order))


def cycles(spans: DataFrame, largest: int | None = None) -> DataFrame:
    """Cycles of the agent and tool names of each session; 0 for sessions without any."""
    acts = with_order(spans).filter(_is("agent", "tool")).select("session_id", "entity_name", *SESSION_ORDER)
    return _cycles(acts, ["session_id"], SESSION_ORDER, largest)


def agent_cycles(owned_in_tree_order: DataFrame) -> DataFrame:
    """Cycles per agent over its spans in pre-order (see `agents.ownership`); null names are
    passed over."""
    acts = owned_in_tree_order.filter(_is("agent", "tool") & truthy(F.col("entity_name")).isNotNull())
    return _cycles(
        acts.select("session_id", "agent", "entity_name", "preorder", "span_id"),
        ["session_id", "agent"],
        ["preorder", "span_id"],
    )


# --- counts ------------------------------------------------------------------------------------


def span_counts(spans: DataFrame) -> DataFrame:
    """Spans, agent spans and workflow spans per session."""
    return spans.groupBy("session_id").agg(
        F.count("*").alias("n_spans"),
        F.count_if(_is("agent")).alias("n_agents"),
        F.count_if(_is("workflow")).alias("n_workflows"),
    )


PASSIVE_APP = {
    "tool_calls": "tool_calls", "tool_fails": "tool_fails", "tool_cost": "tool_total_tokens",
    "tool_duration": "tool_duration", "llm_calls": "llm_calls", "llm_fails": "llm_fails",
    "llm_cost": "llm_total_tokens", "llm_cost_input": "llm_input_tokens",
    "llm_cost_output": "llm_output_tokens", "llm_duration": "llm_duration", "duration": "latency",
    "graph_determinism": "graph_determinism", "graph_dynamism": "graph_dynamism",
    "completion": "completion",
}


def passive_app(session_metrics: DataFrame) -> DataFrame:
    """The 14 passive measures of each session."""
    return session_metrics.select(
        "session_id", "app_name", *[F.col(c).alias(f"eval_app_{n}") for n, c in PASSIVE_APP.items()]
    )


def passive_agents(agent_measures: DataFrame) -> DataFrame:
    """The 12 passive measures of each agent in each session."""
    own = {n: c for n, c in PASSIVE_APP.items() if not n.startswith("graph")}
    own["duration"] = "duration"
    return agent_measures.select(
        "session_id", "agent", *[F.col(c).alias(f"eval_agent_{n}") for n, c in own.items()]
    )
