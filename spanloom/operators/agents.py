"""Which agent a span belongs to, and what each agent did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import attr, per_call, truthy
from spanloom.operators.sessions import session_measures, tokens
from spanloom.operators.tree import Fold, every_span_folded, fold_ancestors, path_item


def span_agent() -> Column:
    """Agent id, else the head of a dotted entity path, else an agent-like entity name."""
    stated = truthy(F.trim(attr(F.col("attrs"), "agent_id")))
    path = attr(F.col("attrs"), "traceloop.entity.path")
    head = F.split_part(path, F.lit("."), F.lit(1))
    low_head = F.lower(head)
    from_path = F.when(
        path.contains(".") & low_head.contains("agent") & (low_head != "agent") & (F.length(head) > 5), head
    )
    base = F.replace(F.replace(F.col("entity_name"), F.lit(".task"), F.lit("")), F.lit(".agent"), F.lit(""))
    low = F.lower(base)
    agent_like = (
        low.endswith("_agent")
        | low.endswith("-agent")
        | low.startswith("agent_")
        | low.startswith("agent-")
        | low.contains("_agent_")
        | low.contains("-agent-")
    )
    excluded = low.contains("graph") | low.contains("workflow") | low.contains("service")
    from_name = F.when((low != "agent") & (F.length(base) > 5) & agent_like & ~excluded, base)
    return F.coalesce(stated, from_path, from_name)


def with_agent(spans: DataFrame) -> DataFrame:
    return spans.withColumn("agent", span_agent())


def agent_stats(spans: DataFrame) -> DataFrame:
    """Counters per (session, agent) from the spans attributed to the agent itself. Negative
    token counts are left out here, and an agent is complete unless all of its model calls or
    all of its tool calls failed."""
    positive = with_agent(spans).filter(F.col("agent").isNotNull())
    keep = lambda f: F.when(~F.coalesce(F.col(f"llm.{f}").startswith("-"), F.lit(False)), F.col(f"llm.{f}"))
    positive = positive.withColumn(
        "llm",
        F.struct(*[keep(f).alias(f) for f in ("input_tokens", "output_tokens", "total_tokens")]),
    )
    own = F.sum(F.when(F.col("entity_type") == "agent", F.coalesce("duration_ms", F.lit(0.0))))
    stats = positive.groupBy("session_id", "agent").agg(
        *[c.alias(n) for n, c in session_measures().items()],
        F.coalesce(own, F.lit(0.0)).alias("duration"),
        F.count("*").alias("n_spans"),
    )
    finished = lambda calls, fails: (F.col(calls) == 0) | (F.col(fails) < F.col(calls))
    return stats.withColumn(
        "completion", finished("llm_calls", "llm_fails") & finished("tool_calls", "tool_fails")
    ).withColumn("tool_total_tokens", F.lit(0).cast("bigint"))


def agent_tools(spans: DataFrame) -> DataFrame:
    """Distinct tool names per (session, agent), one row each."""
    return (
        with_agent(spans)
        .filter((F.col("entity_type") == "tool") & F.col("agent").isNotNull() & truthy(F.col("entity_name")).isNotNull())
        .select("session_id", "agent", F.col("entity_name").alias("tool"))
        .distinct()
    )


def session_completion(stats: DataFrame, session_frame: DataFrame) -> DataFrame:
    """A session is complete when all of its agents are; one without agents is."""
    done = stats.groupBy("session_id").agg(F.bool_and("completion").alias("completion"))
    return session_frame.select("session_id").join(done, "session_id", "left").select(
        "session_id", F.coalesce("completion", F.lit(True)).alias("completion")
    )


_NARROW = [
    "session_id", "span_id", "parent_span_id", "trace_id", "timestamp", "ts_raw", "entity_type", "agent",
]


def ownership(spans: DataFrame, ordered: bool = False) -> DataFrame:
    """(session, span, agent): the spans attributed to an agent and those below its agent and
    task spans, once each. With `ordered`, `preorder` sorts an agent's spans as a depth-first
    walk meets them; spans off the tree come last, by time. Narrow rows only: payloads join
    later, where they are read."""
    nodes = with_agent(spans).select(*_NARROW)
    empty = F.array().cast("array<string>")
    leads = F.when(F.col("entity_type").isin("agent", "task") & F.col("agent").isNotNull(), F.array("agent"))
    fold = Fold("agents_above", F.coalesce(leads, empty), empty, F.array_union)
    keys = ["session_id", "span_id"]
    joined = every_span_folded(nodes, [fold], labels=ordered)
    if ordered:
        rank = F.when(F.col("enter").isNotNull(), F.struct(F.col("enter").alias("rank")))
        joined = joined.withColumn("preorder", rank).withColumn(
            "preorder", F.struct(F.col("preorder").isNull().alias("off"), "preorder", path_item().alias("item"))
        )
    owners = F.array_compact(F.array_union(F.coalesce("agents_above", empty), F.array("agent")))
    extra = ["preorder"] if ordered else []
    # Only agents that some span is attributed to have statistics, and so a view; the names
    # above a span are such by construction.
    return joined.select(*keys, F.explode(owners).alias("agent"), *extra)


def agent_spans(spans: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Every span of every agent, owner in `agent`."""
    return spans.join(ownership(spans) if owned is None else owned, ["session_id", "span_id"])


def agent_view(owned: DataFrame) -> DataFrame:
    """Per (session, agent) over its spans: counts per type, tool errors and error rate, and the
    sorted names of the tools it used."""
    count = lambda kind: F.count_if(F.col("entity_type") == kind)
    errors = F.count_if((F.col("entity_type") == "tool") & F.col("contains_error"))
    return (
        owned.groupBy("session_id", "agent")
        .agg(
            F.count("*").alias("n_spans"),
            count("tool").alias("tool_calls"),
            count("llm").alias("llm_spans"),
            count("workflow").alias("workflow_spans"),
            count("task").alias("task_spans"),
            errors.alias("tool_errors"),
            F.array_sort(F.collect_set(F.when(F.col("entity_type") == "tool", truthy(F.col("entity_name"))))).alias("tool_names"),
        )
        .withColumn("tool_error_rate", per_call(F.col("tool_errors") * 100.0, F.col("tool_calls")))
    )


def agent_tool_tokens(spans: DataFrame) -> DataFrame:
    """Model tokens below the tools an agent called: the real value behind the constant 0
    in the statistics."""
    costs = with_tool_cost(spans)
    return costs.groupBy("session_id", "agent").agg(F.sum("tokens").alias("tool_tokens"))


def with_tool_cost(spans: DataFrame) -> DataFrame:
    """Tool spans attributed to an agent with the tokens of the model calls below them."""
    n = tokens("total_tokens")
    nodes = with_agent(spans).select(*_NARROW, F.when(n >= 0, n).otherwise(0).alias("n"))
    mine = F.when(
        (F.col("entity_type") == "tool") & F.col("agent").isNotNull(),
        F.create_map("agent", F.lit(1).cast("bigint")),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    add = lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    fold = Fold("callers", F.coalesce(mine, empty), empty, lambda n, f: F.map_zip_with(n, f, add))
    calls = fold_ancestors(nodes, [fold]).filter(F.col("entity_type") == "llm")
    return calls.select("session_id", F.explode("callers").alias("agent", "times"), "n").select("session_id", "agent", (F.col("n") * F.col("times")).alias("tokens"))

