"""Statistics of a set of sessions. Averages are global aggregates; histograms stay long
tables (one row per session and measure), never lists in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import per_call
from spanloom.operators.agents import agent_stats
from spanloom.operators.ordered import OrderedGroups
from spanloom.operators.sessions import sessions
from spanloom.operators.tree import tool_token_cost

_AGENTS_A_PART, _SESSIONS_A_PART = 1_000, 50_000
# Values that a quantile sketch keeps as they are; beyond, its error is about 1.3 / SKETCH_K of the rank.
SKETCH_K = 4096
SHARES = 2000

SESSION_MEASURES = [
    "tool_calls", "tool_fails", "tool_total_tokens", "tool_duration", "tool_duration_norm",
    "llm_calls", "llm_fails", "llm_total_tokens", "llm_input_tokens", "llm_output_tokens",
    "llm_duration", "llm_duration_norm", "graph_determinism", "graph_dynamism", "total_tokens",
    "latency", "completion",
]
AGENT_MEASURES = [
    "tool_calls", "tool_fails", "tool_total_tokens", "tool_duration", "tool_duration_norm",
    "llm_calls", "llm_fails", "llm_total_tokens", "llm_input_tokens", "llm_output_tokens",
    "llm_duration", "llm_duration_norm", "duration", "completion",
]


def session_metrics(spans: DataFrame) -> DataFrame:
    """The 17 measures of each session, with its app name."""
    base = sessions(spans)
    stats = agent_stats(spans)
    cost = tool_token_cost(spans).groupBy("session_id").agg(F.sum("tool_tokens").alias("tool_total_tokens"))
    done = stats.groupBy("session_id").agg(F.bool_and("completion").alias("completion"))
    joined = base.join(cost, "session_id", "left").join(done, "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "session_id",
        "app_name",
        "tool_calls",
        "tool_fails",
        zero("tool_total_tokens").alias("tool_total_tokens"),
        "tool_duration",
        per_call(F.col("tool_duration"), F.col("tool_calls")).alias("tool_duration_norm"),
        "llm_calls",
        "llm_fails",
        "llm_total_tokens",
        "llm_input_tokens",
        "llm_output_tokens",
        "llm_duration",
        per_call(F.col("llm_duration"), F.col("llm_calls")).alias("llm_duration_norm"),
        zero("graph_determinism").cast("double").alias("graph_determinism"),
        zero("graph_dynamism").cast("double").alias("graph_dynamism"),
        F.col("llm_total_tokens").alias("total_tokens"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("latency"),
        F.coalesce("completion", F.lit(True)).cast("int").alias("completion"),
    )


def agent_metrics(stats: DataFrame) -> DataFrame:
    """The 14 measures of each agent in each session."""
    return stats.select(
        "session_id",
        "agent",
        *[F.col(m) for m in AGENT_MEASURES if not m.endswith("_norm") and m != "completion"],
        per_call(F.col("tool_duration"), F.col("tool_calls")).alias("tool_duration_norm"),
        per_call(F.col("llm_duration"), F.col("llm_calls")).alias("llm_duration_norm"),
        F.col("completion").cast("int").alias("completion"),
    )


def population_averages(metrics: DataFrame) -> DataFrame:
    """One row: the average of every session measure, and the number of sessions."""
    return metrics.agg(
        F.count("*").alias("n_sessions"), *[F.avg(m).alias(f"avg_{m}") for m in SESSION_MEASURES]
    )


def agent_averages(metrics: DataFrame) -> DataFrame:
    """One row per agent, averaged over the sessions it took part in."""
    return metrics.groupBy("agent").agg(
        F.count("*").alias("n_sessions"), *[F.avg(m).alias(f"avg_{m}") for m in AGENT_MEASURES]
    )


def long_measures(metrics: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Histogram table: one row per key and measure."""
    typed = metrics.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(keys, measures, "measure", "value")


def agent_sketches(metrics: DataFrame, measures: list[str] = AGENT_MEASURES, k: int = SKETCH_K) -> DataFrame:
    """Mergeable state of each agent's measures over the sessions it took part in, one row per
    (agent, measure): n, n_zero, n_below (zero), total, least, most, and a quantile sketch of all
    values that are not zero. Zeros are counted, not sketched, so that sessions without the agent
    can be added as a number."""
    return long_measures(metrics, ["agent"], measures).groupBy("agent", "measure").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value") == 0).alias("n_zero"),
        F.count_if(F.col("value") < 0).alias("n_below"),
        F.sum("value").alias("total"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.call_function("kll_sketch_agg_double", F.when(F.col("value") != 0, F.col("value")), F.lit(k)).alias("sketch"),
    )


def merged_sketches(states: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """The states of several sets of sessions, such as days, as the state of all of them."""
    sums = [F.sum(c).alias(c) for c in ("n", "n_zero", "n_below", "total")]
    ends = [F.min("least").alias("least"), F.max("most").alias("most")]
    return states.groupBy("agent", "measure").agg(*sums, *ends, F.call_function("kll_merge_agg_double", "sketch", F.lit(k)).alias("sketch"))


def agent_distributions(states: DataFrame, n_sessions: int, percents: tuple[int, ...] = (25, 50, 75, 90)) -> DataFrame:
    """What each agent's measures look like over all `n_sessions`, with a zero for each session the
    agent took no part in: n_zero, mean, least, most, and for each of `percents` the least value
    that so many percent of the sessions do not exceed. No (session, agent) pair is formed beyond
    those with spans. Quantiles are exact for up to SHARES values that are not zero, and within the
    error of the sketch beyond."""
    absent = F.lit(n_sessions) - F.col("n")
    zeros, others = F.col("n_zero") + absent, F.col("n") - F.col("n_zero")
    end = lambda c, pick: F.when(absent > 0, pick(F.col(c), F.lit(0.0))).otherwise(F.col(c))

    # A sketch is asked for fixed shares only; the place of a rank among them is looked up.
    shares = F.lit([(i + 0.5) / SHARES for i in range(SHARES)])
    states = states.withColumn("_values", F.when(others > 0, F.call_function("kll_sketch_get_quantile_double", "sketch", shares)))

    def quantile(percent: int):
        rank = F.floor((F.lit(percent * n_sessions) + 99) / 100)
        # Values below zero come first, then the zeros, then the rest.
        place = F.when(rank <= F.col("n_below"), rank).otherwise(rank - zeros)
        found = F.try_element_at("_values", F.least(F.floor((place - 0.5) / others * SHARES) + 1, F.lit(SHARES)).cast("int"))
        is_zero = (rank > F.col("n_below")) & (rank <= F.col("n_below") + zeros)
        return F.when(is_zero | (others == 0), 0.0).otherwise(found).alias(f"p{percent}")

    return states.select(
        "agent",
        "measure",
        F.lit(n_sessions).cast("bigint").alias("n_sessions"),
        zeros.alias("n_zero"),
        (F.col("total") / n_sessions).alias("mean"),
        end("least", F.least).alias("least"),
        end("most", F.greatest).alias("most"),
        *[quantile(p) for p in percents],
    )


def aligned_agent_measures(metrics: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Every agent in each of the sessions `session_ids`, zeros where it took no part: the grid
    itself, for sessions that are looked at one by one; over a population, `agent_distributions`
    gives what the grid would without it. Agents and sessions are dealt into parts of bounded
    size which meet pairwise by equi-join, so that neither list is in one task or collected."""
    agents = metrics.select("agent").distinct()
    a_parts, s_parts = (max(1, -(-df.count() // n)) for df, n in ((agents, _AGENTS_A_PART), (session_ids, _SESSIONS_A_PART)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = agents.select("agent", F.pmod(F.xxhash64("agent"), F.lit(a_parts)).cast("int").alias("_a"), every(s_parts).alias("_s"))
    visits = session_ids.select("session_id", F.pmod(F.xxhash64("session_id"), F.lit(s_parts)).cast("int").alias("_s"), every(a_parts).alias("_a"))
    return visits.join(dealt, ["_a", "_s"]).join(metrics, ["session_id", "agent"], "left").select(
        "session_id",
        "agent",
        *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in AGENT_MEASURES],
    )


def packed_agent_measures(metrics: DataFrame) -> DataFrame:
    """Agent measures by occurrence: the n-th session the agent took part in."""
    return OrderedGroups(metrics, ["agent"], ["session_id"]).positions("occurrence")


def session_apps(metrics: DataFrame) -> DataFrame:
    """(session, app) pairs."""
    return metrics.select("session_id", "app_name")


def with_position_in_population(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Results joined to their session's row in the population statistics."""
    return results.join(metrics.drop("app_name"), "session_id")
