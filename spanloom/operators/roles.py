"""What role an agent plays, from word counts over its conversation. Transcripts are never
built: a word is in a transcript when it is in one of its lines, so flags are or-ed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.constants import COMPUTING_TOOL_WORDS, COORDINATION_WORDS, JSON_MARKS, PROCESSING_WORDS
from spanloom.functions.values import strip
from spanloom.operators.conversation import element_line


def _found(words: list[str], text: Column) -> list[Column]:
    return [F.coalesce(F.max(text.contains(w).cast("int")), F.lit(0)) for w in words]


def agent_behaviour(elements: DataFrame, stats: DataFrame, tools: DataFrame) -> DataFrame:
    """Signals per (session, agent): `elements` is the agent conversation with tool rows,
    `stats` the agent statistics, `tools` the agent's tool names."""
    lines = elements.withColumn("_line", element_line()).filter(F.col("_line").isNotNull())
    low = F.lower("_line")
    replies = F.filter(
        F.transform(F.split("_line", "\n"), strip), lambda x: x.startswith("Assistant:")
    )
    lines = lines.withColumns({"_low": low, "_replies": replies})
    total = lambda cols: sum(cols[1:], cols[0])
    lengths = F.aggregate("_replies", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    short = F.size(F.filter("_replies", lambda x: F.length(x) < 100))
    said = lines.groupBy("session_id", "agent").agg(
        total(_found(COORDINATION_WORDS, F.col("_low"))).alias("coordination_signals"),
        total(_found(PROCESSING_WORDS, F.col("_low"))).alias("processing_signals"),
        total(_found(JSON_MARKS, F.col("_line"))).alias("json_signals"),
        (F.sum(F.length("_line")) + F.count("*") - 1).alias("conversation_length"),
        F.sum(F.size("_replies")).alias("assistant_responses"),
        F.sum(lengths).alias("_reply_chars"),
        F.sum(short).alias("_short"),
    )
    computing = F.lower("tool").rlike("|".join(COMPUTING_TOOL_WORDS))
    used = tools.groupBy("session_id", "agent").agg(F.bool_or(computing).alias("computing_tools"))
    joined = stats.join(said, ["session_id", "agent"], "left").join(used, ["session_id", "agent"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a: F.when(zero("assistant_responses") > 0, F.col(a) / F.col("assistant_responses")).otherwise(0.0)
    return joined.select(
        "session_id",
        "agent",
        "llm_calls",
        "tool_calls",
        F.col("llm_input_tokens").alias("input_tokens"),
        F.col("llm_output_tokens").alias("output_tokens"),
        *[
            zero(c).alias(c)
            for c in (
                "conversation_length", "coordination_signals", "processing_signals", "json_signals",
                "assistant_responses",
            )
        ],
        ratio("_reply_chars").alias("avg_response_length"),
        ratio("_short").alias("short_response_ratio"),
        F.coalesce("computing_tools", F.lit(False)).alias("computing_tools"),
    )


def _steps(value: Column, *limits: tuple[Column, int]) -> Column:
    chain = None
    for condition, points in limits:
        chain = F.when(condition, points) if chain is None else chain.when(condition, points)
    return chain.otherwise(0)


def agent_roles(behaviour: DataFrame) -> DataFrame:
    """Two scores, the role they give and how sure it is."""
    c = F.col
    coordinator = _steps(
        c("coordination_signals"), (c("coordination_signals") >= 3, 3), (c("coordination_signals") >= 1, 1)
    ) + _steps(
        c("tool_calls"),
        ((c("short_response_ratio") > 0.8) & (c("tool_calls") == 0) & (c("coordination_signals") >= 2), 3),
    )
    processor = (
        _steps(c("tool_calls"), (c("tool_calls") > 0, 4))
        + _steps(c("computing_tools"), (c("computing_tools"), 3))
        + _steps(c("processing_signals"), (c("processing_signals") >= 3, 2), (c("processing_signals") >= 1, 1))
        + _steps(c("avg_response_length"), (c("avg_response_length") > 200, 2), (c("avg_response_length") > 100, 1))
        + _steps(c("output_tokens"), (c("output_tokens") > c("input_tokens"), 1))
    )
    scored = behaviour.withColumns({"coordinator_score": coordinator, "processor_score": processor})
    co, pr = c("coordinator_score"), c("processor_score")
    role = (
        F.when((pr >= 4) & (pr > co), "processor")
        .when((co >= 4) & (co > pr), "coordinator")
        .when(F.abs(co - pr) <= 1, "mixed")
        .otherwise("unknown")
    )
    sure = F.when(co + pr > 0, F.abs(co - pr) / (co + pr)).otherwise(0.0)
    return scored.withColumns({"role": role, "confidence": sure})


def skip_coordinators(roles: DataFrame) -> DataFrame:
    """Mark agents whose work is routing rather than handling information, with the reason."""
    c = F.col
    active = (c("processing_signals") >= 2) | (c("tool_calls") >= 2) | (c("avg_response_length") >= 150)
    reason = (
        F.when(c("role") == "coordinator", "routes work, does not handle information")
        .when(c("role") == "processor", "handles information")
        .when((c("role") == "mixed") & active, "mixed, with enough information handling")
        .when(c("role") == "mixed", "mixed, mostly routing")
        .otherwise("role unknown, kept")
    )
    skip = (c("role") == "coordinator") | ((c("role") == "mixed") & ~active)
    return roles.withColumns({"skip": skip, "reason": reason})
