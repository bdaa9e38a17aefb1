"""Requests for external judges, and what becomes of their replies. Calling a model is left
to the caller: requests are a table to hand out, replies a table to read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.values import find_key, reply_json, truthy
from spanloom.operators.results import result_rows
from spanloom.schemas import JUDGE_REPLY_SCHEMA

ANSWER_FORMAT = (
    "\nAnswer with one JSON object: `score_reasoning` (at most 100 words on the rubric) and "
    "`metric_score` (0 or 1)."
)


@dataclass(frozen=True)
class Criterion:
    """What a judge is asked: the question, the fields it sees, whether agents whose work is
    routing are left out at agent level."""

    metric: str
    question: str
    fields: tuple[str, ...] = ("conversation",)
    levels: tuple[str, ...] = ("session", "agent")
    skip_coordinators: bool = True


CRITERIA = {
    c.metric: c
    for c in [
        Criterion("Groundedness", "Is every claim of the assistant backed by what tools, documents or the user said?"),
        Criterion("ComponentConflictRate", "Do parts of the system contradict or undo each other's work?", levels=("session",)),
        Criterion("Consistency", "Do the answers agree with each other from start to end?"),
        Criterion("ContextPreservation", "Is the subject of the exchange kept through all turns?", skip_coordinators=False),
        Criterion("InformationRetention", "Are facts given early still known and used later?"),
        Criterion("ResponseCompleteness", "Is every part of what the user asked answered?"),
        Criterion("WorkflowCohesionIndex", "Do the steps and tools work together towards the goal?"),
        Criterion("GoalSuccessRate", "Does the response reach what the query asks for?", ("query", "response", "ground_truth"), skip_coordinators=False),
        Criterion("IntentRecognitionAccuracy", "Does the response show that the intent of the query was understood?", ("query", "response"), skip_coordinators=False),
        Criterion("ToolUtilizationAccuracy", "Was this tool the right one, called with the right input?", ("tool_name", "tool_definition", "tool_input", "tool_output"), ("span",)),
        Criterion("TaskDelegationAccuracy", "Was the task handed to the right agent, with what it needs?", ("agent_input", "agent_output"), ("span",)),
    ]
}


def render(template: str, fields: list[str], columns: set[str]) -> Column:
    """`{field}` marks of a template replaced by columns; absent or null fields are blank."""
    pieces, rest = [], template
    while rest:
        marks = [(rest.find("{" + f + "}"), f) for f in fields if "{" + f + "}" in rest]
        if not marks:
            pieces.append(F.lit(rest))
            break
        at, name = min(marks)
        pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit(""))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")


def requests(entities: DataFrame, metric: str, level: str) -> DataFrame:
    """One request per row of `entities`, which has session_id, optionally agent and span_id,
    optionally part (0, unless the caller packed texts with a limit), and the fields."""
    criterion = CRITERIA[metric]
    if level not in criterion.levels:
        raise ValueError(f"{metric} is not computed at {level} level")
    template = criterion.question + "".join(f"\n{f}:\n{{{f}}}" for f in criterion.fields) + ANSWER_FORMAT
    have = set(entities.columns)
    pick = lambda c, t="string": (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    ident = F.concat_ws(
        "|", F.lit(metric), F.lit(level), F.col("session_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("agent", "span_id", "part") if c in have],
    )
    return entities.select(
        F.sha2(ident, 256).alias("request_id"),
        F.lit(metric).alias("metric_name"),
        F.lit(level).alias("aggregation_level"),
        "session_id",
        pick("agent"),
        pick("span_id"),
        pick("part", "bigint"),
        render(template, list(criterion.fields), have).alias("prompt"),
    )


def conversation_requests(metric: str, shown: DataFrame, session_frame: DataFrame) -> DataFrame:
    """Session-level request over the conversation's elements (`shown`: their JSON, as
    `conversation.elements_json` renders it). Every session is asked about, one without elements
    with an empty conversation."""
    shown = shown.withColumnRenamed("elements", "conversation")
    every = session_frame.select("session_id").join(shown, "session_id", "left")
    return requests(every.withColumn("part", F.coalesce("part", F.lit(0))), metric, "session")


def agent_conversation_requests(metric: str, texts: DataFrame, roles: DataFrame) -> DataFrame:
    """Agent-level request over the agent's transcript (`texts`, as `conversation.transcripts`
    renders it). Agents without text are passed over,
    and so are coordinators where the criterion says so (`roles` has skip per agent)."""
    asked = texts.withColumnRenamed("text", "conversation")
    asked = asked.filter(truthy(F.col("conversation")).isNotNull())
    if CRITERIA[metric].skip_coordinators:
        asked = asked.join(roles.filter("skip").select("session_id", "agent"), ["session_id", "agent"], "left_anti")
    return requests(asked, metric, "agent")


def endpoint_requests(
    metric: str, ends: DataFrame, level: str, truth: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(requests, error rows) over query and final response. A session is asked about as it
    is; an agent that lacks either becomes an error row. `truth` is (query, answer)."""
    named = ends.withColumnsRenamed({"input_query": "query", "final_response": "response"})
    named = with_ground_truth(named, truth)
    lacking = truthy(F.col("query")).isNull() | truthy(F.col("response")).isNull()
    if level == "session":
        return requests(named, metric, level), result_rows(named.limit(0), metric, level)
    errors = result_rows(named.filter(lacking), metric, level, error=F.lit("no query or no response"))
    return requests(named.filter(~lacking), metric, level), errors


def with_ground_truth(rows: DataFrame, truth: DataFrame | None) -> DataFrame:
    """The known answer to each query, where a table of answers is given."""
    if truth is None:
        return rows.withColumn("ground_truth", F.lit("No ground truth available"))
    # The least of several answers; rows without a query do not meet in one task.
    known = truth.filter("query is not null").groupBy(F.col("query").alias("_query")).agg(F.min("answer").alias("ground_truth"))
    asked = rows.filter("query is not null").join(known, F.col("query") == F.col("_query"), "left").drop("_query")
    apart = rows.filter("query is null").withColumn("ground_truth", F.lit(None).cast("string"))
    return asked.unionByName(apart).withColumn("ground_truth", F.coalesce("ground_truth", F.lit("No ground truth available")))


def tool_use_requests(spans_with_definitions: DataFrame) -> DataFrame:
    """One request per tool span that has both payloads."""
    used = spans_with_definitions.filter(
        (F.col("entity_type") == "tool") & F.col("input_payload").isNotNull() & F.col("output_payload").isNotNull()
    ).select(
        "session_id",
        "span_id",
        F.col("entity_name").alias("tool_name"),
        F.to_json("tool_definition").alias("tool_definition"),
        F.col("input_payload").alias("tool_input"),
        F.col("output_payload").alias("tool_output"),
    )
    return requests(used, "ToolUtilizationAccuracy", "span")


def delegation_requests(spans: DataFrame) -> DataFrame:
    """One request per agent span."""
    tasks = spans.filter(F.col("entity_type") == "agent").select(
        "session_id",
        "span_id",
        F.col("input_payload").alias("agent_input"),
        F.col("output_payload").alias("agent_output"),
    )
    return requests(tasks, "TaskDelegationAccuracy", "span")


# --- replies ------------------------------------------------------------------------------------


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Replies handed back as JSON lines: request_id, judge_no, reply."""
    return spark.read.schema(JUDGE_REPLY_SCHEMA).json(path)


def parsed_replies(replies: DataFrame) -> DataFrame:
    """Score and reasoning of each reply, at any depth; both null where it does not parse."""
    read = replies.withColumn("_json", reply_json(F.col("reply")))
    top = lambda k: F.get_json_object("_json", f"$.{k}")
    # Almost every reply has its keys at the top; only the others are searched.
    deep = lambda k: find_key(F.when(top(k).isNull(), F.col("_json")), k, "reply")
    reason = deep("score_reasoning")
    reason = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), reason, F.lit("}")), "$.v"), reason)
    return read.select(
        "request_id",
        "judge_no",
        F.coalesce(top("metric_score"), deep("metric_score")).try_cast("double").alias("metric_score"),
        F.coalesce(top("score_reasoning"), reason).alias("score_reasoning"),
    )


def consensus(parsed: DataFrame) -> DataFrame:
    """Mean score over the judges and the last judge's reasoning; an error when any reply of
    the request has no score."""
    joint = parsed.groupBy("request_id").agg(
        F.avg("metric_score").alias("_score"),
        F.count_if(F.col("metric_score").isNull()).alias("_bad"),
        F.max_by(F.struct("score_reasoning"), "judge_no")["score_reasoning"].alias("_reason"),
    )
    bad = F.col("_bad") > 0
    return joint.select(
        "request_id",
        F.when(~bad, F.col("_score")).alias("score"),
        F.when(~bad, F.col("_reason")).alias("reasoning"),
        F.when(bad, "Unable to parse a judge's reply").alias("error"),
    )


def judged_results(asked: DataFrame, agreed: DataFrame) -> DataFrame:
    """Metric results from requests and the judges' consensus."""
    return result_rows(
        asked.join(agreed, "request_id"),
        F.col("metric_name"),
        "session",
        F.col("score"),
        error=F.col("error"),
        aggregation_level=F.col("aggregation_level"),
        reasoning=F.col("reasoning"),
        source="judge",
    )
