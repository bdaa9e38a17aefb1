"""Evaluation cases for third-party scorers, one row per case, and the way back from scorer
replies to metric results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.constants import ENTITY_TYPES, NO_FINAL_RESPONSE, NO_USER_INPUT, REFERENCE_TOPICS
from spanloom.functions.filters import is_system_content
from spanloom.functions.values import lenient_json, strip, truthy
from spanloom.operators.conversation import (
    ELEMENT_ORDER,
    chat_messages,
    messages_json,
    conversation_elements,
    endpoints,
)
from spanloom.operators.ordered import packed
from spanloom.operators.parse import attach_tool_definitions, input_text, output_text
from spanloom.operators.results import result_rows
from spanloom.operators.sessions import SESSION_ORDER, with_order
from spanloom.schemas import SCORER_REPLY_SCHEMA

# Evaluation, scorer family, level, entity types, needed inputs.
CATALOG = [
    ("AnswerRelevancyMetric", "deepeval", "span", ["llm"], ["input_query", "final_response"]),
    ("RoleAdherenceMetric", "deepeval", "session", ["llm", "tool"], ["conversation_elements"]),
    ("TaskCompletionMetric", "deepeval", "session", ["llm", "tool"], ["tool_calls", "input_query", "final_response"]),
    ("ConversationCompletenessMetric", "deepeval", "session", ["llm"], ["conversation_elements"]),
    ("BiasMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("CoherenceMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("GroundednessMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("TonalityMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("ToxicityMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("AnswerCorrectnessMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("GeneralStructureAndStyleMetric", "deepeval", "span", ["llm"], ["input_payload", "output_payload"]),
    ("Hallucination", "opik", "span", ["llm"], ["input_payload", "output_payload"]),
    ("Sentiment", "opik", "span", ["llm"], ["input_payload", "output_payload"]),
    ("TopicAdherenceScore", "ragas", "session", ["llm"], ["conversation_elements"]),
]

# Span evaluations whose entity types a caller may widen.
WIDENABLE = ["AnswerRelevancyMetric", "BiasMetric", "ToxicityMetric", "Hallucination", "Sentiment"]

TOPIC_MODES = ["precision", "recall", "f1"]

_CATALOG_SCHEMA = (
    "metric_name string, source string, aggregation_level string, entity_types array<string>, "
    "required_inputs array<string>"
)


def catalog(spark: SparkSession, allowed_types: str = "") -> DataFrame:
    """The evaluation catalogue. `allowed_types` ('llm, agent') replaces the entity types of
    the widenable evaluations; names it does not know are ignored."""
    asked = [t.strip().lower() for t in allowed_types.split(",")]
    types = [t for t in asked if t in ENTITY_TYPES]
    rows = [
        (m, s, level, types if types and m in WIDENABLE else kinds, needs) for m, s, level, kinds, needs in CATALOG
    ]
    return spark.createDataFrame(rows, _CATALOG_SCHEMA)


def assess_spans(spans: DataFrame, metric: str, types: list[str], needs: list[str]) -> DataFrame:
    """Whether each span can be evaluated, with the reason when not."""
    text = {"input_payload": input_text(), "output_payload": output_text()}
    missing = F.array_compact(F.array(*[F.when(_empty(text.get(c, F.col(c))), F.lit(c)) for c in needs]))
    reason = F.when(
        ~F.coalesce(F.col("entity_type").isin(*types), F.lit(False)),
        F.concat(F.lit("entity type not in " + ",".join(types) + ": "), F.coalesce("entity_type", F.lit("none"))),
    ).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    return spans.select(
        "session_id", "span_id", F.lit(metric).alias("metric_name"), reason.isNull().alias("valid"), reason.alias("reason")
    )


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", "{}")


def assess_sessions(spans: DataFrame, metric: str, types: list[str]) -> DataFrame:
    """Whether each session holds a span of a wanted type."""
    hit = spans.groupBy("session_id").agg(F.bool_or(F.col("entity_type").isin(*types)).alias("valid"))
    reason = F.when(~F.col("valid"), F.lit("no span of type " + ",".join(types)))
    return hit.select("session_id", F.lit(metric).alias("metric_name"), "valid", reason.alias("reason"))


def redact_images(values: Column) -> Column:
    """Image links on the first two levels of JSON values replaced; other values unchanged."""
    one_object = r'("image_url"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|\{[^{}]*\}|[^,{}\[\]]+)'
    return F.transform_values(
        values,
        lambda k, v: F.when(
            v.contains("image_url") & lenient_json(v).isNotNull(),
            F.regexp_replace(v, one_object, '$1"REDACTED"'),
        ).otherwise(v),
    )


def _case(df: DataFrame, metric: Column | str, **columns: Column) -> DataFrame:
    have = set(df.columns)
    name = F.lit(metric) if isinstance(metric, str) else metric
    ident = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "span_id", "part") if c in have]
    keys = [F.col(c) for c in ("session_id", "span_id", "part") if c in have]
    return df.select(
        F.sha2(F.concat_ws("|", name, *ident), 256).alias("case_id"),
        name.alias("metric_name"),
        *keys,
        *[c.alias(n) for n, c in columns.items()],
    )


def _models(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("entity_type") == "llm")


def span_cases(spans: DataFrame, metric: str) -> DataFrame:
    """Payload in, payload out, images redacted."""
    return _case(
        _models(spans),
        metric,
        input=F.to_json(redact_images(F.col("prompts"))),
        actual_output=F.to_json("completions"),
    )


def shown_tools() -> Column:
    """All tool definitions of a model span, whatever their numbers."""
    return F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["description"].alias("description"), f["parameters"].alias("parameters")))


def task_cases(spans: DataFrame, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, tool calls): the exchange of each session that has both ends, and the tools it
    called in order."""
    ends = endpoints(spans)
    whole = ends.filter(truthy(F.col("input_query")).isNotNull() & truthy(F.col("final_response")).isNotNull())
    cases = _case(whole, "TaskCompletionMetric", input=F.col("input_query"), actual_output=F.col("final_response"))
    return cases, session_tools(spans, max_items)


def session_tools(spans: DataFrame, max_items: int | None = None) -> DataFrame:
    """Tool calls of each session as a JSON list, with the description that the session's models
    were shown."""
    used = with_order(attach_tool_definitions(spans)).filter(F.col("entity_type") == "tool")
    item = F.struct(
        F.col("entity_name").alias("name"),
        F.col("tool_definition.description").alias("description"),
        F.col("input_payload").alias("input_parameters"),
        F.col("output_payload").alias("output"),
    )
    return packed(used, ["session_id"], SESSION_ORDER, item, "_tools", max_items).select(
        "session_id", "part", F.size("_tools").cast("bigint").alias("n_tools"), F.to_json("_tools").alias("tools_called")
    )


def conversation_cases(spans: DataFrame, metric: str, max_items: int | None = None) -> DataFrame:
    """Turns of each session; roles other than user and assistant become assistant."""
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("assistant")
    turns = packed(
        conversation_elements(spans), ["session_id"], ELEMENT_ORDER, F.struct(role.alias("role"), "content"), "_turns", max_items
    )
    return _case(turns, metric, n_turns=F.size("_turns").cast("bigint"), turns=F.to_json("_turns"))


def answer_relevancy_cases(spans: DataFrame) -> DataFrame:
    """Tool definitions and chat payload in, completions out."""
    asked = F.to_json(
        F.struct(shown_tools().alias("tool_definitions"), redact_images(F.col("prompts")).alias("chat_payload"))
    )
    return _case(_models(spans), "AnswerRelevancyMetric", input=asked, actual_output=F.to_json("completions"))


def session_relevancy_cases(spans: DataFrame) -> DataFrame:
    """Query and response of each session, filtered conversation elements where one of them
    is missing, a fixed text where nothing fits."""
    said = conversation_elements(spans).filter(~is_system_content(F.col("content")))
    order = F.struct(*ELEMENT_ORDER)
    pick = lambda fn, role: fn("content", F.when(F.lower("role") == role, order))
    spare = said.groupBy("session_id").agg(
        pick(F.min_by, "user").alias("_q"), pick(F.max_by, "assistant").alias("_a")
    )
    every = spans.select("session_id").distinct().join(endpoints(spans), "session_id", "left").join(
        spare, "session_id", "left"
    )
    text = lambda a, b, otherwise: F.coalesce(truthy(F.col(a)), truthy(F.col(b)), F.lit(otherwise))
    return _case(
        every,
        "AnswerRelevancyMetric",
        input=text("input_query", "_q", NO_USER_INPUT),
        actual_output=text("final_response", "_a", NO_FINAL_RESPONSE),
    )


def answer_correctness_cases(spans: DataFrame) -> DataFrame:
    """Tool definitions and chat history in, answer out, expected output where known."""
    tools = F.coalesce(F.to_json(shown_tools()), F.lit("[]"))
    asked = messages_json(chat_messages("prompts"))
    return _case(
        _models(spans),
        "AnswerCorrectnessMetric",
        input=F.concat(F.lit('{"tool_definitions":'), tools, F.lit(',"chat_payload":'), asked, F.lit("}")),
        actual_output=messages_json(chat_messages("completions")),
        expected_output=F.coalesce("expected_output", F.lit("")),
    )


def style_cases(spans: DataFrame) -> DataFrame:
    """The answer only."""
    return _case(
        _models(spans),
        "GeneralStructureAndStyleMetric",
        input=F.lit("{}"),
        actual_output=messages_json(chat_messages("completions")),
    )


def _first_of(payload: Column, keys: list[str]) -> Column:
    """The first non-empty value among some top-level keys, else the payload itself."""
    return F.coalesce(*[truthy(F.get_json_object(payload, f"$.{k}")) for k in keys], payload)


def span_parameter_cases(spans: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Input and output by key priority."""
    kept = spans.filter(F.col("entity_type").isin(*(types or ["llm"])))
    return _case(
        kept,
        "Sentiment",
        input=_first_of(input_text(), ["input", "question", "query"]),
        output=_first_of(output_text(), ["output", "answer", "response"]),
        expected_output=F.col("expected_output"),
    )


def hallucination_cases(spans: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The same with more keys, and the context embedded in the input."""
    kept = spans.filter(F.col("entity_type").isin(*(types or ["llm"])))
    source = input_text()
    context = F.coalesce(
        *[truthy(F.get_json_object(source, f"$.{k}")) for k in ("context", "documents", "retrieved_docs", "knowledge_base")]
    )
    listed = F.when(context.startswith("["), F.from_json(context, "array<string>")).when(
        context.isNotNull(), F.array(context)
    )
    return _case(
        kept,
        "Hallucination",
        input=_first_of(source, ["input", "question", "query", "prompt"]),
        output=_first_of(output_text(), ["output", "answer", "response", "completion"]),
        context=listed,
    )


def session_parameter_cases(spans: DataFrame) -> DataFrame:
    """Conversation, ends and tools of each session."""
    turns = conversation_cases(spans, "SessionParameters").drop("case_id", "metric_name")
    tools = session_tools(spans)
    parts = turns.join(tools, ["session_id", "part"], "full_outer").join(endpoints(spans), "session_id", "left")
    return _case(
        parts,
        "SessionParameters",
        conversation=F.col("turns"),
        user_input=F.col("input_query"),
        final_response=F.col("final_response"),
        tools_used=F.col("tools_called"),
    )


def topic_messages(spans: DataFrame) -> DataFrame:
    """User and assistant messages of model spans in time order, blanks dropped, and the
    first completion of each span."""
    elements = conversation_elements(_models(spans).filter((F.size("prompts") > 0) & (F.size("completions") > 0)))
    answer = (F.col("side") == 1) & (F.col("idx") == 0)
    asked = (F.col("side") == 0) & F.col("role").isin("user", "assistant")
    kind = F.when(answer, "ai").when(F.col("role") == "user", "human").otherwise("ai")
    content = strip(F.col("content"))
    return (
        elements.filter(answer | asked)
        .withColumn("message_type", kind)
        .withColumn("content", content)
        .filter(F.col("content") != "")
    )


def topic_cases(spans: DataFrame, mode: str = "precision", topics: list[str] | None = None, max_items: int | None = None) -> DataFrame:
    """Multi-turn samples with reference topics, one row for each session unless `max_items` asks for parts."""
    if mode not in TOPIC_MODES:
        raise ValueError(f"mode must be one of {TOPIC_MODES}, got {mode!r}")
    item = F.struct(F.col("message_type").alias("type"), "content")
    listed = packed(topic_messages(spans), ["session_id"], ELEMENT_ORDER, item, "_m", max_items)
    return _case(
        listed,
        "TopicAdherenceScore",
        n_messages=F.size("_m").cast("bigint"),
        user_input=F.to_json("_m"),
        reference_topics=F.lit(",".join(topics or REFERENCE_TOPICS)),
        mode=F.lit(mode),
    )


def scored_results(cases: DataFrame, replies: DataFrame, source: str) -> DataFrame:
    """Metric results from scorer replies: threshold and reason kept as metadata, a reply with
    an error becomes value -1."""
    joined = cases.join(replies.select(*[f.name for f in SCORER_REPLY_SCHEMA.fields]), "case_id")
    own = F.create_map(
        F.lit("threshold"), F.col("threshold").cast("string"), F.lit("reason"), F.col("reason")
    )
    meta = F.map_filter(F.map_concat(own, F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda k, v: v.isNotNull())
    return result_rows(
        joined,
        F.col("metric_name"),
        "span",
        F.col("score"),
        error=F.col("error"),
        reasoning=F.col("reason"),
        metadata=F.to_json(meta),
        source=source,
    )
