"""A span table derived from the event and conversation tables, for running the operators
on data that carries no traces of its own. Everything is row-local or grouped on at most
a handful of rows, so the derivation itself never builds a large group.

Events: blocks of 16 consecutive ids form a session of 5 to 16 spans (a span's parent sits
at half its slot); the remaining ids are spans without a session. Conversations: every
assistant turn is a model call with up to three earlier turns as its prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.schemas import HISTOGRAM_SCHEMA, SPAN_SCHEMA

AGENTS = ["planner_agent", "research_agent", "writer_agent"]

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Narrow rows over all cores where the input is too few files to fill them; inputs of
    many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _uuid(number: Column) -> Column:
    h = F.md5(number.cast("string"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, p, n) for p, n in cuts])


def _text_map(pairs: dict[str, Column]) -> Column:
    """A text map of the pairs whose value is not null."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _whole_schema(df: DataFrame) -> DataFrame:
    columns = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SPAN_SCHEMA.fields
        ]
    )


def event_spans(spark: SparkSession, folder: str) -> DataFrame:
    e = _spread(table(spark, folder, "events", EVENT_SCHEMA))
    e = e.select(
        F.col("event_id").alias("e"),
        "ts",
        "event_type",
        "value",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"),
        F.floor(F.col("event_id") / 16).cast("bigint").alias("s"),
        (F.col("event_id") % 16).cast("int").alias("j"),
    ).withColumn("member", F.col("j") < 5 + (F.col("s") * 7) % 12)
    s, k, j = F.col("s"), F.col("k"), F.col("j")
    kind = (
        F.when(F.col("event_type").isin("click", "error"), "tool")
        .when(F.col("event_type") == "purchase", "agent")
        .when((F.col("event_type") == "signup") & (k % 5 == 0), "graph")
        .when((F.col("event_type") == "signup") & (k % 5 == 1), "autoflow")
        .when((F.col("event_type") == "signup") & (k % 5 == 2), "autoagent")
        .when(F.col("event_type") == "signup", "workflow")
        .when(k % 4 < 2, "llm")
        .when(k % 12 == 3, "other")
        .otherwise("task")
    )
    e = e.withColumn("kind", kind)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kt = k.cast("string")
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), k % 3 + 1)
    flow = text("flow_", (s % 3).cast("string"))
    session = text("app", (s % 5).cast("string"), "_", _uuid(s))
    micros = F.unix_micros("ts")
    start = text(
        F.floor(micros / 1000000).cast("bigint").cast("string"),
        ".",
        F.lpad((micros % 1000000).cast("string"), 6, "0"),
    )
    span_name = (
        F.when(is_("tool"), text("tool_", (k % 4).cast("string"), ".Tool"))
        .when(is_("agent"), text(agent, ".agent"))
        .when(is_("graph"), F.lit("onboard.graph"))
        .when(is_("autoflow"), text("autogen create group_topic_", kt))
        .when(is_("autoagent"), text("autogen process WebSurfer", (k % 2).cast("string"), "_", kt, ".x"))
        .when(is_("workflow"), text("onboard", (k % 2).cast("string"), ".workflow"))
        .when(is_("llm"), F.lit("openai.chat"))
        .when(is_("task"), text("page_", (k % 5).cast("string"), ".task"))
        .otherwise(text("http.request_", (k % 3).cast("string")))
    )
    tool_output = (
        F.when((F.col("event_type") == "error") & (k % 2 == 0), text('{"error": "Traceback (most recent call) in step ', kt, '"}'))
        .when(k % 20 == 6, text('{"msg": {"deep": ["ValueError Exception raised at ', kt, '"]}}'))
        .when(k % 20 == 11, F.lit('{"exception": "none", "status": "clean"}'))
        .when(k % 5 == 0, text('{"result": {"status": "ok", "code": ', kt, "}}"))
        .when(k % 5 == 1, text('{"status": "failed", "note": "retry ', kt, '"}'))
        .when(k % 5 == 2, text("plain text ", kt))
        .when(k % 5 == 3, F.lit('[{"status": "partial"}]'))
    )
    flow_input = F.when(
        k % 2 == 0, text('{"inputs": {"chat_history": [{"message": "Query ', kt, '"}]}}')
    ).otherwise(text('{"inputs": {"messages": [["user", "Ask ', kt, '"]]}}'))
    flow_output = F.when(
        k % 4 != 3,
        text(
            '{"outputs": {"messages": [{"kwargs": {"content": "first"}}, {"kwargs": {"content": "Answer ',
            kt,
            '"}}, {"kwargs": {"content": "End ',
            kt,
            '"}}]}}',
        ),
    ).otherwise(text("flow text ", kt))
    completion = (
        F.when(k % 5 == 0, F.lit('{"next": "FINISH"}'))
        .when(k % 5 == 1, text("Assistant result for item ", kt, ": the computed value is ", (k * k).cast("string"), "."))
        .when(
            k % 5 == 2,
            text(
                '{"choices": [{"logprobs": {"content": [{"token": "a", "logprob": -0.',
                F.lpad(kt, 2, "0"),
                ', "bytes": null, "top_logprobs": []}, {"token": "b", "logprob": -1.',
                F.lpad((99 - k).cast("string"), 2, "0"),
                ', "bytes": null, "top_logprobs": []}]}}]}',
            ),
        )
        .when(k % 5 == 3, F.lit("The word finish is mentioned."))
        .otherwise(text("Short analysis of item ", kt, " to research and write"))
    )
    llm = is_("llm")
    pairs = {
        "session.id": F.when(F.col("member") & (s % 9 != 0), session),
        "execution.id": F.when(F.col("member") & (s % 9 == 0), session),
        "agent_id": F.when(is_("llm", "tool") & (k % 8 == 0), text(" ", agent, " "))
        .when(is_("llm", "tool") & (k % 2 == 0), agent)
        .when(is_("agent") & (k % 7 == 0), F.lit("lead_agent")),
        "application_id": F.when((s % 17 == 0) & (j % 4 == 1), text("APP-", (s % 3).cast("string"))),
        "app.name": F.when(s % 13 == 0, text("attr_app", (s % 2).cast("string"))),
        "ioa_start_time": F.when(k % 10 != 9, start),
        "traceloop.span.kind": F.when(k % 3 != 0, F.when(is_("autoflow"), "workflow").when(is_("autoagent"), "agent").otherwise(F.col("kind"))),
        "traceloop.entity.name": F.when(is_("tool") & (k % 29 != 0), text("tool_", (k % 4).cast("string")))
        .when(is_("task") & (k % 6 == 2), F.lit("review_agent.task"))
        .when(is_("task"), text("page_", (k % 5).cast("string")))
        .when(is_("agent") & (k % 11 == 3), F.lit("fallback_agent")),
        "ioa_observe.entity.name": F.when(is_("tool") & (k % 3 > 0) & (k % 29 != 0), text("tool_", (k % 4).cast("string")))
        .when(is_("agent") & (k % 11 != 3), agent),
        "traceloop.entity.input": F.when(is_("tool"), text('{"q": ', kt, ', "tag": "t', (k % 4).cast("string"), '"}'))
        .when(is_("workflow", "autoflow"), flow_input),
        "traceloop.entity.output": F.when(is_("tool"), tool_output).when(is_("workflow", "autoflow"), flow_output),
        "ioa_observe.entity.input": F.when(is_("agent"), text("Plan step ", kt)),
        "ioa_observe.entity.output": F.when(
            is_("agent"),
            F.when(k % 2 == 0, text('{"value": "Agent reply ', kt, ' done"}')).otherwise(text('{"answer": ', kt, "}")),
        ),
        "ioa_observe.workflow.name": F.when(is_("tool") & ~((s % 10 == 3) & (k % 2 == 1)), flow)
        .when(is_("workflow"), text("flow_", (k % 2).cast("string")))
        .when(is_("graph"), F.lit("graph_main")),
        "traceloop.entity.path": F.when(is_("task") & (k % 6 == 3), F.lit("helper_agent.step.inner")),
        "traceloop.entity.error": F.when(is_("task") & (k % 14 == 7), F.lit("timeout")),
        "traceloop.entity.message": F.when(is_("task") & (k % 7 == 0), text("note ", kt)),
        "gen_ai.prompt.0.role": F.when(llm, "system"),
        "gen_ai.prompt.0.content": F.when(llm, F.lit("You are a careful helper.")),
        "gen_ai.prompt.1.role": F.when(llm, "user"),
        "gen_ai.prompt.1.content": F.when(llm, text("Please calculate item ", kt)),
        "gen_ai.completion.0.role": F.when(llm & (k % 3 > 0), "assistant"),
        "gen_ai.completion.0.content": F.when(llm, completion),
        "gen_ai.completion.0.tool_calls.0.name": F.when(llm & (k % 16 == 5), F.lit("tool_1")),
        "gen_ai.completion.0.tool_calls.0.arguments": F.when(llm & (k % 16 == 5), text('{"q": ', kt, "}")),
        "gen_ai.request.model": F.when(llm, F.lit("model-a")),
        "gen_ai.response.model": F.when(llm & (k % 9 != 0), F.lit("model-a-1")),
        "gen_ai.request.temperature": F.when(llm, F.lit("0.5")),
        "gen_ai.usage.cache_read_input_tokens": F.when(llm, F.lit("0")),
        "gen_ai.usage.prompt_tokens": F.when(llm & (k % 13 == 0), F.lit("12.0")).when(llm, kt),
        "gen_ai.usage.completion_tokens": F.when(llm, (k * 2).cast("string")),
        "llm.usage.total_tokens": F.when(llm & (k % 17 == 0), F.lit("-1")).when(llm, (k * 3).cast("string")),
        "llm.request.functions.0.name": F.when(llm, text("tool_", (k % 4).cast("string"))),
        "llm.request.functions.0.description": F.when(llm, text("desc ", kt)),
        "llm.request.functions.0.parameters": F.when(llm, text('{"type": "object", "n": ', kt, "}")),
        "llm.request.functions.1.name": F.when(llm & (k % 3 == 0), F.lit("tool_3")),
        "llm.request.functions.3.name": F.when(llm, F.lit("tool_gap")),
        "gen_ai.ioa.graph_determinism_score": F.when(is_("graph") & (k % 10 == 0), text("0.", F.lpad(kt, 2, "0"))),
        "gen_ai.ioa.graph_dynamism": F.when(is_("graph"), text("0.5", kt)),
        "gen_ai.ioa.graph": F.when(is_("graph"), text('{"nodes": ', kt, "}")),
        "tool_name": F.when(is_("other") & (k % 5 == 0), F.lit("probe")),
        "tool_args": F.when(is_("other") & (k % 5 == 0), F.lit("{}")),
        "tool_description": F.when(is_("other") & (k % 10 == 5), F.lit("probe the net")),
    }
    shown = F.when(is_("agent"), F.when(k % 7 == 0, "lead_agent").otherwise(agent))
    event = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    failed = F.col("event_type") == "error"
    return _whole_schema(
        e.select(
            F.col("ts").alias("Timestamp"),
            text("tr", (s * 2 + F.when(j >= 8, 1).otherwise(0)).cast("string")).alias("TraceId"),
            text("sp", F.col("e").cast("string")).alias("SpanId"),
            F.when(~F.col("member") | (j == 0), F.when(s % 2 == 0, ""))
            .when(F.col("e") % 23 == 0, text("gone", F.col("e").cast("string")))
            .otherwise(text("sp", (s * 16 + F.floor((j - 1) / 2)).cast("bigint").cast("string")))
            .alias("ParentSpanId"),
            span_name.alias("SpanName"),
            F.lit("SPAN_KIND_CLIENT").alias("SpanKind"),
            F.when(s % 11 == 0, "unknown")
            .when(s % 13 == 0, "")
            .otherwise(text("app", (s % 5).cast("string")))
            .alias("ServiceName"),
            _text_map(
                {"service.name": F.when((s % 11 == 0) & (s % 2 == 0), text("res_app", (s % 3).cast("string")))}
            ).alias("ResourceAttributes"),
            _text_map(pairs).alias("SpanAttributes"),
            F.when(k % 50 == 49, 0).otherwise(F.round(F.col("value") * 1e6)).cast("bigint").alias("Duration"),
            F.when(failed, "Error")
            .when(is_("task") & (k % 19 == 0), "STATUS_CODE_ERROR")
            .when(k % 2 == 0, "Ok")
            .otherwise("Unset")
            .alias("StatusCode"),
            F.when(failed, F.array(F.lit("log"), F.lit("exception")))
            .when(is_("agent"), F.array(F.lit("agent_start")))
            .alias("EventsName"),
            F.when(
                failed,
                F.array(
                    event("level", "warn"),
                    event("exception.message", text("boom ", kt), "exception.stacktrace", text("at step ", kt)),
                ),
            )
            .when(is_("agent"), F.array(event("agent_name", shown)))
            .alias("EventsAttributes"),
        )
    )


def chat_spans(spark: SparkSession, folder: str) -> DataFrame:
    """One model call per assistant turn; its prompts are all turns before it."""
    t = table(spark, folder, "conversations", TURN_SCHEMA)
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = t.withColumn("before", F.collect_list(F.struct("role", "text")).over(earlier))
    calls = turns.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("call"), F.col("role").alias("role0"), F.col("text").alias("text0"), "before",
        F.try_element_at("before", F.lit(-1))["text"].alias("text1"),
    )
    pairs = {
        "session.id": F.concat(F.lit("chat_"), _uuid(F.col("conv_id"))),
        "agent_id": F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("conv_id") % 3 + 1).cast("int")),
        "gen_ai.completion.0.role": F.col("role0"),
        "gen_ai.completion.0.content": F.col("text0"),
        "gen_ai.response.model": F.lit("model-b-1"),
        "llm.usage.total_tokens": F.length("text0"),
        "gen_ai.usage.prompt_tokens": F.length("text1"),
        "gen_ai.usage.completion_tokens": F.length("text0"),
    }
    prompt = lambda m, n, c, label: F.struct(
        F.concat(F.lit("gen_ai.prompt."), n.cast("string"), F.lit(f".{label}")).alias("key"), m[c].alias("value")
    )
    prompts = F.flatten(F.transform("before", lambda m, n: F.array(prompt(m, n, "role", "role"), prompt(m, n, "text", "content"))))
    prompts = F.map_from_entries(F.filter(prompts, lambda e: e["value"].isNotNull()))
    minute = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return _whole_schema(
        calls.select(
            F.timestamp_micros(
                F.unix_micros(minute) + F.col("conv_id") * 60000000 + F.col("call") * 1000000
            ).alias("Timestamp"),
            F.concat(F.lit("ctr"), F.col("conv_id").cast("string")).alias("TraceId"),
            F.concat_ws("_", F.lit("c"), F.col("conv_id"), F.col("call")).alias("SpanId"),
            F.when(F.col("call") > 2, F.concat_ws("_", F.lit("c"), F.col("conv_id"), F.col("call") - 2)).alias(
                "ParentSpanId"
            ),
            F.lit("openai.chat").alias("SpanName"),
            F.lit("chat").alias("ServiceName"),
            F.map_from_arrays(
                F.array().cast("array<string>"), F.array().cast("array<string>")
            ).alias("ResourceAttributes"),
            F.map_concat(_text_map(pairs), prompts).alias("SpanAttributes"),
            (F.length("text0") * 1000000).cast("bigint").alias("Duration"),
            F.lit("Ok").alias("StatusCode"),
        )
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    return event_spans(spark, folder).unionByName(chat_spans(spark, folder))


def histogram_points(spark: SparkSession, folder: str) -> DataFrame:
    """Latency points, one per event, keyed by the session's service."""
    e = table(spark, folder, "events", EVENT_SCHEMA)
    s = F.floor(F.col("event_id") / 16).cast("bigint")
    points = e.select(
        F.when(F.col("event_type") == "view", "queue_depth").otherwise("response_latency").alias("MetricName"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("app"), (s % 5).cast("string"))).alias(
            "ResourceAttributes"
        ),
        F.col("value").alias("Sum"),
        (F.col("value") / 2).alias("Min"),
        (F.col("value") * 2).alias("Max"),
    )
    return points.select(*[F.col(f.name).cast(f.dataType) for f in HISTOGRAM_SCHEMA.fields])


def judge_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Two judges per labelled document; replies come bare, fenced, as literals or broken."""
    labels = table(spark, folder, "labels", "doc_id bigint, quality int, toxic int")
    body = lambda score: F.concat(
        F.lit('{"metric_score": '), score.cast("string"), F.lit(', "score_reasoning": "doc '),
        F.col("doc_id").cast("string"), F.lit('"}'),
    )
    literal = F.concat(
        F.lit("{'result': {'metric_score': "), F.col("toxic").cast("string"),
        F.lit(", 'score_reasoning': 'lit "), F.col("doc_id").cast("string"), F.lit("'}}"),
    )
    fenced = F.concat(F.lit("```json\n"), body(F.col("toxic")), F.lit("\n```"))
    second = (
        F.when(F.col("doc_id") % 5 == 0, fenced)
        .when(F.col("doc_id") % 5 == 1, literal)
        .when(F.col("doc_id") % 10 == 7, F.lit("no score today"))
        .otherwise(body(F.col("toxic")))
    )
    request = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("request_id")
    return labels.select(
        request,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("judge_no"), body(F.col("quality")).alias("reply")),
                F.struct(F.lit(2).alias("judge_no"), second.alias("reply")),
            )
        ).alias("r"),
    ).select("request_id", F.col("r.judge_no").cast(T.IntegerType()).alias("judge_no"), "r.reply")
