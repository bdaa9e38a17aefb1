"""Conversations as long frames: one row per element, never one object per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.filters import is_control_message
from spanloom.functions.values import decoded_text, json_is_object, strip, truthy
from spanloom.operators.ordered import packed
from spanloom.operators.sessions import order_struct

ELEMENT_ORDER = ["timestamp", "ts_order", "source", "span_id", "side", "idx"]


def _numbered(values: Column, prefix: str) -> Column:
    """Indexes used under 'prefix.N.' in a text map, ascending."""
    pattern = "^" + prefix.replace(".", r"\.") + r"\.([0-9]+)(\..*)?$"
    used = F.filter(F.map_keys(values), lambda k: k.rlike(pattern))
    return F.array_sort(
        F.array_distinct(F.transform(used, lambda k: F.regexp_extract(k, pattern, 1).cast("int")))
    )


def _field(values: Column, prefix: str, n: Column, name: str) -> Column:
    return F.try_element_at(values, F.concat(F.lit(prefix + "."), n.cast("string"), F.lit("." + name)))


def _item(side: int, idx: Column, role: Column, content: Column, source: int) -> Column:
    return F.struct(
        F.lit(source).alias("source"),
        F.lit(side).alias("side"),
        idx.cast("int").alias("idx"),
        role.alias("role"),
        content.alias("content"),
    )


def _messages(values: Column, prefix: str, side: int, default_role: str) -> Column:
    """Messages of a numbered text map: every index that has content."""
    listed = F.transform(
        _numbered(values, prefix),
        lambda n: _item(
            side,
            n,
            F.coalesce(_field(values, prefix, n, "role"), F.lit(default_role)),
            decoded_text(_field(values, prefix, n, "content")) if side else _field(values, prefix, n, "content"),
            0,
        ),
    )
    return F.filter(listed, lambda m: m["content"].isNotNull())


def _payload_value(payload: Column) -> Column:
    return F.get_json_object(payload, "$.value")


def conversation_elements(spans: DataFrame, keys: list[str] | None = None, tools: bool = False) -> DataFrame:
    """Prompts and completions of model spans, inputs and outputs of agent spans and, when
    asked for, tool calls and results. One pass: each span yields its own elements."""
    keys = keys or ["session_id"]
    kind = F.col("entity_type")
    none = F.array().cast("array<struct<source:int,side:int,idx:int,role:string,content:string>>")
    prompts, completions = F.col("prompts"), F.col("completions")
    model = F.concat(
        _messages(prompts, "gen_ai.prompt", 0, "unknown"),
        _messages(completions, "gen_ai.completion", 1, "assistant"),
    )
    exchange = F.array(
        _item(0, F.lit(0), F.lit("user"), _payload_value(F.col("input_payload")), 1),
        _item(1, F.lit(0), F.lit("assistant"), _payload_value(F.col("output_payload")), 1),
    )
    name = F.coalesce("entity_name", F.lit("unknown"))
    call = F.concat(F.lit("Tool call to "), name, F.lit(": "), F.col("input_payload"))
    result = F.concat(F.lit("Tool "), name, F.lit(" result: "), F.col("output_payload"))
    usage = F.array(
        _item(0, F.lit(0), F.lit("tool_input"), call, 2), _item(1, F.lit(0), F.lit("tool_output"), result, 2)
    )
    said = F.when(kind == "llm", model).when(kind == "agent", exchange)
    if tools:
        said = said.when(kind == "tool", usage)
    said = F.filter(F.coalesce(said, none), lambda m: m["content"].isNotNull())
    wanted = ["llm", "agent"] + (["tool"] if tools else [])
    return spans.filter(kind.isin(*wanted)).select(
        *keys,
        "span_id",
        "timestamp",
        F.coalesce("ts_raw", F.lit("")).alias("ts_order"),
        F.when(kind == "agent", F.col("entity_name")).alias("agent_name"),
        F.inline(said),
    )


def tool_call_records(spans: DataFrame) -> DataFrame:
    """Tool calls that model replies hold as JSON objects."""
    found = spans.filter(F.col("entity_type") == "llm").select(
        "session_id", "span_id", "timestamp", F.explode("completions").alias("key", "data")
    )
    return found.filter(
        F.col("key").startswith("gen_ai.completion")
        & F.col("key").contains(".tool_calls")
        & json_is_object(F.col("data"))
    )


def conversation_totals(elements: DataFrame, calls: DataFrame) -> DataFrame:
    """Elements and tool calls per session."""
    n = elements.groupBy("session_id").agg(F.count("*").alias("total_elements"))
    t = calls.groupBy("session_id").agg(F.count("*").alias("total_tool_calls"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(t, "session_id", "full_outer").select("session_id", zero("total_elements"), zero("total_tool_calls"))


def element_line() -> Column:
    """An element as a line of a transcript; roles outside the known five give none."""
    role, content = F.col("role"), F.col("content")
    prefixed = lambda p: F.concat(F.lit(p), content)
    return (
        F.when(role == "user", prefixed("User: "))
        .when(role == "assistant", prefixed("Assistant: "))
        .when(role == "system", prefixed("System: "))
        .when(role.isin("tool_input", "tool_output"), F.concat(F.lit("["), content, F.lit("]")))
    )


def transcripts(
    elements: DataFrame, keys: list[str], max_lines: int | None = None, largest: int | None = None
) -> DataFrame:
    """Transcript text, one row per group. `elements` itself is the long form of it."""
    lines = elements.withColumn("_line", element_line()).filter(F.col("_line").isNotNull())
    return packed(lines, keys, ELEMENT_ORDER, F.col("_line"), "_lines", max_lines, largest).select(
        *keys, "part", F.array_join("_lines", "\n").alias("text")
    )


def elements_json(
    elements: DataFrame, keys: list[str], max_items: int | None = None, largest: int | None = None
) -> DataFrame:
    """Conversation elements per group as a JSON list of {role, content}, one row per group."""
    item = F.struct("role", "content")
    return packed(elements, keys, ELEMENT_ORDER, item, "_items", max_items, largest).select(
        *keys, "part", F.to_json("_items").alias("elements")
    )


def agent_exchanges(spans: DataFrame, max_items: int | None = None) -> DataFrame:
    """Input and output of the agent spans of each session as one text."""
    said = spans.filter(F.col("entity_type") == "agent").withColumn("ts_order", F.coalesce("ts_raw", F.lit("")))
    shown = lambda c: F.coalesce(c, F.lit("None"))
    text = F.concat(F.lit("INPUT: "), shown("input_payload"), F.lit("\nOUTPUT: "), shown("output_payload"))
    return packed(said, ["session_id"], ["timestamp", "ts_order", "span_id"], text, "_t", max_items).select(
        "session_id", "part", F.array_join("_t", "\n\n").alias("conversation")
    )


def chat_messages(side: str) -> Column:
    """Messages of a model span, from its numbered prompts or completions, with every field: role
    and content, the tool calls of assistant messages rebuilt, and `fields`, all others by name.
    Messages of other roles keep flat tool-call fields among these. Row-local: bounded by the span's
    own attributes."""
    prefix = {"prompts": "gen_ai.prompt", "completions": "gen_ai.completion"}[side]

    def message(n: Column) -> Column:
        own = _below(F.col(side), F.concat(F.lit(prefix + "."), n.cast("string"), F.lit(".")))
        role, content = F.try_element_at(own, F.lit("role")), F.try_element_at(own, F.lit("content"))
        assistant = F.coalesce(role == "assistant", F.lit(False))
        calls = F.when(assistant, _tool_calls(own))
        quiet = assistant & (F.size(calls) > 0) & content.isin('""', "''")
        others = F.map_filter(own, lambda k, v: ~k.isin("role", "content") & ~(assistant & k.startswith("tool_calls.")))
        return F.struct(
            role.alias("role"),
            F.when(quiet, F.lit("")).when(assistant, F.coalesce(content, F.lit(""))).otherwise(content).alias("content"),
            calls.alias("tool_calls"),
            others.alias("fields"),
        )

    return F.transform(_numbered(F.col(side), prefix), message)


def _below(values: Column, head: Column) -> Column:
    """The entries whose key begins with `head`, by the rest of the key."""
    own = F.filter(F.map_entries(values), lambda e: e["key"].startswith(head))
    return F.map_from_entries(F.transform(own, lambda e: F.struct(F.substr(e["key"], F.length(head) + 1).alias("key"), e["value"].alias("value"))))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


def _members(fields: Column) -> Column:
    """The entries of a text map as members of a JSON object, by name."""
    return F.transform(
        F.array_sort(F.map_entries(fields)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.coalesce(_quoted(e["value"]), F.lit("null")))
    )


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(members), ","), F.lit("}"))


def messages_json(messages: Column) -> Column:
    """Messages as a JSON list of objects with all their fields. The arguments of a tool call
    are JSON themselves where they parse, else text; assistant messages always list their calls."""

    def call(c: Column) -> Column:
        arguments = F.when(F.try_parse_json(c["arguments"]).isNotNull(), c["arguments"]).otherwise(_quoted(c["arguments"]))
        known = [F.concat(F.lit(f'"{n}":'), _quoted(c[n])) for n in ("id", "name")]
        return _object(F.concat(F.array(*known, F.concat(F.lit('"arguments":'), arguments)), _members(c["fields"])))

    def message(m: Column) -> Column:
        known = [F.concat(F.lit(f'"{n}":'), _quoted(m[n])) for n in ("role", "content")]
        calls = F.concat(F.lit('"tool_calls":['), F.array_join(F.transform(m["tool_calls"], call), ","), F.lit("]"))
        return _object(F.concat(F.array(*known), _members(m["fields"]), F.array(calls)))

    return F.concat(F.lit("["), F.array_join(F.transform(messages, message), ","), F.lit("]"))


def chat_history(spans: DataFrame, side: str = "prompts") -> DataFrame:
    """Messages of each model span."""
    return spans.filter(F.col("entity_type") == "llm").select(
        "session_id", "span_id", chat_messages(side).alias("messages")
    )


def _tool_calls(own: Column) -> Column:
    """Tool calls among a message's fields, in the order of their numbers: id, name, arguments and
    all other fields."""
    numbers = F.array_sort(
        F.array_compact(
            F.array_distinct(F.transform(F.map_keys(own), lambda k: F.nullif(F.regexp_extract(k, r"^tool_calls\.([0-9]+)\.", 1), F.lit("")).cast("int")))
        )
    )

    def call(n: Column) -> Column:
        parts = _below(own, F.concat(F.lit("tool_calls."), n.cast("string"), F.lit(".")))
        known = [F.try_element_at(parts, F.lit(name)).alias(name) for name in ("id", "name", "arguments")]
        return F.struct(*known, F.map_filter(parts, lambda k, v: ~k.isin("id", "name", "arguments")).alias("fields"))

    return F.transform(numbers, call)


def input_query(values: Column) -> Column:
    """The first non-system prompt with text among a span's numbered prompts."""
    asked = F.filter(
        F.transform(
            _numbered(values, "gen_ai.prompt"),
            lambda n: F.struct(
                F.lower(_field(values, "gen_ai.prompt", n, "role")).alias("role"),
                truthy(_field(values, "gen_ai.prompt", n, "content")).alias("content"),
            ),
        ),
        lambda m: m["content"].isNotNull() & ~F.coalesce(m["role"] == "system", F.lit(False)),
    )
    return F.try_element_at(asked, F.lit(1))["content"]


def final_response(values: Column, min_length: int) -> Column:
    """The last completion that is an answer rather than a control message."""
    answered = F.filter(
        F.transform(
            _numbered(values, "gen_ai.completion"),
            lambda n: F.struct(
                F.lower(F.coalesce(_field(values, "gen_ai.completion", n, "role"), F.lit(""))).alias("role"),
                strip(decoded_text(truthy(_field(values, "gen_ai.completion", n, "content")))).alias("content"),
            ),
        ),
        lambda m: m["content"].isNotNull()
        & m["role"].isin("assistant", "")
        & ~is_control_message(m["content"], min_length),
    )
    return F.try_element_at(answered, F.lit(-1))["content"]


def endpoints(spans: DataFrame, keys: list[str] | None = None, min_length: int = 10) -> DataFrame:
    """Input query (from the latest model span) and final response (from the latest model
    span that has an acceptable one) per group. Sessions use length 10, agents 3."""
    keys = keys or ["session_id"]
    order = order_struct()
    answer = final_response(F.col("completions"), min_length)
    calls = spans.filter(F.col("entity_type") == "llm").select(
        *keys, order.alias("_o"), input_query(F.col("prompts")).alias("_q"), answer.alias("_a")
    )
    # A struct keeps a null query null: the latest span decides, not the latest with a query.
    return calls.groupBy(*keys).agg(
        F.max_by(F.struct("_q"), "_o")["_q"].alias("input_query"),
        F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col("_o"))).alias("final_response"),
    )
