import pytest
from pyspark.sql import functions as F

from spanloom.functions import values
from spanloom.operators.parse import attach_tool_definitions, parse_spans
from tests.conftest import agent, model, tool


def _one(df, column):
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("openai.chat", "llm"), ("X.Tool", "tool"), ("a.agent", "agent"), ("w.workflow", "workflow"), ("g.graph", "graph"),
        ("t.task", "task"), ("autogen process Web_1.tool", "agent"), ("autogen create topic", "workflow"), ("GET /", None),
    ],
)
def test_entity_type(raw_spans, name, kind):
    got = [r["entity_type"] for r in parse_spans(raw_spans([{"name": name}])).collect()]
    assert got == ([kind] if kind else [])


def test_tool_attributes_make_a_tool(raw_spans):
    triple = {"tool_name": "a", "tool_args": "", "tool_description": "c"}
    assert _one(parse_spans(raw_spans([{"name": "x.agent", "attrs": triple}])), "entity_type") == "tool"


@pytest.mark.parametrize("text", ['{"a": 1}', '{"a": {"b": [1, 2]}}', "{}", "[1]", '"x"', "12", "true"])
def test_valid_json(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert _one(df, values.lenient_json(F.col("t")).isNotNull())


@pytest.mark.parametrize("text", ["nope", None, "", '{"a": ', "{a: 1}", "{'a': 1}"])
def test_invalid_json(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert not _one(df, values.lenient_json(F.col("t")).isNotNull())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('{"a": "Traceback here"}', True), ('{"a": {"b": ["fine", "HTTPError 500"]}}', True), ('{"x": "an Exception"}', True),
        ('{"exception": "none"}', False), ('{"a": "all well", "n": 3}', False), ('{"a": "say \\"exception\\": now"}', True),
        ('{"exception \\" traceback": 1}', False), ('{"a": "\\u0065xception"}', True),
    ],
)
def test_error_words_are_sought_in_values_only(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert _one(df, values.json_has_error_words(F.col("t"))) is found


@pytest.mark.parametrize(
    ("output", "failed"),
    [('{"m": "Exception"}', True), ("plain Exception text", True), ('["Exception"]', False), ('{"ok": 1}', False), (None, False)],
)
def test_error_flag_from_output(raw_spans, output, failed):
    attrs = {} if output is None else {"traceloop.entity.output": output}
    assert _one(parse_spans(raw_spans([tool(attrs=attrs)])), "contains_error") is failed


def test_error_flag_from_status_and_attribute(raw_spans):
    rows = [tool(status="error"), tool(status="STATUS_CODE_ERROR"), tool(attrs={"traceloop.entity.error": "x"})]
    got = parse_spans(raw_spans(rows)).orderBy("span_id").collect()
    assert [r["contains_error"] for r in got] == [True, False, True]


@pytest.mark.parametrize(
    ("row", "name"),
    [
        ({"service": "svc", "resource": {"service.name": "res"}}, "svc"),
        ({"service": "unknown", "resource": {"service.name": "res"}}, "res"),
        ({"service": "", "attrs": {"app.name": "attr"}}, "attr"),
        ({"service": None}, "unknown-app"),
    ],
)
def test_app_name_priority(raw_spans, row, name):
    assert _one(parse_spans(raw_spans([{"name": "a.tool", **row}])), "app_name") == name


def test_payloads_become_objects(raw_spans):
    attrs = {"traceloop.entity.input": "not json", "traceloop.entity.output": "[1, 2]"}
    got = parse_spans(raw_spans([tool(attrs=attrs)])).first()
    assert (got["input_payload"], got["output_payload"]) == ('{"value":"not json"}', '{"value":[1, 2]}')


def test_agent_id_names_the_agent(raw_spans):
    assert _one(parse_spans(raw_spans([agent("a", attrs={"agent_id": "boss"})])), "entity_name") == "boss"


def test_exception_details_come_from_the_first_exception_event(raw_spans):
    row = tool(
        status="Error", events_name=["log", "exception", "exception"],
        events=[{}, {"exception.message": "m", "exception.stacktrace": "t"}, {"exception.message": "n"}],
    )
    got = _one(parse_spans(raw_spans([row])), "error_data")
    assert (got["error_name"], got["error_trace"]) == ("m", "t")


def test_timing_without_duration(raw_spans):
    got = parse_spans(raw_spans([tool(duration=0, attrs={"ioa_start_time": "5.5"})])).first()
    assert (got["start_time"], got["end_time"], got["duration_ms"]) == (5.5, None, None)


def test_tool_definitions_stop_at_the_first_gap_and_the_first_wins(spans):
    f = "llm.request.functions."
    rows = [
        model(attrs={f + "0.name": "a", f + "0.description": "one", f + "2.name": "c"}),
        model(attrs={f + "0.name": "a", f + "0.description": "two"}),
        tool("a", id="ta"), tool("c", id="tc"),
    ]
    got = {r["span_id"]: r["tool_definition"] for r in attach_tool_definitions(spans(rows)).collect()}
    assert got["ta"]["description"] == "one"
    assert got["tc"] is None


@pytest.mark.parametrize(
    ("text", "order", "found"),
    [
        ('{"a": {"status": 1}, "status": 2}', "document", "1"), ('{"a": {"status": 1}, "status": 2}', "own_first", "2"),
        ('[{"b": 0}, {"status": "x"}]', "document", '"x"'), ('{"b": 1}', "document", None), ("broken status", "document", None),
    ],
)
def test_nested_key_order(spark, text, order, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert _one(df, values.find_key(F.col("t"), "status", order)) == found
