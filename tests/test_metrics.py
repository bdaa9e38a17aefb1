import itertools
import json
import math
import random

import pytest

from spanloom.operators import agents, confidence, conversation, metrics, sessions
from tests.conftest import agent, model, tool


def _rate(df):
    return metrics.tool_error_rate(df).first()["tool_error_rate"]


@pytest.mark.parametrize(("failed", "ok", "rate"), [(0, 0, 0.0), (0, 2, 0.0), (2, 0, 100.0), (1, 1, 50.0)])
def test_tool_error_rate(spans, failed, ok, rate):
    rows = [tool(status="Error")] * failed + [tool()] * ok + [agent("x_agent")]
    rows = [{**r, "id": f"i{n}"} for n, r in enumerate(rows)]
    assert _rate(spans(rows)) == rate


def test_agent_tool_error_rate(spans):
    rows = [agent("first_agent", id="a"), agent("second_agent", id="b")]
    rows += [tool(id=f"a{i}", parent="a", status="Error" if i == 0 else "Ok") for i in range(2)]
    rows += [tool(id=f"b{i}", parent="b") for i in range(3)]
    got = metrics.agent_tool_error_rate(agents.agent_spans(spans(rows))).collect()
    assert {r["agent"]: r["tool_error_rate"] for r in got} == {"first_agent": 50.0, "second_agent": 0.0}


def _mention(name, **kw):
    return agent(name, events=[{"agent_name": name}], **kw)


def test_transitions(spans):
    got = metrics.agent_transitions(spans([_mention("A"), _mention("B"), _mention("B"), _mention("C")])).collect()
    assert sorted(r["transition"] for r in got) == ["A -> B", "B -> C"]


@pytest.mark.parametrize("rows", [[agent("A")], [_mention("Z"), _mention("Z")], [agent("A", events=[None])]])
def test_no_transitions_give_an_empty_map(spans, rows):
    df = spans(rows)
    counts = metrics.transition_counts(metrics.agent_transitions(df))
    got = metrics.agent_to_agent(counts, sessions.sessions(df)).collect()
    assert [r["value_json"] for r in got] == ["{}"]


def test_transitions_of_a_hot_session(spark, spans, small_groups):
    rnd = random.Random(5)
    names = [rnd.choice("ABC") for _ in range(60)]
    got = metrics.agent_transitions(spans([_mention(n) for n in names])).count()
    assert got == sum(a != b for a, b in itertools.pairwise(names))


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([tool()], [("(Agent: flow) -> (Tool: search)", 1)]),
        ([tool(id="a"), tool(id="b")], [("(Agent: flow) -> (Tool: search)", 2)]),
        ([tool(id="a"), {"name": "x.tool", "id": "b", "attrs": {"traceloop.entity.name": "x"}}], [(None, -1)]),
    ],
)
def test_agent_to_tool(spans, rows, want):
    assert [(r["interaction"], r["n"]) for r in metrics.agent_to_tool(spans(rows)).collect()] == want


def test_path_variance_equals_the_mean_over_pairs(spans):
    rnd = random.Random(11)
    paths = {f"s{i}": [rnd.choice("ABCD") for _ in range(rnd.randrange(0, 7))] for i in range(8)}
    rows = [tool(n, session=s) for s, names in paths.items() for n in names]
    rows += [model(session=s) for s in paths]
    edges = {s: {(a, b) for a, b in itertools.pairwise(p)} for s, p in paths.items()}
    pairs = [len(edges[a] ^ edges[b]) for a, b in itertools.combinations(paths, 2)]
    df = spans(rows)
    got = metrics.path_variance(metrics.path_edges(df), df.select("session_id").distinct()).first()
    assert got["path_variance"] == pytest.approx(sum(pairs) / len(pairs))


def test_path_variance_needs_two_sessions(spans):
    df = spans([tool("a"), tool("b")])
    got = metrics.path_variance(metrics.path_edges(df), df.select("session_id").distinct()).first()
    assert got["path_variance"] == -1 and got["error"]


def _with_logprobs(*values):
    tokens = [{"token": "t", "logprob": v, "bytes": None, "top_logprobs": []} for v in values]
    return json.dumps({"choices": [{"logprobs": {"content": tokens}}]})


def test_confidence(spans):
    df = spans([model(completions=[("assistant", _with_logprobs(-0.1, -0.5))]), tool(session="none")])
    got = confidence.confidence(confidence.token_logprobs(df), sessions.sessions(df)).collect()
    by = {r["session_id"]: r for r in got}
    assert by["s1"]["average_confidence"] == pytest.approx(math.exp(-0.3))
    assert by["s1"]["minimum_confidence"] == pytest.approx(math.exp(-0.5))
    assert by["s1"]["maximum_confidence"] == pytest.approx(math.exp(-0.1))
    assert by["none"]["average_confidence"] == -1


def test_average_confidence_of_one_span(spans):
    df = spans([model(completions=[("assistant", _with_logprobs(-0.1, -0.3))])])
    got = confidence.confidence(confidence.token_logprobs(df), sessions.sessions(df)).first()
    assert got["average_confidence"] == pytest.approx(math.exp(-0.2))


def test_conversation_ends(spans):
    rows = [
        model([("system", "be kind"), ("user", "what is the weather?")], [("assistant", "It is sunny all day long.")]),
        model([("system", "be kind"), ("user", "what is the weather?")], [("assistant", '{"next": "FINISH"}')]),
    ]
    got = conversation.endpoints(spans(rows)).first()
    assert (got["input_query"], got["final_response"]) == ("what is the weather?", "It is sunny all day long.")


def test_latest_call_without_query_gives_none(spans):
    rows = [model([("user", "first question")], [(None, "a long enough answer")]), model([("system", "x")], [])]
    got = conversation.endpoints(spans(rows)).first()
    assert (got["input_query"], got["final_response"]) == (None, "a long enough answer")


def test_session_duration_from_span_times(spans):
    rows = [
        tool(attrs={"ioa_start_time": "0"}, duration=1_000_000_000),
        tool(attrs={"ioa_start_time": "1"}, duration=2_000_000_000),
    ]
    assert sessions.sessions(spans(rows)).first()["duration_ms"] == 3000.0


def test_tool_status(spans):
    rows = [
        tool(id="a", attrs={"traceloop.entity.output": '{"r": [{"status": "done"}]}'}),
        tool(id="b", attrs={"traceloop.entity.output": '{"status": 3}'}), tool(id="c"),
    ]
    got = {r["span_id"]: r["status"] for r in metrics.tool_status(spans(rows)).collect()}
    assert got == {"a": "done", "b": "3", "c": None}


def test_negative_tokens_count_in_sessions_but_not_for_agents(spans):
    minus = {"agent_id": "a_agent", "llm.usage.total_tokens": "-4"}
    df = spans([model(attrs=minus), model(attrs={**minus, "llm.usage.total_tokens": "10"})])
    assert sessions.sessions(df).first()["llm_total_tokens"] == 6
    assert agents.agent_stats(df).first()["llm_total_tokens"] == 10


def test_transcripts_of_a_hot_session_are_whole(spark, spans, small_groups):
    rows = [model([("user", f"question {i:03d}")], []) for i in range(45)]
    el = conversation.conversation_elements(spans(rows))
    parts = conversation.transcripts(el, ["session_id"], max_lines=10).orderBy("part").collect()
    assert [p["part"] for p in parts] == [0, 1, 2, 3, 4]
    text = "\n".join(p["text"] for p in parts)
    assert text == "\n".join(f"User: question {i:03d}" for i in range(45))


def test_passive_measures_are_zero_where_an_agent_took_no_part(spans):
    from spanloom.operators import population

    df = spans([agent("one_agent", session="s1"), agent("two_agent", session="s2")])
    grid = population.aligned_agent_measures(population.agent_metrics(agents.agent_stats(df)), sessions.sessions(df))
    got = {(r["session_id"], r["agent"]): r["duration"] for r in grid.select("session_id", "agent", "duration").collect()}
    assert got == {("s1", "one_agent"): 1.0, ("s1", "two_agent"): 0.0, ("s2", "one_agent"): 0.0, ("s2", "two_agent"): 1.0}


def test_long_agent_lists_give_the_same_grid(spans, monkeypatch):
    from spanloom.operators import population

    df = spans([agent(f"a{i}_agent", session=f"s{i % 3}") for i in range(7)])
    stats, ids = population.agent_metrics(agents.agent_stats(df)), sessions.sessions(df)
    shape = lambda g: sorted((r["session_id"], r["agent"], r["completion"]) for r in g.collect())
    plain = shape(population.aligned_agent_measures(stats, ids))
    monkeypatch.setattr(population, "_AGENTS_A_PART", 2)
    monkeypatch.setattr(population, "_SESSIONS_A_PART", 1)
    assert shape(population.aligned_agent_measures(stats, ids)) == plain
    assert len(plain) == 21


def test_distributions_are_those_of_the_grid(spark):
    """Merged states with added zeros against all (session, agent) pairs; values below zero too."""
    from spanloom.operators import population

    draw = random.Random(5)
    part = [(f"s{i:03d}", a, *[float(draw.choice([0, -1, 0.5, draw.randrange(1, 50)])) for _ in range(14)]) for i in range(200) for a in "abc" if draw.random() < {"a": 1.0, "b": 0.4, "c": 0.02}[a]]
    names = ["session_id", "agent", *population.AGENT_MEASURES]
    metrics_rows = spark.createDataFrame(part, ", ".join(f"{n} {'string' if i < 2 else 'double'}" for i, n in enumerate(names)))
    early, late = metrics_rows.filter("session_id < 's120'"), metrics_rows.filter("session_id >= 's120'")
    states = population.merged_sketches(population.agent_sketches(early).unionByName(population.agent_sketches(late)))
    got = {(r.agent, r.measure): r for r in population.agent_distributions(states, 200).collect()}
    assert len(got) == 3 * 14
    grid = population.aligned_agent_measures(metrics_rows, spark.createDataFrame([(f"s{i:03d}",) for i in range(200)], "session_id string"))
    held = {}
    for r in grid.collect():
        for m in population.AGENT_MEASURES:
            held.setdefault((r.agent, m), []).append(r[m])
    for key, values in held.items():
        values.sort()
        r = got[key]
        assert (r.n_sessions, r.n_zero, r.least, r.most) == (200, values.count(0), values[0], values[-1])
        assert [r.p25, r.p50, r.p75, r.p90] == [values[-(-200 * p // 100) - 1] for p in (25, 50, 75, 90)]
        assert abs(r["mean"] - sum(values) / 200) < 1e-9
