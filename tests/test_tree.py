import random

import pytest

from spanloom.operators import agents, tree
from tests.conftest import agent, model, tool


def _depths(df):
    return {r["span_id"]: (r["depth"], r["root_id"]) for r in tree.execution_tree(df).collect()}


def test_long_chain_keeps_true_depth(spans):
    rows = [tool(id=f"n{i:03d}", parent=f"n{i - 1:03d}" if i else None, at=100 - i) for i in range(70)]
    got = _depths(spans(rows))
    assert got == {f"n{i:03d}": (i, "n000") for i in range(70)}


def test_loops_and_self_parents_are_unreachable(spans):
    rows = [
        tool(id="a", parent="b"), tool(id="b", parent="c"), tool(id="c", parent="a"),
        tool(id="under", parent="a"), tool(id="self", parent="self"),
        tool(id="root"), tool(id="child", parent="root"), tool(id="lost", parent="nowhere"),
    ]
    assert _depths(spans(rows)) == {"root": (0, "root"), "child": (1, "root"), "lost": (0, "lost")}


def test_loop_beside_a_chain_longer_than_the_first_hops(spans):
    rows = [tool(id="a", parent="b"), tool(id="b", parent="a")]
    rows += [tool(id=f"n{i:02d}", parent=f"n{i - 1:02d}" if i else "") for i in range(12)]
    assert len(_depths(spans(rows))) == 12


def test_parents_cross_traces_but_not_sessions(spans):
    rows = [
        tool(id="p", trace="t1"), tool(id="q", trace="t2", parent="p"),
        tool(id="r", session="s2", parent="p"),
    ]
    assert _depths(spans(rows)) == {"p": (0, "p"), "q": (1, "p"), "r": (0, "r")}


def _walk(df):
    return [r["span_id"] for r in tree.walked(df).orderBy("session_id", "preorder").collect()]


FOREST = [
    tool(id="r2", trace="t2", at=5), tool(id="r1", trace="t1", at=1), tool(id="c2", parent="r1", at=9),
    tool(id="c1", parent="r1", at=3), tool(id="g", parent="c1", at=20), tool(id="late", trace="t1", at=30),
]
WALK = ["r1", "c1", "g", "c2", "late", "r2"]


def test_preorder_walks_traces_roots_and_children_by_time(spans):
    assert _walk(spans(FOREST)) == WALK


def test_labels_number_the_same_walk(spans):
    got = tree.labelled_tree(spans(FOREST)).orderBy("enter").collect()
    assert [(r["span_id"], r["enter"], r["leave"]) for r in got] == list(zip(WALK, range(6), (3, 2, 2, 3, 4, 5)))


def _below(rows):
    """{id: ids at and below it} of rows (id, parent)."""
    up = dict(rows)
    found = {}
    for node in up:
        at = node
        while at is not None:
            found.setdefault(at, set()).add(node)
            at = up[at]
    return found


def _random_forest(n, reach, seed):
    rnd = random.Random(seed)
    up = {i: (i - rnd.randrange(1, reach) if i > 3 else None) for i in range(n)}
    rows = [tool(id=f"n{i:03d}", parent=f"n{p:03d}" if p is not None and p >= 0 else "", at=rnd.randrange(500)) for i, p in up.items()]
    return rows, [(f"n{i:03d}", f"n{p:03d}" if p is not None and p >= 0 else None) for i, p in up.items()]


@pytest.mark.parametrize(("n", "reach"), [(150, 2), (150, 3), (200, 60)])
def test_descendants_by_interval(spans, n, reach):
    """Chains, thin trees and bushes; intervals of one span and of whole sessions."""
    rows, links = _random_forest(n, reach, n + reach)
    loop = [tool(id="x", parent="y"), tool(id="y", parent="x"), tool(id="one", session="s2")]
    labels = tree.labelled_tree(spans(rows + loop))
    below = _below(links)
    got = {r["span_id"]: (r["enter"], r["leave"]) for r in labels.filter("session_id = 's1'").collect()}
    assert sorted(e for e, _ in got.values()) == list(range(n))
    assert all(leave - enter + 1 == len(below[s]) for s, (enter, leave) in got.items())
    assert all({o for o, (e, _) in got.items() if enter <= e <= leave} == below[s] for s, (enter, leave) in got.items())
    pairs = [(r["start_id"], r["span_id"]) for r in tree.descendants(labels, labels).filter("session_id = 's1'").collect()]
    assert sorted(pairs) == sorted((s, o) for s, found in below.items() for o in found)
    assert tree.descendants(labels, labels.filter("span_id = 'one'")).count() == 1
    assert tree.descendants(labels, labels.filter("false")).count() == 0


def test_labels_with_hot_groups(spans, small_groups):
    rows, _ = _random_forest(120, 40, 3)
    df = spans(rows)
    by_path = [r["span_id"] for r in tree.with_paths(df).orderBy("path").collect()]
    assert _walk(df) == by_path


def test_preorder_is_the_order_of_paths(spans):
    rnd = random.Random(2)
    rows = [tool(id=f"n{i:03d}", parent=f"n{i - rnd.randrange(1, 3):03d}" if i > 1 else "", at=rnd.randrange(500)) for i in range(60)]
    df = spans(rows)
    by_path = [r["span_id"] for r in tree.with_paths(df).orderBy("path").collect()]
    assert _walk(df) == by_path
    assert len(by_path) == 60


def test_leaf_paths_are_whole_at_any_depth(spans):
    rows = [tool(id=f"n{i:02d}", parent=f"n{i - 1:02d}" if i else "") for i in range(15)]
    got = tree.leaf_paths(spans(rows)).collect()
    assert [r["path"] for r in got] == [[f"n{i:02d}" for i in range(15)]]


def test_agent_spans_in_tree_order_with_spans_off_the_tree_last(spans):
    mine = {"attrs": {"agent_id": "x_agent"}}
    rows = [tool(id="loop", parent="loop", at=0, **mine), tool(id="b", parent="a", at=3, **mine), tool(id="a", at=2, **mine)]
    got = agents.ownership(spans(rows), ordered=True).orderBy("preorder").collect()
    assert [r["span_id"] for r in got] == ["a", "b", "loop"]


def test_nested_tools_count_the_same_tokens_again(spans):
    rows = [
        tool("outer", id="o"), tool("inner", id="i", parent="o"),
        model(id="m", parent="i", attrs={"llm.usage.total_tokens": "10"}),
        model(id="n", parent="o", attrs={"llm.usage.total_tokens": "5"}),
        model(id="bad", parent="o", attrs={"llm.usage.total_tokens": "12.0"}),
        model(id="neg", parent="o", attrs={"llm.usage.total_tokens": "-1"}),
    ]
    got = {r["tool"]: r["tool_tokens"] for r in tree.tool_token_cost(spans(rows)).collect()}
    assert got == {"outer": 15, "inner": 10}


def test_repeated_span_ids_are_kept_once(spans):
    rows = [tool(id="x", at=2), tool(id="x", at=1), tool(id="y")]
    kept = tree.unique_spans(spans(rows)).collect()
    assert sorted(r["span_id"] for r in kept) == ["x", "y"]
    assert [r["timestamp"].second for r in kept if r["span_id"] == "x"] == [1]


def test_agent_spans_are_its_own_and_those_below(spans):
    rows = [
        agent("plan_agent", id="a"), tool(id="t", parent="a"),
        tool("other", id="u", parent="a", attrs={"agent_id": "lone_agent"}),
        tool(id="free"), agent("deep_agent", id="d", parent="t"), tool(id="dt", parent="d"),
    ]
    got = {(r["agent"], r["span_id"]) for r in agents.agent_spans(spans(rows)).collect()}
    assert got == {
        ("plan_agent", "a"), ("plan_agent", "t"), ("plan_agent", "u"), ("plan_agent", "d"), ("plan_agent", "dt"),
        ("lone_agent", "u"), ("deep_agent", "d"), ("deep_agent", "dt"),
    }


def _joins(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Join")


def test_sessions_of_few_spans_take_no_joins(spans):
    rows = [tool(id=f"n{i:03d}", session=f"s{i // 10}", parent=f"n{i - 1:03d}" if i % 10 else "") for i in range(60)]
    df = spans(rows)
    assert _joins(tree.labelled_tree(df)) == 0
    assert _joins(tree.execution_tree(df)) == 0
    assert _joins(agents.ownership(df, ordered=True)) == 0
    assert _joins(tree.tool_token_cost(df)) == 1


@pytest.mark.parametrize("limit", [None, "10"])
def test_types_below_a_type_need_no_second_look_at_the_spans(spans, spark, limit):
    """As lists and by joins; loops are left out, a lost span is a root."""
    rows = [agent("a_agent", id="n00"), *[tool(id=f"n{i:02d}", parent=f"n{i - 1:02d}") for i in range(1, 12)]]
    rows += [model(id="m", parent="n05"), model(id="lost", parent="gone"), tool(id="x", parent="y"), tool(id="y", parent="x")]
    if limit:
        spark.conf.set("spanloom.maxGroupRows", limit)
    try:
        out = tree.type_hierarchy(tree.labelled_tree(spans(rows)))
        got = sorted((r.entity_type, r.n_spans, r.contains) for r in out.collect())
    finally:
        spark.conf.unset("spanloom.maxGroupRows")
    assert got == [("agent", 1, "tool"), ("llm", 2, ""), ("tool", 11, "llm,tool")]
    # Counts and types below meet once.
    assert limit or _joins(out) == 1


def test_lists_and_joins_give_the_same_rows(spans, spark):
    """Forests with loops, missing parents, several traces and equal times, folded both ways."""
    rnd = random.Random(8)
    rows = [tool(id=None, parent="s3n1", session="s3", attrs={"agent_id": "x_agent"})]
    for s, n in enumerate([1, 9, 10, 11, 40]):
        for i in range(n):
            up = rnd.choice(["", None, "gone", *[f"s{s}n{rnd.randrange(max(1, i // 2 + rnd.randrange(2)))}" for _ in range(9)]])
            mine = {"attrs": {"agent_id": f"{rnd.choice('abc')}_agent"}} if rnd.random() < 0.5 else {}
            named = rnd.choice([tool, lambda **kw: agent("plan_agent", **kw)])
            rows.append(named(**mine, id=f"s{s}n{i}", session=f"s{s}", parent=up, trace=f"t{rnd.randrange(3)}", at=rnd.randrange(9)))
    df = spans(rows)
    found = {}
    for limit in (None, 10):
        if limit:
            spark.conf.set("spanloom.maxGroupRows", str(limit))
        try:
            label = tree.labelled_tree(df).select("session_id", "span_id", "root_id", "depth", "enter", "leave")
            order = agents.ownership(df, ordered=True).orderBy("session_id", "preorder", "agent").select("session_id", "span_id", "agent")
            found[limit] = [sorted(map(str, label.collect())), order.collect()]
        finally:
            spark.conf.unset("spanloom.maxGroupRows")
    assert found[None] == found[10]
    assert all(found[None])
