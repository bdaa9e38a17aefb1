"""Objects of JSON files of every layout, cut into blocks at every place."""

from __future__ import annotations

import json
import random

import pytest

from spanloom.sources.json_pieces import json_objects
from spanloom.sources.traces import read_trace_file

ODD = ['}', '{', '[{"', '"', "\\", "\\\\", '\\"}', "},{", "]", "é漢🙂", "\n", "a: {b}", "", "﻿", "\\u007d"]


def value(draw, deep):
    kind = draw.randrange(7 if deep else 4)
    if kind < 2:
        return "".join(draw.choice(ODD) for _ in range(draw.randrange(6)))
    if kind == 2:
        return draw.choice([1.5, None, True, -3])
    if kind == 3:
        return draw.choice([{}, [], "plain"])
    if kind == 4:
        return [value(draw, deep - 1) for _ in range(draw.randrange(4))]
    return {"".join(draw.choice(ODD) for _ in range(2)) + str(i): value(draw, deep - 1) for i in range(draw.randrange(4))}


def objects(seed, n):
    draw = random.Random(seed)
    return [{"SpanId": str(i), "x": value(draw, 4)} for i in range(n)]


@pytest.fixture()
def tiny_blocks(spark, request):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, str(request.param))
    yield
    for k, v in kept.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(folder):
    files = {
        "array.json": (objects(1, 40), json.dumps),
        "pretty.json": (objects(2, 15), lambda o: json.dumps(o, indent=2, ensure_ascii=False)),
        "tight.json": (objects(3, 25), lambda o: json.dumps(o, separators=(",", ":"))),
        "lines.json": (objects(4, 30), lambda o: "\n".join(json.dumps(x) for x in o) + "\n"),
        "one.json": (objects(5, 1), lambda o: json.dumps(o[0], indent=1)),
        "marked.json": (objects(6, 3), lambda o: "﻿ \n" + json.dumps(o)),
        "mixed.json": (objects(7, 4), lambda o: json.dumps([1, *o[:2], None, "s", *o[2:], 2])),
        "none.json": ([], json.dumps),
        "empty.json": ([], lambda o: ""),
        "long.json": ([{"SpanId": "0", "x": "}{" * 700}, {"SpanId": "1", "x": "y" * 3000}, {"SpanId": "2", "x": 1}], json.dumps),
    }
    for name, (found, text) in files.items():
        (folder / name).write_text(text(found), encoding="utf-8")
    return {name: found for name, (found, _) in files.items() if found}


@pytest.mark.parametrize("tiny_blocks", [61, 400, 1 << 20], indirect=True)
def test_every_layout_and_cut(spark, tmp_path, tiny_blocks):
    want = written(tmp_path)
    got: dict[str, list] = {}
    for r in sorted(json_objects(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.place)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.json))
    assert got == want


@pytest.mark.parametrize("tiny_blocks", [2000], indirect=True)
def test_one_array_is_read_by_many_tasks(spark, tmp_path, tiny_blocks):
    spans = [{"SpanId": f"s{i}", "SpanName": "}" * (i % 5), "SpanAttributes": {"k": '{"a":[1,2]}'}} for i in range(800)]
    (tmp_path / "a.json").write_text(json.dumps(spans))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = read_trace_file(spark, str(tmp_path)).select("SpanId", "SpanName", "SpanAttributes").collect()
    assert sorted((r.SpanId, r.SpanName, r.SpanAttributes["k"]) for r in rows) == sorted((s["SpanId"], s["SpanName"], '{"a":[1,2]}') for s in spans)


def test_a_span_that_does_not_parse_is_a_row_of_nulls(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"SpanId": "a"}, {"SpanId": oops}, {"SpanId": "b"}]')
    assert sorted(str(r.SpanId) for r in read_trace_file(spark, str(tmp_path)).collect()) == ["None", "a", "b"]
    with pytest.raises(ValueError):
        read_trace_file(spark, str(tmp_path), "document")


def shuffled(plan):
    """Bytes that the shuffles of a plan that has run held."""
    if hasattr(plan, "getClass") and plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if plan.getClass().getSimpleName() == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("tiny_blocks", [100_000], indirect=True)
def test_only_what_crosses_blocks_is_shuffled(spark, tmp_path, tiny_blocks):
    spans = [{"SpanId": f"s{i}", "x": {"k": "}{" * 9 + str(i)}} for i in range(8000)]
    (tmp_path / "a.json").write_text(json.dumps(spans))
    found = json_objects(spark, str(tmp_path))
    rows = sorted(found.collect(), key=lambda r: r.place)
    assert [json.loads(r.json) for r in rows] == spans
    assert [r.place for r in rows] == list(range(8000))
    assert shuffled(found._jdf.queryExecution().executedPlan()) < (tmp_path / "a.json").stat().st_size / 20
