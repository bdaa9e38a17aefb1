import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import judge, results
from spanloom.plans import build, registry
from spanloom.sources import metric_store, traces
from spanloom.streaming import intake
from tests.conftest import agent, model, tool


def _session_results(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, v double")
    return results.result_rows(df, "Groundedness", "session", F.col("v"), app_name="app")


def test_labels_follow_score_and_threshold(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.8), ("b", 0.9, 0.8), ("c", 0.9, None)], "session_id string, v double, t double")
    meta = F.to_json(F.struct(F.col("t").alias("threshold")))
    ours = results.result_rows(rows, "Consistency", "session", F.col("v"))
    theirs = results.result_rows(rows, "BiasMetric", "session", F.col("v"), metadata=meta)
    got = {(r["metric_name"], r["session_id"]): r["label"] for r in results.with_labels(ours.unionByName(theirs)).collect()}
    assert got == {
        ("Consistency", "a"): "consistent", ("Consistency", "b"): "consistent", ("Consistency", "c"): "consistent",
        ("BiasMetric", "a"): "not_biased", ("BiasMetric", "b"): "biased", ("BiasMetric", "c"): None,
    }


@pytest.mark.parametrize(
    ("reply", "score", "reason"),
    [
        ('{"metric_score": 1, "score_reasoning": "good"}', 1.0, "good"),
        ('```json\n{"metric_score": 0, "score_reasoning": "bad"}\n```', 0.0, "bad"),
        ("{'metric_score': 1, 'score_reasoning': 'literal'}", 1.0, "literal"),
        ('{"out": {"metric_score": 1, "score_reasoning": "deep"}}', 1.0, "deep"),
        ("I would rather not say", None, None),
    ],
)
def test_judge_replies(spark, reply, score, reason):
    df = spark.createDataFrame([("r", 1, reply)], "request_id string, judge_no int, reply string")
    got = judge.parsed_replies(df).first()
    assert (got["metric_score"], got["score_reasoning"]) == (score, reason)


def test_consensus_takes_the_mean_and_fails_as_a_whole(spark):
    ok = '{"metric_score": %d, "score_reasoning": "%s"}'
    rows = [("x", 1, ok % (1, "first")), ("x", 2, ok % (0, "last")), ("y", 1, ok % (1, "fine")), ("y", 2, "??")]
    df = spark.createDataFrame(rows, "request_id string, judge_no int, reply string")
    got = {r["request_id"]: r for r in judge.consensus(judge.parsed_replies(df)).collect()}
    assert (got["x"]["score"], got["x"]["reasoning"], got["x"]["error"]) == (0.5, "last", None)
    assert got["y"]["score"] is None and got["y"]["error"]


def test_rows_with_gaps_are_not_stored(spark, tmp_path):
    rows = metric_store.storage_rows(_session_results(spark, [("a", 1.0), ("b", 0.0)]))
    rows = rows.withColumn("AppName", F.when(F.col("SessionId") == "a", "app").otherwise(""))
    accepted, rejected = metric_store.complete_rows(rows)
    assert (accepted.count(), rejected.first()["missing"]) == (1, ["AppName"])
    metric_store.append_metrics(rows, str(tmp_path / "store"))
    metric_store.append_metrics(rows, str(tmp_path / "store"))
    stored = metric_store.read_metrics(spark, str(tmp_path / "store")).collect()
    assert len({r["ID"] for r in stored}) == 2
    assert {r["SessionId"] for r in stored} == {"a"}
    assert json.loads(stored[0]["Metrics"])["value_num"] == 1.0


def test_stored_results_are_reused_and_missing_ones_computed(spark, spans):
    frames = build.Frames(spans([tool(session="old", status="Error"), tool(session="new", status="Error")]))
    stored = results.result_rows(
        spark.createDataFrame([("old", 7.0)], "session_id string, v double"), "ToolErrorRate", "session", F.col("v")
    )
    got = registry.run_metrics(frames, ["ToolErrorRate"], stored=stored).collect()
    assert {(r["session_id"], r["value_num"], r["from_cache"]) for r in got} == {("old", 7.0, True), ("new", 100.0, False)}


def test_all_native_metrics_run_at_every_level(spans):
    frames = build.Frames(
        spans([agent("x_agent", id="a"), tool(id="t", parent="a"), model([("user", "hi there")], [("assistant", "a good answer")], parent="a", id="m")])
    )
    got = registry.run_metrics(frames, levels=["session", "agent", "span", "population"])
    found = {(r["metric_name"], r["aggregation_level"]) for r in got.select("metric_name", "aggregation_level").collect()}
    levels = registry.native.by_level()
    assert found == {(m, level) for level, names in levels.items() for m in names}


def test_unknown_metric_is_an_error(spans):
    """One failed row for the name; the run goes on."""
    got = registry.run_metrics(build.Frames(spans([tool()])), ["NoSuchMetric"]).collect()
    assert [(r.metric_name, r.success, r.bucket) for r in got] == [("NoSuchMetric", False, "failed")]
    assert "NoSuchMetric" in got[0].error_message


def test_build_filters_one_session_and_rejects_nothing_found(raw_spans):
    raw = raw_spans([tool(session="app_one"), tool(session="app_two"), {"name": "GET /"}])
    assert build.build_sessions(raw, "two").spans.count() == 1
    with pytest.raises(ValueError, match="not found"):
        build.build_sessions(raw, "three")
    with pytest.raises(ValueError, match="dropped"):
        build.build_sessions(raw, steps=[lambda s: s.drop("entity_name")])


SPAN = {
    "Timestamp": "2024-05-01T10:00:00.123456789Z", "TraceId": "t", "SpanId": "a", "SpanName": "x.tool",
    "SpanAttributes": {"session.id": "svc_0b2ae1a8-0b1c-4a3e-9d41-2f6a5a3f7c11", "nested": {"k": 1}}, "Duration": 1000000, "StatusCode": "Ok",
}


@pytest.mark.parametrize(
    ("layout", "text", "n"),
    [
        ("any", json.dumps([SPAN, {**SPAN, "SpanId": "b"}], indent=1), 2),
        ("any", json.dumps(SPAN, indent=1), 1),
        ("any", "\n".join(json.dumps({**SPAN, "SpanId": i}) for i in "abc"), 3),
        ("lines", "\n".join(json.dumps({**SPAN, "SpanId": i}) for i in "abc"), 3),
    ],
)
def test_span_files(spark, tmp_path, layout, text, n):
    path = tmp_path / "spans.json"
    path.write_text(text)
    rows = traces.keyed_by_session(traces.file_spans(traces.read_trace_file(spark, str(path), layout))).collect()
    assert len(rows) == n
    first = rows[0]
    assert first["session_key"] == "0b2ae1a8-0b1c-4a3e-9d41-2f6a5a3f7c11"
    assert first["ts_raw"].endswith("123456789Z")
    assert (first["duration_raw_ms"], first["status_number"]) == (1.0, 0)
    assert json.loads(first["SpanAttributes"]["nested"]) == {"k": 1}


def test_rows_without_session_get_one_each(spark):
    rows = spark.createDataFrame([(0, "x"), (1, None), (2, ""), (3, "x")], "n int, session_id string")
    got = {r["n"]: r["population_session"] for r in traces.one_session_per_row(rows, ["n"]).collect()}
    assert got == {0: "x", 1: "file_session_1", 2: "file_session_2", 3: "x"}


def test_a_replayed_span_without_ids_is_kept_once(spark, raw_spans, tmp_path):
    table = str(tmp_path / "table")
    rows = raw_spans([tool(id="a"), tool(id="b"), tool(id="c")])
    rows = rows.withColumn("TraceId", F.when(F.col("SpanId") != "a", F.col("TraceId"))).withColumn("SpanId", F.when(F.col("SpanId") != "c", F.col("SpanId")))
    spark.createDataFrame([], intake.TRACE_TABLE_SCHEMA).write.partitionBy("day").parquet(table)
    for _ in range(3):
        intake.store_batch(rows, table)
    assert spark.read.schema(intake.TRACE_TABLE_SCHEMA).parquet(table).count() == 3


def test_intake_keeps_late_spans_and_drops_repeats(spark, raw_spans, tmp_path):
    landing, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    first = [tool(id="a", at=500_000), tool(id="b", at=500_001)]
    raw_spans(first).coalesce(1).write.parquet(landing)
    intake.start_intake(spark, landing, table, mark, once=True).awaitTermination()
    late = [tool(id="b", at=500_001), tool(id="late", at=0), tool(id="a", at=500_000)]
    raw_spans(late).coalesce(1).write.mode("append").parquet(landing)
    intake.start_intake(spark, landing, table, mark, once=True).awaitTermination()
    got = [r["SpanId"] for r in spark.read.schema(intake.TRACE_TABLE_SCHEMA).parquet(table).collect()]
    assert sorted(got) == ["a", "b", "late"]


def test_deduplicated_stream(spark, raw_spans, tmp_path):
    landing = str(tmp_path / "in")
    raw_spans([tool(id="a", at=1)]).write.parquet(landing)
    raw_spans([tool(id="a", at=1), tool(id="b", at=2)]).write.mode("append").parquet(landing)
    stream = intake.deduplicated(intake.landing_stream(spark, landing))
    q = stream.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["SpanId"] for r in spark.sql("select SpanId from dedup").collect()) == ["a", "b"]


def test_trace_table_layout_prunes_and_pushes_down(spark, raw_spans, tmp_path):
    from spanloom.operators import reads

    path = str(tmp_path / "traces")
    traces.write_trace_table(raw_spans([tool(id="a", session="x_1"), tool(id="b", session="y_2")]), path)
    assert traces.read_traces(spark, path).count() == 2
    table = spark.read.schema(intake.TRACE_TABLE_SCHEMA).parquet(path)
    found = reads.sessions_started(table, "2024-05-01T00:00:00Z", "2024-05-02T00:00:00Z").select("session_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SpanAttributes" not in plan
    assert "IsNotNull(session_attr)" in plan
    assert sorted(r[0] for r in found.collect()) == ["x_1", "y_2"]


def test_histogram_name_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [("response_latency", {"service.name": "a"}, 2.0, 1.0, 3.0), ("other", {}, 1.0, 1.0, 1.0)]
    spark.createDataFrame(rows, "MetricName string, ResourceAttributes map<string,string>, Sum double, Min double, Max double").write.parquet(path)
    points = traces.read_histogram(spark, path, "response_latency")
    assert points.count() == 1
    assert "EqualTo(MetricName,response_latency)" in points._jdf.queryExecution().executedPlan().toString()


def test_scope_is_checked(spark):
    rows = spark.createDataFrame([("a",)], "SessionId string")
    assert metric_store.with_scope(rows, "span").first()["Scope"] == "span"
    with pytest.raises(ValueError, match="scope"):
        metric_store.with_scope(rows, "agent")


def _agent_results(spark, rows):
    return spark.createDataFrame(rows, "session_id string, agent_id string, metric_name string, aggregation_level string, value_num double")


def test_agents_are_reused_only_where_all_of_a_session_are_stored(spark):
    wanted = spark.createDataFrame([("s1", "a", "M"), ("s1", "b", "M"), ("s2", "a", "M"), ("s3", "c", "M")], "session_id string, agent_id string, metric_name string")
    stored = _agent_results(spark, [("s1", "a", "M", "agent", 1.0), ("s2", "a", "M", "agent", 2.0), ("s2", "a", "M", "agent", 2.0), ("s2", "gone", "M", "agent", 3.0), ("s3", "c", "M", "session", 4.0)])
    todo, reuse = results.split_work(wanted, stored, agent_level=True)
    assert sorted((r.session_id, r.agent_id) for r in todo.collect()) == [("s1", "a"), ("s1", "b"), ("s3", "c")]
    assert [(r.session_id, r.agent_id, r.value_num, r.from_cache) for r in reuse.collect()] == [("s2", "a", 2.0, True)]


def test_a_run_skips_what_lacks_inputs_and_survives_failures(spans):
    from spanloom.plans.build import Frames
    from spanloom.plans.registry import Registry, run_metrics, skipped_metrics
    from tests.conftest import model

    frames = Frames(spans([tool(session="s1", id="x1"), model([("user", "hello there")], [("assistant", "hi")], session="s2", id="x2")]))
    own = Registry()

    @own.metric("Talk", "session", requires=("conversation_elements",))
    def talk(f):
        return results.result_rows(f.sessions.select("session_id"), "Talk", "session", F.lit(1.0))

    @own.metric("Broken", "session")
    def broken(f):
        return f.spans.select("no such column")

    got = {(r.metric_name, r.session_id): (r.value_num, r.bucket) for r in run_metrics(frames, ["Talk", "Broken", "Unknown"], registry=own).collect()}
    assert got == {("Talk", "s2"): (1.0, "session"), ("Broken", None): (-1.0, "failed"), ("Unknown", None): (-1.0, "failed")}
    assert [(r.metric_name, r.session_id, r.missing) for r in skipped_metrics(frames, ["Talk"], registry=own).collect()] == [("Talk", "s1", ["conversation_elements"])]


def test_search_survives_deep_texts_and_takes_plain_ones_without_python(spark):
    from spanloom.functions.values import find_key

    texts = ["[" * 200_000 + "]" * 200_000 + '"status"', '{"status": "ok"}', '{"a": {"status": 3}}', '{"status": null, "b": {"x": 1}}', '{"status": "a\\nb"}', '{"a": "status"}', None]
    deep = '{"a":' * 50_000 + '{"status": 1}' + "}" * 50_000
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, deep])], "i int, t string")
    got = [r.v for r in rows.select("i", find_key(F.col("t"), "status").alias("v")).orderBy("i").collect()]
    assert got == [None, '"ok"', "3", None, '"a\\nb"', None, None, None]


def test_span_metrics_are_matched_without_a_shuffle(spans):
    from spanloom.operators import cases

    df = spans([tool(), tool()])
    out = results.match_span_metrics(df, cases.catalog(df.sparkSession, "tool"))
    assert out.count() == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "entity_type" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_a_metric_that_fails_while_it_runs_leaves_the_others(spark, spans):
    from spanloom.plans.registry import Registry, run_metrics

    own = Registry()
    frames = build.Frames(spans([tool(), agent("a"), tool(session="s2")]))
    counted = lambda f: f.spans.groupBy("session_id").agg(F.count("*").alias("n"))

    @own.metric("Fine", "session")
    def fine(f):
        return results.result_rows(counted(f), "Fine", "session", F.col("n"))

    @own.metric("JvmFailure", "session")
    def in_the_jvm(f):
        bad = F.when(F.col("session_id") == "s2", F.raise_error(F.lit("no s2"))).otherwise(F.col("n"))
        return results.result_rows(counted(f), "JvmFailure", "session", bad.cast("double"))

    @own.metric("PythonFailure", "session")
    def in_python(f):
        def broken(batches):
            raise RuntimeError("broken worker")
            yield from batches

        rows = counted(f)
        return results.result_rows(rows.mapInArrow(broken, rows.schema), "PythonFailure", "session", F.col("n"))

    @own.metric("WrongShape", "session")
    def wrong_shape(f):
        return counted(f)

    for parallel in (1, 3):
        got = run_metrics(frames, ["Fine", "JvmFailure", "PythonFailure", "WrongShape"], registry=own, parallel=parallel).collect()
        assert {(r.metric_name, r.session_id, r.value_num) for r in got if r.success} == {("Fine", "s1", 2.0), ("Fine", "s2", 1.0)}
        failed = {r.metric_name: r for r in got if not r.success}
        assert set(failed) == {"JvmFailure", "PythonFailure", "WrongShape"} and len(got) == 5
        assert "no s2" in failed["JvmFailure"].error_message and "broken worker" in failed["PythonFailure"].error_message
        assert all(r.bucket == "failed" or r.bucket for r in failed.values())
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    lazy = run_metrics(frames, ["Fine", "WrongShape"], registry=own, isolated=False).collect()
    assert sorted((r.metric_name, r.success) for r in lazy) == [("Fine", True), ("Fine", True), ("WrongShape", False)]
