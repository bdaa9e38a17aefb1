"""The stored trace table: what reads push to the scan, intake by day, order over files."""

import datetime as dt

from pyspark.sql import functions as F

from spanloom.operators import ordered, reads
from spanloom.sources import traces
from spanloom.streaming import intake
from tests.conftest import model, tool

DAY = 86_400


def _table(raw_spans, tmp_path, rows):
    path = str(tmp_path / "traces")
    traces.write_trace_table(raw_spans(rows), path)
    return path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listings_prune_days_and_push_filters(spark, raw_spans, tmp_path):
    rows = [tool(id=f"x{d}", session=f"s{d}", at=d * DAY) for d in range(5)]
    raw = traces.read_traces(spark, _table(raw_spans, tmp_path, rows))
    assert {"session_attr", "day"} <= set(raw.columns)
    listed = reads.span_listing(raw, "2024-05-02T00:00:00Z", "2024-05-03T12:00:00Z")
    assert [r.session_id for r in listed.collect()] == ["s2", "s1"]
    plan = _plan(listed)
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "Not(EqualTo(session_attr,))" in plan and "GreaterThanOrEqual(T" in plan
    assert "SpanAttributes" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_tables_without_stored_columns_read_alike(spark, raw_spans, tmp_path):
    rows = [tool(id="x1", session="s1"), model([("user", "hi")], [], session="s2", id="x2")]
    path = str(tmp_path / "plain")
    raw_spans(rows).write.parquet(path)
    plain = traces.read_traces(spark, path)
    stored = traces.read_traces(spark, _table(raw_spans, tmp_path, rows))
    assert "day" not in plain.columns
    both = [sorted(r.session_id for r in reads.span_listing(t, "2024-04-01T00:00:00Z", "2024-06-01T00:00:00Z").collect()) for t in (plain, stored)]
    assert both == [["s1", "s2"], ["s1", "s2"]]


def test_a_late_span_reads_its_own_day_only(spark, raw_spans, tmp_path):
    path = _table(raw_spans, tmp_path, [tool(id=f"x{d}", at=d * DAY) for d in range(4)])
    batch = raw_spans([tool(id="x0", at=0), tool(id="late", at=0), tool(id="new", at=3 * DAY)])
    intake.store_batch(batch, path)
    intake.store_batch(batch, path)
    got = traces.read_traces(spark, path)
    assert sorted(r.SpanId for r in got.select("SpanId").collect()) == ["late", "new", "x0", "x1", "x2", "x3"]
    assert got.filter(F.col("day") == dt.date(2024, 5, 1)).count() == 2


def test_rows_are_numbered_over_many_ranges(spark):
    df = spark.range(0, 5000, numPartitions=7).select((4999 - F.col("id")).alias("id"))
    got = ordered.numbered(df, [F.col("id")], "n")
    assert got.filter("n <> id").isEmpty() and got.count() == 5000
    assert ordered.numbered(df.limit(0), [F.col("id")], "n").count() == 0


def test_requested_ids_of_any_length(spark):
    """Suffixes of all lengths at once, ids within ids, the first of several, none at all."""
    import random

    from spanloom.operators import reads

    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("ab") for _ in range(n))
    sessions = sorted({text(draw.randrange(1, 330)) for _ in range(60)} | {"", "b", "ab" * 160})
    asked = [draw.choice(sessions)[-draw.randrange(1, 330) :] for _ in range(280)] + ["zz", " ", "b ", *[text(n) for n in range(1, 12)]]
    ids = spark.createDataFrame(list(enumerate(asked)), "request_no int, session_id string").repartition(3)
    got = {r.session_id: r.matched_id for r in reads.match_requested(spark.createDataFrame([(s,) for s in sessions], "session_id string"), ids).collect()}
    want = {s: next((a.strip() for a in asked if a.strip() and s.endswith(a.strip())), s) for s in sessions}
    assert got == want


def test_spans_are_made_once_when_stored(spark, raw_spans, tmp_path):
    """No sample is taken of what is written, which would make every span a second time."""
    made = spark.sparkContext.accumulator(0)
    rows = raw_spans([tool(id=f"n{i}", at=i * 3600) for i in range(60)])

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    traces.write_trace_table(rows.mapInArrow(counted, rows.schema), str(tmp_path / "table"))
    stored = traces.read_traces(spark, str(tmp_path / "table"))
    assert stored.count() == made.value == 60
    assert stored.select("day").distinct().count() == 3
