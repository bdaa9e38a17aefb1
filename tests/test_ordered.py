import random

from pyspark.sql import functions as F

from spanloom.operators.ordered import OrderedGroups, packed


def _frame(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((key, rnd.choice([None, rnd.randrange(20)]), f"id{i:05d}", rnd.choice("xyz")))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g string, t int, id string, v string")


def _expected(rows):
    groups = {}
    for g, t, i, v in rows:
        groups.setdefault(g, []).append(((t is None, t or 0), i, v))
    out = {}
    for members in groups.values():
        members.sort(key=lambda m: (m[0], m[1]))
        for n, (_, i, v) in enumerate(members):
            before = members[n - 1][2] if n else None
            after = members[n + 1][2] if n + 1 < len(members) else None
            out[i] = (n, before, after)
    return out


def _check(spark, limit):
    df = _frame(spark)
    want = _expected([tuple(r) for r in df.collect()])
    groups = OrderedGroups(df, ["g"], ["t", "id"], limit)
    near = {r["id"]: (r["p"], r["n"]) for r in groups.neighbours({"p": "v"}, {"n": "v"}).collect()}
    place = {r["id"]: r["position"] for r in groups.positions().collect()}
    assert near == {i: (b, a) for i, (_, b, a) in want.items()}
    assert place == {i: n for i, (n, _, _) in want.items()}
    return groups.split


def test_plain_windows(spark):
    assert _check(spark, 1000) is False


def test_hot_groups_are_split_and_exact(spark):
    assert _check(spark, 20) is True


def test_split_blocks_stay_small(spark):
    groups = OrderedGroups(_frame(spark, 2000), ["g"], ["t", "id"], 100)
    biggest = groups.large_groups().count(), groups.df.filter("_block >= 0").groupBy("g", "_block").count()
    assert biggest[0] > 1000
    assert biggest[1].agg(F.max("count")).first()[0] < 300


def test_packed_lists_are_bounded_and_whole(spark):
    df = _frame(spark)
    parts = packed(df, ["g"], ["t", "id"], F.col("id"), "ids", max_items=25).collect()
    assert max(len(p["ids"]) for p in parts) <= 25
    want = _expected([tuple(r) for r in df.collect()])
    for p in parts:
        for n, i in enumerate(p["ids"]):
            assert want[i][0] == p["part"] * 25 + n
    assert sum(len(p["ids"]) for p in parts) == 300


def test_packed_of_hot_groups(spark, small_groups):
    df = _frame(spark)
    hot = {(p["g"], p["part"]): p["ids"] for p in packed(df, ["g"], ["t", "id"], F.col("id"), "ids", 25).collect()}
    spark.conf.unset("spanloom.maxGroupRows")
    plain = {(p["g"], p["part"]): p["ids"] for p in packed(df, ["g"], ["t", "id"], F.col("id"), "ids", 25).collect()}
    assert hot == plain


def test_a_packed_group_is_one_row_at_any_size(spark):
    df = spark.range(25_000).select((F.col("id") % 2).alias("g"), (-F.col("id")).alias("t"), "id")
    got = {r["g"]: r for r in packed(df, ["g"], ["t"], F.col("id"), "ids").collect()}
    assert [r["part"] for r in got.values()] == [0, 0]
    assert got[1]["ids"] == list(range(24_999, 0, -2))


def test_lists_of_hot_groups_are_stitched_from_blocks(spark, small_groups):
    """A group with a third of all rows, one of null key, small ones; ties and missing order values."""
    rows = [("hot", i % 7 if i % 11 else None, f"x{i:03d}") for i in range(120)] + [(None, i, f"n{i:02d}") for i in range(15)]
    rows += [(f"g{i % 40}", i, f"y{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "g string, at int, id string").repartition(5)
    groups = OrderedGroups(df, ["g"], ["at", "id"])
    assert groups.df.filter("g = 'hot'").select("_block").distinct().count() > 5
    item = F.concat_ws("/", F.col("at").cast("string"), "id")
    got = {r.g: r["items"] for r in packed(df, ["g"], ["at", "id"], item).collect()}
    plain = {r.g: r["items"] for r in packed(df, ["g"], ["at", "id"], item, largest=1).collect()}
    assert got == plain and len(got["hot"]) == 120 and len(got) == 42
    assert got["hot"][-1].startswith("x")
