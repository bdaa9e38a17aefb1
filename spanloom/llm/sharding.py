"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in parts. How many rows each part sends to each shard is drawn in advance, so that the
row sums are the parts' sizes, the column sums the shards' sizes (at most one apart), and the
matrix has the distribution that a uniform permutation of all rows would give it. Each part is
permuted locally and cut by its row of the matrix; after the exchange each shard is permuted
again, in blocks whose sizes are counted first. All orders come from hashes of the row, so
reruns agree.

Parts and blocks number at most MAX_PARTS, so the matrix and the offsets are bounded.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import materialize

PART_ROWS = 50_000
MAX_PARTS = 10_000


def hypergeometric(draw: random.Random, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement, by inversion outwards from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    # Weights relative to the mode, until they no longer count.
    up, k, w = [], mode, 1.0
    while k < high and w > 1e-18:
        w *= (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))
        k += 1
        up.append(w)
    down, k, w = [], mode, 1.0
    while k > low and w > 1e-18:
        w *= k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
        k -= 1
        down.append(w)
    at = draw.random() * (1.0 + sum(up) + sum(down)) - 1.0
    if at < 0:
        return mode
    for step, w in enumerate(up, 1):
        at -= w
        if at < 0:
            return mode + step
    for step, w in enumerate(down, 1):
        at -= w
        if at < 0:
            return mode - step
    return mode


def communication_matrix(parts: list[int], shards: int, seed: int = 0) -> list[list[int]]:
    """For each part the number of its rows that go to each shard."""
    total = sum(parts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    draw = random.Random(seed)
    out = []
    for n in parts:
        row, rest, pool = [], n, sum(left)
        for s in range(shards):
            pool -= left[s]
            row.append(hypergeometric(draw, left[s], pool, rest))
            rest -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def _parts(rows: int, part_rows: int) -> int:
    return min(MAX_PARTS, max(1, -(-rows // part_rows)))


def shuffle_into_shards(
    docs: DataFrame, keys: list[Column], shards: int = 8, seed: int = 0, part_rows: int = PART_ROWS
) -> DataFrame:
    """All columns of `docs` and shard (from 0) and slot (place in the shard, gapless from 0).

    keys: columns whose hash orders the rows; rows that agree in all of them are interchangeable
    (repeated rows, null keys too). Shards hold equal numbers of rows, at most one apart; with
    fewer rows than shards the last shards are empty, as all are for an empty table. Columns of
    `docs` named shard or slot are replaced."""
    spark = docs.sparkSession
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    hashed = lambda n: F.xxhash64(F.lit(f"{seed}/{n}"), *keys)
    total = docs.count()
    count = _parts(total, part_rows)
    rows = docs.select(*carried, F.pmod(hashed("part"), F.lit(count)).cast("int").alias("__part"), hashed("first").alias("__first"), hashed("second").alias("__second"))

    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(count)], shards, seed)
    cuts = spark.createDataFrame(
        [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in enumerate(matrix)], "__of int, __cuts array<long>"
    )
    local = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__first", "__second")).cast("long"))
    sent = local.join(F.broadcast(cuts), local["__part"] == cuts["__of"])
    shard = F.size(F.filter("__cuts", lambda c: c < F.col("__rank"))).cast("int")
    blocks = _parts(-(-total // shards), part_rows)
    sent = sent.select(*carried, shard.alias("shard"), F.pmod("__second", F.lit(blocks)).cast("int").alias("__block"), "__first", "__second")
    sent = materialize(sent, "sent-to-shards")

    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    held = sent.groupBy("shard", "__block").count()
    offsets = held.select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    placed = sent.withColumn("__place", F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__second", "__first")))
    placed = placed.join(F.broadcast(offsets), ["shard", "__block"])
    return placed.select(*carried, "shard", (F.col("__offset") + F.col("__place") - 1).cast("long").alias("slot"))
