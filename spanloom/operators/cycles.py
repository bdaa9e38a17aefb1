"""Contiguous repeats in sequences too long for one task, by joins on (group, position).

For a start i the shortest repeat length k in [2^p, 2^(p+1)) is found from names of the
substrings of length 2^p: i + k must carry the same name, and the overlapping pair of names
that ends the two halves must agree as well. Where no shorter repeat exists, equal names
cannot lie closer than 2^(p-1), so the next three places of a name hold every candidate.
The greedy scan is then a chain of jumps, summed by doubling the jumps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import OrderedGroups
from spanloom.runtime import materialize


def _at(names: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    return names.select(*keys, F.col("pos").alias(place), F.col("name").alias(name))


def _shortest_repeats(sequence: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(group, pos, k): the shortest repeat length at each start that has one."""
    names = sequence
    open_starts = sequence.select(*keys, "pos")
    found = None
    width = 1
    while 4 * width <= longest:
        # Names of substrings of twice the width; starts too near the end drop out.
        right = names.select(*keys, (F.col("pos") - width).alias("pos"), F.col("name").alias("_r"))
        names = materialize(
            names.join(right, [*keys, "pos"]).select(
                *keys, "pos", F.md5(F.concat_ws("|", "name", "_r")).alias("name")
            ),
            "names",
        )
        width *= 2
        nexts = OrderedGroups(names, [*keys, "name"], ["pos"]).neighbours(following={"n1": "pos"})
        nexts = materialize(nexts.select(*keys, "pos", "n1").filter("n1 is not null"), "next-place")
        second = nexts.select(*keys, F.col("pos").alias("n1"), F.col("n1").alias("n2"))
        third = nexts.select(*keys, F.col("pos").alias("n2"), F.col("n1").alias("n3"))
        places = (
            open_starts.join(nexts, [*keys, "pos"])
            .join(second, [*keys, "n1"], "left")
            .join(third, [*keys, "n2"], "left")
        )
        tried = places.select(
            *keys, "pos", F.explode(F.array_compact(F.array("n1", "n2", "n3"))).alias("n")
        ).withColumn("k", F.col("n") - F.col("pos"))
        tried = tried.filter((F.col("k") >= width) & (F.col("k") < 2 * width))
        tried = tried.withColumn("_a", F.col("pos") + F.col("k") - width).withColumn(
            "_b", F.col("pos") + 2 * F.col("k") - width
        )
        ends = tried.join(_at(names, keys, "_a", "_na"), [*keys, "_a"]).join(
            _at(names, keys, "_b", "_nb"), [*keys, "_b"]
        )
        hits = ends.filter(F.col("_na") == F.col("_nb")).groupBy(*keys, "pos").agg(F.min("k").alias("k"))
        hits = materialize(hits, "repeats")
        found = hits if found is None else found.unionByName(hits)
        open_starts = materialize(open_starts.join(hits, [*keys, "pos"], "left_anti"), "open-starts")
    return found if found is not None else sequence.select(*keys, "pos", F.lit(0).alias("k")).limit(0)


def count_cycles_long(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cycles of each (large) group: the same count as the array scan gives."""
    placed = OrderedGroups(df, keys, order).positions("pos")
    sequence = materialize(
        placed.select(*keys, "pos", F.concat(F.lit("n"), F.coalesce("entity_name", F.lit("\0"))).alias("name")),
        "sequence",
    )
    sizes = sequence.groupBy(*keys).agg(F.count("*").alias("n_events"))
    longest = sizes.agg(F.max("n_events")).first()[0] or 0
    repeats = _shortest_repeats(sequence, keys, longest)
    hops = (
        sequence.select(*keys, "pos")
        .join(repeats, [*keys, "pos"], "left")
        .select(
            *keys,
            "pos",
            (F.col("pos") + F.coalesce("k", F.lit(1))).alias("to"),
            F.col("k").isNotNull().cast("bigint").alias("cycles"),
        )
    )
    hops = materialize(hops, "hops")
    reach = 1
    while reach < longest:
        # A hop that leaves the sequence finds no partner and stays as it is.
        far = hops.select(*keys, F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("cycles").alias("_c"))
        hops = materialize(
            hops.join(far, [*keys, "to"], "left").select(
                *keys,
                "pos",
                F.coalesce("_to", "to").alias("to"),
                (F.col("cycles") + F.coalesce("_c", F.lit(0))).alias("cycles"),
            ),
            "hops",
        )
        reach *= 2
    first = hops.filter(F.col("pos") == 0).select(*keys, "cycles")
    return sizes.join(first, keys).select(*keys, "n_events", "cycles")
