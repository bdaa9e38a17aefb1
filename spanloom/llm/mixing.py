"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source whose target is t times its words is taken floor(t) times for certain and
once more with probability t - floor(t). The cube method turns these probabilities into zeros and
ones while the totals it balances, words and documents of the source, stay what they were: with
two totals any three open units have a direction in which both stay fixed; the three are moved
along it, forwards or back at random with fair odds, until one is decided, and the next unit takes
its place. At most two units per chunk stay open. They are gathered, chunked again and moved on,
level by level, until each source has one chunk; its last two units, and LANDING more that did not
fly, are landed on the outcome nearest to their words.

Chunks hold about CHUNK_UNITS narrow rows (id, words, probability) by a hash of the id, so a hot
source is many tasks. Texts take no part.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import OrderedGroups, numbered
from spanloom.runtime import materialize

CHUNK_UNITS = 5_000
LANDING = 10
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
_NEAR = 1e-9


def text_words(text: Column) -> Column:
    """Number of runs without white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: one row (source, words) each. Adds target: the shares of `share` times all words
    that the sources get in proportion to their weights, which repeat over the sources in the
    order of their code points (null last); no target is above `most` times the source's words,
    and what is cut off goes to the others by weight."""
    ranked = numbered(sources, [F.col("source").isNull(), F.col("source")], "__n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "words", weight.alias("__weight")), "sources")
    goal = share * (ranked.agg(F.sum("words")).first()[0] or 0)
    limit, level = F.col("words") * most, 0.0
    while True:
        capped = F.col("__weight") * level >= limit
        full, open_ = ranked.agg(F.sum(F.when(capped, limit)), F.sum(F.when(~capped, F.col("__weight")))).first()
        if not open_:
            break
        higher = (goal - (full or 0.0)) / open_
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.select("source", "words", F.least(F.col("__weight") * level, limit).alias("target"))


def cube_flight(p: np.ndarray, totals: np.ndarray, draw: random.Random) -> np.ndarray:
    """Moves the probabilities until at most two are open; sums of p and of p * totals stay."""
    p = p.astype(float).copy()
    open_: list[int] = []
    for unit in range(len(p)):
        if _NEAR < p[unit] < 1 - _NEAR:
            open_.append(unit)
        while len(open_) == 3:
            i, j, k = open_
            a, b, c = totals[i], totals[j], totals[k]
            way = (b - c, c - a, a - b)  # orthogonal to (1, 1, 1) and (a, b, c)
            if way == (0, 0, 0):
                way = (1.0, -1.0, 0.0)
            ahead = back = float("inf")
            for u, d in zip(open_, way, strict=True):
                if d > 0:
                    ahead, back = min(ahead, (1 - p[u]) / d), min(back, p[u] / d)
                elif d < 0:
                    ahead, back = min(ahead, p[u] / -d), min(back, (1 - p[u]) / -d)
            step = ahead if draw.random() * (ahead + back) < back else -back
            for u, d in zip(open_, way, strict=True):
                p[u] += step * d
                if p[u] < _NEAR:
                    p[u] = 0.0
                elif p[u] > 1 - _NEAR:
                    p[u] = 1.0
            open_ = [u for u in open_ if 0.0 < p[u] < 1.0]
    p[p <= _NEAR] = 0.0
    p[p >= 1 - _NEAR] = 1.0
    return p


def land(p: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The outcome of the open units that is nearest in words, then in documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    if len(at):
        outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(outcomes @ totals[at] - (p[at] * totals[at]).sum())
        count = np.abs(outcomes.sum(axis=1) - p[at].sum())
        p[at] = outcomes[np.argmin(words + 0.01 * totals[at].mean() * count)]
    return p


def _flown(seed: int):
    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "size"], na_position="first", kind="stable").reset_index(drop=True)
        draw = random.Random(f"{seed}/{rows['chunk'].iloc[0]}/{len(rows)}/{rows['order'].iloc[0]}")
        totals = rows["total"].to_numpy().astype(float)
        p = rows["p"].to_numpy().astype(float)
        # A source that is down to one chunk is landed, whatever the others still have to fly.
        last = rows["chunks"].iloc[0] == 1
        flying = len(p) - LANDING if last else len(p)
        if flying > 0:
            p = np.concatenate([cube_flight(p[:flying], totals[:flying], draw), p[flying:]])
        rows["p"] = land(p, totals) if last else p
        return rows

    return chunk


def mix(
    units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, chunk_units: int = CHUNK_UNITS
) -> DataFrame:
    """units: doc_id, source, size (words). Rows that stand for rows of `units`: these, n_rows (how
    many), source_size, target (of the source), copies (how often each of them is taken).

    Repeated rows are taken in the same share as others: as many as are certain, and one that is
    drawn, so one (doc_id, source, size) may come in up to three rows. A source without words
    has target 0 and gives nothing; null ids and sources are values like others; an empty table
    gives an empty result. No copies exceed the next integer above target / source_size."""
    every = units.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size").agg(F.count(F.lit(1)).alias("n_rows"))
    every = materialize(every, "units")
    sources = every.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("words"), F.count(F.lit(1)).alias("__units"))
    sources = materialize(sources, "source-words")
    targets = source_targets(sources.select("source", "words"), weights, share, most)
    known = sources.select(F.col("source").alias("__source"), "__units").join(
        targets.select(F.col("source"), "words", "target"), F.col("__source").eqNullSafe(F.col("source"))
    )
    known = known.select("__source", "__units", F.col("words").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = every.join(known, F.col("source").eqNullSafe(F.col("__source")))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    # Of n equal rows at rate p, floor(n * p) are taken, one flies with what is left, the others stay.
    p, n = rate - F.floor(rate), F.col("n_rows")
    whole = F.floor(n * p + 1e-9).cast("long")
    part = lambda rows, chance: F.struct(rows.cast("long").alias("n_rows"), chance.cast("double").alias("p"))
    left = F.when(whole < n, F.greatest(n * p - whole, F.lit(0.0))).otherwise(0.0)
    flies = F.when(left > 1e-9, 1).otherwise(0)
    parts = F.when(n == 1, F.array(part(n, p))).otherwise(
        F.filter(F.array(part(whole, F.lit(1.0)), part(flies, left), part(n - whole - flies, F.lit(0.0))), lambda x: x["n_rows"] > 0)
    )
    start = start.withColumn("part", F.explode(parts)).select(
        "doc_id", "source", "size", "part.n_rows", "source_size", "target",
        F.floor(rate).cast("int").alias("sure"), "part.p",
        (F.col("size") * F.col("part.n_rows")).alias("total"), order.alias("order"),
        F.greatest(F.lit(1), F.ceil(F.col("__units") / chunk_units)).cast("long").alias("chunks"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.schema.fields) + ", chunk long"
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    decided: list[DataFrame] = []
    level = start
    for depth in range(64):
        level = level.withColumn("chunk", F.pmod(F.xxhash64(F.lit(depth), "doc_id", "size"), F.col("chunks")))
        last = level.agg(F.max("chunks")).first()[0] in (None, 1)
        flown = level.groupBy("source", "chunk").applyInPandas(_flown(seed * 64 + depth), schema)
        flown = materialize(flown.drop("chunk"), "flight")
        decided.append(flown.where(~is_open))
        if last:
            break
        # At most two units of each chunk are still open.
        level = flown.where(is_open).withColumn("chunks", F.greatest(F.lit(1), F.ceil(2 * F.col("chunks") / chunk_units)).cast("long"))
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    copies = (F.col("sure") + F.col("p").cast("int")).alias("copies")
    return out.select("doc_id", "source", "size", "n_rows", "source_size", "target", copies)


def take_mix(
    docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0
) -> DataFrame:
    """The rows of `docs` (doc_id, text, source, ...) that the mix takes, each as often as it
    takes it, columns unchanged."""
    keys = {"__id": F.col("doc_id").cast("long"), "__source": F.col(f"`{source}`").cast("string"), "__size": text_words(F.col(f"`{text}`").cast("string"))}
    rows = docs.select("*", *[v.alias(k) for k, v in keys.items()])
    taken = mix(rows.select(*[F.col(k).alias(n) for k, n in zip(keys, ("doc_id", "source", "size"), strict=True)]), weights, share, most, seed)
    # Rows that share a unit are told apart by their number; most units have one row and need none.
    taken = materialize(taken, "taken")
    unit = ["doc_id", "source", "size"]
    several = taken.groupBy(*unit).agg(F.sum("n_rows").alias("n")).where("n > 1")
    if not several.isEmpty():
        return _take_numbered(docs, rows, taken, list(keys))
    taken = taken.where(F.col("copies") > 0).select(*[F.col(n).alias(f"{k}_of") for k, n in zip(keys, ("doc_id", "source", "size"), strict=True)], "copies")
    held = rows.join(taken.hint("merge"), [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    return held.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _take_numbered(docs: DataFrame, rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the mix takes where some share their unit: those of a unit are numbered, and its
    parts take them in turn."""
    unit = ["doc_id", "source", "size"]
    split = OrderedGroups(taken, unit, ["copies"]).sums_before("__from", "n_rows")
    shared = split.groupBy(*unit).agg(F.sum("n_rows").alias("n")).where("n > 1").select(*[F.col(u).alias(f"__of_{u}") for u in unit])
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{u}")) for k, u in zip(keys, unit, strict=True)]
    apart = rows.join(shared, same("__of_"), "left_anti").withColumn("__number", F.lit(0).cast("long"))
    held = rows.join(shared, same("__of_"), "left_semi").withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    together = OrderedGroups(held, keys, ["__tie"]).positions("__number").drop("__tie")
    parts = split.where(F.col("copies") > 0).select(*[F.col(u).alias(f"__of_{u}") for u in unit], "copies", "__from", (F.col("__from") + F.col("n_rows")).alias("__to"))
    within = (F.col("__number") >= F.col("__from")) & (F.col("__number") < F.col("__to"))
    out = apart.unionByName(together).join(parts, [*same("__of_"), within])
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
