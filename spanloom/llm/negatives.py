"""Hard negatives by threshold joins over suffix-norm-pruned inverted indexes.

An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of
other labels whose score lies in a window below the positive's. Both are threshold joins: all
rows of a score of at least t, best first, a few for each window.

1. Vectors become integers; their dimensions are put in order of falling energy, so that what is left
   of a vector behind a dimension, its suffix, is short soon.
2. Anchors are a stated set of queries. They go over the rows in blocks of about ANCHORS, each sent to
   all tasks, divided by their thresholds, so that every score asked for is at least 1.
3. A task indexes its rows a block at a time: a strip of dimensions lists the rows that still need
   it. From where a row's suffix norm times the longest anchor suffix is below 1, its dimensions are
   omitted: what lies behind cannot make a match by itself. Strip by strip partial scores are summed up, and
   rows whose sums and remaining norms stay below 1 for all anchors leave.
4. Pairs whose partial score and omitted norms reach 1 are scored exactly, in integers.
5. A window that has found its number in a task raises its threshold there. A window that has not
   found its number in any is asked again with a lower threshold, until it is full or its bound is
   reached. So no pair is left out for a threshold that was chosen too high.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
ANCHORS = 8192
ROWS = 4096
STRIP = 8
# Cells of a (anchors, rows) matrix of partial scores.
CELLS = 1 << 20
# Thresholds asked one after the other: for positives in parts of the greatest score that norms allow,
# then any score; for negatives in parts of the window from its top, then all of it.
POSITIVE_STEPS = (0.4, 0.2)
NEGATIVE_STEPS = (0.25,)
_EXACT = float(1 << 52)
_LEAST = -(1 << 62)
# Vectors of a squared norm above have no 64-bit scores.
_MOST_SQUARE = float(1 << 60)


def prepared_vectors(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (row, vec_id, label, x, anchor) of the vectors that take part, written once: x are the
    integers floor(scale * component), filled up with zeros to the longest vector; row is a number of
    its own for every row."""
    x = F.col(f"`{vector}`")
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.transform(x, lambda v: v.cast("double") * scale).alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", real))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v) < _MOST_SQUARE)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v).cast("long")))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x")))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", filled.alias("x"), "anchor"), "vectors")


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.int64)


def _energies(rows: DataFrame) -> tuple[list[int], float]:
    """The dimensions in order of falling energy, and the longest vector's norm. Each task adds up
    its own sums, a row for each dimension and one for the norm."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, longest = None, 0.0
        for batch in batches:
            if batch.num_rows:
                squares = _vectors(batch.column("x"), batch.num_rows).astype(np.float64) ** 2
                total = squares.sum(axis=0) + (0 if total is None else total)
                longest = max(longest, float(squares.sum(axis=1).max()))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(longest, total))], names=["dim", "square"])

    sums = rows.select("x").mapInArrow(scan, "dim long, square double").groupBy("dim").agg(F.sum("square").alias("sum"), F.max("square").alias("most"))
    found = sums.collect()
    energy = sorted((r for r in found if r.dim >= 0), key=lambda r: (-r["sum"], r.dim))
    return [r.dim for r in energy], math.sqrt(max((r.most for r in found if r.dim < 0), default=0.0))


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """For each row the norms of what lies behind 0, STRIP, 2 * STRIP, ... dimensions."""
    squares = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], STRIP), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    out = np.zeros((len(x), squares.shape[1] + 1))
    out[:, :-1] = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(out)


class _Index:
    """A block of rows with its dimensions in order."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norms = _suffix_norms(x)
        self.floats = x.astype(np.float64)

    def candidates(self, anchors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the pairs whose score may be 1 or more. anchors are divided by their
        thresholds, norms are their suffix norms."""
        least = 1 - 1e-9 * (1 + norms[:, 0].max() * self.norms[:, 0].max())
        needs = self.norms * norms.max(axis=0) >= least
        depth = needs.sum(axis=1)
        rows = np.argsort(-depth, kind="stable")
        rows = rows[depth[rows] > 0]
        sums = np.zeros((len(anchors), len(rows)))
        for strip in range(needs.shape[1] - 1):
            listed = np.searchsorted(-depth[rows], -strip, "left")
            if not listed:
                break
            cut = slice(strip * STRIP, (strip + 1) * STRIP)
            sums[:, :listed] += anchors[:, cut] @ self.floats[rows[:listed], cut].T
            if strip & (strip + 1) == 0 and strip:
                behind = np.minimum(depth[rows], strip + 1)
                may = (sums + norms[:, behind] * self.norms[rows, behind] >= least).any(axis=0)
                if may.mean() < 0.75:
                    rows, sums = rows[may], sums[:, may]
        # A row of depth d has its strips before d in the sum; the rest is bounded by its norms.
        behind = np.minimum(depth[rows], needs.shape[1] - 1)
        a, r = np.nonzero(sums + norms[:, behind] * self.norms[rows, behind] >= least)
        return a, rows[r]

    def scores(self, anchors: np.ndarray, longest: float, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Exact scores of pairs."""
        if longest * self.norms[:, 0].max(initial=0) < _EXACT and 16 * len(a) > len(anchors) * len(self.x):
            return np.rint(anchors.astype(np.float64) @ self.floats.T).astype(np.int64)[a, r]
        out = np.empty(len(a), np.int64)
        for lo in range(0, len(a), 1 << 15):
            some = slice(lo, lo + (1 << 15))
            out[some] = np.einsum("ij,ij->i", anchors[a[some]], self.x[r[some]])
        return out


@dataclass
class _Asked:
    """Windows of one block of anchors, sorted by anchor: `most` rows each of a score from low to
    high, of the anchor's label or of others."""

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    anchor: np.ndarray
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    most: int


_FOUND = "anchor int, slot int, score long, vec_id long, row long"


def _best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each window; ids has a column for missing ones."""
    order = np.lexsort((row, ids[:, 1], ids[:, 0], -score, window))
    w = window[order]
    start = np.ones(len(w), bool)
    start[1:] = w[1:] != w[:-1]
    at = np.arange(len(w))
    rank = at - np.maximum.accumulate(np.where(start, at, 0))
    return order[rank < most]


def _joined(rows: DataFrame, asked: _Asked, order: list[int]) -> DataFrame:
    """The first rows of every window that each task finds among its own."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def chunks(low: np.ndarray, rows: int):
        """Anchors that may still match, those of positive thresholds apart from the others."""
        size = max(1, CELLS // max(rows, 1))
        for some in (np.flatnonzero(low > 0), np.flatnonzero(low <= 0)):
            for lo in range(0, len(some), size):
                yield some[lo : lo + size]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        anchors, low = q.x, q.low.copy()
        norms, first = _suffix_norms(anchors), np.searchsorted(q.anchor, np.arange(len(anchors) + 1))
        windows = np.diff(first)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)]
        used = np.flatnonzero(windows)
        least = np.full(len(anchors), _LEAST)

        def joined(new):
            return [np.concatenate([n[i] for n in new]) for i in range(4)]

        def merged(new):
            both = joined([held, *new])
            keep = _best(*both, q.most)
            for i, b in enumerate(both):
                held[i] = b[keep]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(low)) == q.most)
            last = np.searchsorted(held[0], full, "right") - 1
            low[full] = np.maximum(low[full], held[1][last])

        def block(batch):
            x = _vectors(batch.column("x"), batch.num_rows)[:, order]
            label, row = batch.column("label").to_numpy(), batch.column("row").to_numpy()
            ids = np.column_stack([batch.column("vec_id").is_null().to_numpy(zero_copy_only=False), batch.column("vec_id").fill_null(0).to_numpy()]).astype(np.int64)
            least[used] = np.minimum.reduceat(low, first[used])
            new = []
            groups = [(np.flatnonzero(label == n), used[q.label[used] == n]) for n in np.unique(label)] if q.same else [(np.arange(len(row)), used)]
            for mine, theirs in groups:
                if not len(mine) or not len(theirs):
                    continue
                index = _Index(x[mine])
                for part in chunks(least[theirs], len(mine)):
                    a = theirs[part]
                    if least[a[0]] > 0:
                        i, j = index.candidates(anchors[a] / least[a, None], norms[a] / least[a, None])
                    else:
                        i, j = (g.ravel() for g in np.indices((len(a), len(mine))))
                    keep = (row[mine][j] != q.row[a][i]) if q.same else (label[mine][j] != q.label[a][i])
                    i, j = i[keep], j[keep]
                    score = index.scores(anchors[a], norms[a, 0].max(), i, j)
                    reach = score >= least[a][i]
                    i, j, score = a[i[reach]], mine[j[reach]], score[reach]
                    own = []
                    for n in range(int(windows[a].max(initial=0))):
                        has = np.flatnonzero(windows[i] > n)
                        window = first[i[has]] + n
                        fits = (score[has] >= low[window]) & (score[has] <= q.high[window])
                        has, window = has[fits], window[fits]
                        own.append((window, score[has], ids[j[has]], row[j[has]]))
                    if own:
                        own = joined(own)
                        best = _best(*own, q.most)
                        new.append([o[best] for o in own])
            if new:
                merged(new)

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                block(batch.slice(lo, ROWS))
        window, score, ids, row = held
        columns = [pa.array(q.anchor[window], pa.int32()), pa.array(q.slot[window], pa.int32()), pa.array(score), pa.array(ids[:, 1], mask=ids[:, 0] > 0), pa.array(row)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "vec_id", "row"])

    return rows.select("row", "vec_id", "label", "x").mapInArrow(scan, _FOUND)


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each window over all tasks, with their rank and number."""
    keys = ["anchor", "slot"]
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return ranked.withColumn("n", F.max("rank").over(Window.partitionBy(*keys)))


def _filled(rows: DataFrame, asked: _Asked, order: list[int], lows: list[np.ndarray], label: str) -> list[DataFrame]:
    """Asks all windows with each of the thresholds `lows` in turn; those that are full are done."""
    left, out = np.arange(len(asked.anchor)), []
    for n, low in enumerate(lows):
        last = n == len(lows) - 1
        part = _Asked(asked.row, asked.label, asked.x, asked.anchor[left], asked.slot[left], low[left], asked.high[left], asked.same, asked.most)
        found = materialize(_first(_joined(rows, part, order), asked.most), label)
        # The last threshold is the lowest that counts: what is not full then has no more.
        settled = found if last else found.where(F.col("n") == asked.most)
        out.append(settled)
        if not last:
            done = settled.where(F.col("rank") == 1).select("anchor", "slot").toArrow()
            full = done.column("anchor").to_numpy().astype(np.int64) << 32 | done.column("slot").to_numpy()
            left = left[~np.isin(asked.anchor[left] << 32 | asked.slot[left], full)]
        if not len(left):
            break
    return out


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    anchors: int = ANCHORS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score with an anchor is the inner product of their integers floor(scale * component);
    higher scores come first, ties by the smaller vec_id, a null one last. An anchor's positives are
    its first `positives` other rows of the same label; for each of them come the first
    `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null label or vector, or a component that is null or not finite, take no part, nor do
    vectors too long for 64-bit scores (squared norm 2 ** 60). A shorter vector counts as filled up
    with zeros. Repeated rows are rows of their own; null ids are no anchors unless `is_anchor` says
    so; other columns are not read; an empty table has no rows."""
    rows = prepared_vectors(vectors, is_anchor, vec_id, vector, label, scale)
    asking = materialize(rows.where("anchor").select("row", "vec_id", "label", "x"), "anchors")
    blocks = max(1, -(-asking.count() // anchors))
    order, longest = _energies(rows)
    out = None
    for block in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        for found in _mined(rows, part, order, longest, positives, negatives, low, high):
            out = found if out is None else out.unionByName(found)
    if out is None:
        names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return rows.where("false").select(*[F.lit(0).cast("int" if n == "rank" else "long").alias(n) for n in names])
    return out


def _mined(rows, part: pa.Table, order, longest: float, positives: int, negatives: int, low: int, high: int) -> list[DataFrame]:
    n = part.num_rows
    x = _vectors(part.column("x"), n)[:, order]
    row, label, ids = part.column("row").to_numpy(), part.column("label").to_numpy(), part.column("vec_id").to_pylist()
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    lows = [(norms * longest * step).astype(np.int64) for step in POSITIVE_STEPS] + [np.full(n, _LEAST)]
    asked = _Asked(row, label, x, np.arange(n), np.zeros(n, np.int64), lows[-1], np.full(n, -_LEAST), True, positives)
    best = _filled(rows, asked, order, lows, "positives")
    table = [t for t in (b.select("anchor", "rank", "score", "vec_id").toArrow() for b in best) if t.num_rows]
    if not table:
        return []
    found = pa.concat_tables(table).combine_chunks().sort_by([("anchor", "ascending"), ("rank", "ascending")])
    anchor, slot = found.column("anchor").to_numpy().astype(np.int64), found.column("rank").to_numpy().astype(np.int64)
    score = [int(s) for s in found.column("score").to_pylist()]
    # Integer bounds of the window, exact at any size; an empty one asks for nothing.
    bottom, top = [-(-low * s // 100) for s in score], [high * s // 100 for s in score]
    some = np.array([k for k in range(len(score)) if bottom[k] <= top[k]], np.int64)
    if not len(some):
        return []
    bottoms, tops = np.array(bottom, np.int64), np.array(top, np.int64)
    asked = _Asked(row, label, x, anchor[some], slot[some], bottoms[some], tops[some], False, negatives)
    lows = [np.array([top[k] - math.floor((top[k] - bottom[k]) * step) for k in some], np.int64) for step in NEGATIVE_STEPS] + [bottoms[some]]
    out = _filled(rows, asked, order, lows, "negatives")
    spark = rows.sparkSession
    names = pa.table({"anchor": pa.array(anchor, pa.int32()), "slot": pa.array(slot, pa.int32()), "anchor_id": pa.array([ids[a] for a in anchor], pa.int64()), "positive_id": found.column("vec_id"), "positive_score": pa.array(score, pa.int64())})
    # One row for each window of a block of anchors.
    names = F.broadcast(spark.createDataFrame(names))
    columns = ["anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    return [o.join(names, ["anchor", "slot"]).select(*columns) for o in out]
