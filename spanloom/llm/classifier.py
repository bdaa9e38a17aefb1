"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; the score is the sum of one table entry per feature and one per
chosen pair of features. The tables are grown by cyclic boosting: round after round, each feature
in turn gets a tree of few leaves over its bins, fitted to the present error and added with a
small rate; then the pairs that explain most of what is left get trees over their grid. Scoring
is one table look-up and addition per feature, for a whole batch at once.

The model is fitted on at most `most_rows` labelled rows, chosen by a hash of the id; all texts
are scored. Features are ratios and counts of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.rows import ROW, packed, schema_with, unpacked
from spanloom.llm.words import NOT_SPACE, SAME, Words, texts, windows

MOST_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1

FEATURES = (
    "log_words",
    "mean_word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "mark_share",
    "stop_share",
    "sentence_share",
    "line_words",
    "distinct_words",
    "repeated_trigrams",
    "beyond_ascii",
    "long_words",
)

_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_SYMBOL = np.isin(_CODE, np.frombuffer(b"#*$%&|<>{}[]\\^~=+@_", np.uint8))
_MARK = np.isin(_CODE, np.frombuffer(b"!?", np.uint8))
_STOP = np.isin(_CODE, np.frombuffer(b".:;!?", np.uint8))


def text_features(w: Words, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; all zero without words."""
    n = len(w.counts)
    out = np.zeros((n, len(FEATURES)))
    if not len(w):
        return out
    here = w.counts > 0
    count = np.maximum(w.counts, 1)
    size = np.maximum(np.diff(offsets), 1)
    length = w.ends - w.starts
    total = lambda values: np.add.reduceat(values, np.minimum(w.first[:-1], len(w) - 1)) * here

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[w.data])])
        return np.diff(sums[offsets])

    hashes, room = w.hashes(), w.room()
    row = w.text

    def distinct(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, rows))
        new = np.ones(len(order), bool)
        new[1:] = (rows[order][1:] != rows[order][:-1]) | (values[order][1:] != values[order][:-1])
        return np.bincount(rows[order][new], minlength=n)

    grams = windows(hashes, 3)
    at = np.flatnonzero(room[: len(grams)] >= 3)
    n_grams = np.bincount(row[at], minlength=n)
    out[:, 0] = np.log1p(w.counts)
    out[:, 1] = total(length) / count
    out[:, 2] = bytes_of(_UPPER) / size
    out[:, 3] = bytes_of(_DIGIT) / size
    out[:, 4] = bytes_of(_SYMBOL) / count
    out[:, 5] = bytes_of(_MARK) / count
    out[:, 6] = total((length <= 3).astype(np.int64)) / count
    out[:, 7] = total(_STOP[w.data[w.ends - 1]].astype(np.int64)) / count
    out[:, 8] = np.log1p(count / (1 + bytes_of(_CODE == 10)))
    out[:, 9] = distinct(hashes, row) / count
    out[:, 10] = 1 - distinct(grams[at], row[at]) / np.maximum(n_grams, 1)
    out[n_grams == 0, 10] = 0
    out[:, 11] = bytes_of(_CODE >= 128) / size
    out[:, 12] = total((length > 12).astype(np.int64)) / count
    out[~here] = 0
    return out


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (f, g), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="nearest"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Steps of a small tree over ordered bins, from sums of gradients and curvatures."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for part in parts:
            a, b = part
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                continue
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], part, a + at + 1)
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Quadrants of a grid: the best cut of each axis given the other's; their gain."""
    best, out = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = []
            for c in (cg, ch):
                a, top, left, every = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
                quads.append((a, top - a, left - a, every - top - left + a))
            gain = sum(x * x / (y + 1.0) for x, y in zip(*quads, strict=True))
            if gain > best:
                best = gain
                v = [x / (y + 1.0) for x, y in zip(*quads, strict=True)]
                out = np.zeros_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(best)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of the log-odds; without rows, or with one label only, a constant."""
    if len(y) == 0:
        x = np.zeros((1, len(FEATURES)))
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))), [_edges(x[:, f], bins) for f in range(x.shape[1])], [], [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            r, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(b, r, size), np.bincount(b, h, size))
            model.tables[f] += step
            total += step[b]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[f]) + 1, len(model.pair_edges[g]) + 1)
        return np.bincount(coarse[f] * shape[1] + coarse[g], values, shape[0] * shape[1]).reshape(shape)

    r, h = slopes()
    ranked = sorted(((_pair_tree(grid(f, g, r), grid(f, g, h))[1], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    model.pairs = [(f, g) for gain, f, g in ranked[:pairs] if gain > 0]
    model.grids = [np.zeros((len(model.pair_edges[f]) + 1, len(model.pair_edges[g]) + 1)) for f, g in model.pairs]
    for _ in range(rounds // 5):
        for n, (f, g) in enumerate(model.pairs):
            r, h = slopes()
            step = rate * _pair_tree(grid(f, g, r), grid(f, g, h))[0]
            model.grids[n] += step
            total += step[coarse[f], coarse[g]]
    return model


def _features(docs: DataFrame, carried: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_features(batch)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], lists], names=[*carried, "features"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema.fields]
    return docs.mapInArrow(run, ", ".join([*kinds, "features array<double>"]))


def _batch_features(batch: pa.RecordBatch) -> np.ndarray:
    found = [np.zeros((0, len(FEATURES)))]
    for _, _, data, offsets in texts(batch.column("__text")):
        found.append(text_features(Words(data, offsets, SAME, NOT_SPACE), offsets))
    return np.concatenate(found)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **settings) -> AdditiveModel:
    """docs: doc_id, text. labels: doc_id, label (0 or 1; others and null are no labels).

    The labelled ids are thinned to about `most_rows` by their hash; a document with several
    labels counts with the mean, one half being 1. Texts are read, features worked out in tasks,
    and at most `most_rows` rows of features come to the driver."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    step = max(1, -(-10 * known.count() // (9 * most_rows)))  # a tenth below the bound, for the hash is not even
    known = F.broadcast(known.where(F.pmod(F.xxhash64("__id"), F.lit(step)) == 0).limit(most_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text")).join(known, F.col("doc_id") == F.col("__id"))
    found = _features(rows.select("doc_id", "label", "__text"), ["doc_id", "label"]).limit(most_rows).toArrow()
    ids, y = found.column("doc_id").to_numpy(), found.column("label").to_numpy().astype(float)
    x = np.array(found.column("features").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, ids))  # the order in which rows arrive must not matter
    return fit(x[order], y[order], **settings)


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", returned: list[str] | None = None) -> DataFrame:
    """The columns `returned` (default: all) of each row of `docs`, and score (0 to 1).

    Null, empty and wordless texts have all features 0 and are scored like others; repeated rows
    come out alike; an empty table gives an empty result; a column named score is replaced."""
    carried = [c for c in returned or docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_batch_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(score)], names=[ROW, "score"])

    rows = docs.select(packed(carried), F.col(f"`{text}`").cast("string").alias("__text"))
    return unpacked(rows.mapInArrow(run, schema_with(rows, "score double")), carried, ["score"])
