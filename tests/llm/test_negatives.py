"""Hard negatives against a plain version, and the index against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import negatives

INF, NAN = float("inf"), float("nan")


def mined(vectors, is_anchor, most=(5, 5), low=80, high=100):
    """vectors: (vec_id, vector, label). Rows as the operator gives them."""
    rows = []
    for vec, v, label in vectors:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        if sum((256 * float(np.float32(c))) ** 2 for c in v) < 2**60:
            rows.append((vec, label, x))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for n, (vec, label, x) in enumerate(rows):
        if not is_anchor(vec):
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=False)), v, m, lab) for m, (v, lab, y) in enumerate(rows) if m != n]
        for s, p, _, _ in sorted((r for r in scored if r[3] == label), key=order)[: most[0]]:
            window = sorted((r for r in scored if r[3] != label and low * s <= 100 * r[0] <= high * s), key=order)[: most[1]]
            out += [(vec, p, k + 1, r[1], s, r[0]) for k, r in enumerate(window)]
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def drawn(n, dims, seed, labels=4):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        v = [draw.gauss(0.2 if d < 2 else 0, 1 / (1 + d)) for d in range(dims)]
        out.append((i, v, draw.choice([0] * 3 + list(range(labels)))))
    return out


TYPE = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("anchors", [8192, 3])
def test_mining(spark, anchors):
    vectors = drawn(400, 11, 1)
    for i in range(60):  # Ties and repeated rows.
        vectors.append((vectors[i][0] if i % 3 == 0 else 1000 + i, vectors[i][1], (vectors[i][2] + i % 2) % 4))
    vectors += [(2000, None, 1), (2010, [1.0] * 11, None), (2020, [0.5, None] * 5 + [1.0], 1), (2030, [NAN] * 11, 1), (2040, [INF] + [0.1] * 10, 2)]
    vectors += [(None, [0.6] * 11, 0), (None, [0.6] * 11, 1), (2050, [], 1), (2060, [0.7, 0.2], 1), (2070, [3e38] * 11, 1), (2080, [-0.4] * 11, 2), (2090, [0.0] * 11, 3)]
    vectors += [(2100, [2.0**20] * 11, 0), (2110, [2.0**20, *[-1.0] * 10], 1), (2120, [2.0**20] * 10 + [2.0**19], 0), (2130, [0.1] * 11, 77)]
    frame = spark.createDataFrame(vectors, TYPE).select("*", F.lit("x").alias("row"), F.lit(1).alias("score"), F.lit(2).alias("anchor")).repartition(5)
    found = negatives.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, anchors=anchors)
    assert got(found) == mined(vectors, lambda v: v is not None and v % 10 == 0)
    assert got(negatives.mine_hard_negatives(frame.where("false"), F.lit(True))) == []
    assert got(negatives.mine_hard_negatives(frame, F.lit(False))) == []


def test_other_numbers_and_windows(spark):
    vectors = drawn(150, 5, 2, labels=2)
    frame = spark.createDataFrame(vectors, TYPE).repartition(3)
    found = negatives.mine_hard_negatives(frame, F.col("vec_id") < 12, positives=2, negatives=9, low=30, high=95)
    assert got(found) == mined(vectors, lambda v: v < 12, (2, 9), 30, 95)


def test_one_vector_many_times(spark):
    """Equal rows of equal scores are told apart by their ids only."""
    vectors = [(i, [0.5, 0.25, -0.1], i % 2) for i in range(700)] + [(700, [0.1, 0.1, 0.1], 1)]
    frame = spark.createDataFrame(vectors, TYPE).repartition(6)
    found = negatives.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0)
    assert got(found) == mined(vectors, lambda v: v % 100 == 0)


@pytest.mark.parametrize("dims", [1, 8, 9, 64])
@pytest.mark.parametrize("share", [0.05, 0.3, 0.8])
def test_index_loses_no_pair(dims, share):
    draw = np.random.default_rng(dims)
    energy = 1 / np.sqrt(1 + np.arange(dims))
    anchors = np.floor(256 * draw.normal(0, energy, (40, dims))).astype(np.int64)
    rows = np.floor(256 * draw.normal(0, energy, (500, dims))).astype(np.int64)
    rows[:40] = anchors
    scores = anchors @ rows.T
    low = np.maximum(1, (share * np.sqrt((anchors**2).sum(axis=1)) * np.sqrt((rows**2).sum(axis=1)).max()).astype(np.int64))
    index = negatives._Index(rows)
    norms = negatives._suffix_norms(anchors)
    a, r = index.candidates(anchors / low[:, None], norms / low[:, None])
    found, due = set(zip(a.tolist(), r.tolist(), strict=True)), set(zip(*(x.tolist() for x in np.nonzero(scores >= low[:, None])), strict=True))
    assert due <= found
    if dims == 64 and share == 0.8:
        assert len(found) < 0.05 * scores.size
    assert (index.scores(anchors, norms[:, 0].max(), a, r) == scores[a, r]).all()
