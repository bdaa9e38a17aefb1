"""Ranked lexical search against a plain version, and bounds that hold."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lexical
from tests.llm.brute import letter_words
from tests.llm.test_operators import CLASHES, passage, tricky_texts


def scores(docs, query):
    """[(score, row)] above 0 of one query over (id, text) rows."""
    held = [Counter(letter_words(t)) for _, t in docs]
    n_docs, n_words = sum(bool(h) for h in held), sum(h.total() for h in held)
    out = []
    for row, h in enumerate(held):
        total = 0
        for term in set(letter_words(query)):
            tf = h[term]
            if tf:
                df = sum(term in x for x in held)
                m = 100 - 90 + (90 * h.total() * n_docs) // n_words
                total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
        if total:
            out.append((total, row))
    return out


def ranking(docs, items, top=10):
    out = []
    for item, query in items:
        found = sorted(scores(docs, query), key=lambda s: (-s[0], docs[s[1]][0] is None, docs[s[1]][0] or 0))[:top]
        out += [(item, n + 1, docs[row][0], score) for n, (score, row) in enumerate(found)]
    return out


def got(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


ITEMS = [(1, passage(1, 60)), (2, "one"), (2, "one"), (3, None), (4, " .,"), (5, "É ñ ß é w1 W2"), (6, "nowhere"), (None, "w3 w4 w3"), (7, " ".join(f"w{i}" for i in range(400)))]


@pytest.mark.parametrize("block_chars", [1_000_000, 30])
def test_search(spark, monkeypatch, block_chars):
    monkeypatch.setattr(lexical, "CELLS", 64)
    texts = [*tricky_texts(), *((100 + i, passage(500 + i // 3, 40 + i % 3)) for i in range(60))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    extra = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in CLASHES.split(", "))]
    docs = docs.select("*", *extra).repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(lexical.search(docs, items, block_chars=block_chars)) == sorted(ranking(texts, ITEMS), key=str)
    assert got(lexical.search(docs, items.limit(0))) == []
    assert got(lexical.search(docs.where("false"), items)) == []
    assert got(lexical.search(docs.where("doc_id in (1, 2, 3)"), items)) == []


def test_many_equal_documents_and_a_stored_index(spark):
    """Ties beyond the first ten go by doc_id, however many share the score and the bound."""
    texts = [(i, "common words of a copy") for i in range(900, 0, -1)] + [(i, f"other text {i}") for i in range(1000, 1100)]
    items = [("a", "copy of words"), ("b", "text 1042")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    index = docs.sparkSession.createDataFrame(lexical.build_signatures(docs).collect(), lexical._INDEX)
    assert got(lexical.search(docs, spark.createDataFrame(items, "item_id string, text string"), index=index)) == sorted(ranking(texts, items), key=str)


@pytest.mark.parametrize("most_bits", [22, 8])
def test_bounds_are_never_below_scores(spark, monkeypatch, most_bits):
    """Also where signatures are far too narrow for their texts."""
    monkeypatch.setattr(lexical, "MOST_BITS", most_bits)
    draw = random.Random(4)
    texts = [(i, " ".join(f"t{int(draw.paretovariate(0.6))}" for _ in range(draw.randrange(1, 400)))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    items = [(0, "t1 t2 t3 t900"), (1, "t5"), (2, " ".join(f"t{i}" for i in range(60)))]
    asked = spark.createDataFrame([(q, t) for q, t in items], "query long, text string")
    queries = lexical._queries(asked.toArrow())
    counts = {r.place: r for r in lexical.term_statistics(docs, queries).collect()}
    queries.n, queries.words = counts[-1].docs, counts[-1].words
    weight = lambda p: math.floor(1000 * math.log((2 * queries.n + 2) / (2 * (counts[p].docs if p in counts else 0) + 1)))
    queries.weights = np.array([weight(p) for p in range(len(queries.terms))], np.int64)
    # The index is built in this process, so that the narrow signatures reach it.
    rows = docs.toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    captured = {}
    docs_like = type("D", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, scan, schema: captured.setdefault("scan", scan)})()
    lexical.build_signatures(docs_like)
    bounds = {}
    for block in captured["scan"](iter(rows)):
        row = block.to_pylist()[0]
        found = lexical._bounds(row, queries, {})
        for d, doc in enumerate(row["doc_ids"]):
            for q in range(len(queries.rows)):
                bounds[int(queries.rows[q]), doc] = int(found[q, d])
    tight = 0
    for query, text in items:
        for score, row in scores(texts, text):
            assert bounds[query, texts[row][0]] >= score
            tight += bounds[query, texts[row][0]] <= 1.4 * score
    if most_bits == 22:
        assert tight > 0.9 * sum(len(scores(texts, t)) for _, t in items)
