"""The pipeline, each stage against plain versions on what it was given."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        out.append((name, docs))
    return {name: (docs.columns, [(r.doc_id, r.text, r.source) for r in docs.collect()], docs) for name, docs in out}


def test_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name][0] == stages["documents"][0]
    assert stages[names[-1]][0] == [*stages["documents"][0], "shard", "slot"]


def test_quality_rules(stages):
    kept = {r[0] for r in stages["quality_rules"][1]}
    failed = {i for i, text, _ in stages["documents"][1] if brute.quality_counts(text)[5]}
    assert kept and not kept & failed


def test_near_dedup(stages):
    given = [(i, t) for i, t, _ in stages["quality_rules"][1]]
    want = {i for i, _, c in brute.similar_components(given, 5, 0.8) if i == c}
    assert {r[0] for r in stages["near_dedup"][1]} == want


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    given = [(i, t) for i, t, _ in stages["near_dedup"][1]]
    want = {r[0] for r in brute.contamination(given, items) if not r[5]}
    assert {r[0] for r in stages["decontamination"][1]} == want


def test_mixing(stages):
    sizes, taken = Counter(), Counter()
    for _, text, source in stages["decontamination"][1]:
        sizes[source] += len(brute.solid_words(text))
    for _, text, source in stages["mixing"][1]:
        taken[source] += len(brute.solid_words(text))
    for source, target in brute.water_fill(sizes).items():
        assert taken[source] == pytest.approx(target, rel=0.02)
    assert max(Counter(r[0] for r in stages["mixing"][1]).values()) <= 2


def test_sharding(stages):
    _, rows, docs = stages["sharding"]
    assert Counter(r[0] for r in rows) == Counter(r[0] for r in stages["mixing"][1])
    shards = Counter(r.shard for r in docs.select("shard").collect())
    assert len(shards) == corpus_pipeline.SHARDS and max(shards.values()) - min(shards.values()) <= 1
