"""Packing: exact round trips, limits and padding, against the tokenizer used plainly."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from spanloom.llm import packing
from tests.llm.test_operators import CLASHES, FOLDER, tricky_texts

FILE = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(FILE)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def sequences(pieces):
    """Checks that offsets are gapless; {sequence: pieces in order}."""
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for parts in by.values():
        parts.sort(key=lambda p: p.offset)
        place = 0
        for p in parts:
            assert p.offset == place and p.length == len(p.ids) // 4 > 0
            place += p.length
    return by


def rebuilt(pieces):
    """{doc_id: ids}, where ids are unique; starts must be gapless."""
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    out = {}
    for doc, parts in by.items():
        parts.sort(key=lambda p: p.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:n]) for n in range(len(parts))]
        out[doc] = b"".join(p.ids for p in parts)
        assert {p.doc_tokens for p in parts} == {len(out[doc]) // 4}
    return out


def test_ids_of_tricky_texts(spark):
    texts = [*tricky_texts(), (20, "́a ́b\n̸ =\n̸ İSTANBUL ΟΔΟΣ ς"), (21, "a b c\x85d\x0be\x0cf\r\ng"), (22, "it's we'll I'd"), (23, "漢字" * 300)]
    rows = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(3)
    extra = rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in CLASHES.split(", ")) if c != "doc_id"])
    got = {r.doc_id: bytes(r.ids) for r in packing.token_ids(extra, FILE).collect()}
    assert got == {n: as_bytes(plain_ids(t)) for n, (_, t) in enumerate(texts)}
    pieces = packing.pack_sequences(packing.token_ids(rows, FILE)).collect()
    assert rebuilt(pieces) == got
    sequences(pieces)


def test_ids_beyond_the_cache(spark, monkeypatch):
    encoder = packing._Encoder(FILE)
    assert encoder.by_word
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    for text in ("alpha beta gamma delta", "epsilon zeta eta theta alpha", "alpha beta iota " + "k" * 100, "alpha"):
        assert encoder.encode(text) == as_bytes(plain_ids(text)[:-1])


def test_words_of_every_character_and_length():
    """Whatever two characters stand side by side, cached or not."""
    encoder, draw = packing._Encoder(FILE), random.Random(8)
    odd = [chr(c) for c in range(0x250) if c not in (0xD800,)] + list("ΣσςİıŉſßẞﬁǅЖ漢字ガ가각\u0301\u0338\u00a0\u2003\u2028\u3000٣²½🙂\U0001f1e9\ufeff\u200d")
    for n in range(4000):
        text = "".join(draw.choice(odd if draw.random() < 0.4 else "abcdeésñ'-<|>. tlrvm0") for _ in range(draw.randrange(1, 12)))
        assert encoder.encode(text) == as_bytes(plain_ids(text)[:-1]), ascii(text)
    for text in ("<|endoftext|>", "a<|startoftext|>b x", "<|ENDOFTEXT|>", "O'REILLY's we'LL" * 40):
        assert encoder.encode(text) == as_bytes(plain_ids(text)[:-1])


def test_a_tokenizer_with_blanks_in_its_tokens(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    text = " two  blanks\nand a line  "
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bytes(packing.token_ids(rows, other, end=7).first().ids) == as_bytes([*Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids, 7])


def examples(spark, n, seed, longest):
    draw, out = random.Random(seed), []
    for i in range(n):
        size = draw.choice([1, 2, draw.randrange(1, 40), draw.randrange(1, longest)])
        ids = [draw.randrange(49_000) for _ in range(size)]
        loss = None if i % 5 == 0 else bytes(int(draw.random() < (i % 4) / 3) for _ in range(size))
        out.append((i, as_bytes(ids), loss))
    return out, spark.createDataFrame(out, "doc_id long, ids binary, loss binary").repartition(3)


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [packing.Limits(64, 5, 40), packing.Limits(64, 64, 64), packing.Limits(64, 1, 3), packing.Limits(1, 1, 1)])
def test_limits_and_round_trip(spark, cut, limits):
    plain, frame = examples(spark, 300, 7, 200)
    pieces = packing.pack_sequences(frame, limits, cut, pool=20).collect()
    assert rebuilt(pieces) == {d: i for d, i, _ in plain}
    masks = {d: m for d, _, m in plain}
    bears = lambda p: p.length if masks[p.doc_id] is None else sum(masks[p.doc_id][p.start : p.start + p.length])
    for parts in sequences(pieces).values():
        total = sum(p.length for p in parts)
        assert total <= limits.tokens and len(parts) <= limits.segments and sum(map(bears, parts)) <= limits.loss
        if cut:
            assert total == limits.tokens or total & (total - 1) == 0
    if not cut:
        fits = {d for d, i, m in plain if len(i) // 4 <= limits.tokens and (len(i) // 4 if m is None else sum(m)) <= limits.loss}
        assert all(p.length == p.doc_tokens for p in pieces if p.doc_id in fits)


def test_whole_examples_leave_little_padding(spark):
    draw = random.Random(3)
    rows = [(i, as_bytes([5] * draw.randrange(5, 900))) for i in range(3000)]
    pieces = packing.pack_sequences(spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1), cut=False).collect()
    by = sequences(pieces)
    assert sum(len(i) // 4 for _, i in rows) > 0.98 * 2048 * (len(by) - 1)


def test_scarce_dimension_is_packed_first():
    """Heavy and light in loss-bearing tokens pair up, so that both limits are used."""
    packer = packing._Packer(packing.Limits(100, 50, 50), False)
    for n in range(20):
        heavy = n % 2 == 0
        packer.add(packing._Example(n, bytes(4 * 50), bytes([1] * 45 + [0] * 5 if heavy else [0] * 45 + [1] * 5)), 0, 50)
    bins = []
    while len(packer):
        bins.append([p[0].doc_id % 2 for p in packer.sequence()])
    assert len(bins) == 10 and all(sorted(b) == [0, 1] for b in bins)


def test_many_empty_repeated_and_missing_examples(spark):
    rows = [(None, b"")] * 3 + [(1, None)] + [(None, as_bytes([1]))] * 700 + [(2, as_bytes([9] * 5000))]
    frame = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(2)
    pieces = packing.pack_sequences(frame).collect()
    assert sum(p.length for p in pieces) == 5700 and sum(p.doc_id is None for p in pieces) == 700
    assert all(len(parts) <= packing.Limits().segments for parts in sequences(pieces).values())
    assert packing.pack_sequences(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)


def test_registered_query(spark):
    got = entry.queries()["op11_packing"](spark, FOLDER)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r.doc_id: plain_ids(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    totals, covered = defaultdict(int), defaultdict(int)
    for r in got.collect():
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(as_bytes(ids[r.start : r.start + r.length]))
        totals[r.sequence_id] += r.length
        covered[r.doc_id] += r.length
    assert covered == {d: len(i) for d, i in docs.items()}
    assert all(t == 2048 or t & (t - 1) == 0 for t in totals.values())
