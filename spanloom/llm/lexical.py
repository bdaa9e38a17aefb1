"""Ranked lexical search over bit-sliced Bloom signatures, rescored exactly.

1. Every text becomes a Bloom signature of its terms: a term and, where it comes at least 2, 4, 8, ...
   times, the term at that level, each set HASHES bits. Texts of like size share a width; up to
   BLOCK_DOCS of them form a block, stored as bit slices: a row of the block is one signature bit of
   all its documents. The index knows no queries and is written once.
2. For the terms of the queries one scan counts the documents that hold each, the documents and
   the words; these give the weights.
3. A query term's slices are ANDed: a bitmap that overestimates who holds it at that level, hence
   how often. The weighted sum of the bitmaps, each level with the most that such a frequency can
   add to a document of that length, is an upper bound of the document's score.
4. The documents with the highest bounds of each query are scored exactly; the k-th of these scores is
   one that the k best reach. Every document whose bound is not below it is then scored exactly.

Queries are a stated set; they go over the index in blocks of about BLOCK_CHARS characters, each
sent to all tasks. Terms are told apart by 64-bit hashes; hashes of query terms are distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.words import LETTERS, LOWER, Members, Words, mix, salts, scanned
from spanloom.runtime import materialize

TOP = 10
HASHES = 4
BITS_A_KEY = 10
LEAST_BITS, MOST_BITS = 8, 22
BLOCK_DOCS = 512
BLOCK_BITS = 1 << 24
BLOCK_CHARS = 1_000_000
# Sums of one block of the index are worked out for about so many (query term, document) pairs at once.
CELLS = 1 << 22

_FACTORS = salts(HASHES, 21) | np.uint64(1)
_LEVELS = salts(64, 22)

_INDEX = "bits int, doc_ids array<long>, n array<int>, most array<int>, slices binary"


def _level(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes if level == 0 else mix(hashes ^ _LEVELS[level])


def _bit(keys: np.ndarray, which: int, bits: int) -> np.ndarray:
    return (mix(keys * _FACTORS[which]) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, how often), sorted by text."""
    row, value = w.text, w.hashes()
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(at, append=len(row))


def _block(bits: int, docs: list[tuple]) -> pa.RecordBatch:
    rows = np.zeros((1 << bits, -(-len(docs) // 8) * 8), bool)
    for column, (_, _, _, keys) in enumerate(docs):
        for which in range(HASHES):
            rows[_bit(keys, which, bits), column] = True
    ids, n, most = ([d[i] for d in docs] for i in range(3))
    columns = [pa.array([bits], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())), pa.array([most], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([np.packbits(rows, axis=1).tobytes()], pa.binary())], names=["bits", "doc_ids", "n", "most", "slices"])


def build_signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The bit-sliced index of a table: a row for each block of documents, with their ids, numbers
    of terms, greatest frequencies, and the slices one after the other.

    Documents without terms are in no block. A text of so many distinct terms that MOST_BITS is too
    narrow gets a fuller signature, whose bounds are looser and still bounds."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple]] = {}
        for batch in batches:
            for lo, _, w in scanned(batch.column("text"), LOWER, LETTERS):
                if not len(w):
                    continue
                row, value, often = _counted(w)
                keys, owner = [value], [row]
                for level in range(1, int(often.max()).bit_length()):
                    at = np.flatnonzero(often >= 1 << level)
                    keys.append(_level(value[at], level))
                    owner.append(row[at])
                key, owner = np.concatenate(keys), np.concatenate(owner)
                key = key[np.argsort(owner, kind="stable")]
                ends = np.cumsum(np.bincount(owner, minlength=len(w.counts)))
                here = np.flatnonzero(w.counts)
                most = np.maximum.reduceat(often, np.searchsorted(row, here))
                for at, top in zip(here.tolist(), most.tolist(), strict=True):
                    own = key[(ends[at - 1] if at else 0) : ends[at]].copy()
                    bits = min(MOST_BITS, max(LEAST_BITS, (len(own) * BITS_A_KEY - 1).bit_length()))
                    held = open_.setdefault(bits, [])
                    held.append((batch.column("doc_id")[lo + at].as_py(), int(w.counts[at]), top, own))
                    if len(held) >= min(BLOCK_DOCS, max(8, BLOCK_BITS >> bits)):
                        yield _block(bits, open_.pop(bits))
        for bits in sorted(open_):
            yield _block(bits, open_[bits])

    return rows.mapInArrow(scan, _INDEX)


@dataclass
class _Queries:
    """A block of queries: the hashes of their distinct terms, sorted; for each query its row number
    and the places of its terms, one after the other; weights of the terms once they are known."""

    terms: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray | None = None
    n: int = 0
    words: int = 0

    def members(self) -> Members:
        return Members(self.terms)

    def of(self, query: int) -> np.ndarray:
        end = self.starts[query + 1] if query + 1 < len(self.starts) else len(self.places)
        return self.places[self.starts[query] : end]


def _queries(rows: pa.Table) -> _Queries | None:
    """None where no query of the block has a term."""
    found, at = [], rows.column("query").to_numpy()
    for lo, _, w in scanned(rows.column("text"), LOWER, LETTERS):
        if len(w):
            row, value, _ = _counted(w)
            found.append((row + lo, value))
    if not found:
        return None
    row, value = (np.concatenate([f[i] for f in found]) for i in range(2))
    terms, places = np.unique(value, return_inverse=True)
    own, starts = np.unique(row, return_index=True)
    return _Queries(terms, at[own], starts, places)


def _frequencies(w: Words, members: Members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place among the terms, how often) of the query terms in some texts."""
    hashes = w.hashes()
    at = members.among(hashes)
    term = np.searchsorted(members.values, hashes[at])
    code, often = np.unique(w.text[at] * np.int64(len(members.values)) + term, return_counts=True)
    return code // len(members.values), code % len(members.values), often


def term_statistics(docs: DataFrame, queries: _Queries) -> DataFrame:
    """(place, docs, words): of each query term the documents that hold it; at place -1 all
    documents with a term, and all words."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = shared.value.members()
        held, docs, words = np.zeros(len(members.values), np.int64), 0, 0
        for batch in batches:
            for _, _, w in scanned(batch.column("text"), LOWER, LETTERS):
                docs += int((w.counts > 0).sum())
                words += len(w)
                if len(w):
                    held += np.bincount(_frequencies(w, members)[1], minlength=len(held))
        some = np.flatnonzero(held)
        columns = [np.append(some, -1), np.append(held[some], docs), np.append(np.zeros(len(some), np.int64), words)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "docs", "words"])

    counted = docs.select("text").mapInArrow(scan, "place long, docs long, words long")
    return counted.groupBy("place").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


def _part(often: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    return (1_000_000_000 * often) // (1000 * often + 8 * length)


def _length(n: np.ndarray, queries: _Queries) -> np.ndarray:
    return 10 + (90 * n.astype(np.int64) * queries.n) // queries.words


def _bounds(row: dict, queries: _Queries, slots: dict) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, (query, document)."""
    bits, n, most = row["bits"], np.array(row["n"], np.int64), np.array(row["most"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint8).reshape(1 << bits, -1)
    length, out, before = _length(n, queries), np.zeros((len(queries.rows), len(n)), np.int64), np.zeros(len(n), np.int64)
    may = None
    for level in range(int(most.max()).bit_length()):
        if (bits, level) not in slots:
            keys = _level(queries.terms, level)
            slots[bits, level] = [_bit(keys, which, bits) for which in range(HASHES)]
        new = slices[slots[bits, level][0]]
        for slot in slots[bits, level][1:]:
            new &= slices[slot]
        may = new if may is None else may & new
        held = np.flatnonzero(may.any(axis=1))
        if not len(held):
            break
        # A term that passes this level and no further comes at most so often.
        part = _part(np.minimum((2 << level) - 1, most), length)
        gain, before = part - before, part
        use = np.zeros(len(queries.terms), bool)
        use[held] = True
        at = np.flatnonzero(use[queries.places])
        owner = np.searchsorted(queries.starts, at, "right") - 1
        own, starts = np.unique(owner, return_index=True)
        step = max(1, CELLS // len(n))
        sums = np.zeros((len(own), len(n)), np.int64)
        # Cut between queries where possible, and within one that is larger than a step.
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            first = np.searchsorted(starts, lo, "right") - 1
            last = np.searchsorted(starts, lo + len(some), "left")
            edges = np.maximum(starts[first:last] - lo, 0)
            here = np.unpackbits(may[queries.places[some]], axis=1, count=len(n)) * queries.weights[queries.places[some], None]
            sums[first:last] += np.add.reduceat(here, edges, axis=0)
        out[own] += sums * gain
    return out


def _above(index: DataFrame, queries: _Queries, least: np.ndarray | None, top: int) -> DataFrame:
    """(query, doc_id, bound): with `least` all documents whose bound reaches it; without, of each
    task those `top` with the highest bounds."""
    shared = index.sparkSession.sparkContext.broadcast((queries, least))

    def batch_of(query, ids, bound):
        columns = [pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(bound, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "bound"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value
        slots: dict = {}
        best = np.zeros((len(queries.rows), top), np.int64)
        best_ids = np.full((len(queries.rows), top), None, object)
        for batch in batches:
            for row in (r for n in range(batch.num_rows) for r in batch.slice(n, 1).to_pylist()):
                bound, ids = _bounds(row, queries, slots), np.array(row["doc_ids"], object)
                if least is not None:
                    q, d = np.nonzero(bound >= least[:, None])
                    if len(q):
                        yield batch_of(queries.rows[q], ids[d], bound[q, d])
                    continue
                both = np.hstack([best, bound])
                at = np.argsort(-both, axis=1, kind="stable")[:, :top]
                best = np.take_along_axis(both, at, axis=1)
                best_ids = np.where(at < top, np.take_along_axis(best_ids, np.minimum(at, top - 1), axis=1), ids[np.maximum(at - top, 0)])
        if least is None:
            q, k = np.nonzero(best)
            yield batch_of(queries.rows[q], best_ids[q, k], best[q, k])

    return index.mapInArrow(scan, "query long, doc_id long, bound long")


def exact_scores(docs: DataFrame, asked: DataFrame, queries: _Queries) -> DataFrame:
    """(query, doc_id, score) of the distinct (query, doc_id) in `asked`, for each row of `docs` with
    that id, where the score is above 0."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    of = asked.groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("query").alias("queries"))
    joined = docs.join(of, F.col("doc_id").eqNullSafe(F.col("__of"))).select("doc_id", "text", "queries")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        members, number = queries.members(), {int(r): n for n, r in enumerate(queries.rows)}
        for batch in batches:
            asked, found = batch.column("queries"), []
            for lo, _, w in scanned(batch.column("text"), LOWER, LETTERS):
                if not len(w):
                    continue
                row, term, often = _frequencies(w, members)
                parts = _part(often, _length(w.counts[row], queries)) * queries.weights[term]
                for at in np.flatnonzero(w.counts):
                    a, b = np.searchsorted(row, at), np.searchsorted(row, at, "right")
                    full = np.zeros(len(queries.terms), np.int64)
                    full[term[a:b]] = parts[a:b]
                    for query in asked[lo + at].as_py():
                        found.append((query, lo + at, int(full[queries.of(number[query])].sum())))
            found = [f for f in found if f[2] > 0]
            query, at, score = zip(*found, strict=True) if found else ((), (), ())
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), ids, pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return joined.mapInArrow(scan, "query long, doc_id long, score long")


def _ranked(rows: DataFrame, by: str, top: int, name: str = "rank") -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col(by).desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): of each item the `top` documents with the highest scores
    above 0, all if fewer; equal scores by ascending doc_id, a null id last.

    docs: any columns; items: item_id (any type), text. `index` is the stored result of
    `build_signatures` over the same documents; without one it is built here. Each row of either table
    counts by itself, so that repeated documents share scores and repeated items come twice. Null,
    empty and termless texts score nothing and ask for nothing; empty tables give no rows."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asking = items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("query"))
    asking = materialize(asking, "items")
    blocks = max(1, -(-(asking.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    if index is None:
        index = materialize(build_signatures(rows), "signatures")
    found = None
    for block in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text")
        queries = _queries(part.toArrow())
        ranked = _search_block(rows, index, queries, top) if queries is not None else None
        if ranked is not None:
            found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = asking.where("false").select("query", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return asking.select("item_id", "query").join(found, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(rows: DataFrame, index: DataFrame, queries: _Queries, top: int) -> DataFrame | None:
    counts = {r.place: r for r in term_statistics(rows, queries).collect()}
    if not counts or not counts[-1].docs:
        return None
    queries.n, queries.words = counts[-1].docs, counts[-1].words
    weight = lambda held: math.floor(1000 * math.log((2 * queries.n + 2) / (2 * held + 1)))
    queries.weights = np.array([weight(counts[p].docs if p in counts else 0) for p in range(len(queries.terms))], np.int64)
    first = _ranked(_above(index, queries, None, 2 * top), "bound", 2 * top)
    scored = _ranked(exact_scores(rows, materialize(first, "first"), queries), "score", top)
    kth = {r["query"]: r.score for r in scored.where(F.col("rank") == top).select("query", "score").collect()}
    least = np.array([kth.get(int(q), 1) for q in queries.rows], np.int64)
    left = materialize(_above(index, queries, least, top).select("query", "doc_id"), "not-excluded")
    return materialize(_ranked(exact_scores(rows, left, queries), "score", top), "ranked")
