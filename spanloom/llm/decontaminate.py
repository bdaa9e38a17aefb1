"""Benchmark decontamination by winnowing.

Every window of `span` item words keeps its least `gram`-word hash as its fingerprint. A text
that holds the window has the same least hash at the same place, so a scan that keeps the
least hash of each text window and looks it up among the item fingerprints misses no shared
span of `span` words or more. Fingerprint hits are then extended: the windows around a hit
are compared as a whole, and the words of equal ones are marked.

Items are a stated set of queries. They are held as (window, fingerprint, item) rows, cut into
blocks of at most about BLOCK_ROWS distinct rows, and each block goes over all texts. The
texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.rows import ROW, packed, unpacked
from spanloom.llm.words import LETTERS, LOWER, Members, scanned, windows
from spanloom.runtime import materialize

SPAN = 10
GRAM = 5
BLOCK_ROWS = 2_000_000

_OWN = ("__n_words", "__hits", "__items")


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` consecutive hashes from each place on."""
    n = len(grams) - width + 1
    out = grams[:n].copy()
    for i in range(1, width):
        np.minimum(out, grams[i : i + n], out=out)
    return out


def item_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Distinct (length, window, fingerprint, item) rows of a benchmark table.

    An item of fewer than `span` words is one window of its own length, which is its own
    fingerprint. Null and wordless items have no windows. A null item_id stays null: its
    windows mark words, but there is no id to report."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in scanned(batch.column("text"), LOWER, LETTERS):
                if not len(w):
                    continue
                hashes, room, text = w.hashes(), w.room(), w.text
                length, window, print_, owner = [], [], [], []
                whole = windows(hashes, span)
                if len(whole):
                    at = np.flatnonzero(room[: len(whole)] >= span)
                    least = _least(windows(hashes, gram), span - gram + 1)
                    length.append(np.full(len(at), span))
                    window.append(whole[at])
                    print_.append(least[at])
                    owner.append(text[at])
                for short in range(1, span):
                    rows = np.flatnonzero(w.counts == short)
                    if len(rows):
                        own = windows(hashes, short)[w.first[rows]]
                        length.append(np.full(len(rows), short))
                        window.append(own)
                        print_.append(own)
                        owner.append(rows)
                ids = batch.column("item_id").slice(lo, hi - lo).take(pa.array(np.concatenate(owner)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(length).astype(np.int32)),
                        pa.array(np.concatenate(window).view(np.int64)),
                        pa.array(np.concatenate(print_).view(np.int64)),
                        ids,
                    ],
                    names=["length", "window", "fingerprint", "item_id"],
                )

    narrow = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scan, "length int, window long, fingerprint long, item_id string").distinct()


class _Block:
    """One block of item windows, as the tasks use it."""

    def __init__(self, rows: pa.Table, span: int, gram: int):
        length = rows.column("length").to_numpy()
        window = rows.column("window").to_numpy().view(np.uint64)
        prints = rows.column("fingerprint").to_numpy().view(np.uint64)
        order = np.argsort(window, kind="stable")
        self.window = window[order]
        self.items = rows.column("item_id").take(pa.array(order)).to_pylist()
        self.span, self.gram = span, gram
        self.prints = Members(prints[length == span])
        self.whole = Members(window[length == span])
        self.short = [(int(k), Members(window[length == k])) for k in np.unique(length) if k < span]

    def hits(self, hashes: np.ndarray, room: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(places, length, hashes) of the windows that occur."""
        found = []
        width = self.span - self.gram + 1
        grams = windows(hashes, self.gram)
        if len(grams) >= width and len(self.prints.values):
            least = _least(grams, width)
            least_here = room[: len(least)] >= self.span
            kept = np.zeros(len(grams), bool)
            for i in range(width):
                kept[i : i + len(least)] |= least_here & (grams[i : i + len(least)] == least)
            at = np.flatnonzero(kept)
            at = at[self.prints.among(grams[at])]
            if len(at):
                near = np.unique(at[:, None] - np.arange(width))
                near = near[(near >= 0) & (near < len(least))]
                near = near[least_here[near]]
                whole = windows(hashes, self.span)[near]
                same = self.whole.among(whole)
                found.append((near[same], self.span, whole[same]))
        for k, members in self.short:
            whole = windows(hashes, k)
            at = np.flatnonzero(room[: len(whole)] >= k)
            same = members.among(whole[at])
            found.append((at[same], k, whole[at][same]))
        return [f for f in found if len(f[0])]

    def items_of(self, found: np.ndarray) -> set[str]:
        lo, hi = np.searchsorted(self.window, found), np.searchsorted(self.window, found, "right")
        return {self.items[i] for a, b in zip(lo, hi, strict=True) for i in range(a, b)} - {None}


def _merged(places: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def _scan(docs: DataFrame, block: _Block, returned: list[str]) -> DataFrame:
    """One block over all texts: adds to n_words, hits and items of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            counts, spans, items = [], batch.column("__hits").to_pylist(), batch.column("__items").to_pylist()
            for lo, _, w in scanned(batch.column("__text"), LOWER, LETTERS):
                counts.append(w.counts)
                found = block.hits(w.hashes(), w.room()) if len(w) else []
                if not found:
                    continue
                at = np.concatenate([f[0] for f in found])
                end = np.concatenate([f[0] + f[1] for f in found])
                hashes = np.concatenate([f[2] for f in found])
                row = np.searchsorted(w.first, at, "right") - 1
                order = np.argsort(row, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
                    r = int(row[part[0]])
                    base = int(w.first[r])
                    old = [(s["start"], s["end"]) for s in spans[lo + r]]
                    new = zip((at[part] - base).tolist(), (end[part] - base).tolist(), strict=True)
                    spans[lo + r] = _merged([*old, *new])
                    items[lo + r] = sorted({*items[lo + r], *block.items_of(np.unique(hashes[part]))})
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in returned],
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                    pa.array(spans, hit_type),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*returned, *_OWN],
            )

    return docs.mapInArrow(scan, docs.select(*[f"`{c}`" for c in returned], *_OWN).schema)


def find_benchmark_words(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    returned: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The columns `returned` (default: all) of each row of `docs`, and n_words, hits (word
    ranges that lie in occurrences of item windows, merged, end exclusive) and items (sorted
    ids of the items with occurring windows).

    docs: any columns; items: item_id, text. One row comes out for each row that goes in.
    Null, empty and wordless texts have no words and no hits; an empty benchmark marks nothing;
    repeated rows are judged alike; repeated items count once; ids and other columns may be
    null. Columns of `docs` named n_words, hits or items are replaced."""
    rows = materialize(item_windows(items, span, gram), "item-windows")
    blocks = max(1, -(-rows.count() // block_rows))
    which = F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks))
    new = ("n_words", "hits", "items")
    carried = [c for c in returned or docs.columns if c not in new]
    out = docs.select(
        packed(carried),
        F.col(f"`{text}`").cast("string").alias("__text"),
        F.lit(0).cast("long").alias("__n_words"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("__hits"),
        F.expr("cast(array() as array<string>)").alias("__items"),
    )
    for n in range(blocks):
        block = _Block(rows.where(which == n).toArrow(), span, gram)
        out = _scan(out, block, [ROW] if n == blocks - 1 else [ROW, "__text"])
        if n < blocks - 1:
            out = materialize(out, "decontaminate")
    return unpacked(out.withColumnsRenamed(dict(zip(_OWN, new, strict=True))), carried, list(new))


def hit_words(hits: str = "hits") -> Column:
    """Number of words in merged ranges."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """The rows of `docs` without a benchmark window, columns unchanged."""
    whole = docs.select(packed(docs.columns).alias("whole"), F.col(f"`{text}`").alias("text"))
    clean = find_benchmark_words(whole, items, "text", span, returned=["whole"]).where(F.size("hits") == 0)
    return unpacked(clean.withColumnRenamed("whole", ROW), docs.columns, [])
