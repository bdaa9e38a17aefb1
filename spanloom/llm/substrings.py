"""Removal of word windows that an earlier document holds, by difference-cover anchors.

A difference cover D of the residues modulo v has, for any two places i and j, a shift d < v
with (i + d) mod v and (j + d) mod v both in D. Anchors are the windows of `span - v + 1` words
at places whose residue is in D, so two equal windows of `span` words at any places i and j
share an anchor at the same shift. Only anchors that two documents hold are followed:

0. a text that equals one of a smaller id has no part in the search: all its windows go;
1. anchors, dealt by their hash, once; those held by one document alone end here;
2. around each shared anchor the windows of `span` words that contain it are hashed in full
   (128 bits) and dealt by that hash; the least doc_id of each is known after partial sums;
3. windows with a smaller owner go back to their document, whose covered words go.

Steps 1 and 2 shuffle hashes and ids only. Hot passages are one hash per document, met by
partial minima, and never grouped into a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.rows import ROW, packed, schema_with, unpacked
from spanloom.llm.words import NOT_SPACE, SAME, Words, column_list, scanned, windows

SPAN = 13

# Perfect difference covers, modulus to residues.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9)}


def _cover(span: int) -> tuple[int, np.ndarray]:
    """The largest known modulus that leaves anchors of at least half the span."""
    v = max((m for m in COVERS if 2 * (span - m + 1) >= span), default=0)
    if not v:
        raise ValueError("span: at least 4 words")
    return v, np.array(COVERS[v])


class _Anchors:
    def __init__(self, w: Words, span: int):
        self.v, cover = _cover(span)
        self.size, self.span, self.words = span - self.v + 1, span, w
        self.hashes, self.room, self.text = w.hashes(), w.room(), w.text
        place = np.arange(len(w)) - w.first[self.text]
        whole = w.counts[self.text] >= span
        at = np.flatnonzero(np.isin(place % self.v, cover) & (self.room >= self.size) & whole)
        self.at = at
        # 48 bits tell anchors apart well enough; they only choose what is compared in full.
        self.hash = windows(self.hashes, self.size)[at] >> np.uint64(16) if len(at) else np.zeros(0, np.uint64)

    def around(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hash, second hash) of the windows that contain the anchors numbered `hit`."""
        at = self.at[hit]
        starts = np.unique(at[:, None] - np.arange(self.v))
        starts = starts[starts >= 0]
        starts = starts[self.room[starts] >= self.span]
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return starts, windows(self.hashes, self.span, 1)[starts], windows(self.hashes, self.span, 2)[starts]


def _joint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for both hashes, to tell the windows of one document apart."""
    return first ^ (second << np.uint64(1))


def _distinct_by_row(row: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of one of each (row, keys)."""
    order = np.lexsort((*keys, row))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (row, *keys)], axis=0)
    return order[new]


def _copied(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    """Rows whose text, by its digest, is listed as a copy for their id."""
    held, text = batch.column("__copies"), batch.column("__text")
    return np.array(
        [held[i].is_valid and hashlib.md5(text[i].as_buffer() or b"").hexdigest() in held[i].as_py() for i in range(lo, hi)], bool
    )


def _anchor_rows(span: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for lo, hi, w in scanned(batch.column("__text"), SAME, NOT_SPACE):
                use = known[lo:hi] & ~_copied(batch, lo, hi)
                a = _Anchors(w, span)
                row = a.text[a.at]
                one = _distinct_by_row(row, a.hash)
                one = one[use[row[one]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.hash[one].view(np.int64)), pa.array(ids[lo + row[one]], pa.int64())],
                    names=["anchor", "doc_id"],
                )

    return scan


def _held(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> list[np.ndarray]:
    """Lists of 64-bit hashes of some rows; null is empty."""
    column = batch.column(name)
    return [
        column[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if column[i].is_valid else np.zeros(0, np.uint64)
        for i in range(lo, hi)
    ]


def _window_rows(span: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id").fill_null(0).to_numpy()
            for lo, hi, w in scanned(batch.column("__text"), SAME, NOT_SPACE):
                lists = _held(batch, "__held", lo, hi)
                if not any(len(x) for x in lists):
                    continue
                a = _Anchors(w, span)
                hit = _in_lists(a.text[a.at], a.hash, lists)
                starts, first, second = a.around(hit)
                row = a.text[starts]
                one = _distinct_by_row(row, first, second)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first[one].view(np.int64)),
                        pa.array(second[one].view(np.int64)),
                        pa.array(ids[lo + row[one]], pa.int64()),
                    ],
                    names=["first", "second", "doc_id"],
                )

    return scan


def _in_lists(row: np.ndarray, value: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Places whose value is in the list of their row; rows are in order."""
    cuts = np.searchsorted(row, np.arange(len(lists) + 1))
    out = [
        cuts[i] + np.flatnonzero(np.isin(value[cuts[i] : cuts[i + 1]], held))
        for i, held in enumerate(lists)
        if len(held) and cuts[i] < cuts[i + 1]
    ]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _cut_rows(span: int):
    """Word ranges to remove and the text that is left."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, left, starts_, ends_, n_ranges = [], [], [], [], [], []
            for lo, hi, w in scanned(batch.column("__text"), SAME, NOT_SPACE):
                gone = np.zeros(len(w) + 1, np.int32)
                lists = _held(batch, "__held", lo, hi)
                if any(len(x) for x in lists):
                    hashes, room = w.hashes(), w.room()
                    key = _joint(windows(hashes, span, 1), windows(hashes, span, 2))
                    at = np.flatnonzero(room[: len(key)] >= span)
                    at = at[_in_lists(w.text[at], key[at], lists)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + span, -1)
                copied = _copied(batch, lo, hi) & (w.counts >= span)
                covered = (np.cumsum(gone)[: len(w)] > 0) | copied[w.text]
                per_text = np.zeros(len(w.counts), np.int64)
                np.add.at(per_text, w.text[covered], 1)
                counts.append(w.counts)
                removed.append(per_text)
                body = w.data.tobytes()
                for t in range(hi - lo):
                    a, b = w.first[t], w.first[t + 1]
                    kept = np.flatnonzero(~covered[a:b]) + a
                    left.append(b" ".join([body[s:e] for s, e in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)]))
                    edge = np.diff(covered[a:b].astype(np.int8), prepend=0, append=0)
                    starts_.append(np.flatnonzero(edge == 1))
                    ends_.append(np.flatnonzero(edge == -1))
                    n_ranges.append(len(starts_[-1]))
            ranges = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32()) for x in (starts_, ends_)], ["start", "end"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW),
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                    pa.array(np.concatenate(removed) if removed else [], pa.int64()),
                    column_list(ranges, n_ranges),
                    pa.array(left, pa.binary()),
                ],
                names=[ROW, "n_words", "n_removed", "removed", "kept_text"],
            )

    return scan


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, returned: list[str] | None = None
) -> DataFrame:
    """The columns `returned` (default: all) of each row of `docs`, and n_words, n_removed,
    removed (word ranges, end exclusive) and kept_text (the other words joined by one space,
    UTF-8 bytes).

    A word goes if a window of `span` words over it starts as well in a document with a smaller
    id. Windows are judged on the input. Null, empty and wordless texts have no words; texts of
    fewer than `span` words lose none; rows with a null id neither lose words nor make others
    lose any; repeated rows of one id do not remove each other's words and come out alike; a
    text that repeats itself loses nothing by that. An empty table gives an empty result.
    Columns of `docs` named like the four new ones are replaced."""
    new = ("n_words", "n_removed", "removed", "kept_text")
    carried = [c for c in returned or docs.columns if c not in new]
    # The joins below deal the same columns by the same key, and what is read twice has no null
    # that a filter could be put against, so that one exchange serves all readers.
    rows = docs.select(
        packed(carried),
        F.col(f"`{doc_id}`").cast("long").alias("__id"),
        F.col(f"`{text}`").cast("string").alias("__text"),
    )
    digests = rows.select("__id", F.md5(F.col("__text").cast("binary")).alias("__digest")).where("__id is not null and __digest is not null")
    first = digests.groupBy("__digest").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    first = first.where(F.col("__first") < F.col("__last")).drop("__last")
    copies = digests.join(first, "__digest").where(F.col("__id") > F.col("__first"))
    copies = copies.groupBy(F.col("__id").alias("__copy")).agg(F.collect_set("__digest").alias("__copies"))

    whole = rows.join(copies, rows["__id"] == copies["__copy"], "left").drop("__copy")
    anchors = whole.mapInArrow(_anchor_rows(span), "anchor long not null, doc_id long not null").repartition("anchor")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("__lo"), F.max("doc_id").alias("__hi"))
    shared = shared.where(F.col("__lo") < F.col("__hi")).select("anchor").hint("shuffle_hash")
    held = anchors.join(shared, "anchor").groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("anchor").alias("__held"))

    around = rows.join(held, rows["__id"] == held["__of"], "left").drop("__of")
    found = around.mapInArrow(_window_rows(span), "first long not null, second long not null, doc_id long not null").repartition("first", "second")
    least = found.groupBy("first", "second").agg(F.min("doc_id").alias("__least"), F.max("doc_id").alias("__most"))
    least = least.where(F.col("__least") < F.col("__most")).drop("__most").hint("shuffle_hash")
    later = found.join(least, ["first", "second"]).where(F.col("__least") < F.col("doc_id"))
    joint = F.col("first").bitwiseXOR(F.shiftleft("second", 1)).alias("__joint")
    gone = later.groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set(joint).alias("__held"))

    marks = gone.join(copies, gone["__of"] == copies["__copy"], "full")
    marks = marks.select(F.coalesce("__of", "__copy").alias("__marked"), "__held", "__copies")
    cut = rows.join(marks, rows["__id"] == marks["__marked"], "left").drop("__marked", "__id")
    own = "n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text binary"
    return unpacked(cut.mapInArrow(_cut_rows(span), schema_with(cut, own)), carried, list(new))
