"""Words and word-window hashes of Arrow text columns, scanned as bytes.

Both word classes used by the operators hold every byte from 0x80 up, so a scan of the
UTF-8 bytes finds the same words as a scan of code points. Texts are scanned whole, a few
at a time; the working memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
SEGMENT_BYTES = 1 << 20

_BYTES = np.arange(256)
SAME = _BYTES.astype(np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
# A-Z count as letters here: the texts are lower-cased before or while they are scanned.
LETTERS = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
LETTERS_ANY_CASE = LETTERS | ((_BYTES >= 65) & (_BYTES <= 90))
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs stay equal, others look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


_CODES = salts(256, 1)
_BASE = 0x5851F42D4C957F2D
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers


class Words:
    """The words of some texts: byte spans, the index of each text's first word, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, inside: np.ndarray):
        self.data = fold[data] if fold is not SAME else data
        n = len(data)
        mask = np.zeros(n + 1, bool)
        mask[:n] = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = mask[:-1]
        self.starts = np.flatnonzero(mask & (~before | edge))
        self.ends = np.flatnonzero(before & (~mask | edge))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """For each word the number of words from it to the end of its text."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        lo = 0
        while lo < len(self):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + SEGMENT_BYTES, "right")))
            s, e = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            up, down = _power_tables(int(e[-1]) + 1)
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(_CODES[self.data[base : base + int(e[-1])]] * up[: int(e[-1])], out=total[1:])
            out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
            lo = hi
        return out


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each place on; only places with k words left have a meaning."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n] + np.uint64(2 * seed + 1)
    for i in range(1, k):
        acc = acc * (_STEP + np.uint64(2 * seed)) + hashes[i : i + n]
    return mix(acc)


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, bytes, offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def scanned(column: pa.Array, fold: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """The words of a text column, a run of rows at a time."""
    for lo, hi, data, offsets in texts(column):
        yield lo, hi, Words(data, offsets, fold, inside)


class Members:
    """Membership in a fixed set of 64-bit hashes; a bitmap answers most of the misses."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.bits = max(16, int(len(self.values)).bit_length() + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.values)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def among(self, x: np.ndarray) -> np.ndarray:
        """Places of x whose value is in the set."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[self._slot(x)])
        at = np.searchsorted(self.values, x[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == x[maybe]]


def column_list(values: pa.Array, counts: list[int] | np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(np.asarray(counts, np.int64), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
