"""Packing of token examples into sequences by vector bin packing.

Every example is a vector: its tokens, its segments (one), its loss-bearing tokens. A sequence is a
bin with a limit on each. The dot-product heuristic fills one sequence after the other: of the
examples that fit, the one whose vector has the greatest product with what is still free, each
dimension in parts of its limit and weighted by how scarce it is in the pool. So an example that is
heavy in what the sequence still has, and light in what it lacks, goes in first.

With `cut`, what nothing fits into is filled with the front of one more example, and a sequence
that a limit closes early ends at a power of two, where no padding is needed; what is cut off goes back
into the pool. Without `cut` only examples above the limits are cut, for instruction data.

Each task packs what it reads, with a pool of POOL examples; nothing is shuffled. The pool, not
the input, bounds its memory, besides the longest single example.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = 2048
FLUSH_BYTES = 4 << 20
WORD_CHARS = 64
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence; all at least 1."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")


# The steps of a tokenizer that lower-cases, drops white space and then knows no token
# across it, and the characters that every library treats alike: line end, printable ASCII, Latin-1 letters.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = {"behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN = r"\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself where it is visible
    in Latin-1, else the next free one above."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class _Encoder:
    """Ids of texts, as little-endian 32-bit bytes.

    Where the tokenizer works word by word (see above), words of plain characters go straight to
    its model, and only when they are new; what lies between blanks and is not plain is encoded by
    itself. Any other tokenizer gets the text whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        steps = json.loads(self.tokenizer.to_str())
        split, *rest = (steps["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.by_word = (
            (steps["normalizer"] or {}).get("normalizers") == _NORMALIZERS and rest == [_BYTES] and _SPLITS.items() <= split.items() and steps["post_processor"] is None
        )
        if self.by_word:
            self.model = self.tokenizer.model
            # The tokenizer's own pattern, over lower-cased plain characters.
            plain_letters = split["pattern"]["Regex"].replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
            self.split = re.compile(plain_letters).findall
            # A character that a special token begins with is not plain.
            apart = "".join({t["content"][0] for t in steps["added_tokens"]})
            self.plain = regex.compile(f"(?V1)[{_PLAIN}--[{regex.escape(apart)}]]*" if apart else f"[{_PLAIN}]*").fullmatch
            letters = _byte_letters()
            self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        words, known = self.split(text.lower()), self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set(words).difference(known)
        for word in new:
            known[word] = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()
        out = b"".join(map(known.__getitem__, words))
        for word in new:
            if len(word) > WORD_CHARS:
                del known[word]
        return out

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if self.plain(text):
            return self._plain(text)
        return b"".join(self._plain(w) if self.plain(w) else self._whole(w) for w in text.replace("\n", " ").split(" ") if w)


def token_ids(docs: DataFrame, vocabulary: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids), one for each row of `docs`: the ids of the whole text by the tokenizer
    file `vocabulary`, a path that every executor has, without special tokens, then `end`;
    little-endian unsigned 32-bit. A null text is empty and has the one id `end`."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    last = np.array([end], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary)
        for batch in batches:
            lo, size, ids = 0, 0, []
            column = batch.column("text")
            for n in range(batch.num_rows):
                ids.append(encoder.encode(column[n].as_py() or "") + last)
                size += len(ids[-1])
                if size >= FLUSH_BYTES or n == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n + 1 - lo), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                    lo, size, ids = n + 1, 0, []

    return rows.mapInArrow(scan, rows.select("doc_id", F.lit(b"").alias("ids")).schema)


class _Packer:
    """The examples of one task. A part is (example, start, end); loss sums are held by example."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.most = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        # One row for each dimension; whole numbers far below 2 ** 53.
        self.vectors = np.zeros((3, 0))
        self.parts: list[tuple[object, int, int]] = []
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def _loss(self, example, start: int, end: int) -> int:
        return end - start if example.bears is None else int(example.bears[end] - example.bears[start])

    def _fitting(self, example, start: int, end: int, tokens: int, loss: int) -> int:
        """The furthest end of a part from `start` within so many tokens and loss-bearing tokens."""
        end = min(end, start + tokens)
        if example.bears is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(example.bears, example.bears[start] + loss, "right")) - 1)

    def add(self, example, start: int, end: int) -> None:
        if self.size == self.vectors.shape[1]:
            self.vectors = np.hstack([self.vectors, np.zeros((3, max(64, self.size)))])
        self.vectors[:, self.size] = end - start, 1, self._loss(example, start, end)
        self.parts[self.size :] = [(example, start, end)]
        self.size += 1

    def _take(self, at: int) -> tuple[object, int, int]:
        part, last = self.parts[at], self.size - 1
        self.parts[at] = self.parts[last]
        self.vectors[:, at] = self.vectors[:, last]
        self.parts.pop()
        self.size = last
        return part

    def _best(self, free: np.ndarray, weight: np.ndarray, fits: np.ndarray | None) -> int:
        product = (weight * free) @ self.vectors[:, : self.size]
        if fits is not None:
            product = np.where(fits, product, -1.0)
        return int(np.argmax(product))

    def sequence(self) -> list[tuple[object, int, int]]:
        """The parts of the next sequence, in order; they leave the pool."""
        free = self.most.copy()
        scarce = self.vectors[:, : self.size].sum(axis=1) / self.most
        weight = scarce / max(scarce.max(), 1e-9) / self.most**2
        chosen = []
        while self.size:
            fits = (self.vectors[:, : self.size] <= free[:, None]).all(axis=0)
            if not fits.any():
                break
            at = self._best(free, weight, fits)
            free = free - self.vectors[:, at]
            chosen.append(self._take(at))
        if not self.cut:
            return chosen
        if self.size and free[0] and free[1]:
            at = self._best(free, weight, None)
            example, start, end = self.parts[at]
            stop = self._fitting(example, start, end, int(free[0]), int(free[2]))
            if stop > start:
                self._take(at)
                self.add(example, stop, end)
                chosen.append((example, start, stop))
                free[0] -= stop - start
        held = self.limits.tokens - int(free[0])
        over = held - (1 << (held.bit_length() - 1)) if free[0] else 0
        while over:
            example, start, end = chosen.pop()
            stop = max(start, end - over)
            over -= end - stop
            self.add(example, stop, end)
            if stop > start:
                chosen.append((example, start, stop))
        return chosen

    def whole(self, example) -> Iterator[list[tuple[object, int, int]]]:
        """Sequences of one part while an example is above the limits; its rest joins the pool."""
        start, end = 0, example.length
        while True:
            stop = self._fitting(example, start, end, self.limits.tokens, self.limits.loss)
            if stop == end:
                break
            if stop - start == self.limits.tokens:
                yield [(example, start, stop)]
            else:
                self.add(example, start, stop)
            start = stop
        self.add(example, start, end)


class _Example:
    __slots__ = ("doc_id", "ids", "length", "bears")

    def __init__(self, doc_id, ids: bytes, loss: bytes | None):
        self.doc_id, self.ids, self.length, self.bears = doc_id, ids, len(ids) // 4, None
        if loss is not None:
            if len(loss) != self.length:
                raise ValueError("a loss mask needs one byte for each id")
            self.bears = np.zeros(self.length + 1, np.int64)
            np.cumsum(np.frombuffer(loss, np.uint8) != 0, out=self.bears[1:])


def pack_sequences(examples: DataFrame, limits: Limits = Limits(), cut: bool = True, pool: int = POOL) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all
    examples and their places in sequences within `limits`.

    examples: doc_id (any type), ids (little-endian 32-bit), and, if there is one, loss: a byte for
    each id, not 0 where it bears loss; without it, or where it is null, every id does. Other
    columns are left out. Each id lies in exactly one piece. Null or empty ids have no piece;
    repeated rows are packed each; ids of rows may be null or equal; an empty table packs to none.
    Sequence ids are unique, not gapless; a task that runs again gives its sequences again."""
    if "loss" not in examples.columns:
        examples = examples.withColumn("loss", F.lit(None).cast("binary"))
    rows = examples.select("doc_id", "ids", "loss").where(F.octet_length("ids") > 0)
    own = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    kind = pa.binary()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, out, size, id_type = _Packer(limits, cut), TaskContext.get().partitionId() << 33, [], 0, None

        def taken(parts):
            nonlocal number, size
            place = 0
            for example, start, end in parts:
                out.append((example.doc_id, start, end - start, example.ids[4 * start : 4 * end], example.length, number, place))
                place += end - start
            size += 4 * place
            number += 1

        def flushed():
            nonlocal out, size
            columns, out, size = list(zip(*out, strict=True)), [], 0
            ids = pa.array(columns[0], id_type)
            rest = [pa.array(c, kind if n == 2 else pa.int64()) for n, c in enumerate(columns[1:])]
            return pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for n in range(batch.num_rows):
                example = _Example(batch.column("doc_id")[n].as_py(), batch.column("ids")[n].as_py(), batch.column("loss")[n].as_py())
                for parts in packer.whole(example):
                    taken(parts)
                    if size >= FLUSH_BYTES:
                        yield flushed()
                if len(packer) >= 2 * pool:
                    while len(packer) > pool:
                        taken(packer.sequence())
                if size >= FLUSH_BYTES:
                    yield flushed()
        while len(packer):
            taken(packer.sequence())
            if size >= FLUSH_BYTES:
                yield flushed()
        if out:
            yield flushed()

    schema = rows.select("doc_id").schema
    for field in own.split(", "):
        schema = schema.add(*field.split())
    return rows.mapInArrow(scan, schema)
