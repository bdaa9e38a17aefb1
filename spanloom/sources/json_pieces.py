"""Objects of JSON files of any layout, split over many tasks.

A file may be one array of objects, one object, or objects one after the other, on lines or over
several. It is cut at every closing brace by the text source, which divides large files among tasks,
so a piece is short and no task needs a whole file. Where an object ends depends on what comes
before: whether a piece begins within a string, and how deep it lies. Both are carried over blocks of
a file by a prefix over one row a block, and the files are read twice instead of moving their text:

1. Of each piece: its quotes, and the change of depth if it begins outside a string and if it begins
   within one. In valid JSON a backslash is never cut from what it escapes, since no brace is escaped.
   The first reading adds these up over each block, in its order, for both ways it may begin.
2. The sums of the blocks before give each block its state. The second reading carries it on.
3. A piece ends an object where its brace returns to the depth at which the file's objects lie: 1 in an
   array, else 0. Objects within a block are put together where they are read; only the first and
   the last of each block may go on in another, and meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.runtime import materialize

_BLOCK = ["file", "block", "length"]
_PIECE = ["quotes", "change", "change_within"]
_SUMS = "file string, block long, length long, quotes long, outside long, within long, opens boolean"
_OBJECTS = "number long, no long, ends boolean, text string"


def _before():
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _count(text: Column, of: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(of)))).cast("long")


def _depth_change(text: Column, quotes: Column, inside: bool) -> Column:
    """Brackets opened less closed, the cut brace included, outside of strings."""
    whole = F.concat(F.lit('"'), text) if inside else text
    plain = F.regexp_replace(F.regexp_replace(whole, '"[^"]*"', ""), '(?s)".*$', "")
    ends_outside = (quotes + int(inside)) % 2 == 0
    return _count(plain, "{") + _count(plain, "[") - _count(plain, "]") - ends_outside.cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of the files in their order within each block."""
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("value").alias("text"),
    )
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    pieces = pieces.withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"'))
    return pieces.select(
        *_BLOCK, "text", "quotes", *[_depth_change(F.col("bare"), F.col("quotes"), inside).alias(n) for n, inside in (("change", False), ("change_within", True))]
    )


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of rows equal in all columns begin and end."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return zip(cuts[:-1], cuts[1:]) if len(columns[0]) else iter(())


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _walk(quotes: np.ndarray, change: np.ndarray, change_within: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of pieces in order: their change of depth, whether they end outside a string, and the parity of
    the quotes so far, which was `odd`."""
    after = odd + np.cumsum(quotes)
    moved = np.where((after - quotes) % 2 == 1, change_within, change)
    return moved, after % 2 == 0, int(after[-1] % 2)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its quotes, the change of depth if it begins outside a string and if within
    one, and whether its first piece opens an array. The rows of a block come together."""
    at: tuple | None = None
    sums: list = []
    row = lambda: pa.RecordBatch.from_pydict(
        {n: [v] for n, v in zip(("file", "block", "length", "quotes", "outside", "within", "opens"), (*at, *sums))}
    )
    for batch in batches:
        block, length, *piece = _numbers(batch, "block", "length", *_PIECE)
        for i, j in _runs(batch.column("file").dictionary_encode().indices.to_numpy(), block, length):
            here = (batch.column("file")[i].as_py(), int(block[i]), int(length[i]))
            if here != at:
                if at is not None:
                    yield row()
                at, sums = here, [0, 0, 0, batch.column("opens")[i].as_py()]
            part = [c[i:j] for c in piece]
            odd = sums[0] % 2
            sums[1] += int(_walk(*part, odd)[0].sum())
            sums[2] += int(_walk(*part, 1 - odd)[0].sum())
            sums[0] += int(part[0].sum())
    if at is not None:
        yield row()


def _block_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of each block by the number `no` of those that end before in it, without their last
    brace. What is left of the block behind them comes last, with `ends` false."""
    number, odd, depth, base, no = None, 0, 0, 0, 0
    held: list[str] = []

    def rows(texts: pa.Array, ends: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict(
            {"number": np.full(n, number), "no": np.arange(no, no + n), "ends": np.full(n, ends), "text": texts}
        )

    def joined(texts: pa.Array, cuts: list[int] | np.ndarray) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), texts)
        return pc.binary_join(lists, pa.scalar("}", texts.type))

    for batch in batches:
        numbers, within, before, bases, *piece = _numbers(batch, "number", "begins_within", "depth_before", "base", *_PIECE)
        for i, j in _runs(numbers):
            texts = batch.column("text").slice(i, j - i)
            if numbers[i] != number:
                if held:
                    yield rows(pa.array(["}".join(held)], texts.type), False)
                number, odd, depth, base, no, held = int(numbers[i]), int(within[i]), int(before[i]), int(bases[i]), 0, []
            moved, outside, odd = _walk(*[c[i:j] for c in piece], odd)
            deep = depth + np.cumsum(moved)
            depth = int(deep[-1])
            # The cut brace is the last step down, so the depth was one more before it.
            last = np.flatnonzero(outside & (deep == base))
            if len(last):
                found = joined(texts, np.concatenate([[0], last + 1]))
                if held:
                    first = pa.array(["}".join([*held, found[0].as_py()])], texts.type)
                    found = pa.concat_arrays([first, found.slice(1)])
                yield rows(found, True)
                no, held, texts = no + len(last), [], texts.slice(int(last[-1]) + 1)
            if len(texts):
                held.append(joined(texts, [0, len(texts)])[0].as_py())
    if held:
        yield rows(pa.array(["}".join(held)], pa.string()), False)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, place, json): the objects of the files at `path`, in the order of each file.

    Text between objects, such as commas, line ends or members of an array that are no objects, is
    left out; an empty file or array has no rows. An object that a file breaks off within comes out
    closed, and fails to parse later unless only its end is missing. The files must not change
    between the two readings; one that is not divided as before fails."""
    pieces = _pieces(spark, path)
    opens = F.rlike(F.col("text"), F.lit(r"^[\s\x{FEFF}]*\["))
    blocks = pieces.select(*_BLOCK, *_PIECE, opens.alias("opens")).mapInArrow(_block_sums, _SUMS)
    # Depth of a block if it begins outside a string, and if within one; the state itself by parity.
    blocks = blocks.withColumn("begins_within", F.coalesce(F.sum("quotes").over(_before()), F.lit(0)) % 2 == 1)
    change = F.when(F.col("begins_within"), F.col("within")).otherwise(F.col("outside"))
    opening = F.first("opens").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    states = blocks.withColumn("moved", change).select(
        *_BLOCK, "begins_within", F.coalesce(F.sum("moved").over(_before()), F.lit(0)).alias("depth_before"), opening.cast("long").alias("base")
    )
    states = materialize(states.withColumn("number", F.monotonically_increasing_id()), "json-blocks")

    # One row a block on each side that is sent to all tasks, so that no text is moved.
    placed = pieces.join(F.broadcast(states), _BLOCK, "left")
    other = F.raise_error(F.lit("the files are divided otherwise than when first read")).cast("long")
    placed = placed.select(F.coalesce("number", other).alias("number"), "begins_within", "depth_before", "base", "text", *_PIECE)
    found = materialize(placed.mapInArrow(_block_objects, _OBJECTS), "json-objects")

    ended = found.groupBy("number").agg(F.count_if("ends").alias("ended"))
    ends_before = F.coalesce(F.sum("ended").over(_before()), F.lit(0))
    places = states.join(ended, "number").select("number", "file", "block", ends_before.alias("ends_before"))
    rows = found.join(F.broadcast(places), "number").withColumn("place", F.col("ends_before") + F.col("no"))
    whole = rows.where("ends and no > 0").select("file", "place", "text")
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    met = rows.where("no = 0 or not ends").groupBy("file", "place").agg(parts.alias("parts"), F.bool_or("ends").alias("whole"))
    met = met.where("whole").select("file", "place", F.array_join(F.transform("parts", lambda p: p["text"]), "}").alias("text"))
    json = F.regexp_replace(F.concat("text", F.lit("}")), r"(?s)^[^{]*", "")
    return whole.unionByName(met).select("file", "place", json.alias("json")).where("json != ''")
