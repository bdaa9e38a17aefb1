"""Near-duplicates by an LSH forest of min-hash signatures, confirmed on full shingle sets.

1. Each text becomes the set of its distinct word shingles, a 128-bit digest of that set, and a
   signature of TREES * DEPTH min-hashes. Texts with the same set form a class, known by its
   least doc_id; from here on only classes move.
2. Each tree sorts the classes by its own DEPTH min-hashes, then by a sketch of the whole
   signature. The rows next to a row are those with the longest common prefix: where the
   collection is thin they share few hashes, where it is dense many, so the depth adapts to the
   region. Neighbours that share LEAST_DEPTH hashes or more, whose sizes allow the similarity and
   whose sketches agree well enough, are candidates: at most TREES * NEAR for a class on either
   side, whatever the size of a group of copies. Blocks of the sorted order are met at their
   edges by their first and last NEAR rows.
3. The best candidate of every class is confirmed on the full sets; components of the confirmed
   links are formed; then the candidates between different components are confirmed, and the
   components joined. No link found is lost: a candidate that is skipped lies within a component.
4. Where a region, that is a tree and the LEAST_DEPTH hashes its classes share, still holds several
   components, its classes meet in blocks with their full sets: those outside its largest component
   with all, exactly, and a block puts out the links that join components, at most one less than
   it has classes. A region above a block is deepened first: its parts that share all DEPTH hashes
   come before it. Trees go in ROUNDS, so that later ones have only what is still apart.

A link of similarity s is missed only if no tree has both ends in one region, with probability
(1 - s ** LEAST_DEPTH) ** TREES, at s = 0.8 in 1 of 97,000. Texts that share a region but no link
are the costly case: within their region all are compared, by one matrix product a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.llm.rows import ROW, packed, schema_with, unpacked
from spanloom.llm.words import LOWER, NOT_SPACE, Words, mix, salts, scanned, texts, windows
from spanloom.runtime import materialize

WORDS = 5
PERCENT = 80
TREES = 16
DEPTH = 6
LEAST_DEPTH = 3
NEAR = 3
# Classes of a region on either side of a block of comparisons, and shingles of them.
BLOCK = 4096
BLOCK_SHINGLES = 4_000_000
# The trees whose regions are compared one round after the other.
ROUNDS = (range(0, 4), range(4, 8), range(8, 16))
# Cells of a matrix of shared shingles.
TILE = 1024
COLUMNS = 4096

_VALUES = TREES * DEPTH
_FACTORS = salts(_VALUES, 11) | np.uint64(1)
_SHIFTS = salts(_VALUES, 12)
_KEY = 2 * DEPTH


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, in that order. A text of fewer than k words is one."""
    hashes, room = w.hashes(), w.room()
    whole = windows(hashes, k)
    at = np.flatnonzero(room[: len(whole)] >= k)
    rows, values = [w.text[at]], [whole[at]]
    for short in range(1, k):
        few = np.flatnonzero(w.counts == short)
        if len(few):
            rows.append(few)
            values.append(windows(hashes, short, short)[w.first[few]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _signatures(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in scanned(batch.column("text"), LOWER, NOT_SPACE):
                size = np.zeros(hi - lo, np.int64)
                first, second = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                signature = np.zeros((hi - lo, _VALUES), np.uint16)
                if len(w):
                    row, value = shingle_sets(w, k)
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    here = row[starts]
                    size[here] = np.diff(starts, append=len(row))
                    first[here] = np.add.reduceat(mix(value), starts)
                    second[here] = np.add.reduceat(mix(value ^ _SHIFTS[0]), starts)
                    for j in range(_VALUES):
                        least = np.minimum.reduceat(value * _FACTORS[j] + _SHIFTS[j], starts)
                        signature[here, j] = (mix(least) >> np.uint64(48)).astype(np.uint16)
                flat = signature.astype(">u2").tobytes()
                width = 2 * _VALUES
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(size),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array([flat[i * width : (i + 1) * width] for i in range(hi - lo)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "first", "second", "signature"],
                )

    return scan


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its own hashes, then four bits of every hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signature = _matrix(batch.column("signature"), 2 * _VALUES)
        low = signature[:, 1::2] & 15
        sketch = (low[:, ::2] << 4) | low[:, 1::2]
        for tree in range(TREES):
            keys = np.hstack([signature[:, tree * _KEY : (tree + 1) * _KEY], sketch]).tobytes()
            width = _KEY + sketch.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(batch.num_rows, tree, np.int32)),
                    pa.array([keys[i * width : (i + 1) * width] for i in range(batch.num_rows)], pa.binary()),
                    batch.column("doc_id"),
                    batch.column("n_shingles"),
                ],
                names=["tree", "key", "doc_id", "n_shingles"],
            )


def _least_agreement(percent: int) -> int:
    """Of the sketch values of two sets of that similarity, five deviations below the mean."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(_VALUES * p - 5 * (_VALUES * p * (1 - p)) ** 0.5)


def _adjacent(percent: int, emit_edges: bool):
    """Candidates among sorted tree rows; with emit_edges also the first and last NEAR rows."""
    floor = _least_agreement(percent)
    width = _KEY + _VALUES // 2

    def pairs(tree, key, ids, size):
        for step in range(1, NEAR + 1):
            same = tree[step:] == tree[:-step]
            same &= (key[step:, : 2 * LEAST_DEPTH] == key[:-step, : 2 * LEAST_DEPTH]).all(axis=1)
            a, b = size[step:], size[:-step]
            at = np.flatnonzero(same & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)))
            x = key[at + step, _KEY:] ^ key[at, _KEY:]
            agree = ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
            at, agree = at[agree >= floor], agree[agree >= floor]
            yield np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step]), agree

    def table(a, b, agree, edge):
        n, m = len(a), len(edge[0])
        pad = lambda values, kind, before, after: pa.concat_arrays([pa.nulls(before, kind), pa.array(values, kind), pa.nulls(after, kind)])
        return pa.RecordBatch.from_arrays(
            [
                pad(a, pa.int64(), 0, m),
                pad(b, pa.int64(), 0, m),
                pad(agree, pa.int32(), 0, m),
                pad(edge[0], pa.int32(), n, 0),
                pad([x.tobytes() for x in edge[1]], pa.binary(), n, 0),
                pad(edge[2], pa.int64(), n, 0),
                pad(edge[3], pa.int64(), n, 0),
            ],
            names=["a", "b", "agree", "tree", "key", "doc_id", "n_shingles"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        none = (np.zeros(0, np.int32), np.zeros((0, width), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (
                batch.column("tree").to_numpy(),
                _matrix(batch.column("key"), width),
                batch.column("doc_id").to_numpy(),
                batch.column("n_shingles").to_numpy(),
            )
            edge = none
            if held is None:
                edge = tuple(x[:NEAR] for x in rows) if emit_edges else none
            else:
                rows = tuple(np.concatenate([h, x]) for h, x in zip(held, rows, strict=True))
            found = list(pairs(*rows))
            yield table(*(np.concatenate([f[i] for f in found]) for i in range(3)), edge)
            held = tuple(x[-NEAR:].copy() for x in rows)
        if held is not None and emit_edges:
            yield table(none[2], none[2], none[2], held)

    return scan


_ADJACENT = "a long, b long, agree int, tree int, key binary, doc_id long, n_shingles long"


def candidate_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, agree) of the classes (doc_id, n_shingles, signature), a < b."""
    rows = classes.select("doc_id", "n_shingles", "signature").mapInArrow(_tree_rows, "tree int, key binary, doc_id long, n_shingles long")
    ordered = rows.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    found = materialize(ordered.mapInArrow(_adjacent(percent, True), _ADJACENT), "neighbours")
    edges = found.where(F.col("tree").isNotNull()).select("tree", "key", "doc_id", "n_shingles")
    across = edges.coalesce(1).sortWithinPartitions("tree", "key", "doc_id").mapInArrow(_adjacent(percent, False), _ADJACENT)
    both = found.where(F.col("a").isNotNull()).select("a", "b", "agree").union(across.select("a", "b", "agree"))
    return both.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, region, deep, node) for each tree: the first LEAST_DEPTH hashes, and a hash of all."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signature = _matrix(batch.column("signature"), 2 * _VALUES).astype(np.uint64)
        for tree in range(TREES):
            region, deep = np.full(batch.num_rows, tree, np.uint64), np.full(batch.num_rows, tree, np.uint64)
            for at in range(_KEY):
                value = signature[:, tree * _KEY + at]
                region = (region << np.uint64(8)) | value if at < 2 * LEAST_DEPTH else region
                deep = mix(deep ^ value)
            columns = [pa.array(np.full(batch.num_rows, tree, np.int32)), pa.array(region.view(np.int64)), pa.array(deep.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("doc_id"), batch.column("n_shingles")], names=["tree", "region", "deep", "node", "n_shingles"])


def dense_regions(classes: DataFrame) -> DataFrame:
    """(tree, region, deep, node, n_shingles) of the regions with more than one class."""
    rows = classes.select("doc_id", "n_shingles", "signature").mapInArrow(_region_rows, "tree int, region long, deep long, node long, n_shingles long")
    several = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("region")
    return rows.join(several, "region")


def _incidence(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(common)), np.float32)
    for n, values in enumerate(sets):
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        out[n, at[common[at] == values]] = 1
    return out


def linked(sets: list[np.ndarray], comp: np.ndarray, asks: np.ndarray, to: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the components that links join: pairs of components. Sets are sorted
    shingle hashes; those at `asks` are compared with those at `to`, exactly."""
    size = np.array([len(x) for x in sets])
    # A shingle that only one set has is in no intersection.
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[times > 1]
    up: dict[int, int] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    forest = []
    for lo in range(0, len(asks), TILE):
        of = asks[lo : lo + TILE]
        for low in range(0, len(to), TILE):
            other = to[low : low + TILE]
            both = np.zeros((len(of), len(other)), np.float32)
            for c in range(0, len(shared), COLUMNS):
                columns = shared[c : c + COLUMNS]
                both += _incidence([sets[i] for i in of], columns) @ _incidence([sets[i] for i in other], columns).T
            both = both.astype(np.int64)
            near = 100 * both >= percent * (size[of][:, None] + size[other] - both)
            i, j = np.nonzero(near & (both > 0) & (comp[of][:, None] != comp[other]))
            for a, b in np.unique(np.column_stack([comp[of[i]], comp[other[j]]]), axis=0).tolist():
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    forest.append((a, b))
    return forest


def _blocks(k: int, percent: int):
    """Links (a, b) of components within the blocks (region, base, probe) of sorted rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved():
            rows = pa.Table.from_batches(held).combine_chunks()
            asks = rows.column("asks").to_numpy()
            if not asks.any() or not len(rows):
                return
            found = linked(_sets(rows.column("text"), k), rows.column("comp").to_numpy(), np.flatnonzero(asks), np.flatnonzero(~asks), percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("part", "base", "probe")]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in key])
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                now = tuple(x[lo] for x in key)
                if held and now != last:
                    yield from solved()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield from solved()

    return scan


def region_links(regions: DataFrame, comps: DataFrame, held: DataFrame, k: int, percent: int, least: int = 0, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) of components that share a region. regions: part, node, n_shingles; comps: node, comp;
    held: node, text.

    Regions of one component are left out, and those of no more than `least` classes. The others are
    dealt in blocks of about `block` classes and `shingles` shingles on either side."""
    rows = regions.join(comps, "node")
    parts = rows.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    whole = parts.groupBy("part").agg(
        F.sum("n").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "s", "comp")).alias("main")
    )
    whole = whole.where((F.col("k") > 1) & (F.col("m") > least))
    count = lambda n, s: F.ceil(F.greatest(n / F.lit(block), s / F.lit(shingles))).cast("int")
    whole = whole.select("part", F.col("main.comp").alias("main"), count(F.col("m"), F.col("s")).alias("bases"), count(F.col("m") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("probes"))
    open_rows = rows.join(whole, "part").select("part", "node", "comp", "bases", "probes", (F.col("comp") != F.col("main")).alias("rest"))
    piece = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Each class is a base; those outside the largest component also ask.
    places = F.transform(every("probes"), lambda p: F.struct(F.lit(False).alias("asks"), piece("bases", 1).alias("base"), p.alias("probe")))
    asking = F.transform(every("bases"), lambda p: F.struct(F.lit(True).alias("asks"), p.alias("base"), piece("probes", 2).alias("probe")))
    none = F.filter(asking, lambda p: F.lit(False))
    dealt = open_rows.select("part", "node", "comp", F.explode(F.concat(places, F.when(F.col("rest"), asking).otherwise(none))).alias("p")).select("part", "node", "comp", "p.*")
    keys = ["part", "base", "probe"]
    full = dealt.join(held, "node").select(*keys, "asks", "comp", "text").repartition(*keys).sortWithinPartitions(*keys)
    return full.mapInArrow(_blocks(k, percent), "a long, b long")


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for lo, hi, w in scanned(column, LOWER, NOT_SPACE):
        row, value = shingle_sets(w, k) if len(w) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        out.extend(np.split(value, np.searchsorted(row, np.arange(1, hi - lo))))
    return out


def _confirmed(k: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for lo, hi, _, _ in texts(batch.column("text_a")):
                for x, y in zip(_sets(batch.column("text_a").slice(lo, hi - lo), k), _sets(batch.column("text_b").slice(lo, hi - lo), k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            keep = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return scan


def confirmed_pairs(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) whose full shingle sets are similar enough. docs: node, text."""
    left = docs.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.mapInArrow(_confirmed(k, percent), "a long, b long").distinct()


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) after the links (a, b) between components."""
    top = components(links).select(F.col("node").alias("__comp"), F.col("root").alias("__top"))
    grown = comps.join(top, F.col("comp") == F.col("__comp"), "left").select("node", F.coalesce("__top", "comp").alias("comp"))
    return materialize(grown, "components")


def _of_their_class(k: int):
    """The rows whose text has the digest of the class that their id stands for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches(list(_signatures(k)(iter([batch]))))
            same = np.ones(batch.num_rows, bool)
            for name in ("first", "second"):
                same &= own.column(name).to_numpy() == batch.column(name).to_numpy()
            keep = pa.array(same)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("node", "text")], names=["node", "text"])

    return scan


_SIGNED = "doc_id long, n_shingles long, first long, second long, signature binary"
_DIGEST = ["first", "second", "n_shingles"]


def _classes(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): the digest of every row; of every class its digest, its least doc_id and
    the least of its component, and whether it is the class that stands for the component."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = materialize(rows.mapInArrow(_signatures(k), _SIGNED), "signatures")
    able = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    grouped = able.groupBy(*_DIGEST).agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    # A class has a number of its own, since two may share their least doc_id.
    classes = materialize(grouped.withColumn("doc_id", F.monotonically_increasing_id()), "classes")
    regions = materialize(dense_regions(classes), "regions")
    pairs = materialize(candidate_pairs(classes, percent), "pairs")

    ids = regions.select("node").distinct().join(classes.select(F.col("doc_id").alias("node"), F.col("least").alias("doc_id"), "first", "second"), "node")
    # Merged at every size, so that the work grows with the input and not by leaps.
    held = rows.join(ids.hint("merge"), "doc_id").groupBy("doc_id", "node", "first", "second", F.xxhash64("text")).agg(F.first("text").alias("text"))
    held = materialize(held.mapInArrow(_of_their_class(k), "node long, text string"), "candidates")

    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))).alias("e"), "agree")
    best = ends.groupBy("e.of").agg(F.max(F.struct("agree", (-F.col("e.to")).alias("to"))).alias("m"))
    best = best.select(F.least("of", -F.col("m.to")).alias("a"), F.greatest("of", -F.col("m.to")).alias("b")).distinct()
    roots = components(confirmed_pairs(best, held, k, percent)).select("node", "root")
    comps = regions.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"))
    comps = materialize(comps, "components")

    of = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where(F.col("comp_a") != F.col("comp_b"))
    rest = materialize(rest.select("a", "b", "comp_a", "comp_b"), "pairs-left")
    more = rest.join(confirmed_pairs(rest, held, k, percent), ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    comps = merged(comps, more)

    sizes = materialize(regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "large-regions")
    deepened = not sizes.isEmpty()
    for trees in ROUNDS:
        own = regions.where(F.col("tree").isin(*trees))
        passes = [("deep", own.join(sizes, "region", "left_semi"))] if deepened else []
        for part, some in [*passes, ("region", own)]:
            links = materialize(region_links(some.select(F.col(part).alias("part"), "node", "n_shingles"), comps, held, k, percent), "region-links")
            if not links.isEmpty():
                comps = merged(comps, links)

    every = classes.select("doc_id", "least", *_DIGEST).join(comps, F.col("doc_id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    first = every.groupBy("comp").agg(F.min(F.struct("least", "doc_id")).alias("f"))
    found = every.join(first, "comp").select(*_DIGEST, "least", F.col("f.least").alias("component_id"), (F.col("doc_id") == F.col("f.doc_id")).alias("stands"))
    return signed, found


def _with_class(signed: DataFrame, classes: DataFrame) -> DataFrame:
    own = classes.select(*[F.col(c).alias(f"__{c}") for c in _DIGEST], "least", "component_id", "stands")
    return signed.join(own, [signed[c] == own[f"__{c}"] for c in _DIGEST])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of `docs`.

    Texts are lower-cased (A-Z) and cut at white space; two are linked where their sets of
    distinct shingles of `words` words have a Jaccard similarity of `percent` % or more;
    component_id is the least doc_id that links reach, itself included. A text of fewer words is
    one shingle. Null, empty and wordless texts have no shingles and are linked with nothing; a
    null id is linked with nothing and has a null component; repeated rows come out alike; rows
    that share an id but not the text are linked each by its own text."""
    signed, classes = _classes(docs, doc_id, text, words, percent)
    able = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    joined = _with_class(able, classes).select("doc_id", "n_shingles", "component_id")
    apart = signed.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    return joined.union(apart.select("doc_id", "n_shingles", "doc_id"))


def _digests(k: int):
    """The rows, each with the digest of its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pa.Table.from_batches(list(_signatures(k)(iter([batch])))).combine_chunks()
                columns = [own.column(c).combine_chunks() for c in ("doc_id", *_DIGEST)]
                yield pa.RecordBatch.from_arrays([batch.column(ROW), *columns], names=[ROW, "doc_id", *_DIGEST])

    return scan


def keep_one_of_each(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` (doc_id, text, ...) for each group of near-duplicates, columns unchanged: one
    with the group's least id. Rows without an id or without words stay, all of them; of repeated rows,
    and of equal texts under one id, one stays."""
    signed, classes = _classes(docs, "doc_id", text, words, percent)
    standing = materialize(classes.where("stands").select(F.col("least").alias("doc_id"), *_DIGEST), "standing")
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    times = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("most"))
    single = times.where("n = 1").join(standing.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left")
    single = single.where(F.col("kept") | (F.col("most") == 0)).select("doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = docs.where(F.col("doc_id").isNotNull()).join(single.hint("merge"), "doc_id", "left_semi").select(*columns)
    # Ids that several rows share: rows are told apart by the digests of their texts.
    again = materialize(times.where("n > 1").select("doc_id"), "shared-ids")
    out = alone.unionByName(docs.where(F.col("doc_id").isNull()))
    if again.isEmpty():
        return out
    rows = docs.join(again, "doc_id", "left_semi").select(packed(docs.columns), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    digested = rows.mapInArrow(_digests(words), schema_with(rows, "doc_id long, first long, second long, n_shingles long"))
    shared = materialize(digested, "shared-rows")
    one = shared.where(able).join(standing, ["doc_id", *_DIGEST], "left_semi").groupBy("doc_id", *_DIGEST).agg(F.first(ROW).alias(ROW))
    for more in (one, shared.where(~able)):
        out = out.unionByName(unpacked(more, docs.columns, []))
    return out
