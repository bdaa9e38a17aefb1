"""The execution forest of a session: parents, depth, roots and what lies above a span.

Everything that depends on ancestors is folded along parent pointers that double in reach
every round, so a chain of depth d takes log2(d) joins on (session, span) and no pair of
(ancestor, descendant) is ever formed. A round that reaches no new root ends the work:
depths below a root have no gaps, so whatever is left hangs in a parent loop and stays
unreachable.

Sessions of few spans take one shuffle instead: the spans of a session are listed by its id and the
same doubling runs within the list. Both ways use the same folds and give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.functions.values import truthy
from spanloom.operators.ordered import OrderedGroups
from spanloom.operators.sessions import order_struct, tokens
from spanloom.runtime import materialize, max_group_rows


@dataclass
class Fold:
    """A value gathered from the strict ancestors of a span. `start` is what a span gives to
    its children; `merge(near, far)` joins the gathered parts of two path pieces."""

    name: str
    start: Column
    empty: Column
    merge: Callable[[Column, Column], Column]


def unique_spans(spans: DataFrame) -> DataFrame:
    """One row per (session, span id): the first in session order. Ids are counted first on
    the two key columns alone; only rows of repeated ids are regrouped. The operators below
    expect unique ids, so this runs once, when spans are stored."""
    keys = ["session_id", "span_id"]
    repeated = spans.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)
    repeated = materialize(repeated, "repeated-ids")
    if repeated.isEmpty():
        return spans
    columns = [c for c in spans.columns if c not in keys]
    first = F.min_by(F.struct(*columns), order_struct())
    regrouped = (
        spans.join(repeated, keys, "left_semi").groupBy(*keys).agg(first.alias("x")).select(*keys, "x.*")
    )
    return spans.join(repeated, keys, "left_anti").unionByName(regrouped)


def parents(spans: DataFrame) -> DataFrame:
    """Each span with its parent's type and name; a parent outside the session, or none,
    makes a root. The join key holds the span id, so a large session spreads."""
    s, p = spans.alias("s"), spans.alias("p")
    joined = s.join(
        p,
        (F.col("s.session_id") == F.col("p.session_id"))
        & (truthy(F.col("s.parent_span_id")) == F.col("p.span_id")),
        "left",
    )
    return joined.select(
        "s.*",
        F.col("p.span_id").alias("tree_parent"),
        F.col("p.entity_type").alias("parent_type"),
        F.col("p.entity_name").alias("parent_name"),
        F.col("p.span_id").isNull().alias("is_root"),
    )


# Hops made in one plan before the first result is stored; most forests end here.
_FIRST_HOPS = 3


def _first_hops(nodes: DataFrame, folds: list[Fold]) -> DataFrame:
    """Each span with the ancestors of its first hops folded in. `at` is the last of them,
    `root_id` is set where the walk ended."""
    own = nodes.select(
        "session_id",
        "span_id",
        truthy(F.col("parent_span_id")).alias("_next"),
        *[f.start.alias(f"_start_{f.name}") for f in folds],
    )
    above = own.select(
        F.col("session_id").alias("_s"),
        F.col("span_id").alias("_up"),
        F.col("_next").alias("_beyond"),
        *[f"_start_{f.name}" for f in folds],
    )
    state = own.select(
        "session_id",
        "span_id",
        "_next",
        F.lit(None).cast("string").alias("at"),
        F.lit(0).cast("bigint").alias("depth"),
        *[f.empty.alias(f.name) for f in folds],
    )
    for _ in range(_FIRST_HOPS):
        met = F.col("_up").isNotNull()
        state = state.join(
            above, (F.col("session_id") == F.col("_s")) & (F.col("_next") == F.col("_up")), "left"
        ).select(
            "session_id",
            "span_id",
            F.col("_beyond").alias("_next"),
            F.coalesce("_up", "at").alias("at"),
            (F.col("depth") + met.cast("bigint")).alias("depth"),
            *[
                F.when(met, f.merge(F.col(f.name), F.col(f"_start_{f.name}"))).otherwise(F.col(f.name)).alias(f.name)
                for f in folds
            ],
        )
    ended = F.col("_next").isNull()
    return state.withColumn("root_id", F.when(ended, F.coalesce("at", "span_id"))).drop("_next")


# Sessions of up to this many spans are folded as lists.
_TOGETHER = 500


def _by_size(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the sessions to be folded as lists, and the rows of larger ones if there are any.
    One map-side-combined count tells."""
    limit = min(_TOGETHER, max_group_rows(nodes.sparkSession))
    large = nodes.groupBy("session_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select("session_id")
    large = materialize(large, "large-sessions")
    if large.isEmpty():
        return nodes, None
    known = nodes.filter("span_id is not null")
    return nodes.join(large, "session_id", "left_anti"), known.join(large, "session_id", "left_semi")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _listed_folds(nodes: DataFrame, folds: list[Fold], labels: bool = False, every_span: bool = False) -> DataFrame:
    """`fold_ancestors`, and with `labels` also enter and leave as `interval_labels` gives them, of
    sessions that are small enough to be lists. With `every_span` spans that are not reached stay,
    without any of these."""
    carried = [c for c in nodes.columns if c != "session_id"]
    every = [*folds, path_fold()] if labels else folds
    own = [F.col(c) for c in carried]
    starts = [f.start.alias(f"_start_{f.name}") for f in every]
    # Ids are compared by equality, so rows without one are in no forest.
    known = nodes.filter("session_id is not null and span_id is not null")
    listed = known.groupBy("session_id").agg(F.collect_list(F.struct(*own, truthy(F.col("parent_span_id")).alias("_next"), *starts)).alias("_nodes"))
    rows = F.col("_nodes")

    def begun(u: Column, i: Column) -> Column:
        root = u == 0
        first = [F.when(root, f.empty).otherwise(F.get(rows, u - 1)[f"_start_{f.name}"]).alias(f.name) for f in every]
        return F.struct(u.alias("at"), F.when(root, i + 1).alias("top"), F.when(root, 0).otherwise(1).cast("bigint").alias("depth"), *first)

    def doubled(state: Column) -> Column:
        def step(s: Column) -> Column:
            far = F.get(state, s["at"] - 1)
            more = [f.merge(s[f.name], far[f.name]).alias(f.name) for f in every]
            return F.when(s["at"] == 0, s).otherwise(
                F.struct(far["at"].alias("at"), far["top"].alias("top"), (s["depth"] + far["depth"]).alias("depth"), *more)
            )

        return F.transform(state, step)

    def found(state: Column) -> Column:
        def row(n: Column, s: Column) -> Column:
            kept = [n[c].alias(c) for c in carried]
            met = s["top"].isNotNull()
            extra = [F.concat(s["above"], n["_start_above"]).alias("_path"), s["top"].alias("_top")] if labels else []
            return F.struct(*kept, F.get(rows, s["top"] - 1)["span_id"].alias("root_id"), F.when(met, s["depth"]).alias("depth"), *[F.when(met, s[f.name]).alias(f.name) for f in folds], *extra)

        whole = F.zip_with(rows, state, row)
        return whole if every_span else F.filter(whole, lambda x: x["root_id"].isNotNull())

    ids = F.transform(rows, lambda n: n["span_id"])
    ups = _let(ids, lambda known_ids: F.transform(rows, lambda n: F.coalesce(F.array_position(known_ids, n["_next"]), F.lit(0)).cast("int")))
    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(rows))))
    folded = F.aggregate(rounds, F.transform(ups, begun), lambda state, _: doubled(state))
    reached = _let(folded, found)
    names = [*carried, "root_id", "depth", *[f.name for f in folds]]
    if labels:
        reached = _let(reached, lambda x: _with_labels(x, rows, names, every_span))
        names += ["enter", "leave"]
    out = listed.select("session_id", F.inline(reached))
    return out.select("session_id", "span_id", *[c for c in names if c != "span_id"])


def _with_labels(spans: Column, rows: Column, names: list[str], every_span: bool) -> Column:
    """The reached spans of one list in the order of the depth-first walk, with enter and leave,
    and after them the others where `every_span` says so."""
    reached = F.filter(spans, lambda x: x["root_id"].isNotNull()) if every_span else spans
    trace = lambda x: F.coalesce(x["trace_id"], F.lit("unknown"))
    roots = F.transform(F.filter(reached, lambda x: x["depth"] == 0), lambda x: F.struct(trace(x).alias("trace"), F.get(x["_path"], F.lit(0)).alias("item")))

    def placed(tops: Column) -> Column:
        def key(x: Column) -> Column:
            of = trace(F.get(rows, x["_top"] - 1))
            start = F.array_min(F.transform(F.filter(tops, lambda r: r["trace"] == of), lambda r: r["item"]))
            return F.struct(start.alias("start"), x["_path"].alias("path"), x["depth"].alias("depth"), F.struct(*[x[c].alias(c) for c in names]).alias("row"))

        return F.transform(reached, key)

    def first_start(a: Column, b: Column) -> Column:
        ahead = lambda x, y: F.when(x < y, -1).when(x > y, 1)
        return F.coalesce(ahead(a["start"], b["start"]), ahead(a["path"], b["path"]), F.lit(0))

    def numbered(walk: Column) -> Column:
        depths = F.transform(walk, lambda x: x["depth"])

        def label(x: Column, i: Column, d: Column) -> Column:
            after = F.transform(F.slice(d, i + 2, F.size(d)), lambda other: other <= x["depth"])
            below = F.array_position(after, F.lit(True))
            leave = F.when(below == 0, F.size(d) - 1).otherwise(i + below - 1)
            return F.struct(*[x["row"][c].alias(c) for c in names], i.cast("bigint").alias("enter"), leave.cast("bigint").alias("leave"))

        return _let(depths, lambda d: F.transform(walk, lambda x, i: label(x, i, d)))

    walk = _let(_let(roots, lambda tops: F.array_sort(placed(tops), first_start)), numbered)
    if not every_span:
        return walk
    none = F.lit(None).cast("bigint")
    off = F.filter(spans, lambda x: x["root_id"].isNull())
    return F.concat(walk, F.transform(off, lambda x: F.struct(*[x[c].alias(c) for c in names], none.alias("enter"), none.alias("leave"))))


def fold_ancestors(nodes: DataFrame, folds: list[Fold]) -> DataFrame:
    """`nodes` (session_id, span_id, parent_span_id, ...) with root_id, depth and one column
    per fold. Spans in or under a parent loop are left out."""
    small, large = _by_size(nodes)
    together = _listed_folds(small, folds)
    return together if large is None else together.unionByName(_joined_folds(large, folds))


def _joined_folds(nodes: DataFrame, folds: list[Fold]) -> DataFrame:
    """`fold_ancestors` of sessions of any size, by joins."""
    columns = ["session_id", "span_id", "at", "root_id", "depth", *[f.name for f in folds]]
    state, done, total = _stored_step(_first_hops(nodes, folds).select(*columns))
    still_open = total - done
    while still_open:
        a = state.filter(F.col("root_id").isNull()).alias("a")
        b = state.alias("b")
        step = a.join(
            b,
            (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.at") == F.col("b.span_id")),
        ).select(
            "a.session_id",
            "a.span_id",
            F.coalesce("b.at", "b.root_id").alias("at"),
            "b.root_id",
            (F.col("a.depth") + F.col("b.depth")).alias("depth"),
            *[f.merge(F.col(f"a.{f.name}"), F.col(f"b.{f.name}")).alias(f.name) for f in folds],
        )
        grown, done, total = _stored_step(step)
        state = state.filter(F.col("root_id").isNotNull()).unionByName(grown)
        still_open = total - done if done else 0
    reached = state.filter(F.col("root_id").isNotNull()).drop("at")
    return nodes.join(reached, ["session_id", "span_id"])


def _stored_step(step: DataFrame) -> tuple[DataFrame, int, int]:
    """(stored rows, rows whose root is known, all rows), counted while writing."""
    seen = Observation()
    counted = step.observe(seen, F.count("root_id").alias("done"), F.count(F.lit(1)).alias("rows"))
    stored = materialize(counted, "tree")
    return stored, seen.get["done"], seen.get["rows"]


def path_item() -> Column:
    return F.struct(
        F.col("timestamp").alias("t"), F.coalesce("ts_raw", F.lit("")).alias("r"), F.col("span_id").alias("s")
    )


def path_fold() -> Fold:
    """Root-to-parent path of (time, id): the pre-order key."""
    empty = F.array().cast("array<struct<t:timestamp,r:string,s:string>>")
    return Fold("above", F.array(path_item()), empty, lambda near, far: F.concat(far, near))


def type_counts_fold(kind: str) -> Fold:
    """How many ancestors of a type there are, by name: bounded by the distinct names."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    start = F.when(
        F.col("entity_type") == kind, F.create_map(F.coalesce("entity_name", F.lit("")), F.lit(1).cast("bigint"))
    ).otherwise(empty)
    add = lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    return Fold(f"{kind}s_above", start, empty, lambda near, far: F.map_zip_with(near, far, add))


_NODE = [
    "session_id", "trace_id", "span_id", "parent_span_id", "entity_type", "entity_name",
    "timestamp", "ts_raw",
]


def execution_tree(spans: DataFrame) -> DataFrame:
    """Reachable spans with root_id and depth."""
    return fold_ancestors(spans.select(*_NODE), [])


def with_paths(spans: DataFrame, folds: list[Fold] | None = None) -> DataFrame:
    """Reachable spans with root_id, depth and the root-first path of (time, id) in `path`; for
    results that hold the path itself."""
    reached = fold_ancestors(spans, [*(folds or []), path_fold()])
    return reached.withColumn("path", F.concat("above", F.array(path_item()))).drop("above")


def walked(spans: DataFrame, folds: list[Fold] | None = None) -> DataFrame:
    """Reachable spans with `preorder`, whose order is a depth-first walk: traces by their
    first root, then roots and children by time. One way at every depth."""
    reached = _labelled(spans, folds or [])
    return reached.withColumn("preorder", F.struct(F.col("enter").alias("rank"))).drop("enter", "leave")


def _labelled(nodes: DataFrame, folds: list[Fold]) -> DataFrame:
    """`fold_ancestors` with enter and leave."""
    small, large = _by_size(nodes)
    together = _listed_folds(small, folds, labels=True)
    return together if large is None else together.unionByName(_joined_labels(large, folds))


def _joined_labels(nodes: DataFrame, folds: list[Fold]) -> DataFrame:
    reached = _joined_folds(nodes, folds)
    return reached.join(interval_labels(reached), ["session_id", "span_id"])


def every_span_folded(nodes: DataFrame, folds: list[Fold], labels: bool = False) -> DataFrame:
    """All rows of `nodes` with what `fold_ancestors` adds, and with `labels` enter and leave; null
    for spans that are not reached."""
    keys = ["session_id", "span_id"]
    small, large = _by_size(nodes)
    whole = _listed_folds(small, folds, labels, every_span=True)
    if large is not None:
        reached = _joined_labels(large, folds) if labels else _joined_folds(large, folds)
        added = [c for c in reached.columns if c not in nodes.columns]
        whole = whole.unionByName(large.join(reached.select(*keys, *added), keys, "left"))
    return whole.unionByName(nodes.filter("session_id is null or span_id is null"), allowMissingColumns=True)


def subtree_sizes(reached: DataFrame) -> DataFrame:
    """(session_id, span_id, size): the spans at and below each, for rows (session_id, span_id, up).

    After a round a span knows how many lie less than 2, 4, 8, ... steps below it and the ancestor
    as many steps above; the next round adds what those who have it as that ancestor know. So a
    forest of depth d takes log2(d) rounds of sums and joins on (session, span)."""
    size = F.lit(1).cast("bigint").alias("size")
    state, left = reached.select("session_id", "span_id", "up", size), 1
    while left:
        below = state.filter("up is not null").groupBy("session_id", F.col("up").alias("span_id")).agg(F.sum("size").alias("_more"))
        far = state.select("session_id", F.col("span_id").alias("up"), F.col("up").alias("_up"))
        step = state.join(below, ["session_id", "span_id"], "left").join(far, ["session_id", "up"], "left")
        seen = Observation()
        grown = step.select("session_id", "span_id", F.col("_up").alias("up"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
        state = materialize(grown.observe(seen, F.count("up").alias("left")), "sizes")
        left = seen.get["left"]
    return state.select("session_id", "span_id", "size")


def interval_labels(reached: DataFrame) -> DataFrame:
    """(session_id, span_id, enter, leave) of reachable spans: `enter` numbers the depth-first walk
    of a session from 0, and the spans below a span are those that enter after it and not after its
    `leave`. Nothing kept per span grows with depth.

    A child enters one after its parent plus the sizes of its earlier siblings, a root after
    the sizes of the roots before it; summed along the ancestors."""
    trace = F.coalesce("trace_id", F.lit("unknown"))
    own = reached.select(
        "session_id", "span_id", F.when(F.col("depth") > 0, F.col("parent_span_id")).alias("up"), "depth", trace.alias("root_trace"), path_item().alias("item")
    )
    own = materialize(own, "reached")
    starts = own.filter("depth = 0").groupBy("session_id", "root_trace").agg(F.min("item").alias("start"))
    roots = own.filter("up is null").join(starts, ["session_id", "root_trace"])
    rows = roots.unionByName(own.filter("up is not null"), allowMissingColumns=True).drop("root_trace", "depth")
    rows = rows.join(subtree_sizes(own), ["session_id", "span_id"])
    placed = OrderedGroups(rows, ["session_id", "up"], ["start", "item"]).sums_before("before", "size")
    step = F.col("before") + F.when(F.col("up").isNull(), 0).otherwise(1)
    nodes = materialize(placed.select("session_id", "span_id", F.col("up").alias("parent_span_id"), "size", step.alias("step")), "walk")
    above = Fold("above", F.col("step"), F.lit(0).cast("bigint"), lambda near, far: near + far)
    labelled = _joined_folds(nodes, [above]).withColumn("enter", F.col("above") + F.col("step"))
    return labelled.select("session_id", "span_id", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def parent_type_fold() -> Fold:
    """The type of the nearest ancestor, as a list of one; empty for a root."""
    empty = F.array().cast("array<string>")
    return Fold("parent_type", F.array("entity_type"), empty, lambda near, far: F.when(F.size(near) > 0, near).otherwise(far))


def labelled_tree(spans: DataFrame) -> DataFrame:
    """Reachable spans with root_id, depth, enter, leave and the parent's type."""
    labelled = _labelled(spans.select(*_NODE), [parent_type_fold()])
    return labelled.withColumn("parent_type", F.get("parent_type", F.lit(0)))


# Intervals are cut into aligned ranges of powers of this many numbers.
_RADIX = 16


def _aligned(enter: Column, leave: Column) -> Column:
    """The least aligned ranges (level, n) that make up the numbers from enter to leave: at most
    2 * (_RADIX - 1) of each level, and no more levels than the interval's length has digits."""
    up = lambda x, k: F.ceil(x / F.pow(F.lit(_RADIX), k)).cast("bigint")
    down = lambda x, k: F.floor(x / F.pow(F.lit(_RADIX), k)).cast("bigint")
    end = leave + 1
    digits = F.floor(F.log(float(_RADIX), end - enter) + 1e-9).cast("int")

    def of_level(k: Column) -> Column:
        first, last = up(enter, k), down(end, k)
        inner, outer = up(enter, k + 1) * _RADIX, down(end, k + 1) * _RADIX
        # What the next level covers is left to it.
        span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        numbers = F.when(inner < outer, F.concat(span(first, inner), span(outer, last))).otherwise(span(first, last))
        return F.transform(numbers, lambda n: F.struct(k.alias("level"), n.alias("n")))

    return F.flatten(F.transform(F.sequence(F.lit(0), digits), of_level))


def descendants(labels: DataFrame, starts: DataFrame) -> DataFrame:
    """Spans at or below each start (`starts`: session_id, span_id), as a range join on the labels
    (session_id, span_id, enter, leave): an interval is cut into aligned ranges, a span lies in one
    range of each level, so the join is by equality, spreads within a session, and makes the
    rows of the result alone."""
    wanted = labels.join(starts.select("session_id", "span_id").distinct(), ["session_id", "span_id"], "left_semi")
    ranges = wanted.select("session_id", F.col("span_id").alias("start_id"), F.explode(_aligned(F.col("enter"), F.col("leave"))).alias("r"))
    ranges = ranges.select("session_id", "start_id", "r.level", "r.n")
    # Only levels that some interval of the session uses.
    levels = ranges.groupBy("session_id").agg(F.max("level").alias("top"))
    placed = labels.join(levels, "session_id").select("session_id", "span_id", "enter", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    placed = placed.withColumn("n", F.floor(F.col("enter") / F.pow(F.lit(_RADIX), F.col("level"))).cast("bigint"))
    return placed.join(ranges, ["session_id", "level", "n"]).select("session_id", "span_id", "start_id")


def tree_summary(tree: DataFrame) -> DataFrame:
    """Per session and trace: spans in the flows of its roots, and roots. A span counts for
    the trace of its root. tree: a labelled tree."""
    roots = tree.filter(F.col("depth") == 0)
    return roots.groupBy("session_id", F.coalesce("trace_id", F.lit("unknown")).alias("trace_id")).agg(
        F.count("*").alias("root_count"), F.sum(F.col("leave") - F.col("enter") + 1).alias("flow_count")
    )


def roots_of_type(spans: DataFrame, kind: str) -> DataFrame:
    """Roots of an entity type."""
    return parents(spans).filter(F.col("is_root") & (F.col("entity_type") == kind))


def leaf_paths(spans: DataFrame) -> DataFrame:
    """The path of every leaf, from its root, as an array of span ids: whole at any depth,
    since the path is the result."""
    reached = with_paths(spans.select(*_NODE))
    inner = spans.select("session_id", F.col("parent_span_id").alias("span_id")).distinct()
    leaves = reached.join(inner, ["session_id", "span_id"], "left_anti")
    return leaves.select("session_id", "span_id", "root_id", "depth", F.col("path.s").alias("path"))


def flow_listing(tree: DataFrame) -> DataFrame:
    """Label, depth and number of children of every reachable span."""
    children = (
        tree.filter(F.col("depth") > 0)
        .groupBy("session_id", F.col("parent_span_id").alias("span_id"))
        .agg(F.count("*").alias("children_count"))
    )
    return tree.join(children, ["session_id", "span_id"], "left").select(
        "session_id",
        "span_id",
        F.concat_ws(":", "entity_type", "entity_name").alias("entity"),
        "depth",
        F.coalesce("children_count", F.lit(0)).alias("children_count"),
    )


def type_hierarchy(tree: DataFrame) -> DataFrame:
    """Per session: spans of each type, and the types found directly below it. tree: a labelled tree."""
    counts = tree.groupBy("session_id", "entity_type").agg(F.count("*").alias("n_spans"))
    below = (
        tree.filter(F.col("depth") > 0)
        .groupBy("session_id", F.col("parent_type").alias("entity_type"))
        .agg(F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("contains"))
    )
    return counts.join(below, ["session_id", "entity_type"], "left").withColumn(
        "contains", F.coalesce("contains", F.lit(""))
    )


def tool_token_cost(spans: DataFrame) -> DataFrame:
    """Model tokens spent below each tool, per session and tool name. A model call under two
    nested tools counts for both, so each call is weighted by the tools above it."""
    nodes = spans.select(*_NODE, tokens("total_tokens").alias("total_tokens"))
    fold = type_counts_fold("tool")
    reached = fold_ancestors(nodes, [fold])
    calls = reached.filter(F.col("entity_type") == "llm").select(
        "session_id",
        F.when(F.col("total_tokens") >= 0, F.col("total_tokens")).otherwise(0).alias("n"),
        F.explode(fold.name).alias("tool", "times"),
    )
    spent = calls.groupBy("session_id", "tool").agg(F.sum(F.col("n") * F.col("times")).alias("tool_tokens"))
    tools = (
        reached.filter(F.col("entity_type") == "tool")
        .select("session_id", F.coalesce("entity_name", F.lit("")).alias("tool"))
        .distinct()
    )
    return tools.join(spent, ["session_id", "tool"], "left").withColumn(
        "tool_tokens", F.coalesce("tool_tokens", F.lit(0))
    )
