"""Order-dependent work that survives hot groups.

A window over a session is fine while every session fits one task. That is measured, not
assumed: one map-side-combined count finds the groups above the row limit. Without such
groups the ordinary window is used. Otherwise the rows of the hot groups alone are range
partitioned on (group, order), so that a group spreads over many tasks, and written once
to the shared folder to fix the partition numbers. Each partition number is then an
ordered block: windows run inside (group, block), and only one row per block travels to
stitch neighbouring blocks together. Results are identical on both paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import materialize, max_group_rows

_BLOCK = "_block"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: a map-side-combined count."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


class OrderedGroups:
    """Rows of `df` in a total order inside each group.

    `order` must be a total key (end it with an id): ties are the caller's to break.
    `largest` is the size of the largest group where a caller has measured it already
    (`largest_group`), which spares counting again.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        max_rows: int | None = None,
        largest: int | None = None,
    ):
        self.keys = keys
        self.order_columns = order
        self.order = [F.col(o).asc_nulls_last() for o in order]
        limit = max_rows or max_group_rows(df.sparkSession)
        hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        fits = largest is not None and largest <= limit
        hot_rows = 0 if fits else hot.agg(F.sum("_n")).first()[0] or 0
        self.split = hot_rows > 0
        self.df = self._split(df, hot, int(hot_rows), limit) if self.split else df

    def _split(self, df: DataFrame, hot: DataFrame, hot_rows: int, limit: int) -> DataFrame:
        hot = materialize(hot.select(*self.keys), "hot-keys")
        same = reduce(
            lambda a, b: a & b, [df[k].eqNullSafe(hot[k]) for k in self.keys]
        )
        blocks = max(2, -(-2 * hot_rows // limit))
        spread = (
            df.join(hot, same, "left_semi")
            .repartitionByRange(blocks, *[F.col(k) for k in self.keys], *self.order)
            .withColumn(_BLOCK, F.spark_partition_id())
        )
        rest = df.join(hot, same, "left_anti").withColumn(_BLOCK, F.lit(-1))
        return materialize(spread, "hot-rows").unionByName(rest)

    def _window(self):
        keys = self.keys + ([_BLOCK] if self.split else [])
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _block_window(self):
        return Window.partitionBy(*self.keys).orderBy(_BLOCK)

    def _done(self, df: DataFrame) -> DataFrame:
        return df.drop(_BLOCK) if self.split else df

    def small_groups(self) -> DataFrame:
        """Rows of the groups within the limit (only meaningful when split)."""
        return self._done(self.df.filter(F.col(_BLOCK) == -1))

    def large_groups(self) -> DataFrame:
        """Rows of the groups above the limit (only meaningful when split)."""
        return self._done(self.df.filter(F.col(_BLOCK) != -1))

    def neighbours(
        self,
        previous: dict[str, str] | None = None,
        following: dict[str, str] | None = None,
    ) -> DataFrame:
        """Add lagged (`previous`) and leading (`following`) copies of columns, given as
        {new column: source column}; null at the ends of a group."""
        previous, following = previous or {}, following or {}
        w = self._window()
        out = self.df
        for name, source in previous.items():
            out = out.withColumn(name, F.lag(source).over(w))
        for name, source in following.items():
            out = out.withColumn(name, F.lead(source).over(w))
        if not self.split:
            return out
        # Block edges: the last row of a block feeds the first row of the next one.
        edge_key = F.struct(
            *[
                F.struct(F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))
                for i, c in enumerate(self.order_columns)
            ]
        )
        sources = sorted({*previous.values(), *following.values()})
        value = F.struct(*[F.col(s) for s in sources])
        edges = (
            self.df.groupBy(*self.keys, _BLOCK)
            .agg(F.min_by(value, edge_key).alias("_first"), F.max_by(value, edge_key).alias("_last"))
            .withColumn("_before", F.lag("_last").over(self._block_window()))
            .withColumn("_after", F.lead("_first").over(self._block_window()))
            .select(*self.keys, _BLOCK, "_before", "_after")
        )
        out = (
            out.withColumn("_head", F.row_number().over(w) == 1)
            .withColumn("_tail", F.lead(F.lit(1)).over(w).isNull())
            .alias("r")
        )
        same = reduce(
            lambda a, b: a & b,
            [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in self.keys + [_BLOCK]],
        )
        # One row per (group, block): few rows, so both sides stay narrow in the join.
        joined = out.join(edges.alias("e"), same & (F.col("_head") | F.col("_tail")), "left")
        columns = []
        for c in out.columns:
            if c in ("_head", "_tail", _BLOCK):
                continue
            if c in previous:
                edge = F.col(f"e._before.{previous[c]}")
                columns.append(F.when(F.col("_head"), edge).otherwise(F.col(f"r.{c}")).alias(c))
            elif c in following:
                edge = F.col(f"e._after.{following[c]}")
                columns.append(F.when(F.col("_tail"), edge).otherwise(F.col(f"r.{c}")).alias(c))
            else:
                columns.append(F.col(f"r.{c}").alias(c))
        return joined.select(*columns)

    def positions(self, name: str = "position") -> DataFrame:
        """Number the rows of each group from 0."""
        return self._running(name, F.lit(1).cast("bigint"))

    def sums_before(self, name: str, source: str) -> DataFrame:
        """Add to each row the sum of `source` over the rows of its group before it."""
        return self._running(name, F.col(source).cast("bigint"))

    def _running(self, name: str, amount: Column) -> DataFrame:
        within = self._window().rowsBetween(Window.unboundedPreceding, -1)
        out = self.df.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0).cast("bigint")))
        if not self.split:
            return out
        before = self._block_window().rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            self.df.groupBy(*self.keys, _BLOCK)
            .agg(F.sum(amount).alias("_n"))
            .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .drop("_n")
        )
        same = reduce(
            lambda a, b: a & b,
            [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in self.keys + [_BLOCK]],
        )
        return (
            out.alias("r")
            .join(offsets.alias("e"), same)
            .select(
                *[F.col(f"r.{c}").alias(c) for c in out.columns if c not in (name, _BLOCK)],
                (F.col(f"r.{name}") + F.col("e._offset")).alias(name),
            )
        )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` numbered from 0 in one order over all: dealt by ranges, numbered within each, and
    moved on by the sizes of the ranges before. The order should end with an id."""
    ranges = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range; its number is that of the shuffle's partitions.
    offsets = ranges.groupBy("_range").count().select(
        F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = ranges.withColumn("_within", within).join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_within") - 1).alias(name))


def packed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    name: str = "items",
    max_items: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Ordered lists, one row per group: `part` 0 holds the group whole, at any size. Only a
    caller that asks for `max_items` gets numbered parts of that length.

    The lists of hot groups are put together twice: the rows of a block, in as many tasks as the
    group has blocks, and then the blocks, which are in order already."""
    if max_items is None:
        place = [c for o in order for c in (F.col(o).isNull().alias(f"n_{o}"), F.col(o).alias(f"v_{o}"))]
        own = F.array_sort(F.collect_list(F.struct(*place, item.alias("_item"))))
        groups = OrderedGroups(df, keys, order, largest=largest)
        if groups.split:
            blocks = groups.df.groupBy(*keys, _BLOCK).agg(F.transform(own, lambda x: x["_item"]).alias("_items"))
            whole = F.array_sort(F.collect_list(F.struct(_BLOCK, "_items")), lambda a, b: (a[_BLOCK] - b[_BLOCK]).cast("int"))
            stitched = blocks.groupBy(*keys).agg(F.flatten(F.transform(whole, lambda x: x["_items"])).alias(name))
            return stitched.select(*keys, F.lit(0).cast("bigint").alias("part"), name)
        listed = df.groupBy(*keys).agg(own.alias("_l"))
        listed = listed.withColumn("part", F.lit(0).cast("bigint"))
    else:
        placed = OrderedGroups(df, keys, order, largest=largest).positions("_pos")
        listed = (
            placed.withColumn("_part", F.floor(F.col("_pos") / max_items).cast("bigint"))
            .groupBy(*keys, F.col("_part").alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), item.alias("_item")))).alias("_l"))
        )
    return listed.select(*keys, "part", F.transform("_l", lambda x: x["_item"]).alias(name))
