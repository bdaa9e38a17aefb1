"""Rows of any table carried through an operator as one struct, so that no name can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"


def packed(names: list[str]) -> Column:
    return (F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.struct(F.lit(True).alias("none"))).alias(ROW)


def unpacked(rows: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"{ROW}.`{n}`").alias(n) for n in names], *own)


def schema_with(rows: DataFrame, own: str) -> T.StructType:
    """The schema of (the struct, the operator's own columns)."""
    return T.StructType([rows.schema[ROW], *T.StructType.fromDDL(own).fields])
