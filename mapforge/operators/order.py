"""Sorting, distinct runs, ranks and selections by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.geometry import hull


def sort_index(df: DataFrame, keys: list[str], order: str, value: str, mask: str | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of a key's values in ascending order; NaN and masked values come last, ties by order."""
    last = F.isnan(value) | F.col(mask) if mask else F.isnan(value)
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(last, value, order)) - 1).cast("long"))


def uniq_integers(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last row of each run of equal values."""
    after = F.lead(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__a", after).filter(F.col("__a").isNull() | (F.col("__a") != F.col(value))).drop("__a")


def uniq_reals(df: DataFrame, keys: list[str], order: str, value: str, rtol: float = 0.0) -> DataFrame:
    """The first row of each run of values that are equal within rtol to the run's first; values are in ascending order."""
    return reorder(df, keys, order, value, rtol).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "index").orderBy(order))).filter("__n = 1 and index is not null").drop("__n", "index")


def reorder(df: DataFrame, keys: list[str], order: str, value: str, rtol: float = 0.0, mask: str | None = None, name: str = "index") -> DataFrame:
    """Adds the number (from 1) of each value among its key's distinct values; null for NaN and masked ones.

    Without rtol that is a dense rank. With it, a value belongs to the run whose first value it equals within rtol,
    which only a walk through the sorted values can tell; a key's distinct values are walked in one task.
    """
    good = ~F.isnan(value) & (~F.col(mask) if mask else F.lit(True))
    if rtol == 0:
        w = Window.partitionBy(*keys, good).orderBy(value)
        return df.withColumn(name, F.when(good, F.dense_rank().over(w)))
    distinct = df.filter(good).select(*keys, value).distinct()
    kinds = StructType([*distinct.schema, StructField("__i", IntegerType())])

    def run(table):
        table = table.sort_by(value)
        x, out, first, n = table.column(value).to_numpy(), [], None, 0
        for v in x.tolist():
            if first is None or abs(v - first) > rtol * max(abs(v), abs(first)):
                first, n = v, n + 1
            out.append(n)
        return table.append_column("__i", pa.array(out, pa.int32()))

    found = (distinct.groupBy(*keys) if keys else distinct.groupBy(F.lit(1))).applyInArrow(run, kinds)
    found = found.select(*[F.col(k).alias(f"__{n}") for n, k in enumerate(keys)], F.col(value).alias("__v"), "__i")
    marked = df.withColumn("__good", good)
    on = [F.col(k).eqNullSafe(F.col(f"__{n}")) for n, k in enumerate(keys)] + [F.col(value) == F.col("__v"), F.col("__good")]
    return marked.join(found, on, "left").select(*df.columns, F.col("__i").alias(name))


def where(df: DataFrame, condition, *index: str) -> DataFrame:
    """The index columns of rows that fulfil a condition."""
    return df.filter(condition).select(*index)


def arithmetic(df: DataFrame, vector: DataFrame, keys: list[str], value: str, how: str, operand: str) -> DataFrame:
    """value (+ - * /) the operand of its key, from a table with one row for each key."""
    x, v = F.col(value), F.col(operand)
    done = {"add": x + v, "subtract": x - v, "multiply": x * v, "divide": F.when(v != 0, x / v)}
    return df.join(vector.select(*keys, operand), keys).withColumn(value, done[how]).select(*df.columns)


def convex_hull(df: DataFrame, keys: list[str], x: str, y: str, name: str = "corner") -> DataFrame:
    """The points on each key's hull with their number, counter-clockwise from the leftmost of the lowest."""
    schema = StructType([*df.schema, StructField(name, IntegerType())])

    def run(table):
        at = hull(np.asarray(table.column(x), float), np.asarray(table.column(y), float))
        return table.take(pa.array(at)).append_column(name, pa.array(np.arange(len(at)), pa.int32()))

    return df.groupBy(*keys).applyInArrow(run, schema)
