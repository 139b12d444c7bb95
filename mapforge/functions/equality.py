"""Structural comparison: of columns of any type, and of tables by their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from .numeric import close

#: Relative tolerances of double and single precision.
DOUBLE, SINGLE = 1e-14, 1e-7


def all_eq(a: Column, b: Column, kind: DataType, rtol: float | None = None) -> Column:
    """Whether two values of one type are equal: floats within a tolerance (NaN equals NaN), arrays by place, maps by key, structs by field.

    Null equals null only, inside as well.
    """
    if isinstance(kind, (FloatType, DoubleType)):
        same = close(a, b, rtol if rtol is not None else SINGLE if isinstance(kind, FloatType) else DOUBLE)
    elif isinstance(kind, ArrayType):
        places = F.zip_with(a, b, lambda x, y: all_eq(x, y, kind.elementType, rtol))
        same = (F.size(a) == F.size(b)) & F.forall(places, lambda x: x)
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(a))
        each = F.forall(keys, lambda k: all_eq(F.element_at(a, k), F.element_at(b, k), kind.valueType, rtol))
        same = (keys == F.array_sort(F.map_keys(b))) & each
    elif isinstance(kind, StructType):
        same = reduce(lambda x, y: x & y, (all_eq(a[f.name], b[f.name], f.dataType, rtol) for f in kind), F.lit(True))
    else:
        same = a.eqNullSafe(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def any_neq(a: Column, b: Column, kind: DataType, rtol: float | None = None) -> Column:
    return ~all_eq(a, b, kind, rtol)


def differences(a: DataFrame, b: DataFrame, keys: list[str], rtol: float | None = None) -> DataFrame:
    """(keys, columns): the rows that differ, with the names of their unequal columns; null where only one table has the key.

    Keys identify a row, null keys included. Tables with other names or types of columns are an error.
    """
    kinds = dict((f.name, f.dataType) for f in a.schema)
    if kinds != dict((f.name, f.dataType) for f in b.schema):
        raise ValueError(f"{a.schema.simpleString()} and {b.schema.simpleString()} are other columns")
    rest = [c for c in a.columns if c not in keys]
    x, y = (t.select(*keys, F.struct(F.lit(1).alias("there"), *rest).alias("r")).alias(n) for t, n in ((a, "x"), (b, "y")))
    on = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    names = F.array_compact(F.array(*[F.when(any_neq(F.col(f"x.r.`{c}`"), F.col(f"y.r.`{c}`"), kinds[c], rtol), F.lit(c)) for c in rest]).cast("array<string>"))
    both = F.col("x.r").isNotNull() & F.col("y.r").isNotNull()
    found = x.join(y, on, "full").select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], F.when(both, names).alias("columns"))
    return found.filter("columns is null or size(columns) > 0")


def assert_all_eq(a: DataFrame, b: DataFrame, keys: list[str], rtol: float | None = None) -> None:
    """An error that names a few of the rows that differ, if any does."""
    few = differences(a, b, keys, rtol).limit(5).collect()
    if few:
        raise AssertionError("tables differ: " + "; ".join(map(str, few)))
