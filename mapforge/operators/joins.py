"""Joins on keys that may be null and on tables that come from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """left with right's other columns, where keys are equal or both null. Without keys right has one row.

    The right side's keys get names of their own first, so that a table can be joined with one made of it.
    """
    renamed = right.select(*[F.col(f"`{k}`").alias(f"__key{i}") if k in keys else F.col(f"`{k}`") for k in right.columns for i in [keys.index(k) if k in keys else 0]])
    if not keys and also is None:
        return left.crossJoin(F.broadcast(renamed))  # one row
    condition = also
    for i, k in enumerate(keys):
        equal = F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}"))
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition, how).drop(*[f"__key{i}" for i in range(len(keys))])
