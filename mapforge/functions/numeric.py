"""Tolerant comparison, division without errors, grids."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(num: Column, den: Column, other: float | None = None) -> Column:
    """num / den, and other (null unless given) where den is zero or null."""
    return F.when(den != 0, num / den).otherwise(F.lit(other).cast("double"))


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def close(a: Column, b: Column, rtol: float = 10 * sys.float_info.epsilon) -> Column:
    """|a - b| <= rtol * max(|a|, |b|); NaN equals NaN."""
    both = F.isnan(a) & F.isnan(b)
    either = F.isnan(a) | F.isnan(b)
    return F.when(both, True).when(either, False).otherwise((a == b) | (F.abs(a - b) <= rtol * F.greatest(F.abs(a), F.abs(b))))


def linspace(low: float, high: float, n: int) -> Column:
    """n values from low to high, both included, as an array."""
    if n < 2:
        return F.array(F.lit(float(low)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * F.lit((high - low) / (n - 1)))


def logspace(low: float, high: float, n: int) -> Column:
    """n values from low to high with equal ratios, both included."""
    return F.transform(linspace(math.log(low), math.log(high), n), F.exp)


def grid_distance(origin: tuple[float, ...], resolution: float, *axes: str) -> Column:
    """Distance of a grid point (1-based index columns) from origin, times the step."""
    total = None
    for o, c in zip(origin, axes):
        d = (F.col(c) - F.lit(float(o))) * F.lit(float(resolution))
        total = d * d if total is None else total + d * d
    return F.sqrt(total)
