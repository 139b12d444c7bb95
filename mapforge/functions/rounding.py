"""Nine ways to round to an integer-valued double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_zero(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def away(x: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x)).cast("double")


def down(x: Column) -> Column:
    return F.floor(x).cast("double")


def up(x: Column) -> Column:
    return F.ceil(x).cast("double")


def half_to_zero(x: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x) - 0.5).cast("double")


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")


def half_down(x: Column) -> Column:
    return F.ceil(x - 0.5).cast("double")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def half_random(x: Column, seed: int = 0) -> Column:
    """Exact halves go up or down by a coin drawn from the value and the seed, so that a task run again agrees."""
    coin = F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(2)) == 0
    half = F.abs(x - F.floor(x)) == 0.5
    return F.when(half & coin, half_down(x)).when(half, half_up(x)).otherwise(half_away(x))


MODES = {
    "rtz": to_zero, "rti": away, "rtmi": down, "rtpi": up, "rhtz": half_to_zero,
    "rhti": half_away, "rhtmi": half_down, "rhtpi": half_up, "rhs": half_random,
}


def rounded(x: Column, mode: str = "rhti") -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown rounding mode {mode!r}; known: {', '.join(MODES)}")
    return MODES[mode](x)


nint_up, nint_down = half_up, half_down
