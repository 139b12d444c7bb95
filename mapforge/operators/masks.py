"""Masks, policies, flags and bit masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite

IN_SCAN, TURNAROUND, OTHER = 1, 2, 3
CHOICES = ("keep", "mask", "remove")


@dataclass(frozen=True)
class Policy:
    """What happens to samples of each kind; mask zeroes them, remove drops them."""

    inscan: str = "keep"
    turnaround: str = "keep"
    other: str = "remove"
    invalid: str = "mask"

    def __post_init__(self) -> None:
        for name, what in vars(self).items():
            if what not in CHOICES:
                raise ValueError(f"policy {name} is {what!r}; known: {', '.join(CHOICES)}")

    def __str__(self) -> str:
        return ", ".join(f"{what} {name}" for name, what in vars(self).items())


def apply_policy(pointing: DataFrame, policy: Policy, info: str = "info", invalid: str | None = "invalid") -> DataFrame:
    """Adds masked and removed to a pointing table; an invalid sample obeys the stricter of two policies."""

    def is_(what: str) -> Column:
        kinds = (F.col(info) == IN_SCAN) & (policy.inscan == what) | (F.col(info) == TURNAROUND) & (policy.turnaround == what) | (F.col(info) == OTHER) & (policy.other == what)
        return kinds | (F.col(invalid) & F.lit(policy.invalid == what)) if invalid else kinds

    return pointing.withColumn("removed", is_("remove")).withColumn("masked", is_("mask") & ~F.col("removed"))


def outside_section(pointing: DataFrame, first: int, last: int, order: str = "t") -> DataFrame:
    """Removes samples outside a 1-based inclusive section; the comparison reaches the scan."""
    return pointing.filter(F.col(order).between(first - 1, last - 1))


def apply_mask(df: DataFrame, value: str, mask: str = "masked") -> DataFrame:
    return df.withColumn(value, F.when(F.col(mask), 0.0).otherwise(F.col(value)))


def filter_nonfinite(df: DataFrame, value: str, mask: str = "masked") -> DataFrame:
    """NaN and infinite values become 0 and masked."""
    bad = ~finite(F.col(value))
    had = F.col(mask) if mask in df.columns else F.lit(False)
    return df.withColumn("__bad", bad).withColumn(mask, had | F.col("__bad")).withColumn(value, F.when(F.col("__bad"), 0.0).otherwise(F.col(value))).drop("__bad")


def combine(*masks: str) -> Column:
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(F.col(m), F.lit(False))
    return out


def selected_masks(table: DataFrame, select: str | list[str] = "activated") -> DataFrame:
    """Rows (name, activated) of a mask catalogue chosen by all, activated, deactivated, none or names."""
    if isinstance(select, list):
        return table.filter(F.lower("name").isin([s.lower() for s in select]))
    if select not in ("all", "activated", "deactivated", "none"):
        return selected_masks(table, [select])
    return {"all": table, "activated": table.filter("activated"), "deactivated": table.filter("not activated"), "none": table.filter(F.lit(False))}[select]


def scanline_mask(pointing: DataFrame, repetition: str, line: str, repetitions: int = 0, lines: int = 0, mask: str = "masked") -> DataFrame:
    """Masks the first `repetitions` repetitions, and the first `lines` scan lines of the one after these (all, without lines)."""
    early = F.col(repetition) < repetitions
    partly = (F.col(repetition) == repetitions) & (F.col(line) < lines) if lines else F.lit(False)
    return pointing.withColumn(mask, F.col(mask) | early | partly)


def flags(status: DataFrame, period: float, extension: float = 0.0, bbid: str = "bbid", order: str = "t", keys: list[str] = ["slice"], chop: str | None = None) -> DataFrame:
    """Adds info to a status table, from building block numbers: 0xcd2 in scan, 0x4000 turnaround, all else other.

    What lies before the first in-scan sample is other; so are the ceil(extension / period) samples behind each calibration
    block (0x4004) and a last block that no in-scan sample follows. Without any block number the chopper's
    angle decides: other beyond 0.01.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    kind = F.shiftright(F.col(bbid), 16)
    n = int(-(-extension // period)) if extension > 0 else 0
    df = status.withColumn("__k", kind)
    df = df.withColumn("__first", F.min(F.when(F.col("__k") == 0xCD2, F.col(order))).over(whole)).withColumn("__last", F.max(F.when(F.col("__k") == 0xCD2, F.col(order))).over(whole))
    df = df.withColumn("__cal", F.last(F.when(F.col("__k") == 0x4004, F.col(order)), ignorenulls=True).over(w)).withColumn("__none", F.max(F.col(bbid)).over(whole) == 0)
    info = (
        F.when(F.col("__first").isNull() | (F.col(order) < F.col("__first")), OTHER)
        .when(F.col("__cal").isNotNull() & (F.col(order) - F.col("__cal") <= n), OTHER)
        .when(F.col("__k") == 0xCD2, IN_SCAN)
        .when(F.col(order) > F.col("__last"), OTHER)
        .when(F.col("__k") == 0x4000, TURNAROUND)
        .otherwise(OTHER)
    )
    guess = F.when(F.abs(F.col(chop)) > 0.01, OTHER).otherwise(IN_SCAN) if chop else F.lit(IN_SCAN)
    return df.withColumn("info", F.when(F.col("__none"), guess).otherwise(info)).drop("__k", "__first", "__last", "__cal", "__none")


def to_bits(df: DataFrame, keys: list[str], order: str, mask: str) -> DataFrame:
    """(keys, word, bits): 32 samples to an int, lowest bit first."""
    bit = F.when(F.col(mask), F.expr(f"shiftleft(1L, cast(`{order}` % 32 as int))")).otherwise(F.lit(0).cast("long"))
    return df.groupBy(*keys, F.floor(F.col(order) / 32).cast("long").alias("word")).agg(F.bit_or(bit).cast("long").alias("bits"))


def from_bits(words: DataFrame, keys: list[str], order: str, mask: str) -> DataFrame:
    """(keys, order, mask) of every sample in the words."""
    spread = words.select(*keys, "bits", "word", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("__b"))
    return spread.select(*keys, (F.col("word") * 32 + F.col("__b")).alias(order), (F.expr("(bits >> __b) & 1") == 1).alias(mask))


def validate(status: DataFrame, keys: list[str], column: str) -> None:
    """Raises unless a column has one value for all keys."""
    seen = [r[0] for r in status.select(column).distinct().limit(2).collect()]
    if len(seen) > 1:
        raise ValueError(f"{column} differs: {seen[0]!r}, {seen[1]!r}")


def sampling(status: DataFrame, keys: list[str], order: str, time: str, period: float) -> DataFrame:
    """(keys, interval, factor): median time step and its multiple of the period; more than 1 % off is an error."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    out = status.withColumn("__s", step).groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __s)").alias("interval"))
    out = out.withColumn("factor", F.floor(F.col("interval") / period + 0.5).cast("int"))
    off = out.filter(F.abs(F.col("interval") / (F.col("factor") * period) - 1) > 0.01).limit(1).count()
    if off:
        raise ValueError("the sampling interval is no multiple of the period")
    return out


def repair_jumps(status: DataFrame, keys: list[str], order: str, time: str, carried: list[str]) -> DataFrame:
    """A step back in time: the row takes the values of the row before, and both are invalid; two in a row are an error."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.coalesce(F.col(time) < F.lag(time).over(w), F.lit(False))
    df = status.withColumn("__b", back).withColumn("__p", F.coalesce(F.lag("__b").over(w), F.lit(False)))
    if df.filter("__b and __p").limit(1).count():
        raise ValueError("time goes back twice in a row")
    df = df.withColumn("invalid", F.col("__b") | F.coalesce(F.lead("__b").over(w), F.lit(False)))
    before = {c: F.when(F.col("__b"), F.lag(c).over(w)).otherwise(F.col(c)) for c in (time, *carried)}
    return df.select(*[before[c].alias(c) if c in before else F.col(c) for c in status.columns if c != "invalid"], "invalid")


def summary(pointing: DataFrame, keys: list[str] = ["slice"]) -> DataFrame:
    """Kept, masked and removed samples by scan phase."""
    return pointing.groupBy(*keys, "info").agg(F.count_if(~F.col("masked") & ~F.col("removed")).alias("kept"), F.count_if(F.col("masked") & ~F.col("removed")).alias("masked"), F.count_if(F.col("removed")).alias("removed"))
