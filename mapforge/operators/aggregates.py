"""Statistics, norms and their gradients, histograms, profiles.

Medians are lower medians: of an even number of values the smaller of the two in the middle. Each function takes an
optional mask column; masked values don't count. Values that are null don't count either; NaN does unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import NAN, ratio
from .joins import on_keys
from .storage import saved


def unmasked(value: str | Column, mask: str | Column | None = None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    if mask is None:
        return v
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.when(~m, v)


def exact_sum(x: Column, scale: int = 12) -> Column:
    """A sum that doesn't depend on the order of rows: of decimals with so many places."""
    return F.sum(x.cast(f"decimal(38,{scale})")).cast("double")


def moments(df: DataFrame, value: str, keys: list[str] = [], mask: str | None = None) -> DataFrame:
    """n, mean, variance, skewness, kurtosis, stddev, meandev; sample variance (n - 1), which skewness and kurtosis use too.

    Without values mean is NaN; with one, variance and stddev are; where the deviation is zero, skewness and kurtosis are.
    Two passes: the mean deviation needs the mean.
    """
    v = unmasked(value, mask)
    n = F.count(v)
    first = df.groupBy(*keys).agg(n.alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k"))
    dev = on_keys(df, first.select(*keys, "mean"), keys).groupBy(*keys).agg(F.avg(F.abs(v - F.col("mean"))).alias("d"))
    both = on_keys(first, dev, keys)
    share = ratio(F.col("n") - 1.0, F.col("n").cast("double"))
    flat = (F.col("n") <= 1) | (F.col("variance") == 0)
    return both.select(
        *keys, "n", F.coalesce("mean", F.lit(NAN)).alias("mean"), F.when(F.col("n") > 1, F.col("variance")).otherwise(NAN).alias("variance"),
        F.when(flat, NAN).otherwise(F.col("s") * F.pow(share, 1.5)).alias("skewness"), F.when(flat, NAN).otherwise((F.col("k") + 3) * share * share - 3).alias("kurtosis"),
        F.when(F.col("n") > 1, F.sqrt("variance")).otherwise(NAN).alias("stddev"), F.coalesce("d", F.lit(NAN)).alias("meandev"),
    )


def lower_median(x: Column, drop_nan: bool = True) -> Column:
    """Lower median as an aggregate expression: the value at place (n - 1) / 2 of a group's sorted ones, in one task's memory."""
    ordered = F.array_sort(F.collect_list(F.when(~F.isnan(x), x) if drop_nan else x))
    return F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int"))


def median(df: DataFrame, value: str, keys: list[str], name: str = "median", mask: str | None = None) -> DataFrame:
    """Lower median of each group by percentile_disc, which spills and counts equal values once; NaN and masked values don't count."""
    v = unmasked(value, mask)
    known = df.withColumn("__v", F.when(~F.isnan(v), v))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __v)")
    return known.groupBy(*keys).agg(middle.alias(name))


def mad(df: DataFrame, value: str, keys: list[str], mask: str | None = None) -> DataFrame:
    """(keys, median, mad): lower median, and lower median of the absolute deviations from it."""
    med = median(df, value, keys, "median", mask)
    joined = on_keys(df, med, keys).select(*keys, "median", F.abs(unmasked(value, mask) - F.col("median")).alias("__d"))
    return joined.withColumn("__v", F.when(~F.isnan("__d"), F.col("__d"))).groupBy(*keys).agg(F.first("median").alias("median"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __v)").alias("mad"))


def minmax(x: Column) -> tuple[Column, Column]:
    """Smallest and largest value that is not NaN; NaN if there is none."""
    v = F.when(~F.isnan(x), x)
    return F.coalesce(F.min(v), F.lit(NAN)), F.coalesce(F.max(v), F.lit(NAN))


def dot(a: Column, b: Column) -> Column:
    return F.sum(a * b)


# Norms: an aggregate, and the gradient of it at each value. Gradients that need the norm take it as a column.


def norm_l1(x: Column) -> Column:
    return F.sum(F.abs(x))


def norm_l1_gradient(x: Column) -> Column:
    """The sign, which is 1 at 0."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def norm_l2(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def norm_l2_gradient(x: Column, norm: Column) -> Column:
    return ratio(x, norm, 0.0)


def norm2(x: Column) -> Column:
    return F.sum(x * x)


def norm2_gradient(x: Column) -> Column:
    return 2.0 * x


def norm_lp(x: Column, p: float) -> Column:
    return F.pow(normp(x, p), F.lit(1.0 / p))


def norm_lp_gradient(x: Column, p: float, norm: Column) -> Column:
    return F.when(norm > 0, F.signum(x) * F.pow(F.abs(x) / norm, F.lit(p - 1.0))).otherwise(0.0)


def normp(x: Column, p: float) -> Column:
    return F.sum(F.pow(F.abs(x), F.lit(float(p))))


def normp_gradient(x: Column, p: float) -> Column:
    return p * F.signum(x) * F.pow(F.abs(x), F.lit(p - 1.0))


def norm_linf(x: Column) -> Column:
    return F.max(F.abs(x))


def norm_huber(x: Column, delta: float) -> Column:
    """x^2 below delta, 2 delta |x| - delta^2 above; delta 0 is norm2."""
    if delta < 0:
        raise ValueError("delta is negative")
    if delta == 0:
        return norm2(x)
    return F.sum(F.when(F.abs(x) < delta, x * x).otherwise(2 * delta * F.abs(x) - delta * delta))


def norm_huber_gradient(x: Column, delta: float) -> Column:
    if delta < 0:
        raise ValueError("delta is negative")
    if delta == 0:
        return 2.0 * x
    return F.when(F.abs(x) < delta, 2.0 * x).otherwise(2.0 * delta * F.signum(x))


def histogram(df: DataFrame, bin: str, bins: int, mask: str | None = None) -> DataFrame:
    """(bin, n) for bins 1 to bins, empty ones with 0; values outside and masked ones don't count."""
    counted = df.select(unmasked(bin, mask).alias("bin")).filter(F.col("bin").between(1, bins)).groupBy("bin").count()
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def radial_profile(df: DataFrame, x: str, y: str, center: tuple[float, float], step: float, value: str, bins: int) -> DataFrame:
    """(bin, r, value, n): means of the distance from centre and of the value in rings of the width step.

    An empty ring has its middle as r and NaN as value. NaN values and what lies beyond the last ring don't count.
    """
    d = F.sqrt(F.pow(F.col(x) - center[0], 2) + F.pow(F.col(y) - center[1], 2))
    ring = df.filter(~F.isnan(value)).select(d.alias("d"), F.col(value).alias("v"), (F.floor(d / step) + 1).alias("bin")).filter(F.col("bin") <= bins)
    means = ring.groupBy("bin").agg(F.avg("d").alias("r"), F.avg("v").alias("value"), F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return every.join(means, "bin", "left").select("bin", F.coalesce("r", (F.col("bin") - 0.5) * step).alias("r"), F.coalesce("value", F.lit(NAN)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def sigma_clip(df: DataFrame, value: str, keys: list[str], nsigma: float, most: int = 0, mask: str | None = None) -> DataFrame:
    """df with the column `rejected`: values further than nsigma sample deviations from the mean, and masked ones.

    Passes go on until none more is rejected, or for `most` passes if that is positive. A group's statistics are small rows that
    are joined back; the state between passes is one boolean a row.
    """
    out = saved(df.withColumn("rejected", F.col(mask) if mask else F.lit(False)), "clip")
    before, passes = -1, 0
    while True:
        stats = out.groupBy(*keys).agg(F.avg(F.when(~F.col("rejected"), F.col(value))).alias("__m"), F.stddev_samp(F.when(~F.col("rejected"), F.col(value))).alias("__s"))
        far = F.coalesce(F.abs(F.col(value) - F.col("__m")) > nsigma * F.col("__s"), F.lit(False))
        joined = on_keys(out, stats, keys).select(*df.columns, (F.col("rejected") | far).alias("rejected"))
        out = saved(joined, "clip")
        now = out.filter("rejected").count()
        passes += 1
        if now == before or (most and passes >= most):
            return out
        before = now

