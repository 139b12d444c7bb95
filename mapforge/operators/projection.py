"""The pointing matrix as an edge table: rows (sample keys, k, pixel, weight) say what a sample sees of which pixel.

Projection is a join with the map and a sum for each sample; back-projection a sum for each pixel, which needs no join
when signal and matrix share a row. Sums combine on the map side before the shuffle, so a pixel that very many samples
see is no hot key; a map small enough is broadcast by the optimiser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import NAN

SAMPLE = ["det", "t"]


def project(matrix: DataFrame, sky: DataFrame, samples: DataFrame | None = None, sample: list[str] = SAMPLE, value: str = "value") -> DataFrame:
    """(sample, value): sums of weight * map; samples that see nothing of the map get 0 if `samples` names them."""
    out = matrix.join(sky.select("pixel", F.col(value).alias("__x")), "pixel").groupBy(*sample).agg(F.sum(F.col("weight").cast("double") * F.col("__x")).alias(value))
    if samples is None:
        return out
    return samples.select(*sample).join(out, sample, "left").select(*sample, F.coalesce(value, F.lit(0.0)).alias(value))


def back_project(matrix: DataFrame, tod: DataFrame, sample: list[str] = SAMPLE, value: str = "value") -> DataFrame:
    """(pixel, value): sums of weight * signal, the adjoint of project."""
    joined = matrix.join(tod.select(*sample, F.col(value).alias("__y")), sample)
    return joined.groupBy("pixel").agg(F.sum(F.col("weight").cast("double") * F.col("__y")).alias(value))


def back_project_weight(matrix: DataFrame, tod: DataFrame, sample: list[str] = SAMPLE, value: str = "value", mask: str | None = "masked") -> DataFrame:
    """(pixel, value, weight): sums of weight * signal and of weight in one pass, without masked samples."""
    good = tod.filter(~F.col(mask)) if mask else tod
    joined = matrix.join(good.select(*sample, F.col(value).alias("__y")), sample)
    w = F.col("weight").cast("double")
    return joined.groupBy("pixel").agg(F.sum(w * F.col("__y")).alias(value), F.sum(w).alias("weight"))


def normal_matrix(matrix: DataFrame, sample: list[str] = SAMPLE) -> DataFrame:
    """(i, j, value): P^T P, from pairs of entries of one sample; a sample has few of them, which one shuffle brings together."""
    entries = F.collect_list(F.struct(F.col("pixel").alias("p"), F.col("weight").cast("double").alias("w")))
    pair = lambda a, b: F.struct(a["p"].alias("i"), b["p"].alias("j"), (a["w"] * b["w"]).alias("w"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: pair(a, b))))
    each = matrix.groupBy(*sample).agg(entries.alias("e")).select(F.inline(pairs))
    return each.groupBy("i", "j").agg(F.sum("w").alias("value"))


def unobserved(matrix: DataFrame, npixels: int) -> DataFrame:
    """(pixel, masked): masked unless some entry of the pixel has a weight that is not 0."""
    seen = matrix.filter("weight <> 0").select("pixel").distinct().withColumn("__seen", F.lit(True))
    return matrix.sparkSession.range(npixels).select(F.col("id").cast("int").alias("pixel")).join(seen, "pixel", "left").select("pixel", F.col("__seen").isNull().alias("masked"))


def pack_pixels(matrix: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix with unmasked pixels renumbered from 0 in their order and other entries dropped, and (pixel, packed).

    Numbers come from counts before each block of pixels, so that no task sorts all of them.
    """
    block = 1 << 16
    kept = mask.filter("not masked").select("pixel", F.floor(F.col("pixel") / block).alias("__b"))
    counts = kept.groupBy("__b").count()
    firsts = counts.withColumn("__first", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 32,768 rows at most
    number = F.row_number().over(Window.partitionBy("__b").orderBy("pixel")) - 1
    table = kept.withColumn("__n", number).join(firsts, "__b").select("pixel", (F.col("__first") + F.col("__n")).cast("int").alias("packed"))
    packed = matrix.filter("weight <> 0").join(table, "pixel").select(*[F.col("packed").alias("pixel") if c == "pixel" else c for c in matrix.columns])
    return packed, table


def mask_samples(matrix: DataFrame, tod: DataFrame, sample: list[str] = SAMPLE, mask: str = "masked") -> DataFrame:
    """The matrix without masked samples."""
    return matrix.join(tod.filter(mask).select(*sample), sample, "left_anti")


def mini_maps(matrix: DataFrame, tod: DataFrame, frame: list[str] = ["t"], sample: list[str] = SAMPLE, value: str = "value", mask: str = "masked") -> DataFrame:
    """(frame, pixel, value, weight): weighted means of one frame's unmasked detectors; NaN where their weights add up to 0."""
    joined = matrix.join(tod.select(*sample, F.col(value).alias("__y"), F.col(mask).alias("__m")), sample)
    w = F.when(~F.col("__m"), F.col("weight").cast("double")).otherwise(0.0)
    sums = joined.groupBy(*frame, "pixel").agg(F.sum(F.when(~F.col("__m"), w * F.col("__y")).otherwise(0.0)).alias("__wy"), F.sum(w).alias("weight"))
    return sums.select(*frame, "pixel", F.when(F.col("weight") != 0, F.col("__wy") / F.col("weight")).otherwise(NAN).alias("value"), "weight")


def decimated(matrix: DataFrame, threshold: float) -> DataFrame:
    """(pixel, masked) by coverage: masked where the weights of a pixel add up to less than the threshold."""
    return matrix.groupBy("pixel").agg((F.sum(F.col("weight").cast("double")) < threshold).alias("masked"))
