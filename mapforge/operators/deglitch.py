"""Glitch rejection on the map: samples of one pixel that stand out from the others mask all detectors that saw it then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import mad, sigma_clip
from .projection import SAMPLE, mini_maps
from .storage import saved

#: Frames that must see a pixel, and values that must be there, for it to be judged.
LEAST_HITS = 5


def glitches(matrix: DataFrame, tod: DataFrame, nsigma: float, method: str = "mad", frame: list[str] = ["t"], sample: list[str] = SAMPLE, value: str = "value", mask: str = "masked") -> DataFrame:
    """(frame, pixel) of mini-map values that stand out among those of their pixel.

    mad: further than nsigma * 1.4826 * MAD from the lower median; std: clipped at nsigma deviations until nothing changes.
    Hits count frames with masked samples as well; values are those of frames with unmasked ones.
    """
    maps = saved(mini_maps(matrix, tod, frame, sample, value, mask), "mini-maps")  # several passes read them
    hits = maps.groupBy("pixel").agg(F.count("*").alias("hits"), F.count_if(~F.isnan("value")).alias("values")).filter((F.col("hits") >= LEAST_HITS) & (F.col("values") >= LEAST_HITS))
    judged = maps.filter(~F.isnan("value")).join(hits.select("pixel"), "pixel").select(*frame, "pixel", "value")
    if method == "mad":
        stats = mad(judged, "value", ["pixel"])
        return judged.join(stats, "pixel").filter(F.abs(F.col("value") - F.col("median")) > nsigma * 1.4826 * F.col("mad")).select(*frame, "pixel")
    if method == "std":
        return sigma_clip(judged, "value", ["pixel"], nsigma).filter("rejected").select(*frame, "pixel")
    raise ValueError(f"unknown method {method!r}; known: mad, std")


def deglitch(matrix: DataFrame, tod: DataFrame, nsigma: float | None = None, method: str = "mad", frame: list[str] = ["t"], sample: list[str] = SAMPLE, value: str = "value", mask: str = "masked") -> DataFrame:
    """tod with a glitch's samples masked as well: those of its frame with an entry in its pixel. nsigma is 25 for mad and 5 for std unless given."""
    nsigma = nsigma if nsigma is not None else 25.0 if method == "mad" else 5.0
    bad = glitches(matrix, tod, nsigma, method, frame, sample, value, mask)
    hit = matrix.join(bad, [*frame, "pixel"], "left_semi").select(*sample).distinct().withColumn("__hit", F.lit(True))
    return tod.join(hit, sample, "left").withColumn(mask, F.col(mask) | F.coalesce("__hit", F.lit(False))).drop("__hit").select(*tod.columns)


def newly_masked(before: DataFrame, after: DataFrame, sample: list[str] = SAMPLE, mask: str = "masked") -> float:
    """Percentage of samples that were unmasked before and are masked after."""
    both = before.select(*sample, F.col(mask).alias("x")).join(after.select(*sample, F.col(mask).alias("y")), sample)
    row = both.agg(F.count_if(~F.col("x")), F.count_if(~F.col("x") & F.col("y"))).first()
    return 100.0 * row[1] / row[0] if row[0] else 0.0
