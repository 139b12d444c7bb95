"""Streams of samples: maps that grow, and compressed timelines, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def growing_map(samples: DataFrame) -> DataFrame:
    """(pixel, value, coverage) over a stream of (pixel, weight, value, masked): the naive map so far; output mode complete or update."""
    w = F.col("weight").cast("double")
    sums = samples.filter("not masked").groupBy("pixel").agg(F.sum(w * F.col("value")).alias("wy"), F.sum(w).alias("coverage"))
    return sums.select("pixel", F.when(F.col("coverage") != 0, F.col("wy") / F.col("coverage")).alias("value"), "coverage")


def compressed(samples: DataFrame, time: str, seconds: float, late: str = "10 seconds") -> DataFrame:
    """(det, start, value, n): means of a stream's unmasked samples over tumbling windows; samples later than `late` are left out."""
    window = F.window(time, f"{int(seconds * 1e6)} microseconds")
    kept = samples.withWatermark(time, late).filter("not masked")
    return kept.groupBy("det", window.alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("det", F.col("w.start").alias("start"), "value", "n")
