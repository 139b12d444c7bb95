"""Instrument metadata: band and mode keywords, calibration products, flat fields, sample accounting."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pointing import COORDINATES
from .observation import PERIOD

#: Letters of the BAND column that belong to each band.
BAND_CODES = {"blue": ("BS",), "green": ("BL",), "red": ("R ", "R")}
FINE_FACTORS = (1, 2, 4, 8, 16, 32)


def band(header: Mapping[str, object]) -> str:
    """blue, green or red, from a camera's name and its filter."""
    camera = str(header.get("CAMNAME", header.get("CAMERA", ""))).lower()
    if "red" in camera:
        return "red"
    if "blue" not in camera:
        raise ValueError(f"unknown camera {camera!r}")
    kind = str(header.get("BLUE", header.get("FILTER", "blue1"))).lower()
    if kind in ("blue1", "blue70um", "blue"):
        return "blue"
    if kind in ("blue2", "green", "blue100um"):
        return "green"
    raise ValueError(f"unknown filter {kind!r}")


def invalid_band(df: DataFrame, band_: str, column: str = "band") -> DataFrame:
    """Adds to `invalid` the samples that another band's filter was in for."""
    ok = F.col(column).isin(*BAND_CODES[band_])
    had = F.col("invalid") if "invalid" in df.columns else F.lit(False)
    return df.withColumn("invalid", had | ~ok)


def compression_factor(algorithm: str) -> int:
    """The on-board compression factor that an algorithm's name ends with; anything else is an error."""
    text = algorithm.strip().lower()
    if text in ("none", ""):
        return 1
    m = re.search(r"(?:floating average|averaging)\D*(\d+)?", text)
    if not m:
        raise ValueError(f"unknown compression algorithm {algorithm!r}")
    return int(m[1] or 1)


def check_fine_sampling(factor: int) -> int:
    if factor not in FINE_FACTORS:
        raise ValueError(f"fine sampling factor {factor}; known: {FINE_FACTORS}")
    return factor


def fine_samples(slices: DataFrame, fine: int = 1) -> DataFrame:
    """Adds nfine: samples * compression factor * fine sampling factor of each slice."""
    check_fine_sampling(fine)
    return slices.withColumn("nfine", F.col("nsamples") * F.col("compression_factor") * fine)


def scan_speed(pointing: DataFrame, keys: list[str] = ["slice"]) -> DataFrame:
    """(keys, speed): lower median of in-scan speeds in arcsec a second, rounded to tenths."""
    w = Window.partitionBy(*keys).orderBy("t")
    dt = F.lead("time").over(w) - F.col("time")
    dr = (F.lead("ra").over(w) - F.col("ra")) * F.cos(F.radians("dec"))
    dd = F.lead("dec").over(w) - F.col("dec")
    v = F.when(dt > 0, 3600 * F.sqrt(dr * dr + dd * dd) / dt)
    out = pointing.withColumn("__v", F.when(F.col("info") == 1, v)).groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __v)").alias("speed"))
    return out.withColumn("speed", F.round("speed", 1))


def inside_box(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Coordinates outside their bounds become NaN."""
    return df.select(*[F.when(F.col(c).between(*bounds[c]), F.col(c)).otherwise(float("nan")).alias(c) if c in bounds else F.col(c) for c in df.columns])


def read_calibration(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A calibration product of a folder of parquet tables, one for each name; their column format_version must be the one asked for."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if version is not None and "format_version" in df.columns:
        seen = [r[0] for r in df.select("format_version").distinct().limit(2).collect()]
        if seen != [version]:
            raise ValueError(f"{name} has format versions {seen}, not {version}")
    return df.drop("format_version")


def flats(detectors: DataFrame, center: tuple[int, ...]) -> DataFrame:
    """Adds flat_optical, the area over the mean area of the detectors named (the central four), and flat_detector, the rest of flat_total."""
    mean = detectors.filter(F.col("det").isin(*center)).agg(F.avg("area").alias("__m"))
    out = detectors.crossJoin(F.broadcast(mean)).withColumn("flat_optical", F.col("area") / F.col("__m")).drop("__m")  # one row
    return out.withColumn("flat_detector", F.col("flat_total") / F.col("flat_optical")) if "flat_total" in out.columns else out


def corners_scaled(us: Column, u: Column, active: float, calibrated: float) -> Column:
    """Corner coordinates moved towards or from the centre, so that the area follows the active fraction."""
    k = math.sqrt(active / calibrated)
    return F.transform(us, lambda x: u + (x - u) * k)


def detector_stddev(curve: DataFrame, length: float) -> DataFrame:
    """(det, stddev): noise for a median filter's length, on a straight line between logarithms of a calibrated curve (det, length, stddev).

    Lengths beyond the curve's last take that one's value; NaN counts as infinite noise.
    """
    w = Window.partitionBy("det").orderBy("length")
    x = math.log(length)
    df = curve.withColumn("__l", F.lead("length").over(w)).withColumn("__s", F.lead("stddev").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    part = (F.lit(x) - F.log("length")) / (F.log("__l") - F.log("length"))
    hit = ((F.col("length") <= length) | F.col("__first")) & ((F.col("__l") > length) | F.col("__l").isNull())
    value = F.when(F.col("__l").isNull() | (F.col("length") > length), F.col("stddev")).otherwise(F.exp(F.log("stddev") + (F.log("__s") - F.log("stddev")) * part))
    return df.filter(hit).select("det", F.when(F.isnan(value), float("inf")).otherwise(value).alias("stddev"))


def widened(parts: list[DataFrame]) -> DataFrame:
    """Status tables of several files below each other; a column takes the widest of its types."""
    order = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string"]
    kinds: dict[str, str] = {}
    for p in parts:
        for name, kind in p.dtypes:
            if name not in kinds or (kind in order and kinds[name] in order and order.index(kind) > order.index(kinds[name])):
                kinds[name] = kind
    names = [c for c in parts[0].columns]
    for p in parts[1:]:
        if set(p.columns) != set(names):
            raise ValueError(f"columns differ: {sorted(set(p.columns) ^ set(names))}")
    out = None
    for p in parts:
        cast = p.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names])
        out = cast if out is None else out.unionByName(cast)
    return out


def status_of(pointing: DataFrame, factor: int = 4) -> DataFrame:
    """The status table that a simulated pointing would have: FINETIME in microseconds, building blocks of its phases, positions."""
    kind = F.when(F.col("info") == 1, 0xCD2).when(F.col("info") == 2, 0x4000).otherwise(0)
    return pointing.select(
        "slice", "t", F.shiftleft(kind.cast("long"), 16).alias("BBID"), F.round(F.col("time") * 1e6).cast("long").alias("FINETIME"),
        *[F.col(c).alias(n) for c, n in zip(COORDINATES, ("RaArray", "DecArray", "PaArray", "CHOPFPUANGLE"))], F.lit(factor * PERIOD).alias("interval"),
    )
