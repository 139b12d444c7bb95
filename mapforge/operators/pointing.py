"""From pointings and detectors to pointing matrices: interpolation in time, frames, corners, overlaps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.angles import barycenter_lonlat
from ..functions.wcs import Wcs, check_numbered, pixel_index, projection_scale, sky_to_pixel

COORDINATES = ["ra", "dec", "pa", "chop"]


def position_at(pointing: DataFrame, times: DataFrame, keys: list[str] = ["slice"], time: str = "time", columns: list[str] = COORDINATES, bucket: float = 64.0) -> DataFrame:
    """Pointings at other times by straight lines between samples; up to one step beyond either end, NaN further out.

    An as-of join without a range condition over all pairs: both sides are dealt by blocks of time, sorted within a
    block, and the bracket is carried along; the last sample before a block is repeated in it. A time on a sample lies in the
    bracket that begins there, so that each asked row, repeated ones too, comes out once.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    cols = [time, *columns]
    here = F.struct(*[F.col(c).cast("double").alias(c) for c in cols])
    p = pointing.select(*keys, here.alias("a"))
    wp = Window.partitionBy(*keys).orderBy("a." + time)
    p = p.withColumn("b", F.lead("a").over(wp)).withColumn("z", F.lag("a").over(wp))
    # A bracket [a, b] with its slope; the first reaches one step back, the last one step on.
    step = F.col("b")[time] - F.col("a")[time]
    first, last = F.col("z").isNull(), F.col("b").isNull()
    brackets = p.filter(~last).withColumn("low", F.when(first, F.col("a")[time] - step).otherwise(F.col("a")[time]))
    ending = p.filter(last & ~first).select(*keys, F.col("z").alias("a"), F.col("a").alias("b"), F.col("a")[time].alias("low"), (2 * F.col("a")[time] - F.col("z")[time]).alias("high"), F.lit(True).alias("closed"))
    brackets = brackets.select(*keys, "a", "b", "low", F.col("b")[time].alias("high"), F.lit(False).alias("closed")).union(ending)
    slots = brackets.select("*", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))).alias("__s"))
    asked = times.withColumn("__s", F.floor(F.col(time) / bucket))
    q, s = asked.alias("q"), slots.alias("s")
    inside = (F.col(f"q.{time}") >= F.col("s.low")) & ((F.col(f"q.{time}") < F.col("s.high")) | (F.col("s.closed") & (F.col(f"q.{time}") == F.col("s.high"))))
    on = [F.col(f"q.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("q.__s") == F.col("s.__s"), inside]
    joined = q.join(s, on, "left").select(*[F.col(f"q.{c}") for c in times.columns], F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    share = (F.col(time) - F.col("a")[time]) / (F.col("b")[time] - F.col("a")[time])
    lines = [F.coalesce(F.col("a")[c] + (F.col("b")[c] - F.col("a")[c]) * share, F.lit(float("nan"))).alias(c) for c in columns]
    return joined.select(*times.columns, *lines)


def position_fine(pointing: DataFrame, factor: int, keys: list[str] = ["slice"], order: str = "t", columns: list[str] = COORDINATES, offset: float = 0.0) -> DataFrame:
    """`factor` positions for each sample by straight lines to the next one; the last interval goes on. Adds fine, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = pointing
    for c in columns:
        df = df.withColumn(f"__d{c}", F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    fine = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    share = F.col("__i") / F.lit(float(factor)) - offset
    return fine.select(*keys, (F.col(order) * factor + F.col("__i")).alias("fine"), *[(F.col(c) + F.col(f"__d{c}") * share).alias(c) for c in columns])


def to_sky(u: Column, v: Column, ra: Column, dec: Column, pa_: Column, unit: float = 3600.0) -> tuple[Column, Column]:
    """Focal-plane offsets (arcsec unless unit is 1 for degrees) turned by the position angle and added to a pointing, for small angles."""
    c, s = F.cos(F.radians(pa_)), F.sin(F.radians(pa_))
    du, dv = u / unit, v / unit
    d = dec + (-du * s + dv * c)
    return ra + (du * c + dv * s) / F.cos(F.radians(dec)), d


def distorted(u: Column, v: Column, chop: Column, coefficients: np.ndarray) -> Column:
    """Sum of 27 terms c[i][j][k] u^i v^j chop^k with powers 0 to 2."""
    out = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            for k in range(3):
                c = float(coefficients[i][j][k])
                if c:
                    term = F.lit(c)
                    for x, p in ((u, i), (v, j), (chop, k)):
                        for _ in range(p):
                            term = term * x
                    out = out + term
    return out


def detector_grid(spark, rows: int, columns: int, size: float, fill: float = 1.0, flip_x: bool = False, flip_y: bool = False, angle: float = 0.0) -> DataFrame:
    """(det, row, column, u, v, us, vs): square detectors around the origin; centres and four corners counter-clockwise."""
    grid = spark.range(rows * columns).select(F.col("id").cast("int").alias("det"), F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).cast("int").alias("column"))
    sx, sy = (-1 if flip_x else 1), (-1 if flip_y else 1)
    x, y = (F.col("column") - (columns - 1) / 2) * size * sx, (F.col("row") - (rows - 1) / 2) * size * sy
    h, a = size * math.sqrt(fill) / 2, math.radians(angle)
    turn = lambda p, q: (p * math.cos(a) - q * math.sin(a), p * math.sin(a) + q * math.cos(a))
    corners = [turn(x + dx, y + dy) for dx, dy in ((h, h), (-h, h), (-h, -h), (h, -h))]
    u, v = turn(x, y)
    return grid.select("det", "row", "column", u.alias("u"), v.alias("v"), F.array(*[c[0] for c in corners]).alias("us"), F.array(*[c[1] for c in corners]).alias("vs"))


def _with_detectors(pointing: DataFrame, detectors: DataFrame, *columns: str) -> DataFrame:
    """Every pointing with every detector, a small fixed table of one camera that is broadcast.

    Pointings are dealt evenly first: a slice's rows may lie in one partition, and there are many detectors for each.
    """
    dealt = pointing.repartition(int(pointing.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.crossJoin(F.broadcast(detectors.select(*columns)))


def nearest_matrix(pointing: DataFrame, detectors: DataFrame, wcs: Wcs, keys: list[str] = ["slice", "t"]) -> DataFrame:
    """(keys, det, k, pixel, weight): the pixel under each detector's centre, weighted with its area times the projection's scale."""
    both = _with_detectors(pointing.select(*keys, "ra", "dec", "pa"), detectors, "det", "u", "v", "area")
    ra, dec = to_sky(F.col("u"), F.col("v"), F.col("ra"), F.col("dec"), F.col("pa"))
    both = both.select(*keys, "det", "area", ra.alias("ra"), dec.alias("dec"))
    # As a generator's output the coordinates are computed once: a filter on the pixel is not pushed below it, which
    # would put both of the long expressions into the filter again.
    at = both.select(*keys, "det", "area", F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip("xy", sky_to_pixel(wcs, F.col("ra"), F.col("dec")))]))))
    at = at.withColumn("pixel", pixel_index(wcs, F.col("x"), F.col("y")))
    weight = F.col("area") * projection_scale(wcs, F.col("x"), F.col("y"))
    return at.filter("pixel >= 0").select(*keys, "det", F.lit(0).alias("k"), "pixel", weight.cast("float").alias("weight"))


def sharp_matrix(pointing: DataFrame, detectors: DataFrame, wcs: Wcs, keys: list[str] = ["slice", "t"]) -> DataFrame:
    """(keys, det, k, pixel, weight, outside): overlaps of each detector's four projected corners with the pixels below."""
    both = _with_detectors(pointing.select(*keys, "ra", "dec", "pa"), detectors, "det", "us", "vs")
    corner = F.transform(F.arrays_zip("us", "vs"), lambda c: F.struct(*[x.alias(n) for n, x in zip("xy", sky_to_pixel(wcs, *to_sky(c["us"], c["vs"], F.col("ra"), F.col("dec"), F.col("pa"))))]))
    placed = both.select(*keys, "det", corner.alias("c")).select(*keys, "det", F.col("c.x").alias("xs"), F.col("c.y").alias("ys"))
    return overlap_matrix(placed, [*keys, "det"], wcs.naxis)


def overlap_matrix(polygons: DataFrame, keys: list[str], naxis: tuple[int, int]) -> DataFrame:
    """(keys, k, pixel, weight, outside) of polygons given as arrays xs and ys in 1-based pixel coordinates."""
    check_numbered(naxis)
    nx, ny = naxis
    kinds = ", ".join(f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                lists = part.column("xs"), part.column("ys")
                sizes = np.diff(np.asarray(lists[0].offsets))
                for corners in np.unique(sizes[sizes > 2]):
                    rows = np.flatnonzero(sizes == corners)
                    x, y = (np.stack([np.asarray(c[i].values, float) for i in rows]) if len(np.unique(sizes)) > 1 else np.asarray(c.flatten(), float).reshape(-1, corners) for c in lists)
                    fine = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
                    rows, x, y = rows[fine], x[fine], y[fine]
                    if not len(rows):
                        continue
                    who, pixels, areas, cut = geometry.overlaps_many(x, y, nx, ny)
                    first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
                    k = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
                    take = pa.array(rows[who])
                    cols = [pa.array(k.astype(np.int32)), pa.array(pixels.astype(np.int32)), pa.array(areas.astype(np.float32)), pa.array(cut[who])]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in keys), *cols], [*keys, "k", "pixel", "weight", "outside"])

    return polygons.select(*keys, "xs", "ys").mapInArrow(run, f"{kinds}, k int, pixel int, weight float, outside boolean")


def center(pointing: DataFrame) -> tuple[float, float]:
    """Barycentre of the pointings that are neither masked nor removed."""
    lon, lat = barycenter_lonlat(F.col("ra"), F.col("dec"))
    return tuple(pointing.filter("not masked and not removed").agg(lon, lat).first())


def map_header(pointing: DataFrame, detectors: DataFrame, step: float) -> Wcs:
    """A map of square pixels of `step` arcsec around the barycentre that holds every detector corner at every kept pointing.

    A long scan's header may have more pixels than can be numbered; the matrices then refuse it.
    """
    base = Wcs.square(center(pointing), step / 3600, (1, 1))
    corners = detectors.select(F.explode(F.arrays_zip("us", "vs")).alias("c")).select(F.col("c.us").alias("u"), F.col("c.vs").alias("v"))
    got = corners.toPandas()  # one camera's corners
    rim = got.iloc[geometry.hull(got["u"].to_numpy(), got["v"].to_numpy())]
    rim = pointing.sparkSession.createDataFrame(rim)
    both = pointing.filter("not removed").crossJoin(F.broadcast(rim))
    x, y = sky_to_pixel(base, *to_sky(F.col("u"), F.col("v"), F.col("ra"), F.col("dec"), F.col("pa")))
    x0, x1, y0, y1 = both.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    left, right, low, high = (math.floor(v + 0.5) for v in (x0, x1, y0, y1))
    return base.resized((right - left + 1, high - low + 1), (1 - left, 1 - low))


def scan(spark, center_: tuple[float, float], length: float, step: float, speed: float, interval: float, legs: int, turn: float = 0.0, slice_: int = 0) -> DataFrame:
    """A raster scan: legs of `length` degrees, `step` apart, back and forth, with `turn` seconds between; speed in degrees a second."""
    per_leg, per_turn = int(round(length / speed / interval)), int(round(turn / interval))
    per = per_leg + per_turn
    r = spark.range(legs * per).select(F.lit(slice_).alias("slice"), F.col("id").alias("t"), F.floor(F.col("id") / per).alias("leg"), (F.col("id") % per).alias("i"))
    on = F.col("i") < per_leg
    along = F.when(on, F.col("i") * (speed * interval) - length / 2).otherwise(length / 2)
    sign = F.when(F.col("leg") % 2 == 0, 1.0).otherwise(-1.0)
    up = (F.col("leg") - (legs - 1) / 2) * step + F.when(on, 0.0).otherwise((F.col("i") - per_leg + 1) / F.lit(float(per_turn + 1)) * step)
    return r.select("slice", "t", (F.col("t") * interval).alias("time"), (center_[0] + sign * along / math.cos(math.radians(center_[1]))).alias("ra"), (center_[1] + up).alias("dec"), F.lit(0.0).alias("pa"), F.lit(0.0).alias("chop"), F.when(on, 1).otherwise(2).alias("info"), F.lit(False).alias("masked"), F.lit(False).alias("removed"))


def gaussian(x: Column, y: Column, fwhm: float) -> Column:
    """A point's image of total 1."""
    s2 = (fwhm / math.sqrt(8 * math.log(2))) ** 2
    return F.exp(-(x * x + y * y) / (2 * s2)) / (2 * math.pi * s2)
