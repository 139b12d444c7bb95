"""One query for each operator, on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import solvers
from ..functions import angles, equality, geometry, numeric, rounding, strings, units, wcs
from ..operators import aggregates, deglitch, masks, order, pointing, projection, timeline
from ..operators.algebra import Diagonal, Difference, Identity, Mask, Projection
from ..operators.storage import saved
from ..sources import instrument
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

A = f"WITH a AS ({T.TOD})"
S = f"WITH s AS ({T.SAMPLES})"
M = f"{S}, m AS ({T.MATRIX})"
W = "OVER (PARTITION BY det ORDER BY t)"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def r(c, digits: int = 4):
    """Rounded, since sums of doubles depend on their order."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# Pointing matrix and maps


@query(f"""{M} SELECT pixel, round(sum(CASE WHEN NOT masked THEN weight::DOUBLE * value END) / sum(CASE WHEN NOT masked THEN weight::DOUBLE END), 4) AS value,
    round(sum(CASE WHEN NOT masked THEN weight::DOUBLE END), 4) AS coverage FROM m JOIN s USING (det, t) WHERE NOT masked GROUP BY pixel""")
def map_naive(spark, d):
    out = solvers.mapper_naive(T.matrix(spark, d), T.samples(spark, d))
    return out.select("pixel", r("value").alias("value"), r("coverage").alias("coverage"))


@query(f"{M}, x AS ({T.SKY}) SELECT det, t, round(coalesce(sum(weight::DOUBLE * x.value), 0), 4) AS value FROM m LEFT JOIN x USING (pixel) GROUP BY det, t")
def projection_direct(spark, d):
    m = T.matrix(spark, d)
    return projection.project(m, T.sky(spark, d), T.samples(spark, d)).select("det", "t", r("value").alias("value"))


@query(f"{M} SELECT pixel, round(sum(weight::DOUBLE * value), 2) AS value FROM m JOIN s USING (det, t) GROUP BY pixel")
def projection_transpose(spark, d):
    return projection.back_project(T.matrix(spark, d), T.samples(spark, d)).select("pixel", r("value", 2).alias("value"))


@query(f"{M} SELECT pixel, round(sum(weight::DOUBLE * value), 2) AS value, round(sum(weight::DOUBLE), 4) AS weight FROM m JOIN s USING (det, t) WHERE NOT masked GROUP BY pixel")
def backprojection_weight(spark, d):
    return projection.back_project_weight(T.matrix(spark, d), T.samples(spark, d)).select("pixel", r("value", 2).alias("value"), r("weight").alias("weight"))


@query(f"{M} SELECT a.pixel AS i, b.pixel AS j, round(sum(a.weight::DOUBLE * b.weight::DOUBLE), 3) AS value FROM m a JOIN m b USING (det, t) GROUP BY 1, 2")
def normal_matrix(spark, d):
    return projection.normal_matrix(T.matrix(spark, d)).select("i", "j", r("value", 3).alias("value"))


_WIDE = f"m2 AS (SELECT * REPLACE (pixel * 3 AS pixel) FROM m), g AS (SELECT p::INT AS p FROM range({3 * T.PIXELS}) g(p))"


def _wide(spark, d):
    """The matrix on a map with three times as many pixels, of which it reaches each third one: the others are unobserved."""
    return T.matrix(spark, d).withColumn("pixel", F.col("pixel") * 3)


@query(f"{M}, {_WIDE} SELECT p AS pixel, NOT EXISTS (SELECT 1 FROM m2 WHERE m2.pixel = p AND weight <> 0) AS masked FROM g")
def pmatrix_get_mask(spark, d):
    return projection.unobserved(_wide(spark, d), 3 * T.PIXELS)


@query(f"""{M}, {_WIDE}, seen AS (SELECT DISTINCT pixel FROM m2 WHERE weight <> 0), num AS (SELECT pixel, (row_number() OVER (ORDER BY pixel) - 1)::INT AS packed FROM seen)
    SELECT det, t, k, packed AS pixel, round(weight::DOUBLE, 4) AS weight FROM m2 JOIN num USING (pixel) WHERE weight <> 0""")
def pmatrix_pack(spark, d):
    m = _wide(spark, d)
    packed, _ = projection.pack_pixels(m, projection.unobserved(m, 3 * T.PIXELS))
    return packed.select("det", "t", "k", "pixel", r(F.col("weight").cast("double")).alias("weight"))


@query(f"{M} SELECT m.det, m.t, k, pixel, round(weight::DOUBLE, 4) AS weight FROM m JOIN s USING (det, t) WHERE NOT masked")
def pmatrix_mask_samples(spark, d):
    return projection.mask_samples(T.matrix(spark, d), T.samples(spark, d)).select("det", "t", "k", "pixel", r(F.col("weight").cast("double")).alias("weight"))


_MINI = f"""{M}, mm AS MATERIALIZED (SELECT t, pixel, sum(CASE WHEN NOT masked THEN weight::DOUBLE * value ELSE 0 END) AS wy, sum(CASE WHEN NOT masked THEN weight::DOUBLE ELSE 0 END) AS weight FROM m JOIN s USING (det, t) GROUP BY t, pixel)"""


@query(f"{_MINI} SELECT t, pixel, round(CASE WHEN weight <> 0 THEN wy / weight END, 4) AS value, round(weight, 4) AS weight FROM mm")
def mini_maps(spark, d):
    out = projection.mini_maps(T.matrix(spark, d), T.samples(spark, d))
    return out.select("t", "pixel", r(F.nanvl("value", F.lit(None))).alias("value"), r("weight").alias("weight"))


@query(f"{M} SELECT pixel, sum(weight::DOUBLE) < 8000 AS masked FROM m GROUP BY pixel")
def map_mask(spark, d):
    return projection.decimated(T.matrix(spark, d), 8000.0)


@query(f"""{_MINI}, h AS (SELECT pixel FROM mm GROUP BY pixel HAVING count(*) >= 5 AND count(CASE WHEN weight <> 0 THEN 1 END) >= 5),
    j AS MATERIALIZED (SELECT t, pixel, wy / weight AS v FROM mm JOIN h USING (pixel) WHERE weight <> 0),
    c AS (SELECT pixel, quantile_disc(v, 0.5) AS med FROM j GROUP BY pixel), e AS (SELECT pixel, quantile_disc(abs(v - med), 0.5) AS mad FROM j JOIN c USING (pixel) GROUP BY pixel),
    bad AS (SELECT t, pixel FROM j JOIN c USING (pixel) JOIN e USING (pixel) WHERE abs(v - med) > 2 * 1.4826 * mad),
    hit AS (SELECT DISTINCT det, t FROM m JOIN bad USING (t, pixel)) SELECT s.det, s.t, masked OR hit.det IS NOT NULL AS masked FROM s LEFT JOIN hit ON s.det = hit.det AND s.t = hit.t""")
def deglitch_mad(spark, d):
    return deglitch.deglitch(T.matrix(spark, d), T.samples(spark, d).select("det", "t", "value", "masked"), 2.0, "mad").select("det", "t", "masked")


#: Passes of clipping that the SQL writes out; those after the last rejection change nothing.
_CLIPS = 12
_CLIP = ",\n    ".join(
    f"k{i} AS MATERIALIZED (SELECT t, pixel, v, keep AND NOT coalesce(abs(v - m) > 3 * s, false) AS keep FROM k{i - 1} JOIN (SELECT pixel, avg(v) AS m, stddev_samp(v) AS s FROM k{i - 1} WHERE keep GROUP BY pixel) USING (pixel))"
    for i in range(1, _CLIPS + 1)
)


@query(f"""{_MINI}, h AS (SELECT pixel FROM mm GROUP BY pixel HAVING count(*) >= 5 AND count(CASE WHEN weight <> 0 THEN 1 END) >= 5),
    j AS MATERIALIZED (SELECT t, pixel, wy / weight AS v FROM mm JOIN h USING (pixel) WHERE weight <> 0), k0 AS (SELECT *, true AS keep FROM j),
    {_CLIP},
    hit AS (SELECT DISTINCT det, t FROM m JOIN k{_CLIPS} USING (t, pixel) WHERE NOT keep) SELECT s.det, s.t, masked OR hit.det IS NOT NULL AS masked FROM s LEFT JOIN hit ON s.det = hit.det AND s.t = hit.t""")
def deglitch_std(spark, d):
    return deglitch.deglitch(T.matrix(spark, d), T.samples(spark, d).select("det", "t", "value", "masked"), 3.0, "std").select("det", "t", "masked")


@query(f"""{A}, one AS (SELECT det, avg(value) AS m, stddev_samp(value) AS s FROM a WHERE NOT masked GROUP BY det)
    SELECT a.det, a.t, masked OR coalesce(abs(value - m) > 1.5 * s, false) AS rejected FROM a LEFT JOIN one USING (det)""")
def sigma_clipping(spark, d):
    return aggregates.sigma_clip(T.tod(spark, d), "value", ["det"], 1.5, 1, "masked").select("det", "t", "rejected")


# Statistics


@query(f"""{A}, v AS (SELECT det, value AS x FROM a WHERE NOT masked), m AS (SELECT det, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM v GROUP BY det HAVING count(*) > 3)
    SELECT det, any_value(n) AS n, round(any_value(mu), 6) AS mean, round(any_value(sd) * any_value(sd), 6) AS variance, round(sum(power(x - mu, 3)) / (any_value(n) * power(any_value(sd), 3)), 6) AS skewness,
    round(sum(power(x - mu, 4)) / (any_value(n) * power(any_value(sd), 4)) - 3, 6) AS kurtosis, round(any_value(sd), 6) AS stddev, round(avg(abs(x - mu)), 6) AS meandev FROM v JOIN m USING (det) GROUP BY det""")
def moment(spark, d):
    out = aggregates.moments(T.tod(spark, d), "value", ["det"], "masked")
    return out.select("det", "n", *[r(c, 6).alias(c) for c in ("mean", "variance", "skewness", "kurtosis", "stddev", "meandev")])


@query(f"{A} SELECT det, quantile_disc(value, 0.5) FILTER (NOT masked) AS median FROM a GROUP BY det")
def median(spark, d):
    return aggregates.median(T.tod(spark, d), "value", ["det"], mask="masked")


@query(f"{A}, m AS (SELECT det, quantile_disc(value, 0.5) AS median FROM a GROUP BY det) SELECT det, any_value(median) AS median, round(quantile_disc(abs(value - median), 0.5), 6) AS mad FROM a JOIN m USING (det) GROUP BY det")
def mad(spark, d):
    return aggregates.mad(T.tod(spark, d), "value", ["det"]).select("det", "median", r("mad", 6).alias("mad"))


@query(f"{A} SELECT det, round(sum(value), 4) AS total FROM a GROUP BY det")
def sum_exact(spark, d):
    return T.tod(spark, d).groupBy("det").agg(r(aggregates.exact_sum(F.col("value"))).alias("total"))


_V = f"WITH v AS ({T.VECTORS})"


@query(f"""{_V} SELECT label, round(sum(abs(x)), 6) AS l1, round(sqrt(sum(x * x)), 6) AS l2, round(sum(x * x), 6) AS n2, round(power(sum(power(abs(x), 3)), 1 / 3.0::DOUBLE), 6) AS lp, round(sum(power(abs(x), 3)), 6) AS np,
    round(max(abs(x)), 6) AS linf, round(sum(CASE WHEN abs(x) < 0.1 THEN x * x ELSE 0.2 * abs(x) - 0.01 END), 6) AS huber FROM v GROUP BY label""")
def norms(spark, d):
    x = F.col("x")
    parts = {"l1": aggregates.norm_l1(x), "l2": aggregates.norm_l2(x), "n2": aggregates.norm2(x), "lp": aggregates.norm_lp(x, 3), "np": aggregates.normp(x, 3), "linf": aggregates.norm_linf(x), "huber": aggregates.norm_huber(x, 0.1)}
    return T.vectors(spark, d).groupBy("label").agg(*[r(c, 6).alias(n) for n, c in parts.items()])


@query(f"""{_V}, n AS (SELECT label, sqrt(sum(x * x)) AS l2, power(sum(power(abs(x), 3)), 1 / 3.0::DOUBLE) AS lp FROM v GROUP BY label)
    SELECT vec_id, i::INT AS i, CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g1, round(x / l2, 6) AS g2, round(2 * x, 6) AS gn2, round(sign(x) * power(abs(x) / lp, 2), 6) AS glp, round(3 * sign(x) * power(abs(x), 2), 6) AS gnp,
    round(CASE WHEN abs(x) < 0.1 THEN 2 * x ELSE 0.2 * sign(x) END, 6) AS gh FROM v JOIN n USING (label)""")
def norm_gradients(spark, d):
    v, x = T.vectors(spark, d), F.col("x")
    n = v.groupBy("label").agg(aggregates.norm_l2(x).alias("l2"), aggregates.norm_lp(x, 3).alias("lp"))
    g = {"g2": aggregates.norm_l2_gradient(x, F.col("l2")), "gn2": aggregates.norm2_gradient(x), "glp": aggregates.norm_lp_gradient(x, 3, F.col("lp")), "gnp": aggregates.normp_gradient(x, 3), "gh": aggregates.norm_huber_gradient(x, 0.1)}
    return v.join(n, "label").select("vec_id", "i", aggregates.norm_l1_gradient(x).alias("g1"), *[r(c, 6).alias(k) for k, c in g.items()])


@query(f"{_V} SELECT a.label, round(sum(a.x * b.x), 5) AS dot FROM v a JOIN v b ON a.i = b.i AND a.vec_id + 1 = b.vec_id GROUP BY 1")
def dot(spark, d):
    v = T.vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("y"))
    return v.join(b, ["vec_id", "i"]).groupBy("label").agg(r(aggregates.dot(F.col("x"), F.col("y")), 5).alias("dot"))


@query(f"{A}, h AS (SELECT floor(value / 10)::BIGINT + 1 AS bin FROM a WHERE NOT masked) SELECT g.bin, count(h.bin) AS n FROM range(1, 31) g(bin) LEFT JOIN h USING (bin) GROUP BY 1")
def histogram(spark, d):
    t = T.tod(spark, d).withColumn("bin", (F.floor(F.col("value") / 10) + 1).cast("long"))
    return aggregates.histogram(t, "bin", 30, "masked")


@query(f"""WITH p AS ({T.POSITIONS}), q AS (SELECT sqrt(power(ra - 30.3, 2) + power(dec - 20, 2)) AS d, id::DOUBLE AS v FROM p), b AS (SELECT floor(d / 0.05)::BIGINT + 1 AS bin, d, v FROM q)
    SELECT g.bin, round(coalesce(avg(d), (g.bin - 0.5) * 0.05), 6) AS r, round(avg(v), 6) AS value, count(v) AS n FROM range(1, 25) g(bin) LEFT JOIN b USING (bin) GROUP BY g.bin""")
def radial_profile(spark, d):
    p = T.positions(spark, d).withColumn("v", F.col("id").cast("double"))
    out = aggregates.radial_profile(p, "ra", "dec", (30.3, 20.0), 0.05, "v", 24)
    return out.select("bin", r("r", 6).alias("r"), r(F.nanvl("value", F.lit(None)), 6).alias("value"), "n")


_DEG = "WITH c AS (SELECT s_nationkey AS zone, (s_acctbal - 360 * floor(s_acctbal / 360)) AS v FROM supplier), f AS (SELECT zone, min(v) < 180 AND max(v) >= 180 AS b FROM c GROUP BY zone), w AS (SELECT zone, b, v, CASE WHEN v >= 180 THEN v - 360 ELSE v END AS x FROM c JOIN f USING (zone))"


@query(f"""{_DEG}, m AS (SELECT zone, CASE WHEN any_value(b) THEN avg(x) ELSE avg(v) END AS mean, CASE WHEN any_value(b) THEN min(x) ELSE min(v) END AS low, CASE WHEN any_value(b) THEN max(x) ELSE max(v) END AS high FROM w GROUP BY zone)
    SELECT zone, round(mean - 360 * floor(mean / 360), 5) AS mean, round(low - 360 * floor(low / 360), 5) AS low, round(high - 360 * floor(high / 360), 5) AS high FROM m""")
def degrees(spark, d):
    x = F.col("s_acctbal")
    low, high = angles.minmax_degrees(x)
    return T.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(r(angles.mean_degrees(x), 5).alias("mean"), r(low, 5).alias("low"), r(high, 5).alias("high"))


@query(f"""WITH p AS ({T.POSITIONS}), s AS (SELECT zone, sum(cos(radians(dec)) * cos(radians(ra))) AS x, sum(cos(radians(dec)) * sin(radians(ra))) AS y, sum(sin(radians(dec))) AS z FROM p GROUP BY zone)
    SELECT zone, round(degrees(atan2(y, x)), 7) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 7) AS lat FROM s""")
def barycenter_lonlat(spark, d):
    lon, lat = angles.barycenter_lonlat(F.col("ra"), F.col("dec"))
    return T.positions(spark, d).groupBy("zone").agg(r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


@query(f"{A} SELECT det, min(CASE WHEN t % 3 <> 0 THEN value END) AS low, max(CASE WHEN t % 3 <> 0 THEN value END) AS high FROM a GROUP BY det HAVING count(CASE WHEN t % 3 <> 0 THEN value END) > 0")
def minmax(spark, d):
    low, high = aggregates.minmax(F.when(F.col("t") % 3 == 0, numeric.NAN).otherwise(F.col("value")))
    return T.tod(spark, d).groupBy("det").agg(low.alias("low"), high.alias("high")).filter("not isnan(low)")


# Timelines


def _tod(spark, d):
    return T.tod(spark, d).select("det", "t", "value")


def _out(df, digits: int = 6):
    return df.select("det", "t", r("value", digits).alias("value"))


@query(f"{A} SELECT det, (t // 4)::BIGINT AS t, round(sum(value) / 4, 6) AS value FROM a GROUP BY 1, 2")
def compression_average(spark, d):
    return _out(timeline.average(_tod(spark, d), ["det"], "t", "value", 4))


@query(f"{A} SELECT det, t * 4 + k AS t, round(value / 4, 6) AS value FROM a, range(4) g(k)")
def compression_average_adjoint(spark, d):
    return _out(timeline.average_adjoint(_tod(spark, d), ["det"], "t", "value", 4))


@query(f"{A} SELECT det, (t // 4)::BIGINT AS t, value FROM a WHERE t % 4 = 0")
def downsampling(spark, d):
    return timeline.downsample(_tod(spark, d), ["det"], "t", "value", 4)


@query(f"{A} SELECT det, t * 4 + k AS t, CASE WHEN k = 0 THEN value ELSE 0 END AS value FROM a, range(4) g(k)")
def downsampling_adjoint(spark, d):
    return timeline.downsample_adjoint(_tod(spark, d), ["det"], "t", "value", 4)


@query(f"{A} SELECT det, t, round(coalesce(value - lead(value) {W}, 0), 6) AS value FROM a")
def diff(spark, d):
    return _out(timeline.diff(_tod(spark, d), ["det"], "t", "value"))


@query(f"""{A}, b AS (SELECT det, t, value AS x, lag(value) {W} AS p, lead(value) {W} AS n FROM a)
    SELECT det, t, round(CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN x WHEN n IS NULL THEN -p ELSE x - p END, 6) AS value FROM b""")
def diff_transpose(spark, d):
    return _out(timeline.diff_adjoint(_tod(spark, d), ["det"], "t", "value"))


@query(f"{A} SELECT det, t, round(0.5 * (coalesce(value - lag(value) {W}, 0) + coalesce(value - lead(value) {W}, 0)), 6) AS value FROM a")
def diff_normal(spark, d):
    one = Difference(["det"], "t")
    return _out(((one.T @ one) * 0.5)(_tod(spark, d)))


@query(f"{A} SELECT det, t, coalesce(lag(value, 3) {W}, 0) AS value FROM a")
def shift(spark, d):
    return timeline.shift(_tod(spark, d), ["det"], "t", "value", 3)


@query(f"{A} SELECT a.det, a.t, coalesce(b.value, 0) AS value FROM a LEFT JOIN a b ON a.det = b.det AND b.t = a.t - (a.det % 5 - 2)")
def shift_offsets(spark, d):
    t = _tod(spark, d).withColumn("n", F.col("det") % 5 - 2)
    return timeline.shift_by(t, ["det"], "t", "value", "n").drop("n")


@query(f"{A} SELECT det, t + 2 AS t, value FROM a UNION ALL SELECT det, k, 0 FROM (SELECT DISTINCT det FROM a), range(2) g(k) UNION ALL SELECT det, n + 2 + k, 0 FROM (SELECT det, count(*) AS n FROM a GROUP BY det), range(5) g(k)")
def pad(spark, d):
    return timeline.pad(_tod(spark, d), ["det"], "t", "value", 2, 5)


@query(f"{A} SELECT det, t - 2 AS t, value FROM (SELECT *, count(*) OVER (PARTITION BY det) AS n FROM a) WHERE t >= 2 AND t < n - 5")
def pad_adjoint(spark, d):
    return timeline.trim(_tod(spark, d), ["det"], "t", "value", 2, 5)


@query(f"{A} SELECT det, row_number() {W} - 1 AS t, value FROM a WHERE NOT masked")
def pack(spark, d):
    return timeline.pack(T.tod(spark, d), ["det"], "t", "value", "masked")


@query(f"{A} SELECT det, t, CASE WHEN masked THEN 0 ELSE value END AS value FROM a")
def pack_unpack(spark, d):
    t = T.tod(spark, d)
    return timeline.unpack(timeline.pack(t, ["det"], "t", "value", "masked"), t, ["det"], "t", "value", "masked")


_NEAR = """{A}, n AS (SELECT *, last_value(CASE WHEN NOT masked THEN t END IGNORE NULLS) OVER (PARTITION BY det ORDER BY t) AS lt, last_value(CASE WHEN NOT masked THEN value END IGNORE NULLS) OVER (PARTITION BY det ORDER BY t) AS lv,
    first_value(CASE WHEN NOT masked THEN t END IGNORE NULLS) OVER (PARTITION BY det ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rt,
    first_value(CASE WHEN NOT masked THEN value END IGNORE NULLS) OVER (PARTITION BY det ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv FROM a)""".replace("{A}", A)


@query(f"{_NEAR} SELECT det, t, round(CASE WHEN NOT masked THEN value WHEN lt IS NOT NULL AND rt IS NOT NULL THEN lv + (rv - lv) * (t - lt) / (rt - lt) ELSE coalesce(lv, rv, value) END, 6) AS value FROM n")
def interpolate_linear(spark, d):
    return _out(timeline.interpolate_clamped(T.tod(spark, d), ["det"], "t", "value", "masked"))


@query(f"""{_NEAR}, g AS (SELECT det, t, value, row_number() {W} AS i, count(*) OVER (PARTITION BY det) AS c FROM a WHERE NOT masked),
    e AS (SELECT det, any_value(c) AS c, max(CASE WHEN i = 1 THEN t END) AS t1, max(CASE WHEN i = 1 THEN value END) AS v1, max(CASE WHEN i = 2 THEN t END) AS t2, max(CASE WHEN i = 2 THEN value END) AS v2,
      max(CASE WHEN i = c - 1 THEN t END) AS t3, max(CASE WHEN i = c - 1 THEN value END) AS v3, max(CASE WHEN i = c THEN t END) AS t4, max(CASE WHEN i = c THEN value END) AS v4 FROM g GROUP BY det)
    SELECT det, t, round(CASE WHEN NOT masked THEN value WHEN lt IS NOT NULL AND rt IS NOT NULL THEN lv + (rv - lv) * (t - lt) / (rt - lt) WHEN c = 1 THEN v1
      WHEN lt IS NULL THEN v1 + (v2 - v1) * (t - t1) / (t2 - t1) ELSE v3 + (v4 - v3) * (t - t3) / (t4 - t3) END, 6) AS value FROM n JOIN e USING (det)""")
def interpolate_nan(spark, d):
    t = T.tod(spark, d).withColumn("value", F.when(F.col("masked"), numeric.NAN).otherwise(F.col("value")))
    out = timeline.interpolate_extrapolated(t, ["det"], "t", "value")
    return _out(out.filter("not isnan(value)"))


@query(f"{A} SELECT det, t, round(value - coalesce(avg(CASE WHEN NOT masked THEN value END) OVER (PARTITION BY det), 0), 6) AS value FROM a")
def subtract_mean(spark, d):
    return _out(timeline.subtract_mean(T.tod(spark, d), ["det"], "value", "masked"))


_LINE = f"{A}, f AS (SELECT det, regr_slope(value, t) AS b, regr_intercept(value, t) AS c FROM a WHERE NOT masked GROUP BY det HAVING count(*) > 1) SELECT det, t, round(value - c - b * t, 5) AS value FROM a JOIN f USING (det)"


@query(_LINE)
def filter_line(spark, d):
    return _out(timeline.filter_line(T.tod(spark, d), ["det"], "t", "value", "masked"), 5)


@query(_LINE)
def filter_polynomial(spark, d):
    return _out(timeline.filter_polynomial(T.tod(spark, d), ["det"], "t", "value", 1, "masked"), 5)


# Orthogonal polynomials over the unmasked samples, one after the other; detectors with too few samples for a degree lack it.
@query(f"""{A}, u AS (SELECT det, t, value, masked, (t - mt) / n AS x FROM a JOIN (SELECT det, avg(t) AS mt, count(*)::DOUBLE AS n FROM a WHERE NOT masked GROUP BY det) USING (det)),
    q2 AS (SELECT det, count(*) AS k, avg(x * x) AS a0, sum(x * x * x) / sum(x * x) AS a1 FROM u WHERE NOT masked GROUP BY det), v AS (SELECT u.*, k, CASE WHEN k > 2 THEN x * x - a0 - a1 * x ELSE 0 END AS p2 FROM u JOIN q2 USING (det)),
    q3 AS (SELECT det, avg(x * x * x) AS b0, sum(x * x * x * x) / sum(x * x) AS b1, sum(x * x * x * p2) / sum(p2 * p2) AS b2 FROM v WHERE NOT masked GROUP BY det),
    w AS (SELECT v.*, CASE WHEN k > 3 THEN x * x * x - b0 - b1 * x - b2 * p2 ELSE 0 END AS p3 FROM v JOIN q3 USING (det)),
    c AS (SELECT det, avg(value) AS c0, sum(value * x) / sum(x * x) AS c1, sum(value * p2) / sum(p2 * p2) AS c2, sum(value * p3) / sum(p3 * p3) AS c3 FROM w WHERE NOT masked GROUP BY det)
    SELECT a.det, a.t, round(CASE WHEN c0 IS NULL THEN a.value ELSE a.value - c0 - CASE WHEN k > 1 THEN c1 * x ELSE 0 END - CASE WHEN k > 2 THEN c2 * p2 ELSE 0 END - CASE WHEN k > 3 THEN c3 * p3 ELSE 0 END END, 5) AS value
    FROM a LEFT JOIN w ON a.det = w.det AND a.t = w.t LEFT JOIN c ON a.det = c.det""")
def filter_polynomial_cubic(spark, d):
    return _out(timeline.filter_polynomial(T.tod(spark, d), ["det"], "t", "value", 3, "masked"), 5)


_MED = f"""{A}, n AS (SELECT *, count(*) OVER (PARTITION BY det) AS n FROM a), w AS (SELECT det, t, value, n, quantile_disc(value, 0.5) OVER (PARTITION BY det ORDER BY t ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS m,
    quantile_disc(value, 0.5) OVER (PARTITION BY det) AS g FROM n) SELECT det, t, round(value - CASE WHEN n <= 8 THEN g ELSE m END, 6) AS value FROM w"""


@query(_MED)
def filter_median(spark, d):
    return _out(timeline.filter_median(_tod(spark, d), ["det"], "t", "value", 8))


@query(_MED)
def filter_median_window(spark, d):
    return _out(timeline.filter_median_window(_tod(spark, d), ["det"], "t", "value", 8))


@query(f"{A}, w AS (SELECT a.det, a.t, sum(CASE WHEN b.t = 0 THEN exp(-(a.t - b.t) / 2.0::DOUBLE) ELSE exp(-(a.t - b.t) / 2.0::DOUBLE) * (1 - exp(-0.5::DOUBLE)) END * b.value) AS v FROM a JOIN a b ON a.det = b.det AND b.t <= a.t AND b.t > a.t - 100 GROUP BY 1, 2) SELECT det, t, round(v, 6) AS value FROM w")
def exponential_response(spark, d):
    return _out(timeline.exponential_response(_tod(spark, d), ["det"], "t", "value", 2.0))


@query(f"{A} SELECT a.det, a.t, round(sum(CASE WHEN a.t = 0 THEN exp(-(b.t - a.t) / 2.0::DOUBLE) ELSE exp(-(b.t - a.t) / 2.0::DOUBLE) * (1 - exp(-0.5::DOUBLE)) END * b.value), 6) AS value FROM a JOIN a b ON a.det = b.det AND b.t >= a.t AND b.t < a.t + 100 GROUP BY 1, 2")
def exponential_response_adjoint(spark, d):
    return _out(timeline.exponential_response(_tod(spark, d), ["det"], "t", "value", 2.0, adjoint=True))


@query(f"{A} SELECT det, t, value FROM a", name="fft_round_trip")
def fft_round_trip(spark, d):
    there = timeline.fft_half_complex(_tod(spark, d), ["det"], "t", "value")
    return timeline.fft_half_complex(there, ["det"], "t", "value", inverse=True).select("det", "t", r("value", 2).alias("value"))


@query(f"""{A}, n AS (SELECT det, count(*) AS n FROM a GROUP BY det), k AS (SELECT det, n, j, least(j, n - j) AS f FROM n, LATERAL (SELECT unnest(range(n)) AS j))
    SELECT k.det, k.j AS t, round(sum(CASE WHEN k.j <= n // 2 THEN value * cos(2 * pi() * ((f * t) % n) / n) ELSE -value * sin(2 * pi() * ((f * t) % n) / n) END), 4) AS value FROM k JOIN a ON a.det = k.det GROUP BY 1, 2""")
def fft_half_complex(spark, d):
    return _out(timeline.fft_half_complex(_tod(spark, d), ["det"], "t", "value"), 4)


# The filter's spectrum, 0.6 - 0.4 cos w - 0.1 cos 2w, is positive and has its top, 0.9, at w = pi, which all spectra have.
@query(f"""{A} SELECT det, t, round((0.6::DOUBLE * value - 0.2::DOUBLE * (coalesce(lag(value) {W}, 0) + coalesce(lead(value) {W}, 0)) - 0.05::DOUBLE * (coalesce(lag(value, 2) {W}, 0) + coalesce(lead(value, 2) {W}, 0))) / 0.9::DOUBLE, 6) AS value FROM a""")
def inverse_noise(spark, d):
    t = _tod(spark, d)
    filters = t.select("det").distinct().select("det", F.array(*[F.lit(x) for x in (0.6, -0.2, -0.05)]).alias("coef"))
    return _out(timeline.inverse_noise(t, filters, ["det"], "t", "value"))


@query(f"""{A}, c AS (SELECT det, t, value, coalesce(lead(value) {W}, value) AS nx, floor((det % 16) * 4 / 16.0::DOUBLE) AS lo, (det % 16) * 4 / 16.0::DOUBLE - floor((det % 16) * 4 / 16.0::DOUBLE) AS p FROM a)
    SELECT det, (t // 4)::BIGINT AS t, round(value * (1 - p) + nx * p, 6) AS value FROM c WHERE t % 4 = lo""")
def multiplexing(spark, d):
    t = _tod(spark, d).withColumn("c", F.col("det"))
    return _out(timeline.multiplexing(t, ["det"], "t", "value", "c", 4))


# Masks, flags, policies


@query(f"{A} SELECT det, t, CASE WHEN t % 5 = 0 THEN 0 ELSE value END AS value, masked OR t % 5 = 0 AS masked FROM a")
def filter_nonfinite(spark, d):
    bad = F.when(F.col("t") % 10 == 0, numeric.NAN).when(F.col("t") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return masks.filter_nonfinite(T.tod(spark, d).withColumn("value", bad), "value").select("det", "t", "value", "masked")


@query(f"{A} SELECT det, t, CASE WHEN masked THEN 0 ELSE value END AS value FROM a")
def apply_mask(spark, d):
    return masks.apply_mask(T.tod(spark, d), "value").select("det", "t", "value")


@query(f"WITH p AS ({T.POINTING}) SELECT slice, t, info = 3 AS removed, (info = 2 OR t % 50 = 0) AND info <> 3 AS masked FROM p")
def policy(spark, d):
    p = T.pointing(spark, d).withColumn("invalid", F.col("t") % 50 == 0)
    return masks.apply_policy(p, masks.Policy(turnaround="mask")).select("slice", "t", "removed", "masked")


@query(f"""WITH p AS ({T.POINTING}), x AS (SELECT slice, info, info = 3 AS removed, info = 2 AS masked FROM p)
    SELECT slice, info, count(*) FILTER (NOT removed AND NOT masked) AS kept, count(*) FILTER (masked AND NOT removed) AS masked, count(*) FILTER (removed) AS removed FROM x GROUP BY slice, info""")
def observation_summary(spark, d):
    p = masks.apply_policy(T.pointing(spark, d), masks.Policy(turnaround="mask"), invalid=None)
    return masks.summary(p)


@query(f"""WITH p AS ({T.POINTING}), k AS (SELECT slice, t, CASE WHEN t % 40 < 20 THEN 3282 WHEN t % 40 < 30 THEN 16384 WHEN t % 200 BETWEEN 30 AND 34 THEN 16388 ELSE 0 END AS b FROM p),
    w AS (SELECT slice, t, b, min(CASE WHEN b = 3282 THEN t END) OVER (PARTITION BY slice) AS f, max(CASE WHEN b = 3282 THEN t END) OVER (PARTITION BY slice) AS l, max(CASE WHEN b = 16388 THEN t END) OVER (PARTITION BY slice ORDER BY t) AS c FROM k)
    SELECT slice, t, CASE WHEN t < f THEN 3 WHEN c IS NOT NULL AND t - c <= 3 THEN 3 WHEN b = 3282 THEN 1 WHEN t > l THEN 3 WHEN b = 16384 THEN 2 ELSE 3 END AS info FROM w""")
def flags(spark, d):
    t = F.col("t")
    kind = F.when(t % 40 < 20, 0xCD2).when(t % 40 < 30, 0x4000).when((t % 200).between(30, 34), 0x4004).otherwise(0)
    s = T.pointing(spark, d).withColumn("bbid", F.shiftleft(kind.cast("long"), 16))
    return masks.flags(s, 0.5, 1.2).select("slice", "t", "info")


@query(f"WITH p AS ({T.POINTING}) SELECT slice, t, t // 100 < 2 OR (t // 100 = 2 AND t % 100 // 10 < 3) AS masked FROM p")
def scanline_masking(spark, d):
    p = T.pointing(spark, d).withColumn("rep", F.floor(F.col("t") / 100)).withColumn("line", F.floor(F.col("t") % 100 / 10)).withColumn("masked", F.lit(False))
    return masks.scanline_mask(p, "rep", "line", 2, 3).select("slice", "t", "masked")


@query(f"{A} SELECT det, (t // 32)::BIGINT AS word, bit_or(CASE WHEN masked THEN 1::BIGINT << (t % 32)::INT ELSE 0::BIGINT END) AS bits FROM a GROUP BY 1, 2")
def mask_bits(spark, d):
    return masks.to_bits(T.tod(spark, d), ["det"], "t", "masked")


@query(f"{A} SELECT det, t FROM a WHERE masked")
def mask_unpacked(spark, d):
    words = masks.to_bits(T.tod(spark, d), ["det"], "t", "masked")
    return masks.from_bits(words, ["det"], "t", "masked").filter("masked").select("det", "t")


@query(f"WITH p AS ({T.POINTING}) SELECT slice, 0.5::DOUBLE AS interval, 4 AS factor FROM p GROUP BY slice HAVING count(*) > 1")
def sampling_interval(spark, d):
    return masks.sampling(T.pointing(spark, d), ["slice"], "t", "time", 0.125)


@query(f"WITH p AS ({T.POINTING}) SELECT slice, t FROM p WHERE t BETWEEN 22 AND 129")
def section(spark, d):
    _, first, last = strings.section("frames.fits[23:130]", 360)
    return masks.outside_section(T.pointing(spark, d), first, last).select("slice", "t")


# Sorting


@query(f"{A} SELECT det, t, row_number() OVER (PARTITION BY det ORDER BY masked, value, t) - 1 AS rank FROM a")
def sort_index(spark, d):
    return order.sort_index(T.tod(spark, d), ["det"], "t", "value", "masked").select("det", "t", "rank")


@query(f"{A}, b AS (SELECT det, t, floor(value / 40)::BIGINT AS v FROM a), c AS (SELECT *, lead(v) {W} AS n FROM b) SELECT det, t, v FROM c WHERE n IS NULL OR n <> v")
def uniq_integers(spark, d):
    t = T.tod(spark, d).select("det", "t", F.floor(F.col("value") / 40).alias("v"))
    return order.uniq_integers(t, ["det"], "t", "v")


@query(f"{A}, b AS (SELECT det, t, floor(value / 40)::DOUBLE AS v FROM a) SELECT det, min(t) AS t, v FROM b GROUP BY det, v")
def uniq_reals(spark, d):
    t = T.tod(spark, d).select("det", "t", F.floor(F.col("value") / 40).cast("double").alias("v"))
    return order.uniq_reals(t, ["det"], "t", "v", 1e-12)


@query(f"{A} SELECT det, t, CASE WHEN NOT masked THEN dense_rank() OVER (PARTITION BY det, masked ORDER BY value)::INT END AS index FROM a")
def reorder(spark, d):
    return order.reorder(T.tod(spark, d), ["det"], "t", "value", mask="masked").select("det", "t", "index")


@query(f"{A} SELECT det, t FROM a WHERE value > 50 AND NOT masked")
def where(spark, d):
    return order.where(T.tod(spark, d), (F.col("value") > 50) & ~F.col("masked"), "det", "t")


@query(f"{A} SELECT det, t, round(value / (det % 7 + 1), 6) AS value FROM a")
def detector_arithmetic(spark, d):
    t = _tod(spark, d)
    flat = t.select("det").distinct().withColumn("flat", (F.col("det") % 7 + 1).cast("double"))
    return _out(order.arithmetic(t, flat, ["det"], "value", "divide", "flat"))


# A directed edge of the hull has all other points of its zone on its left, or behind it on the same line.
@query(f"""WITH p AS ({T.POSITIONS}), e AS (SELECT a.zone, a.id, a.ra, a.dec, b.ra AS x2, b.dec AS y2 FROM p a JOIN p b ON a.zone = b.zone AND a.id <> b.id
      WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.zone = a.zone AND ((b.ra - a.ra) * (c.dec - a.dec) - (c.ra - a.ra) * (b.dec - a.dec) < 0
        OR (b.ra - a.ra) * (c.dec - a.dec) - (c.ra - a.ra) * (b.dec - a.dec) = 0 AND c.id <> a.id AND (b.ra - a.ra) * (c.ra - a.ra) + (b.dec - a.dec) * (c.dec - a.dec) > power(b.ra - a.ra, 2) + power(b.dec - a.dec, 2)))),
    v AS (SELECT DISTINCT zone, id, ra, dec FROM e), o AS (SELECT zone, arg_min(ra, dec * 1000 + ra) AS ra0, min(dec) AS dec0 FROM v GROUP BY zone)
    SELECT zone, id, (row_number() OVER (PARTITION BY zone ORDER BY CASE WHEN ra = ra0 AND dec = dec0 THEN -1 ELSE atan2(dec - dec0, ra - ra0) END) - 1)::INT AS corner FROM v JOIN o USING (zone)""")
def convex_hull(spark, d):
    return order.convex_hull(T.positions(spark, d), ["zone"], "ra", "dec").select("zone", "id", "corner")


# Scalars


@query("""WITH x AS (SELECT c_custkey AS id, c_acctbal / 4 AS x FROM customer) SELECT id, trunc(x) AS rtz, sign(x) * ceil(abs(x)) AS rti, floor(x) AS rtmi, ceil(x) AS rtpi, sign(x) * ceil(abs(x) - 0.5) AS rhtz,
    sign(x) * floor(abs(x) + 0.5) AS rhti, ceil(x - 0.5) AS rhtmi, floor(x + 0.5) AS rhtpi FROM x""")
def rounding_modes(spark, d):
    x = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 4).alias("x"))
    return x.select("id", *[rounding.rounded(F.col("x"), m).alias(m) for m in rounding.MODES if m != "rhs"])


#: Relative differences on either side of the tolerance of 1e-9.
_APART = "CASE c_custkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 5e-10::DOUBLE ELSE 2e-9::DOUBLE END"


@query(f"WITH x AS (SELECT c_custkey AS id, c_acctbal AS x, c_acctbal * (1 + {_APART}) AS y FROM customer) SELECT id, abs(x - y) <= 1e-9 * greatest(abs(x), abs(y)) AS same FROM x")
def eq_real(spark, d):
    c, n = T.read(spark, d, "customer"), F.col("c_custkey") % 3
    apart = F.when(n == 0, 0.0).when(n == 1, 5e-10).otherwise(2e-9)
    return c.select(F.col("c_custkey").alias("id"), numeric.close(F.col("c_acctbal"), F.col("c_acctbal") * (1 + apart), 1e-9).alias("same"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE vec_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 5e-15::DOUBLE ELSE 1e-12::DOUBLE END AS d FROM embeddings)
    SELECT vec_id AS id, coalesce(list_bool_and(list_transform(e, lambda v: abs(v - v * (1 + d)) <= 1e-14::DOUBLE * greatest(abs(v), abs(v * (1 + d))))), true) AS same FROM x""")
def all_eq(spark, d):
    """Arrays against arrays that are moved by nothing, by less and by more than the tolerance."""
    n = F.col("vec_id") % 3
    e = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"), F.when(n == 0, 0.0).when(n == 1, 5e-15).otherwise(1e-12).alias("d"))
    moved = F.transform("a", lambda v: v * (1 + F.col("d")))
    return e.select("id", equality.all_eq(F.col("a"), moved, e.schema["a"].dataType).alias("same"))


@query("SELECT r_regionkey AS id, i::INT AS i, round(1 + i * 0.25::DOUBLE, 6) AS lin, round(exp(ln(1) + i * (ln(16) - ln(1)) / 4), 6) AS log FROM region, range(5) g(i)")
def grids(spark, d):
    g = T.read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.posexplode(F.arrays_zip(numeric.linspace(1, 2, 5).alias("lin"), numeric.logspace(1, 16, 5).alias("log"))).alias("i", "z"))
    return g.select("id", "i", r(F.col("z.lin"), 6).alias("lin"), r(F.col("z.log"), 6).alias("log"))


@query(f"WITH p AS ({T.POSITIONS}) SELECT id, round(degrees(acos(least(1, greatest(-1, cos(radians(dec)) * cos(radians(20.1)) * cos(radians(30.2 - ra)) + sin(radians(dec)) * sin(radians(20.1)))))), 5) AS angle FROM p")
def angle_lonlat(spark, d):
    p = T.positions(spark, d)
    return p.select("id", r(angles.angle_lonlat(F.col("ra"), F.col("dec"), F.lit(30.2), F.lit(20.1)), 5).alias("angle"))


@query("SELECT n_nationkey AS id, round(sqrt(power((n_nationkey % 5 + 1 - 2.5) * 0.5, 2) + power((n_nationkey // 5 + 1 - 3.0) * 0.5, 2)), 6) AS distance FROM nation")
def grid_distance(spark, d):
    n = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5 + 1).alias("x"), (F.floor(F.col("n_nationkey") / 5) + 1).alias("y"))
    return n.select("id", r(numeric.grid_distance((2.5, 3.0), 0.5, "x", "y"), 6).alias("distance"))


_WCS = wcs.Wcs.square((30.4, 20.0), 0.01, (120, 110))
_TAN = f"""WITH p AS ({T.POSITIONS}), q AS (SELECT id, zone, radians(ra) - radians(30.4) AS a, radians(dec) AS d, radians(20.0) AS d0 FROM p), c AS (SELECT *, sin(d) * sin(d0) + cos(d) * cos(d0) * cos(a) AS cosc FROM q),
    u AS (SELECT id, zone, degrees(cos(d) * sin(a) / cosc) AS u, degrees((sin(d) * cos(d0) - cos(d) * sin(d0) * cos(a)) / cosc) AS v FROM c), xy AS (SELECT id, zone, 60.5 - u / 0.01 AS x, 55.5 + v / 0.01 AS y FROM u)"""


@query(f"{_TAN} SELECT id, round(x, 5) AS x, round(y, 5) AS y FROM xy")
def tangent_plane(spark, d):
    x, y = wcs.sky_to_pixel(_WCS, F.col("ra"), F.col("dec"))
    return T.positions(spark, d).select("id", r(x, 5).alias("x"), r(y, 5).alias("y"))


@query(f"WITH p AS ({T.POSITIONS}) SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM p")
def tangent_plane_back(spark, d):
    x, y = wcs.sky_to_pixel(_WCS, F.col("ra"), F.col("dec"))
    ra, dec = wcs.pixel_to_sky(_WCS, F.col("x"), F.col("y"))
    return T.positions(spark, d).select("id", x.alias("x"), y.alias("y")).select("id", r(ra, 6).alias("ra"), r(dec, 6).alias("dec"))


@query(f"{_TAN} SELECT id, CASE WHEN floor(x + 0.5) BETWEEN 1 AND 120 AND floor(y + 0.5) BETWEEN 1 AND 110 THEN (floor(x + 0.5) - 1 + (floor(y + 0.5) - 1) * 120)::INT ELSE -1 END AS pixel, round(power(cos(atan(sqrt(power(x - 60.5, 2) + power(y - 55.5, 2)) * tan(radians(0.01)))), 3), 9) AS scale FROM xy")
def pixel_and_scale(spark, d):
    x, y = wcs.sky_to_pixel(_WCS, F.col("ra"), F.col("dec"))
    p = T.positions(spark, d).select("id", x.alias("x"), y.alias("y"))
    return p.select("id", wcs.pixel_index(_WCS, F.col("x"), F.col("y")).alias("pixel"), r(wcs.projection_scale(_WCS, F.col("x"), F.col("y")), 9).alias("scale"))


@query("SELECT n_nationkey AS id, ((n_nationkey + 1) * 2 + (n_nationkey + 1) * 1)::DOUBLE AS area FROM nation")
def polygon_area(spark, d):
    w = (F.col("n_nationkey") + 1).cast("double")
    z = F.lit(0.0)
    return T.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), geometry.shoelace(F.array(z, w, w, w / 2 + 0, z), F.array(z, z, F.lit(2.0), F.lit(4.0), F.lit(2.0))).alias("area"))


@query("SELECT p_partkey AS id, replace(p_name, ' ', '') AS plain, len(string_split(p_type, ' '))::INT AS parts, array_to_string(string_split(p_type, ' '), '/') AS joined, lpad(p_size::VARCHAR, 4, '0') AS padded, upper(p_brand) AS up, lower(p_brand) AS low FROM part")
def string_helpers(spark, d):
    parts = strings.split_kept(F.col("p_type"), " ")
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), strings.without_blanks(F.col("p_name")).alias("plain"), F.size(parts).alias("parts"), strings.joined(parts, "/").alias("joined"), strings.padded_integer(F.col("p_size"), 4).alias("padded"), F.upper("p_brand").alias("up"), F.lower("p_brand").alias("low"))


@query("SELECT p_partkey AS id, round(p_retailprice * 16 / (p_size + 1.0), 6) AS value FROM part")
def unit_conversion(spark, d):
    f = units.factor("Jy / detector", "Jy / pixel", F.col("p_size") + F.lit(1.0), 10.0, 16.0)
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), r(F.col("p_retailprice") * f, 6).alias("value"))


@query("SELECT p_partkey AS id, least(65535, greatest(0, round(p_retailprice / 0.7 - 500))) AS adu FROM part")
def adu(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), units.to_adu(F.col("p_retailprice"), 0.7, -500.0).alias("adu"))


# Pointings


@query(f"""WITH p AS ({T.POINTING}), q AS (SELECT slice, time, ra, dec, lead(time) OVER w AS nt, lead(ra) OVER w AS nr, lead(dec) OVER w AS nd FROM p WINDOW w AS (PARTITION BY slice ORDER BY t))
    SELECT slice, time + 0.2::DOUBLE AS time, round(ra + (nr - ra) * 0.2 / (nt - time), 11) AS ra, round(dec + (nd - dec) * 0.2 / (nt - time), 11) AS dec FROM q WHERE nt IS NOT NULL""")
def position_by_time(spark, d):
    p = T.pointing(spark, d)
    last = p.groupBy("slice").agg(F.max("time").alias("__e"))
    asked = p.join(last, "slice").filter("time < __e").select("slice", (F.col("time") + 0.2).alias("time"))
    return pointing.position_at(p, asked, columns=["ra", "dec"]).select("slice", "time", r("ra", 11).alias("ra"), r("dec", 11).alias("dec"))


@query(f"""WITH p AS ({T.POINTING}), q AS (SELECT slice, t, ra, dec, coalesce(lead(ra) OVER w - ra, ra - lag(ra) OVER w, 0) AS dr, coalesce(lead(dec) OVER w - dec, dec - lag(dec) OVER w, 0) AS dd FROM p WINDOW w AS (PARTITION BY slice ORDER BY t))
    SELECT slice, t * 4 + k AS fine, round(ra + dr * k / 4.0::DOUBLE, 11) AS ra, round(dec + dd * k / 4.0::DOUBLE, 11) AS dec FROM q, range(4) g(k)""")
def position_by_index(spark, d):
    return pointing.position_fine(T.pointing(spark, d), 4, columns=["ra", "dec"]).select("slice", "fine", r("ra", 11).alias("ra"), r("dec", 11).alias("dec"))


def _camera(spark):
    return pointing.detector_grid(spark, 4, 4, 20.0, 0.9).withColumn("area", F.lit(360.0))


@query("SELECT (i)::INT AS det, (i // 4)::INT AS row, (i % 4)::INT AS column, (i % 4 - 1.5::DOUBLE) * 20.0::DOUBLE AS u, (i // 4 - 1.5::DOUBLE) * 20.0::DOUBLE AS v FROM range(16) g(i)")
def detector_grid(spark, d):
    return _camera(spark).select("det", "row", "column", r("u").alias("u"), r("v").alias("v"))


_NEAREST = wcs.Wcs.square((30.8, 20.2), 0.005, (400, 200))


@query(f"""WITH p AS ({T.POINTING}), g AS (SELECT i::INT AS det, (i % 4 - 1.5) * 20.0::DOUBLE AS u, (i // 4 - 1.5) * 20.0::DOUBLE AS v FROM range(16) g(i)),
    s AS (SELECT slice, t, det, ra + (u / 3600 * cos(radians(pa)) + v / 3600 * sin(radians(pa))) / cos(radians(dec)) AS ra, dec + (-u / 3600 * sin(radians(pa)) + v / 3600 * cos(radians(pa))) AS dec FROM p, g),
    q AS (SELECT *, radians(ra) - radians(30.8) AS a, radians(dec) AS d, radians(20.2) AS d0 FROM s), c AS (SELECT *, sin(d) * sin(d0) + cos(d) * cos(d0) * cos(a) AS cosc FROM q),
    xy AS (SELECT slice, t, det, 200.5 - degrees(cos(d) * sin(a) / cosc) / 0.005 AS x, 100.5 + degrees((sin(d) * cos(d0) - cos(d) * sin(d0) * cos(a)) / cosc) / 0.005 AS y FROM c)
    SELECT slice, t, det, (floor(x + 0.5) - 1 + (floor(y + 0.5) - 1) * 400)::INT AS pixel, round((360 * power(cos(atan(sqrt(power(x - 200.5, 2) + power(y - 100.5, 2)) * tan(radians(0.005)))), 3))::FLOAT::DOUBLE, 3) AS weight
    FROM xy WHERE floor(x + 0.5) BETWEEN 1 AND 400 AND floor(y + 0.5) BETWEEN 1 AND 200""")
def nearest_matrix(spark, d):
    m = pointing.nearest_matrix(T.pointing(spark, d), _camera(spark), _NEAREST)
    return m.select("slice", "t", "det", "pixel", r(F.col("weight").cast("double"), 3).alias("weight"))


@query()
def sharp_matrix(spark, d):
    return pointing.sharp_matrix(T.pointing(spark, d), _camera(spark), _NEAREST)


@query(f"""WITH p AS ({T.POINTING}), z AS (SELECT sum(cos(radians(dec)) * cos(radians(ra))) AS x, sum(cos(radians(dec)) * sin(radians(ra))) AS y, sum(sin(radians(dec))) AS z FROM p),
    o AS (SELECT atan2(y, x) AS a0, atan2(z, sqrt(x * x + y * y)) AS d0 FROM z),
    g AS (SELECT (i % 4 - 1.5) * 20.0::DOUBLE + du * 20 * sqrt(0.9::DOUBLE) / 2 AS u, (i // 4 - 1.5) * 20.0::DOUBLE + dv * 20 * sqrt(0.9::DOUBLE) / 2 AS v FROM range(16) g(i), (VALUES (1, 1), (-1, 1), (-1, -1), (1, -1)) c(du, dv)),
    s AS (SELECT radians(ra + (u / 3600 * cos(radians(pa)) + v / 3600 * sin(radians(pa))) / cos(radians(dec))) - a0 AS a, radians(dec + (-u / 3600 * sin(radians(pa)) + v / 3600 * cos(radians(pa)))) AS d, d0 FROM p, g, o),
    c AS (SELECT *, sin(d) * sin(d0) + cos(d) * cos(d0) * cos(a) AS k FROM s), xy AS (SELECT 1 - degrees(cos(d) * sin(a) / k) / 0.005 AS x, 1 + degrees((sin(d) * cos(d0) - cos(d) * sin(d0) * cos(a)) / k) / 0.005 AS y FROM c),
    b AS (SELECT floor(min(x) + 0.5)::INT AS x0, floor(max(x) + 0.5)::INT AS x1, floor(min(y) + 0.5)::INT AS y0, floor(max(y) + 0.5)::INT AS y1 FROM xy)
    SELECT x1 - x0 + 1 AS nx, y1 - y0 + 1 AS ny, round(degrees(a0), 6) AS ra, round(degrees(d0), 6) AS dec, (2 - x0)::DOUBLE AS x, (2 - y0)::DOUBLE AS y FROM b, o""")
def map_header(spark, d):
    p = T.pointing(spark, d).withColumn("masked", F.lit(False)).withColumn("removed", F.lit(False))
    w = pointing.map_header(p, _camera(spark), 18.0)
    ra = w.crval[0] - 360 if w.crval[0] > 180 else w.crval[0]  # as atan2 gives it
    return spark.createDataFrame([(w.naxis[0], w.naxis[1], round(ra, 6), round(w.crval[1], 6), w.crpix[0], w.crpix[1])], "nx int, ny int, ra double, dec double, x double, y double")


# Instrument


@query(f"""WITH p AS ({T.POINTING}), v AS (SELECT slice, info, 3600 * sqrt(power((lead(ra) OVER w - ra) * cos(radians(dec)), 2) + power(lead(dec) OVER w - dec, 2)) / (lead(time) OVER w - time) AS v FROM p WINDOW w AS (PARTITION BY slice ORDER BY t))
    SELECT slice, round(quantile_disc(v, 0.5), 1) AS speed FROM v WHERE info = 1 GROUP BY slice""")
def scan_speed(spark, d):
    return instrument.scan_speed(T.pointing(spark, d))


@query(f"WITH p AS ({T.POINTING}) SELECT slice, count(*) AS nsamples, count(*) * 4 * 8 AS nfine FROM p GROUP BY slice")
def fine_samples(spark, d):
    n = T.pointing(spark, d).groupBy("slice").agg(F.count("*").alias("nsamples")).withColumn("compression_factor", F.lit(4))
    return instrument.fine_samples(n, 8).select("slice", "nsamples", "nfine")


@query(f"WITH p AS ({T.POSITIONS}) SELECT id, CASE WHEN ra BETWEEN 30.1 AND 30.6 THEN round(ra, 6) END AS ra, CASE WHEN dec BETWEEN 19.8 AND 20.3 THEN round(dec, 6) END AS dec FROM p")
def coordinate_boundary(spark, d):
    p = instrument.inside_box(T.positions(spark, d), {"ra": (30.1, 30.6), "dec": (19.8, 20.3)})
    return p.select("id", *[r(F.nanvl(c, F.lit(None)), 6).alias(c) for c in ("ra", "dec")])


@query("""WITH c AS (SELECT p_brand AS det, p_size::DOUBLE AS length, avg(p_retailprice) AS s FROM part GROUP BY 1, 2), w AS (SELECT *, lead(length) OVER v AS nl, lead(s) OVER v AS ns, row_number() OVER v AS k FROM c WINDOW v AS (PARTITION BY det ORDER BY length))
    SELECT det, round(CASE WHEN nl IS NULL OR length > 20.5 THEN s ELSE exp(ln(s) + (ln(ns) - ln(s)) * (ln(20.5) - ln(length)) / (ln(nl) - ln(length))) END, 5) AS stddev FROM w WHERE (length <= 20.5 OR k = 1) AND (nl > 20.5 OR nl IS NULL)""")
def detector_stddev(spark, d):
    c = T.read(spark, d, "part").groupBy(F.col("p_brand").alias("det"), F.col("p_size").cast("double").alias("length")).agg(F.avg("p_retailprice").alias("stddev"))
    return instrument.detector_stddev(c, 20.5).select("det", r("stddev", 5).alias("stddev"))


@query("""WITH c AS (SELECT avg(p_retailprice) AS m FROM part WHERE p_partkey IN (1, 2, 3, 4)) SELECT p_partkey AS det, round(p_retailprice / m, 8) AS optical, round(p_size / (p_retailprice / m), 6) AS detector FROM part, c""")
def flat_fields(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("det"), F.col("p_retailprice").alias("area"), F.col("p_size").cast("double").alias("flat_total"))
    return instrument.flats(p, (1, 2, 3, 4)).select("det", r("flat_optical", 8).alias("optical"), r("flat_detector", 6).alias("detector"))


# Operators and solvers


@query(f"{A} SELECT det, t, round(2 * CASE WHEN t % 3 = 0 THEN 0 ELSE value END + value, 6) AS value FROM a")
def operator_algebra(spark, d):
    op = Mask(F.col("t") % 3 == 0) * 2.0 + Identity()
    return _out(op(_tod(spark, d)))


@query(f"{M} SELECT pixel, round(sum(weight::DOUBLE * value), 2) AS value FROM m JOIN s USING (det, t) GROUP BY pixel", name="operator_projection_adjoint")
def operator_projection_adjoint(spark, d):
    t = T.samples(spark, d).select("det", "t", "value")
    return Projection(T.matrix(spark, d)).T(t).select("pixel", r("value", 2).alias("value"))


@query()
def mapper_rls(spark, d):
    t = T.samples(spark, d).select("det", "t", F.when(F.col("masked"), 0.0).otherwise(F.col("value")).alias("value"))
    got = solvers.mapper_rls(t, Projection(saved(T.matrix(spark, d), "matrix")), hyper=0.1, priors=[Difference([], "pixel")], tol=1e-3, most=6)
    return got.x.select("pixel", r("value", 2).alias("value"))


@query()
def mapper_nl(spark, d):
    t = T.samples(spark, d).select("det", "t", "value")
    x0 = spark.range(T.PIXELS).select(F.col("id").cast("int").alias("pixel"), F.lit(0.0).alias("value"))
    got = solvers.mapper_nl(t, Projection(saved(T.matrix(spark, d), "matrix")), x0, tol=1e-3)
    return got.x.select("pixel", r("value", 2).alias("value"))


_SINGLE = f"{S} SELECT (part % {T.PIXELS})::INT AS pixel, round(sum(CASE WHEN masked THEN 0 ELSE quantity::FLOAT::DOUBLE * value END) / sum(power(quantity::FLOAT::DOUBLE, 2)), 3) AS value FROM s GROUP BY 1"


def _least_squares(spark, d, solver):
    """Of a matrix with one pixel for each sample, whose normal equations are diagonal; preconditioned with that diagonal."""
    m = saved(T.matrix_single(spark, d), "matrix")
    t = T.samples(spark, d).select("det", "t", F.when(F.col("masked"), 0.0).otherwise(F.col("value")).alias("value"))
    hits = m.groupBy("pixel").agg((1 / F.sum(F.col("weight").cast("double") * F.col("weight").cast("double"))).alias("weight"))
    got = solvers.mapper_ls(t, Projection(m), tol=1e-8, m=Diagonal(hits, ["pixel"]), solver=solver)
    return got.x.select("pixel", r("value", 3).alias("value"))


@query(_SINGLE)
def mapper_ls(spark, d):
    return _least_squares(spark, d, solvers.cg)


@query(_SINGLE)
def mapper_ls_cgs(spark, d):
    return _least_squares(spark, d, solvers.cgs)


@query(_SINGLE)
def mapper_ls_bicgstab(spark, d):
    return _least_squares(spark, d, solvers.bicgstab)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

