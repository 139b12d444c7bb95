from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import same, timeline, values
from pyspark.sql import functions as F

from mapforge.functions import angles, geometry, numeric, rounding, strings, units, wcs
from mapforge.operators import aggregates, masks, order, pointing


def column(spark, xs, f):
    return [r[0] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(f(F.col("x"))).collect()]


def test_rounding(spark):
    xs = [-1.5, -1.2, -0.5, 0, 0.2, 0.5, 0.8, 1.5, 1.7]
    want = {
        "rtz": [-1, -1, 0, 0, 0, 0, 0, 1, 1], "rti": [-2, -2, -1, 0, 1, 1, 1, 2, 2], "rhtz": [-1, -1, 0, 0, 0, 0, 1, 1, 2], "rhti": [-2, -1, -1, 0, 0, 1, 1, 2, 2],
        "rhtmi": [-2, -1, -1, 0, 0, 0, 1, 1, 2], "rhtpi": [-1, -1, 0, 0, 0, 1, 1, 2, 2],
    }
    for mode, w in want.items():
        same(column(spark, xs, rounding.MODES[mode]), w)
    assert all(abs(a - b) <= 0.5 for a, b in zip(column(spark, xs, rounding.half_random), xs))
    with pytest.raises(ValueError):
        rounding.rounded(F.lit(1.0), "up")


def test_close(spark):
    got = spark.createDataFrame([(1.0, 1.0 + 1e-16), (1.0, 1.1), (float("nan"), float("nan")), (float("nan"), 1.0), (0.0, 0.0)], "a double, b double").select(numeric.close(F.col("a"), F.col("b")))
    assert [r[0] for r in got.collect()] == [True, False, True, False, True]


def test_degrees(spark):
    got = spark.createDataFrame([(x,) for x in (11.0, 351.0, 1.0, 341.0, 21.0)], "x double").agg(angles.mean_degrees(F.col("x")), *angles.minmax_degrees(F.col("x"))).first()
    same(list(got), [1, 341, 21])


@pytest.mark.parametrize("text, want", [("f[23:23]", ("f", 23, 23)), ("f[200:]", ("f", 200, 360)), ("f[:130]", ("f", 1, 130)), ("f[:]", ("f", 1, 360)), ("f[]", ("f", 1, 360)), ("f", ("f", 1, 360)), ("f[7]", ("f", 7, 7))])
def test_sections(text, want):
    assert strings.section(text, 360) == want


@pytest.mark.parametrize("text", ["f[32:23]", "f[a:3]", "f[1:361]", "f[0:3]", "f[1:2"])
def test_wrong_sections(text):
    with pytest.raises(ValueError):
        strings.section(text, 360)


def test_geometry():
    x, y = np.array([0.0, 1, 1, 0]), np.array([0.0, 0, 1, 1])
    assert geometry.area(x, y) == 1
    assert [geometry.inside(px, py, x, y) for px, py in ((0.5, 0.5), (0, 0.5), (1, 1), (2, 0.5))] == [1, 0, 0, -1]
    px, py = np.array([0.5, 0, 1, 0, 1, 0.5]), np.array([0.5, 0, 0, 1, 1, 0])
    assert geometry.hull(px, py).tolist() == [1, 2, 4, 3]


def test_wcs_round_trip(spark):
    w = wcs.Wcs.square((120.0, -35.0), 0.01, (50, 40), angle=20)
    assert wcs.Wcs.from_header(w.to_header()) == w
    p = spark.createDataFrame([(120.1, -35.05), (119.9, -34.9)], "ra double, dec double")
    x, y = wcs.sky_to_pixel(w, F.col("ra"), F.col("dec"))
    back = p.select("ra", "dec", x.alias("x"), y.alias("y")).select("ra", "dec", *wcs.pixel_to_sky(w, F.col("x"), F.col("y"))).collect()
    for r in back:
        same(list(r[:2]), list(r[2:]), 1e-9)
    with pytest.raises(ValueError):
        wcs.Wcs.from_header({"NAXIS1": 2, "NAXIS2": 2, "CRPIX1": 1, "CRPIX2": 1, "CRVAL1": 0, "CRVAL2": 0, "CD1_1": 1.0})
    with pytest.raises(ValueError):
        wcs.Wcs.square((0, 0), 0.1, (70_000, 70_000))


def test_moments(spark):
    x = np.array([1.0, 3, 2, 8, 5])
    got = aggregates.moments(timeline(spark, x), "value").first()
    m, s = x.mean(), x.std(ddof=1)
    same([got.n, got["mean"], got.variance, got.skewness, got.kurtosis, got.stddev, got.meandev], [5, m, s * s, ((x - m) ** 3).sum() / (5 * s**3), ((x - m) ** 4).sum() / (5 * s**4) - 3, s, abs(x - m).mean()])
    one = aggregates.moments(timeline(spark, x, [True] * 4 + [False]), "value", mask="masked").first()
    assert one["mean"] == 5 and math.isnan(one.variance) and math.isnan(one.skewness)
    none = aggregates.moments(timeline(spark, x, [True] * 5), "value", mask="masked").first()
    assert none.n == 0 and math.isnan(none["mean"])


def test_lower_medians(spark):
    t = timeline(spark, [4, 1, 3, 2])
    assert aggregates.median(t, "value", ["det"]).first()["median"] == 2
    assert t.agg(aggregates.lower_median(F.col("value"))).first()[0] == 2
    assert aggregates.mad(t, "value", ["det"]).first()["mad"] == 1


def test_norm_gradients_are_derivatives(spark):
    x0, h = np.array([0.5, -1.5, 2.0]), 1e-6
    cases = [(aggregates.norm2, aggregates.norm2_gradient), (lambda x: aggregates.norm_huber(x, 1.0), lambda x: aggregates.norm_huber_gradient(x, 1.0)), (lambda x: aggregates.normp(x, 3), lambda x: aggregates.normp_gradient(x, 3)), (aggregates.norm_l1, aggregates.norm_l1_gradient)]
    for norm, slope in cases:
        value = lambda x, n=norm: timeline(spark, x).agg(n(F.col("value"))).first()[0]
        numeric_ = [(value(x0 + h * e) - value(x0 - h * e)) / (2 * h) for e in np.eye(3)]
        same([r[0] for r in timeline(spark, x0).orderBy("t").select(slope(F.col("value"))).collect()], numeric_, 1e-4)
    with pytest.raises(ValueError):
        aggregates.norm_huber(F.lit(1.0), -1)


def test_sigma_clipping(spark):
    x = [2.0, 100.0] + [50 + i / 100 for i in range(98)]
    t = timeline(spark, x)
    assert aggregates.sigma_clip(t, "value", ["det"], 5, 1).filter("rejected").count() == 2
    assert aggregates.sigma_clip(t, "value", ["det"], 5).filter("rejected").count() == 2


def test_uniq_and_reorder(spark):
    t = timeline(spark, [2, 2, 3, 4, 4, 5, 8, 8, 9, 9, 9])
    ints = t.withColumn("value", F.col("value").cast("long"))
    assert [r.t + 1 for r in order.uniq_integers(ints, ["det"], "t", "value").orderBy("t").collect()] == [2, 3, 5, 6, 8, 11]
    assert [r.t + 1 for r in order.uniq_reals(t, ["det"], "t", "value", 1e-12).orderBy("t").collect()] == [1, 3, 4, 6, 7, 9]
    near = timeline(spark, [1.0, 1.05, 2.0, float("nan")])
    assert [r["index"] for r in order.reorder(near, ["det"], "t", "value", 0.1).orderBy("t").collect()] == [1, 1, 2, None]


def test_nonfinite_and_bits(spark):
    t = timeline(spark, [1, math.nan, 5, math.inf, -math.inf, 8])
    out = masks.filter_nonfinite(t, "value")
    same(values(out), [1, 0, 5, 0, 0, 8])
    assert [r.masked for r in out.orderBy("t").collect()] == [False, True, False, True, True, False]
    many = timeline(spark, range(70), [i % 3 == 0 for i in range(70)])
    back = masks.from_bits(masks.to_bits(many, ["det"], "t", "masked"), ["det"], "t", "masked")
    assert {r.t for r in back.filter("masked").collect()} == {i for i in range(70) if i % 3 == 0}


def test_policy_and_jumps(spark):
    with pytest.raises(ValueError):
        masks.Policy(other="drop")
    p = spark.createDataFrame([(0, 0, 1, False), (0, 1, 2, True), (0, 2, 3, False)], "slice int, t long, info int, invalid boolean")
    got = masks.apply_policy(p, masks.Policy()).orderBy("t").collect()
    assert [(r.masked, r.removed) for r in got] == [(False, False), (True, False), (False, True)]
    s = spark.createDataFrame([(0, i, float(x), 1.0 + i) for i, x in enumerate([0, 1, 0.5, 3])], "slice int, t long, time double, ra double")
    fixed = masks.repair_jumps(s, ["slice"], "t", "time", ["ra"]).orderBy("t").collect()
    assert [r.time for r in fixed] == [0, 1, 1, 3] and [r.ra for r in fixed] == [1, 2, 2, 4] and [r.invalid for r in fixed] == [False, True, True, False]


def test_positions_between_samples(spark):
    p = spark.createDataFrame([(0, i, float(i), 10.0 + 2 * i, 0.0, 0.0, 0.0) for i in range(3)], "slice int, t long, time double, ra double, dec double, pa double, chop double")
    times = spark.createDataFrame([(0, x) for x in (-1.5, -0.5, 0.0, 0.25, 1.0, 2.0, 2.5, 3.5)], "slice int, time double")
    got = [r.ra for r in pointing.position_at(p, times, columns=["ra"]).orderBy("time").collect()]
    same(got, [math.nan, 9, 10, 10.5, 12, 14, 15, math.nan])


def test_units(spark):
    d = spark.createDataFrame([(4.0,)], "area double")
    assert d.select(units.factor("Jy/detector", "Jy/arcsec^2", F.col("area"), 2.0, 9.0)).first()[0] == 0.25
    assert d.select(units.factor("Jy / detector_reference", "Jy / pixel", F.col("area"), 2.0, 9.0)).first()[0] == 4.5
    with pytest.raises(ValueError):
        units.factor("V", "Jy", F.col("area"), 1.0, 1.0)


def test_histogram_and_profile(spark):
    t = spark.createDataFrame([(1, False), (1, True), (3, False), (9, False)], "bin long, masked boolean")
    assert [(r.bin, r.n) for r in aggregates.histogram(t, "bin", 4, "masked").orderBy("bin").collect()] == [(1, 1), (2, 0), (3, 1), (4, 0)]
    g = spark.createDataFrame([(0.0, 0.5, 2.0), (0.0, 2.5, 4.0)], "x double, y double, v double")
    got = aggregates.radial_profile(g, "x", "y", (0.0, 0.0), 1.0, "v", 3).orderBy("bin").collect()
    same([got[0].r, got[0].value, got[1].r, got[1].value, got[2].value], [0.5, 2, 1.5, math.nan, 4])


def test_structural_equality(spark):
    from mapforge.functions import equality

    kind = "id int, x double, l array<struct<p:float,q:string>>, m map<string,double>"
    rows = [(1, 1.0, [(1.0, "a"), (None, None)], {"k": 2.0, "j": 3.0}), (2, float("nan"), [], None), (None, None, None, {})]
    a = spark.createDataFrame(rows, kind)
    equality.assert_all_eq(a, spark.createDataFrame([(1, 1.0 + 1e-15, [(1.0 + 1e-9, "a"), (None, None)], {"j": 3.0, "k": 2.0}), *rows[1:]], kind).repartition(3), ["id"])
    other = spark.createDataFrame([(1, 1.0 + 1e-13, [(1.0, "a")], {"k": 2.0, "i": 3.0}), (2, None, None, None), (3, 1.0, [], {})], kind)
    got = {r.id: r["columns"] for r in equality.differences(a, other, ["id"]).collect()}
    assert got == {1: ["x", "l", "m"], 2: ["x", "l"], 3: None, None: None}
    assert {r.id: r["columns"] for r in equality.differences(a, other, ["id"], 1e-6).collect()}[1] == ["l", "m"]
    with pytest.raises(AssertionError):
        equality.assert_all_eq(a, other, ["id"])
    with pytest.raises(ValueError):
        equality.differences(a, other.drop("m"), ["id"])
