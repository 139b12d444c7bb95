from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import dense, same, timeline, values
from pyspark.sql import functions as F

from mapforge.operators import algebra, timeline as T

KEY, NAN = ["det"], float("nan")


def at(f, *args, **kw):
    return lambda df: f(df, KEY, "t", "value", *args, **kw)


def test_average_and_adjoint(spark):
    t = timeline(spark, [1, 2, 2, 3])
    same(values(T.average(t, KEY, "t", "value", 2)), [1.5, 2.5])
    same(values(T.average_adjoint(T.average(t, KEY, "t", "value", 2), KEY, "t", "value", 2)), [0.75, 0.75, 1.25, 1.25])
    with pytest.raises(ValueError):
        T.check_divides(t, KEY, 3)


def test_downsampling(spark):
    t = timeline(spark, [1, 9, 2, 9])
    same(values(T.downsample(t, KEY, "t", "value", 2)), [1, 2])
    same(values(T.downsample_adjoint(T.downsample(t, KEY, "t", "value", 2), KEY, "t", "value", 2)), [1, 0, 2, 0])


def test_differences_have_the_sign_of_the_earlier_value(spark):
    same(values(T.diff(timeline(spark, [1, 4, 9]), KEY, "t", "value")), [-3, -5, 0])
    same(values(T.diff(timeline(spark, [7]), KEY, "t", "value")), [0])
    same(values(T.diff_adjoint(timeline(spark, [7]), KEY, "t", "value")), [0])


@pytest.mark.parametrize("f, g, n, m", [
    (at(T.diff), at(T.diff_adjoint), 4, 4), (at(T.shift, 1), at(T.shift, -1), 4, 4), (at(T.pad, 1, 2), at(T.trim, 1, 2), 3, 6), (at(T.average, 2), at(T.average_adjoint, 2), 4, 2),
    (at(T.downsample, 2), at(T.downsample_adjoint, 2), 4, 2), (at(T.exponential_response, 1.5), at(T.exponential_response, 1.5, adjoint=True), 4, 4),
])
def test_adjoints_are_transposes(spark, f, g, n, m):
    assert np.allclose(dense(f, n, m, spark).T, dense(g, m, n, spark))


def test_multiplexing_adjoint_is_the_transpose(spark):
    f = lambda d: T.multiplexing(d.withColumn("c", F.lit(6)), KEY, "t", "value", "c", 4)
    g = lambda d: T.multiplexing_adjoint(d.withColumn("c", F.lit(6)), KEY, "t", "value", "c", 4, 8)
    assert np.allclose(dense(f, 8, 2, spark).T, dense(g, 2, 8, spark))


def test_difference_normal_is_fused(spark):
    d = algebra.Difference(KEY, "t")
    op = (d.T @ d) * 2.0
    assert isinstance(op, algebra.DifferenceNormal) and op.scalar == 2.0
    t = timeline(spark, [1, 4, 9, 3]).drop("masked")
    same(values(op(t)), [2 * x for x in values(d.T(d(t)))])


def test_shift(spark):
    same(values(T.shift(timeline(spark, [1, 1, 1, 1]), KEY, "t", "value", 1)), [0, 1, 1, 1])
    same(values(T.shift(timeline(spark, [2, 2, 2, 2]), KEY, "t", "value", -1)), [2, 2, 2, 0])
    same(values(T.shift_by(timeline(spark, [5, 6, 7], n=1), KEY, "t", "value", "n")), [0, 5, 6])


def test_pack_and_unpack(spark):
    t = timeline(spark, [1, 2, 3, 4], [False, True, True, False])
    packed = T.pack(t, KEY, "t", "value", "masked")
    same(values(packed), [1, 4])
    same(values(T.unpack(packed, t, KEY, "t", "value", "masked")), [1, 0, 0, 4])
    p = algebra.Pack(t, KEY, "t")
    assert isinstance(p @ p.T, algebra.Identity)
    same(values((p.T @ p)(t.drop("masked"))), [1, 0, 0, 4])


def test_interpolation_clamps_or_goes_on(spark):
    same(values(T.interpolate_clamped(timeline(spark, [1, 0, 3, 4], [False, True, False, True]), KEY, "t", "value", "masked")), [1, 2, 3, 3])
    same(values(T.interpolate_extrapolated(timeline(spark, [NAN, NAN, 2, NAN, NAN, 5, NAN, 5, 4.5, NAN]), KEY, "t", "value")), [0, 1, 2, 3, 4, 5, 5, 5, 4.5, 4])
    same(values(T.interpolate_extrapolated(timeline(spark, [NAN, 3, NAN]), KEY, "t", "value")), [3, 3, 3])
    assert all(math.isnan(v) for v in values(T.interpolate_extrapolated(timeline(spark, [NAN, NAN]), KEY, "t", "value")))


X = [7.1, 1.2, 5, 3, 4, 5, 3, 10, 22, 32]


@pytest.mark.parametrize("length, medians", [(3, [1.2, 5, 3, 4, 4, 4, 5, 10, 22, 22]), (5, [5, 3, 4, 4, 4, 4, 5, 10, 10, 22])])
@pytest.mark.parametrize("f", [T.filter_median, T.filter_median_window])
def test_median_filter(spark, length, medians, f):
    same(values(f(timeline(spark, X), KEY, "t", "value", length)), [x - m for x, m in zip(X, medians)])


@pytest.mark.parametrize("f", [T.filter_median, T.filter_median_window])
def test_median_filter_edges(spark, f):
    same(values(f(timeline(spark, [3, 1, 2]), KEY, "t", "value", 5)), [1, -1, 0])
    same(values(f(timeline(spark, [3, 1, 2], [True] * 3), KEY, "t", "value", 2, "masked")), [0, 0, 0])
    same(values(f(timeline(spark, [1, 1, 9, 9, 9, 9, 2, 2], [False] * 2 + [True] * 4 + [False] * 2), KEY, "t", "value", 2, "masked")), values(T.filter_median(timeline(spark, [1, 1, 9, 9, 9, 9, 2, 2], [False] * 2 + [True] * 4 + [False] * 2), KEY, "t", "value", 2, "masked")))


def test_polynomials(spark):
    t = timeline(spark, [1, 0, 3, 4], [False, True, False, True])
    for got in (values(T.filter_line(t, KEY, "t", "value", "masked")), values(T.filter_polynomial(t, KEY, "t", "value", 1, "masked"))):
        same([got[0], got[2]], [0, 0], 1e-12)
        same([got[1], got[3]], [-2, 0], 1e-12)
    same(values(T.filter_polynomial(timeline(spark, [1, 2], [True, True]), KEY, "t", "value", 2, "masked")), [1, 2])


def test_exponential(spark):
    same(values(T.exponential_response(timeline(spark, [1, 1, 1]), KEY, "t", "value", 1.0)), [1, 1, 1])
    same(values(T.exponential_response(timeline(spark, [1, 0, 0]), KEY, "t", "value", 1.0)), [1, math.exp(-1), math.exp(-2)])
    same(values(T.exponential_response(timeline(spark, [1, 1]), KEY, "t", "value", 0.0)), [0, 0])


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_half_complex(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(T.from_half_complex(T.half_complex(x)), x)


def test_inverse_noise_is_symmetric_and_scaled(spark):
    f = spark.createDataFrame([(0, [0.4, 0.3, 0.2])], "det int, coef array<double>")
    m = dense(lambda d: T.inverse_noise(d, f, KEY, "t", "value"), 3, 3, spark)
    assert np.allclose(m, m.T)
    root = dense(lambda d: T.inverse_noise(d, f, KEY, "t", "value", root=True), 3, 3, spark)
    assert np.linalg.eigvalsh(m).max() <= 1 + 1e-12 and root.trace() > m.trace() * 0.5


@pytest.mark.parametrize("length", [1, 2, 9, 10, 63, 64])
def test_windows_side_by_side(monkeypatch, length):
    """Both ways of sliding medians agree, masked and repeated values included."""
    rng = np.random.default_rng(length)
    x, good = np.round(rng.normal(size=300), 1), rng.uniform(size=300) < 0.3
    fast = T.sliding_lower_median(x, good, length)
    monkeypatch.setattr(T, "SIDE_BY_SIDE", 0)
    assert np.array_equal(fast, T.sliding_lower_median(x, good, length), equal_nan=True)


@pytest.mark.parametrize("tau", [0.01, 2.0, 1e4, np.inf])
def test_decaying_sums(tau):
    x = np.random.default_rng(1).normal(size=1000)
    w, y, last = np.exp(-1 / tau), np.zeros(1000), 0.0
    for i, v in enumerate(x):
        last = v if i == 0 else w * last + (1 - w) * v
        y[i] = last
    assert np.allclose(T.exponential(x, tau), y, rtol=1e-10, atol=1e-12)
    a, b = np.random.default_rng(2).normal(size=(2, 50))
    assert abs(T.exponential(a, tau) @ b - a @ T.exponential_adjoint(b, tau)) < 1e-10
    assert len(T.exponential(x[:0], tau)) == 0
    x[500] = np.inf
    got = T.exponential(x, 2.0)
    assert np.isfinite(got[:500]).all() and np.isinf(got[500:]).all()
