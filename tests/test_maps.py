from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import same
from pyspark.sql import functions as F

from mapforge import solvers
from mapforge.functions import geometry
from mapforge.operators import algebra, deglitch, pointing, projection
from mapforge.operators.aggregates import norm2, norm2_gradient


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    rows = [(d, t, k, int(rng.integers(0, 8)), float(np.float32(rng.uniform(0.1, 1)))) for d in range(3) for t in range(12) for k in range(2)]
    m = spark.createDataFrame(rows, "det int, t long, k int, pixel int, weight float")
    h = np.zeros((36, 8))
    for d, t, _, p, w in rows:
        h[d * 12 + t, p] += np.float32(w)
    return m.cache(), h


def vec(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pixel int, value double")


def tod_of(spark, y):
    return spark.createDataFrame([(i // 12, i % 12, float(v)) for i, v in enumerate(y)], "det int, t long, value double")


def test_projection_and_adjoint(spark, small):
    m, h = small
    p = algebra.Projection(m)
    x, y = np.arange(8.0), np.linspace(-1, 1, 36)
    got = {(r.det, r.t): r.value for r in p(vec(spark, x)).collect()}
    assert np.allclose([got[i // 12, i % 12] for i in range(36)], h @ x)
    back = {r.pixel: r.value for r in p.T(tod_of(spark, y)).collect()}
    assert np.allclose([back.get(i, 0) for i in range(8)], h.T @ y)
    n = {(r.i, r.j): r.value for r in projection.normal_matrix(m).collect()}
    assert all(abs(v - (h.T @ h)[k]) < 1e-9 for k, v in n.items())


def test_a_repartition_changes_nothing(spark, small):
    m, _ = small
    y = tod_of(spark, np.linspace(-1, 1, 36)).withColumn("masked", F.col("t") == 3)
    a = sorted(map(tuple, solvers.mapper_naive(m, y).collect()))
    b = sorted(map(tuple, solvers.mapper_naive(m.repartition(7), y.repartition(5)).collect()))
    for p, q in zip(a, b):
        same(p, q, 1e-10)


def test_naive_map_of_masked_samples_is_empty(spark, small):
    m, _ = small
    y = tod_of(spark, np.ones(36)).withColumn("masked", F.lit(True))
    got = solvers.mapper_naive(m, y, npixels=9).collect()
    assert len(got) == 9 and all(math.isnan(r.value) and r.coverage == 0 for r in got)


def test_least_squares_solves_the_normal_equations(spark, small):
    m, h = small
    y = h @ np.arange(8.0)
    got = solvers.mapper_ls(tod_of(spark, y), algebra.Projection(m), tol=1e-10, most=12)
    x = {r.pixel: r.value for r in got.x.collect()}
    assert got.iterations <= 10 and np.allclose([x.get(i, 0) for i in range(8)], np.linalg.lstsq(h, y, rcond=None)[0], atol=1e-6)


def test_regularised_and_nonlinear_agree(spark, small):
    m, h = small
    y = h @ np.arange(8.0) + 0.1
    d = algebra.Difference([], "pixel")
    got = solvers.mapper_rls(tod_of(spark, y), algebra.Projection(m), hyper=0.2, priors=[d], tol=1e-9, most=20)
    dm = np.eye(8) - np.eye(8, k=1)
    dm[-1] = 0
    scale = 0.2 * 36 / 8
    want = np.linalg.solve(h.T @ h + scale * dm.T @ dm, h.T @ y)
    x = {r.pixel: r.value for r in got.x.collect()}
    assert np.allclose([x[i] for i in range(8)], want, atol=1e-5)
    zero = vec(spark, np.zeros(8))
    nl = solvers.mapper_nl(tod_of(spark, y), algebra.Projection(m), zero, [(norm2, norm2_gradient)] * 2, [d], [0.2], most=9, tol=1e-7)
    x = {r.pixel: r.value for r in nl.x.collect()}
    assert np.allclose([x[i] for i in range(8)], want, atol=1e-2)


def test_cg_edges(spark):
    zero = vec(spark, [0, 0])
    assert [r.value for r in solvers.cg(algebra.Identity(), zero).x.collect()] == [0, 0]
    b = vec(spark, [1, 2])
    got = solvers.cg(algebra.Homothety(2.0), b, x0=vec(spark, [0.5, 1.0]))
    assert got.iterations == 0 and sorted(r.value for r in got.x.collect()) == [0.5, 1.0]


@pytest.mark.parametrize("solver", [solvers.cgs, solvers.bicgstab])
def test_solvers_of_general_systems(spark, small, solver):
    m, h = small
    rows = np.linspace(0.5, 2, 8)  # scaled rows: not symmetric
    a = algebra.Diagonal(spark.createDataFrame([(i, float(v)) for i, v in enumerate(rows)], "pixel int, weight double"), ["pixel"]) @ algebra.Projection(m).T @ algebra.Projection(m)
    n = rows[:, None] * (h.T @ h)
    near = algebra.Diagonal(spark.createDataFrame([(i, float(1 / v)) for i, v in enumerate(np.diag(n))], "pixel int, weight double"), ["pixel"])
    b, told = n @ np.arange(8.0), []
    got = solver(a, vec(spark, b), tol=1e-6, most=24, m=near, callback=lambda k, e: told.append(k))
    x = {r.pixel: r.value for r in got.x.collect()}
    assert np.allclose([x[i] for i in range(8)], np.arange(8.0), atol=1e-3) and told == list(range(1, got.iterations + 1))
    assert solver(a, vec(spark, np.zeros(8))).iterations == 0
    assert solver(a, vec(spark, b), x0=vec(spark, np.arange(8.0))).iterations == 0


@pytest.mark.parametrize("search", ["armijo", "wolfe"])
def test_line_searches_go_down(spark, search):
    f = solvers.NormOf(algebra.Identity(), vec(spark, [1, 2]), norm2, norm2_gradient)
    x = vec(spark, [0, 0])
    step = solvers.STEPS[search](f, x, solvers.combine([(-1.0, f.gradient(x))]))
    assert 0 < step <= 1 and f.value(solvers.combine([(1.0, x), (-step, f.gradient(x))])) < f.value(x)


def test_golden_section():
    assert abs(solvers.golden_section(lambda x: (x - 0.3) ** 2, -1, 1, 1e-4) - 0.3) < 1e-3


def test_algebra_rules():
    i, z, d = algebra.Identity(), algebra.Zero(), algebra.Difference([], "pixel")
    assert (i @ d) is d and isinstance(z @ d, algebra.Zero) and (d + z) is d and isinstance(d * 0.0, (algebra.Zero, algebra.Composition))
    assert isinstance(algebra.Average([], "t", 1), algebra.Identity) and isinstance(i * 1.0, algebra.Identity) and d.T.T is d


def scene(spark, detectors=2, frames=10, bad=(0, 4)):
    m = spark.createDataFrame([(d, t, 0, 0, 1.0) for d in range(detectors) for t in range(frames)], "det int, t long, k int, pixel int, weight float")
    y = spark.createDataFrame([(d, t, 100.0 if (d, t) == bad else 1.0 + 0.01 * ((d * 7 + t * 3) % 5), False) for d in range(detectors) for t in range(frames)], "det int, t long, value double, masked boolean")
    return m, y


@pytest.mark.parametrize("method, nsigma", [("mad", 5.0), ("std", 2.5)])
def test_a_glitch_masks_all_detectors_of_its_frame(spark, method, nsigma):
    m, y = scene(spark)
    out = deglitch.deglitch(m, y, nsigma, method)
    assert sorted((r.det, r.t) for r in out.filter("masked").collect()) == [(0, 4), (1, 4)]
    assert deglitch.newly_masked(y, out) == pytest.approx(10.0)


def test_a_pixel_with_few_hits_is_not_judged(spark):
    m, y = scene(spark, frames=4, bad=(0, 2))
    assert deglitch.deglitch(m, y, 3.0, "mad").filter("masked").count() == 0


def test_overlaps_keep_the_area(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        cx, cy, a = rng.uniform(3, 7), rng.uniform(3, 7), rng.uniform(0, 6.3)
        c = [(cx + 1.3 * math.cos(a + k * math.pi / 2), cy + 1.3 * math.sin(a + k * math.pi / 2)) for k in range(4)]
        x, y = np.array([p[0] for p in c]), np.array([p[1] for p in c])
        found, cut = geometry.overlaps(x, y, 10, 10)
        assert not cut and abs(sum(w for _, w in found) - geometry.area(x, y)) < 1e-9
    square = np.array([0.6, 2.4, 2.4, 0.6]), np.array([0.6, 0.6, 2.4, 2.4])
    assert [p for p, _ in geometry.overlaps(*square, 100, 200)[0]] == [0, 1, 100, 101]
    df = spark.createDataFrame([(1, square[0].tolist(), square[1].tolist())], "id int, xs array<double>, ys array<double>")
    assert abs(pointing.overlap_matrix(df, ["id"], (100, 200)).agg(F.sum("weight")).first()[0] - 1.8**2) < 1e-6


def test_packing_pixels(spark, small):
    m, _ = small
    packed, table = projection.pack_pixels(m, projection.unobserved(m.filter("pixel in (1, 4, 6)"), 8))
    assert sorted(map(tuple, table.collect())) == [(1, 0), (4, 1), (6, 2)] and packed.count() == m.filter("pixel in (1, 4, 6)").count()


def test_ellipsoid_gradient(spark):
    d = algebra.DifferenceNormal([], "pixel")
    x = vec(spark, [1.0, 3.0, 2.0])
    for f in (solvers.Ellipsoid(d, 0.5), solvers.Ellipsoid(algebra.Identity())):
        want = sorted(solvers.numeric_gradient(f, x))
        got = sorted((r.pixel, r.value) for r in f.gradient(x).collect())
        assert all(abs(a[1] - b[1]) < 1e-5 for a, b in zip(want, got))


def test_overlaps_are_those_of_one_pixel_after_the_other():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, r, (cx, cy) = rng.uniform(0, 6.3), rng.uniform(0.2, 2), rng.uniform(-1, 12, 2)
        c = [(cx + r * math.cos(a + k * math.pi / 2), cy + r * math.sin(a + k * math.pi / 2)) for k in range(4)]
        x, y = np.array([p[0] for p in c]), np.array([p[1] for p in c])
        got = dict(geometry.overlaps(x, y, 10, 10)[0])
        for p in range(100):
            assert abs(got.get(p, 0) - abs(geometry.clipped_area(x, y, p % 10 + 0.5, p // 10 + 0.5))) < 1e-12


def test_positions_of_repeated_times(spark):
    p = spark.createDataFrame([(0, 60.0 + i, float(i * i), 0.0, 0.0, 0.0) for i in range(8)], "slice int, time double, ra double, dec double, pa double, chop double")
    asked = [59.0, 60.0, 61.0, 61.0, 63.5, 64.0, 64.0, 64.0, 67.0, 68.0, 68.5]
    got = sorted((r.time, r.ra) for r in pointing.position_at(p, spark.createDataFrame([(0, t) for t in asked], "slice int, time double")).collect())
    want = [-1.0, 0.0, 1.0, 1.0, 12.5, 16.0, 16.0, 16.0, 49.0, 62.0, math.nan]
    assert [t for t, _ in got] == asked
    same([x for _, x in got], want)


def test_sharp_matrix_by_clipping(spark):
    """Each weight is the area of a detector's projected corners within a pixel, by clipping polygon by polygon."""
    from mapforge.functions.wcs import Wcs

    w = Wcs.square((30.0, 20.0), 0.002, (12, 10))
    points = [(0, t, 30.0 + 0.0011 * t, 20.0 - 0.0007 * t, 17.0 * t) for t in range(4)]
    camera = pointing.detector_grid(spark, 2, 2, 9.0, 0.8, angle=10.0)
    got = {(r.t, r.det, r.pixel): r.weight for r in pointing.sharp_matrix(spark.createDataFrame(points, "slice int, t long, ra double, dec double, pa double"), camera, w).filter("weight > 1e-6").collect()}

    def clipped(poly, axis, bound, sign):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                f = a / (a - b)
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        return out

    want = {}
    for _, t, ra, dec, pa in points:
        for d in camera.collect():
            poly, c, s = [], math.cos(math.radians(pa)), math.sin(math.radians(pa))
            for u, v in zip(d.us, d.vs):
                dd = math.radians(dec + (-u * s + v * c) / 3600)
                a, d0 = math.radians(ra + (u * c + v * s) / 3600 / math.cos(math.radians(dec)) - 30), math.radians(20)
                k = math.sin(dd) * math.sin(d0) + math.cos(dd) * math.cos(d0) * math.cos(a)
                poly.append((6.5 - math.degrees(math.cos(dd) * math.sin(a) / k) / 0.002, 5.5 + math.degrees((math.sin(dd) * math.cos(d0) - math.cos(dd) * math.sin(d0) * math.cos(a)) / k) / 0.002))
            for x in range(12):
                for y in range(10):
                    left = poly
                    for axis, low in ((0, x + 0.5), (1, y + 0.5)):
                        left = clipped(clipped(left, axis, low, 1), axis, low + 1, -1) if left else left
                    area = abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(left, left[1:] + left[:1]))) / 2 if left else 0
                    if area > 1e-6:
                        want[t, d.det, x + 12 * y] = area
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_header_of_more_pixels_than_can_be_numbered(spark):
    """A header may be larger than a map; only the matrices, which number its pixels, refuse it."""
    from mapforge.functions.wcs import Wcs

    spots = [(ra, dec) for ra in (330.0, 30.0) for dec in (-30.0, 30.0)]
    points = spark.createDataFrame([(0, t, ra, dec, 0.0, False, False) for t, (ra, dec) in enumerate(spots)], "slice int, t long, ra double, dec double, pa double, masked boolean, removed boolean")
    camera = pointing.detector_grid(spark, 2, 2, 9.0, 0.8).withColumn("area", F.lit(81.0))
    w = pointing.map_header(points, camera, 3.0)
    corner = (9.0 / 2 + 9.0 * math.sqrt(0.8) / 2) / 3600
    far, up = math.radians(30 + corner / math.cos(math.radians(30))), math.radians(30 + corner)
    x, y = math.degrees(math.tan(far)) * 1200, math.degrees(math.tan(up) / math.cos(far)) * 1200
    assert w.naxis == tuple(math.floor(1 + v + 0.5) - math.floor(1 - v + 0.5) + 1 for v in (x, y)) and w.naxis[0] * w.naxis[1] > 2**31 - 1
    assert w.crpix == tuple(2 - math.floor(1 - v + 0.5) for v in (x, y)) and Wcs.from_header(w.to_header()) == w
    for matrix in (pointing.nearest_matrix, pointing.sharp_matrix):
        with pytest.raises(ValueError):
            matrix(points, camera, w)
