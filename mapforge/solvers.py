"""Solvers and map makers. State between passes is written tables; the driver holds scalars only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.numeric import NAN
from .operators.algebra import Identity, LinearOp
from .operators.projection import SAMPLE, back_project_weight
from .operators.storage import saved

INDEX = ["pixel"]


def combine(parts: list[tuple[float, DataFrame]], index: list[str] = INDEX) -> DataFrame:
    """Sum of c * x; a place that one of them lacks counts 0 there."""
    out = None
    for c, x in parts:
        p = x.select(*index, (F.col("value") * F.lit(float(c))).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(*index).agg(F.sum("value").alias("value"))


def dots(pairs: list[tuple[DataFrame, DataFrame]], index: list[str] = INDEX) -> list[float]:
    out = []
    for a, b in pairs:
        if a is b:
            out.append(a.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
        else:
            j = a.select(*index, F.col("value").alias("x")).join(b.select(*index, F.col("value").alias("y")), index)
            out.append(j.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0)
    return out


@dataclass
class Solution:
    x: DataFrame
    iterations: int
    error: float
    history: list[float] = field(default_factory=list)


def cg(a: LinearOp, b: DataFrame, x0: DataFrame | None = None, tol: float = 1e-5, most: int = 300, m: LinearOp | None = None, index: list[str] = INDEX, callback: Callable[[int, float], None] | None = None) -> Solution:
    """Preconditioned conjugate gradients for a symmetric positive operator.

    Stops when |r|^2 <= tol^2 |b|^2 and returns the best iterate; b = 0 gives 0. A start that is best already is returned as it is.
    """
    m = m or Identity()
    b = saved(b.select(*index, "value"), "cg")
    norm = dots([(b, b)], index)[0]
    zero = b.select(*index, F.lit(0.0).alias("value"))
    if norm == 0:
        return Solution(zero, 0, 0.0)
    x = saved(combine([(1.0, zero), (1.0, x0)], index), "cg") if x0 is not None else zero
    r = saved(combine([(1.0, b), (-1.0, a(x))], index), "cg") if x0 is not None else b
    z = saved(m(r), "cg") if not isinstance(m, Identity) else r
    d, delta = z, dots([(r, z)], index)[0]
    error = dots([(r, r)], index)[0] / norm
    best, least, history = x, error, [error]
    n = 0
    while n < most and error > tol * tol:
        n += 1
        q = saved(a(d), "cg")
        curve = dots([(d, q)], index)[0]
        if curve == 0:
            break
        alpha = delta / curve
        x = saved(combine([(1.0, x), (alpha, d)], index), "cg")
        r = saved(combine([(1.0, r), (-alpha, q)], index), "cg")
        z = saved(m(r), "cg") if not isinstance(m, Identity) else r
        old, (delta, rr) = delta, dots([(r, z), (r, r)], index)
        error = rr / norm
        history.append(error)
        if callback:
            callback(n, error)
        if error < least:
            best, least = x, error
        d = saved(combine([(1.0, z), (delta / old, d)], index), "cg")
    return Solution(best, n, math.sqrt(least), history)


def _begin(a: LinearOp, b: DataFrame, x0: DataFrame | None, index: list[str]) -> tuple[DataFrame, DataFrame, float]:
    """(x, r, |b|^2) that a solver of a general system starts from."""
    b = saved(b.select(*index, "value"), "solver")
    norm = dots([(b, b)], index)[0]
    zero = b.select(*index, F.lit(0.0).alias("value"))
    if x0 is None or norm == 0:
        return zero, b, norm
    x = saved(combine([(1.0, zero), (1.0, x0)], index), "solver")
    return x, saved(combine([(1.0, b), (-1.0, a(x))], index), "solver"), norm


def bicgstab(a: LinearOp, b: DataFrame, x0: DataFrame | None = None, tol: float = 1e-5, most: int = 300, m: LinearOp | None = None, index: list[str] = INDEX, callback: Callable[[int, float], None] | None = None) -> Solution:
    """Stabilised bi-conjugate gradients for any square operator, preconditioned from the right. Stops and returns like cg()."""
    m = m or Identity()
    x, r, norm = _begin(a, b, x0, index)
    if norm == 0:
        return Solution(x, 0, 0.0)
    shadow, p, v = r, None, None
    rho = alpha = omega = 1.0
    error = dots([(r, r)], index)[0] / norm
    best, least, history, n = x, error, [error], 0
    while n < most and error > tol * tol and omega != 0:
        old, rho = rho, dots([(shadow, r)], index)[0]
        if rho == 0:
            break
        beta = rho / old * alpha / omega
        p = r if p is None else saved(combine([(1.0, r), (beta, p), (-beta * omega, v)], index), "solver")
        y = p if isinstance(m, Identity) else saved(m(p), "solver")
        v = saved(a(y), "solver")
        seen = dots([(shadow, v)], index)[0]
        if seen == 0:
            break
        n += 1
        alpha = rho / seen
        s = saved(combine([(1.0, r), (-alpha, v)], index), "solver")
        z = s if isinstance(m, Identity) else saved(m(s), "solver")
        t = saved(a(z), "solver")
        tt, ts = dots([(t, t), (t, s)], index)
        omega = ts / tt if tt else 0.0
        x = saved(combine([(1.0, x), (alpha, y), (omega, z)], index), "solver")
        r = saved(combine([(1.0, s), (-omega, t)], index), "solver")
        error = dots([(r, r)], index)[0] / norm
        history.append(error)
        if callback:
            callback(n, error)
        if error < least:
            best, least = x, error
    return Solution(best, n, math.sqrt(least), history)


def cgs(a: LinearOp, b: DataFrame, x0: DataFrame | None = None, tol: float = 1e-5, most: int = 300, m: LinearOp | None = None, index: list[str] = INDEX, callback: Callable[[int, float], None] | None = None) -> Solution:
    """Conjugate gradients squared for any square operator, preconditioned from the right. Stops and returns like cg()."""
    m = m or Identity()
    x, r, norm = _begin(a, b, x0, index)
    if norm == 0:
        return Solution(x, 0, 0.0)
    shadow, p, q, rho = r, None, None, 1.0
    error = dots([(r, r)], index)[0] / norm
    best, least, history, n = x, error, [error], 0
    while n < most and error > tol * tol:
        old, rho = rho, dots([(shadow, r)], index)[0]
        if rho == 0:
            break
        if p is None:
            u = p = r
        else:
            beta = rho / old
            u = saved(combine([(1.0, r), (beta, q)], index), "solver")
            p = saved(combine([(1.0, u), (beta, q), (beta * beta, p)], index), "solver")
        v = saved(a(m(p)), "solver")
        seen = dots([(shadow, v)], index)[0]
        if seen == 0:
            break
        n += 1
        alpha = rho / seen
        q = saved(combine([(1.0, u), (-alpha, v)], index), "solver")
        z = saved(m(combine([(1.0, u), (1.0, q)], index)), "solver")
        x = saved(combine([(1.0, x), (alpha, z)], index), "solver")
        r = saved(combine([(1.0, r), (-alpha, a(z))], index), "solver")
        error = dots([(r, r)], index)[0] / norm
        history.append(error)
        if callback:
            callback(n, error)
        if error < least:
            best, least = x, error
    return Solution(best, n, math.sqrt(least), history)


# Functions with derivatives


class Objective:
    """value(x) is a number, gradient(x) a vector; sums of them are objectives."""

    def value(self, x: DataFrame) -> float:
        raise NotImplementedError

    def gradient(self, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __add__(self, other: Objective) -> Objective:
        return _Sum([self, other])


class _Sum(Objective):
    def __init__(self, parts: list[Objective]):
        self.parts = parts

    def value(self, x: DataFrame) -> float:
        return sum(p.value(x) for p in self.parts)

    def gradient(self, x: DataFrame) -> DataFrame:
        return combine([(1.0, p.gradient(x)) for p in self.parts], [c for c in x.columns if c != "value"])


class NormOf(Objective):
    """scale * norm(operator x - data), with a norm as an aggregate and its gradient as a column; both of a value column."""

    def __init__(self, operator: LinearOp, data: DataFrame | None, norm, gradient, scale: float = 1.0):
        self.operator, self.data, self.norm, self.slope, self.scale = operator, data, norm, gradient, scale

    def residual(self, x: DataFrame) -> DataFrame:
        y = self.operator(x)
        return y if self.data is None else combine([(1.0, y), (-1.0, self.data)], [c for c in y.columns if c != "value"])

    def value(self, x: DataFrame) -> float:
        return self.scale * (self.residual(x).agg(self.norm(F.col("value"))).first()[0] or 0.0)

    def gradient(self, x: DataFrame) -> DataFrame:
        r = self.residual(x)
        g = r.withColumn("value", self.scale * self.slope(F.col("value")))
        return self.operator.adjoint(g)


class Ellipsoid(Objective):
    """x^T A x for a symmetric operator; the identity makes it the squared norm."""

    def __init__(self, a: LinearOp, scale: float = 1.0, index: list[str] = INDEX):
        self.a, self.scale, self.index = a, scale, index

    def value(self, x: DataFrame) -> float:
        return self.scale * dots([(x, x if isinstance(self.a, Identity) else self.a(x))], self.index)[0]

    def gradient(self, x: DataFrame) -> DataFrame:
        return self.a(x).withColumn("value", 2 * self.scale * F.col("value"))


def numeric_gradient(f: Objective, x: DataFrame, index: list[str] = INDEX, step: float = 1e-6) -> list[tuple]:
    """(index, slope) by central differences, one place after the other: for tests of small vectors."""
    out = []
    for r in x.collect():
        at = None
        for c in index:
            at = F.col(c) == r[c] if at is None else at & (F.col(c) == r[c])
        h = step * max(1.0, abs(r["value"]))
        moved = lambda d, at=at: x.withColumn("value", F.col("value") + F.when(at, d).otherwise(0.0))
        out.append((*[r[c] for c in index], (f.value(moved(h)) - f.value(moved(-h))) / (2 * h)))
    return out


def quadratic_step(f: Objective, x: DataFrame, d: DataFrame, index: list[str] = INDEX) -> float:
    """The exact step for a quadratic objective: the slope at two places gives its curvature."""
    s0 = dots([(f.gradient(x), d)], index)[0]
    s1 = dots([(f.gradient(combine([(1.0, x), (1.0, d)], index)), d)], index)[0]
    return -s0 / (s1 - s0) if s1 != s0 else 0.0


def armijo_step(f: Objective, x: DataFrame, d: DataFrame, index: list[str] = INDEX, first: float = 1.0, c: float = 1e-4, shrink: float = 0.5, most: int = 30) -> float:
    """Halves the step until the objective falls enough."""
    v0, s0, a = f.value(x), dots([(f.gradient(x), d)], index)[0], first
    for _ in range(most):
        if f.value(combine([(1.0, x), (a, d)], index)) <= v0 + c * a * s0:
            return a
        a *= shrink
    return 0.0


def wolfe_step(f: Objective, x: DataFrame, d: DataFrame, index: list[str] = INDEX, first: float = 1.0, c1: float = 1e-4, c2: float = 0.1, most: int = 20) -> float:
    """A step that fulfils the strong Wolfe conditions, by bisection of a bracket."""
    v0, s0 = f.value(x), dots([(f.gradient(x), d)], index)[0]
    low, high, a = 0.0, math.inf, first
    for _ in range(most):
        y = saved(combine([(1.0, x), (a, d)], index), "search")
        if f.value(y) > v0 + c1 * a * s0:
            high = a
        else:
            s = dots([(f.gradient(y), d)], index)[0]
            if abs(s) <= c2 * abs(s0):
                return a
            if s < 0:
                low = a
            else:
                high = a
        a = (low + high) / 2 if high < math.inf else 2 * a
    return low or a


STEPS = {"quadratic": quadratic_step, "armijo": armijo_step, "wolfe": wolfe_step}


def nlcg(f: Objective, x0: DataFrame, method: str = "pr", search: str = "quadratic", tol: float = 1e-6, most: int = 300, restart: int = 50, index: list[str] = INDEX, callback: Callable[[int, float], None] | None = None) -> Solution:
    """Non-linear conjugate gradients; method fr, pr or hs. Restarts every `restart` passes or when the factor is not positive."""
    if method not in ("fr", "pr", "hs"):
        raise ValueError(f"unknown method {method!r}; known: fr, pr, hs")
    step = STEPS[search]
    x = saved(x0.select(*index, "value"), "nlcg")
    r = saved(combine([(-1.0, f.gradient(x))], index), "nlcg")
    d, rr = r, dots([(r, r)], index)[0]
    first, history, n = rr, [], 0
    while n < most and rr > tol * tol * first and rr > 0:
        n += 1
        x = saved(combine([(1.0, x), (step(f, x, d, index), d)], index), "nlcg")
        new = saved(combine([(-1.0, f.gradient(x))], index), "nlcg")
        nn, nr = dots([(new, new), (new, r)], index)
        if method == "fr":
            beta = nn / rr
        elif method == "pr":
            beta = (nn - nr) / rr
        else:
            nd, rd = dots([(new, d), (r, d)], index)
            beta = -(nn - nr) / (nd - rd) if nd != rd else 0.0
        if beta <= 0 or n % restart == 0:
            beta = 0.0
        d = saved(combine([(1.0, new), (beta, d)], index), "nlcg") if beta else new
        r, rr = new, nn
        history.append(rr / first)
        if callback:
            callback(n, rr / first)
    return Solution(x, n, math.sqrt(rr / first) if first else 0.0, history)


# Map makers


def mapper_naive(matrix: DataFrame, tod: DataFrame, sample: list[str] = SAMPLE, value: str = "value", mask: str | None = "masked", npixels: int | None = None) -> DataFrame:
    """(pixel, value, coverage): weighted means of the unmasked samples that see a pixel.

    A pixel that only masked samples see has coverage 0 and the value NaN; with npixels, so has one that none sees.
    """
    sums = back_project_weight(matrix, tod, sample, value, mask)
    if npixels is not None:
        every = matrix.sparkSession.range(npixels).select(F.col("id").cast("int").alias("pixel"))
        sums = every.join(sums, "pixel", "left")
    cover = F.coalesce(F.col("weight"), F.lit(0.0))
    return sums.select("pixel", F.when(cover != 0, F.col(value) / cover).otherwise(NAN).alias("value"), cover.alias("coverage"))


def mapper_ls(tod: DataFrame, h: LinearOp, invntt: LinearOp | None = None, **options) -> Solution:
    return mapper_rls(tod, h, invntt, hyper=0.0, **options)


def mapper_rls(tod: DataFrame, h: LinearOp, invntt: LinearOp | None = None, hyper: float = 1.0, priors: list[LinearOp] | None = None, x0: DataFrame | None = None, tol: float = 1e-5, most: int = 300, m: LinearOp | None = None, unpacking: LinearOp | None = None, index: list[str] = INDEX, callback=None, solver: Callable[..., Solution] = cg) -> Solution:
    """Regularised least squares: (H^T N^-1 H + sum of hyper * n_tod / n_map * D^T D) x = H^T N^-1 y by conjugate gradients.

    tod has its sample columns and value, masked samples at 0. Values that are not finite are an error. solver is cg, cgs or bicgstab.
    """
    n = invntt or Identity()
    b = saved((h.T @ n)(tod.select(*[c for c in tod.columns if c != "masked"])), "rls")
    if b.filter(F.isnan("value") | (F.abs(F.col("value")) == float("inf"))).limit(1).count():
        raise ValueError("the back-projected signal is not finite")
    a = h.T @ n @ h
    if hyper and priors:
        scale = hyper * tod.count() / max(b.count(), 1)
        for d in priors:
            a = a + (d.T @ d) * scale
    got = solver(a, b, x0, tol, most, m, index, callback)
    return Solution(unpacking(got.x), got.iterations, got.error, got.history) if unpacking else got


def mapper_nl(tod: DataFrame, h: LinearOp, x0: DataFrame, norms: list | None = None, priors: list[LinearOp] = [], hypers: list[float] = [], unpacking: LinearOp | None = None, **options) -> Solution:
    """Any norms: scale * norm(H x - y) + sum of hyper / n_map * norm(D x), by non-linear conjugate gradients.

    norms holds (norm, gradient) for the data and for each prior; squared norms unless given.
    """
    from .operators.aggregates import norm2, norm2_gradient

    norms = norms or [(norm2, norm2_gradient)] * (1 + len(priors))
    n_tod, n_map = tod.count(), x0.count()
    f: Objective = NormOf(h, tod, *norms[0], scale=1.0 / max(n_tod, 1))
    for d, hyper, (norm, slope) in zip(priors, hypers, norms[1:]):
        f = f + NormOf(d, None, norm, slope, hyper / max(n_map, 1))
    got = nlcg(f, x0, **options)
    return Solution(unpacking(got.x), got.iterations, got.error, got.history) if unpacking else got


def golden_section(f: Callable[[float], float], low: float, high: float, tol: float = 1e-3) -> float:
    """The place of a function's least value between two bounds."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def compute_delay(tod: DataFrame, model: Callable[[float], LinearOp], low: float, high: float, hyper: float = 0.0, priors: list[LinearOp] | None = None, invntt: LinearOp | None = None, tol: float = 1e-2, **options) -> float:
    """The delay whose regularised map leaves the least residual."""

    def criterion(delay: float) -> float:
        h = model(delay)
        x = mapper_rls(tod, h, invntt, hyper, priors, **options).x
        r = NormOf(h, tod.drop("masked") if "masked" in tod.columns else tod, lambda v: F.sum(v * v), lambda v: 2 * v)
        return r.value(x)

    return golden_section(criterion, low, high, tol)
