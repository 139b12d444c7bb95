"""Polygons: areas and tests as array columns, hulls and pixel overlaps in numpy for use inside Arrow functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def shoelace(x: Column, y: Column) -> Column:
    """Signed area of polygons given as arrays of corners; counter-clockwise is positive."""
    n = F.size(x)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, i) * F.get(y, F.pmod(i + 1, n)) - F.get(x, F.pmod(i + 1, n)) * F.get(y, i))
    return F.when(n >= 3, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2).otherwise(0.0)


def area(x: np.ndarray, y: np.ndarray) -> float:
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def inside(px: float, py: float, x: np.ndarray, y: np.ndarray) -> int:
    """1 inside a polygon, 0 on its edge, -1 outside."""
    odd = False
    for x1, y1, x2, y2 in zip(x, y, np.roll(x, -1), np.roll(y, -1)):
        cross = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
        if cross == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return 0
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return 1 if odd else -1


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the points on the convex hull, counter-clockwise from the leftmost of the lowest; straight edges have no inner points."""
    order = np.lexsort((x, y))
    if len(order) < 3:
        return order

    def chain(points) -> list[int]:
        out: list[int] = []
        for i in points:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (x[i] - x[a]) * (y[b] - y[a]) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out[:-1]

    found = chain(order) + chain(order[::-1])
    return np.array(found if found else [int(order[0])])


def clipped_area(x: np.ndarray, y: np.ndarray, x0: float, y0: float) -> float:
    """Signed area of a polygon inside the unit square with lower corner (x0, y0), by clipping it with each side in turn."""
    pts = list(zip((x - x0).tolist(), (y - y0).tolist()))
    for axis, limit, sign in ((0, 0.0, 1), (0, 1.0, -1), (1, 0.0, 1), (1, 1.0, -1)):
        out = []
        for p, q in zip(pts, pts[1:] + pts[:1]):
            dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if dp >= 0:
                out.append(p)
            if dp * dq < 0:
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        pts = out
        if len(pts) < 3:
            return 0.0
    a = np.array(pts)
    return area(a[:, 0], a[:, 1])


def _clipped(px: np.ndarray, py: np.ndarray, limit: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Polygons (rows of corners) cut at x = limit; what lies on the side of the sign `keep` stays. Unused corners repeat the last one."""
    n, v = px.shape
    qx, qy = np.roll(px, -1, axis=1), np.roll(py, -1, axis=1)
    dp, dq = keep * (px - limit), keep * (qx - limit)
    cross = dp * dq < 0
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(cross, dp / (dp - dq), 0.0)
    x, y, live = np.empty((n, 2 * v)), np.empty((n, 2 * v)), np.empty((n, 2 * v), bool)
    x[:, 0::2], y[:, 0::2], live[:, 0::2] = px, py, dp >= 0
    x[:, 1::2], y[:, 1::2], live[:, 1::2] = px + t * (qx - px), py + t * (qy - py), cross
    order = np.argsort(~live, axis=1, kind="stable")[:, : v + 1]
    count = live.sum(axis=1)
    last = np.minimum(np.arange(v + 1)[None, :], np.maximum(count - 1, 0)[:, None])
    at = np.take_along_axis(order, last, axis=1)
    x, y = np.take_along_axis(x, at, axis=1), np.take_along_axis(y, at, axis=1)
    none = count == 0
    x[none], y[none] = limit, 0.0
    return x, y


def overlaps_many(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For convex polygons with one number of corners (rows of x and y, in 1-based pixel coordinates): the polygon, pixel and area of
    every overlap, in row order of pixels, and for each polygon whether part of it lies outside the map."""
    left, right = np.floor(x.min(axis=1) + 0.5).astype(np.int64), np.ceil(x.max(axis=1) - 0.5).astype(np.int64)
    low, high = np.floor(y.min(axis=1) + 0.5).astype(np.int64), np.ceil(y.max(axis=1) - 0.5).astype(np.int64)
    cut = (left < 1) | (low < 1) | (right > nx) | (high > ny)
    left, low, right, high = np.maximum(left, 1), np.maximum(low, 1), np.minimum(right, nx), np.minimum(high, ny)
    wide, tall = np.maximum(right - left + 1, 0), np.maximum(high - low + 1, 0)
    n = wide * tall
    who = np.repeat(np.arange(len(x)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = left[who] + step % np.maximum(wide[who], 1), low[who] + step // np.maximum(wide[who], 1)
    areas = np.empty(len(who))
    for at in range(0, len(who), 100_000):
        part = slice(at, at + 100_000)
        px, py = x[who[part]] - (i[part, None] - 0.5), y[who[part]] - (j[part, None] - 0.5)
        for limit, keep in ((0.0, 1), (1.0, -1)):
            px, py = _clipped(px, py, limit, keep)
        for limit, keep in ((0.0, 1), (1.0, -1)):
            py, px = _clipped(py, px, limit, keep)
        areas[part] = np.abs((px * np.roll(py, -1, axis=1) - np.roll(px, -1, axis=1) * py).sum(axis=1)) / 2
    on = areas > 0
    return who[on], (i - 1 + (j - 1) * nx)[on], areas[on], cut


def overlaps(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> tuple[list[tuple[int, float]], bool]:
    """(pixel, area) of the map's pixels that one convex polygon covers, in row order; whether part lies outside."""
    _, pixels, areas, cut = overlaps_many(np.asarray(x, float)[None, :], np.asarray(y, float)[None, :], nx, ny)
    return list(zip(pixels.tolist(), areas.tolist())), bool(cut[0])
