"""Small timelines and adjoint checks."""

from __future__ import annotations

import math

import numpy as np


def timeline(spark, values, masked=None, det=0, **extra):
    rows = [(det, i, float(v), bool(masked[i]) if masked is not None else False, *[e for e in extra.values()]) for i, v in enumerate(values)]
    kinds = "det int, t long, value double, masked boolean" + "".join(f", {n} {'double' if isinstance(e, float) else 'long'}" for n, e in extra.items())
    return spark.createDataFrame(rows, kinds)


def values(df, order="t", value="value"):
    return [r[value] for r in df.orderBy(order).collect()]


def same(a, b, tol=1e-9):
    assert len(a) == len(b), (a, b)
    for x, y in zip(a, b):
        assert (math.isnan(x) and math.isnan(y)) or abs(x - y) <= tol * max(1, abs(x), abs(y)), (a, b)


def dense(apply, n, m, spark):
    """The matrix of a linear map of timelines of n values to ones of m values."""
    out = np.zeros((m, n))
    for j in range(n):
        out[:, j] = values(apply(timeline(spark, np.eye(n)[j]).drop("masked")))
    return out
