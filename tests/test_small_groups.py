"""Queries return detectors with few or no unmasked samples too, as the operators define them."""

from __future__ import annotations

import math

import pytest

from mapforge.plans import registry


@pytest.fixture
def short(spark, monkeypatch):
    rows = [(1, 0, 5.0, True), (1, 1, 7.0, True), (2, 0, 5.0, False), (2, 1, 9.0, True)] + [(3, i, 1.0 + 2 * i, False) for i in range(5)]
    df = spark.createDataFrame(rows, "det int, t long, value double, masked boolean")
    monkeypatch.setattr(registry.T, "tod", lambda spark, d: df)


def test_moments_of_short_detectors(spark, short):
    got = {r.det: r for r in registry.queries()["moment"](spark, "").collect()}
    assert {d: r.n for d, r in got.items()} == {1: 0, 2: 1, 3: 5}
    assert math.isnan(got[1].mean) and got[2].mean == 5 and math.isnan(got[2].variance) and got[3].variance == 10


@pytest.mark.parametrize("name", ["filter_line", "filter_polynomial"])
def test_filters_of_short_detectors(spark, short, name):
    got = {(r.det, r.t): r.value for r in registry.queries()[name](spark, "").collect()}
    want = {(1, 0): 5.0, (1, 1): 7.0, (2, 0): 0.0, (2, 1): 4.0} | {(3, i): 0.0 for i in range(5)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
