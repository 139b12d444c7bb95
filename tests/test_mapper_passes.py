"""The map makers' queries end by their tolerance."""

from __future__ import annotations

from mapforge.plans import registry


def test_tolerance_ends_the_non_linear_map_maker(spark, monkeypatch):
    told = {}
    monkeypatch.setattr(registry.T, "samples", lambda spark, d: spark.createDataFrame([(0, 0, 1.0)], "det int, t long, value double"))
    monkeypatch.setattr(registry.T, "matrix", lambda spark, d: spark.createDataFrame([(0, 0, 0, 0, 1.0)], "det int, t long, k int, pixel int, weight float"))

    def record(tod, h, x0, **options):
        told.update(options)
        return type("Got", (), {"x": x0})

    monkeypatch.setattr(registry.solvers, "mapper_nl", record)
    registry.queries()["mapper_nl"](spark, "")
    assert told == {"tol": 1e-3}
