from __future__ import annotations

import numpy as np
import pytest
from helpers import same
from pyspark.sql import functions as F

from mapforge import streaming
from mapforge.functions.wcs import Wcs
from mapforge.operators import masks, pointing
from mapforge.sources import fits, madmap, observation, pipeline


def test_fits_images(spark, tmp_path):
    x = np.arange(12, dtype=np.float64).reshape(3, 4)
    data = fits.image_bytes(x, {"OBJECT": "it's", "META_0": 5, "key.META_0": "OBSID"}) + fits.image_bytes(x.astype(np.int32) + 1, name="Coverage")
    got, h = fits.image(data)
    assert (got == x).all() and h["OBJECT"] == "it's" and fits.keyword(h, "obsid") == 5 and fits.keyword(h, "none", 7) == 7
    with pytest.raises(fits.FitsError):
        fits.keyword(h, "none")
    with pytest.raises(fits.FitsError):
        fits.extension(data, "absent")
    path = str(tmp_path / "a.fits")
    fits.write_bytes(spark, path, data)
    same([r.value for r in fits.read_image(spark, path, "coverage").orderBy("i").collect()], (np.arange(12) + 1).tolist())
    assert fits.read_header(spark, path).filter("keyword = 'NAXIS1'").first().value == "4"


def test_fits_tables(spark, tmp_path):
    cols = {"N": np.array([1, 2], np.int64), "X": np.array([0.5, 1.5]), "S": np.array(["a", "bc"]), "B": np.array([True, False])}
    data = fits.image_bytes(np.zeros(1, np.int32)) + fits.table_bytes(cols, "Status")
    got, _ = fits.table(data, "status")
    assert all((got[k] == v).all() for k, v in cols.items())
    path = str(tmp_path / "t.fits")
    fits.write_bytes(spark, path, data)
    fits.register(spark)
    rows = spark.read.format("fits").option("extension", "Status").load(path).orderBy("N").collect()
    assert [tuple(r) for r in rows] == [(1, 0.5, "a", True), (2, 1.5, "bc", False)]


def test_map_round_trip(spark, tmp_path):
    w = Wcs.square((1.0, 2.0), 0.1, (3, 2))
    sky = spark.createDataFrame([(0, 1.5, 2.0), (5, 7.0, 1.0)], "pixel int, value double, coverage double")
    path = str(tmp_path / "m.fits")
    fits.write_map(sky, path, w.to_header(), coverage="coverage")
    got = {r.i: r.value for r in fits.read_image(spark, path).collect()}
    assert got[0] == 1.5 and got[5] == 7 and np.isnan(got[1])


@pytest.mark.parametrize("endian", ["little", "big"])
def test_madmap(spark, tmp_path, endian):
    n = 2 * (3 + 2)
    value, weight, pixel = np.arange(n) * 1.5, np.ones((n, 2), np.float32), np.stack([np.arange(n), np.full(n, -1)], 1)
    path = tmp_path / "tod.bin"
    path.write_bytes(madmap.encode(value, weight, pixel, 50, endian=endian))
    tod = madmap.read_tod(spark, str(path), [3, 2], 2, endian)
    rows = tod.orderBy("slice", "det", "t").collect()
    same([r.value for r in rows], value.tolist())
    assert [(r.slice, r.det, r.t) for r in rows][5:8] == [(0, 1, 2), (1, 0, 0), (1, 0, 1)] and all(len(r.entries) == 1 for r in rows)
    assert madmap.matrix_of(tod).count() == n
    with pytest.raises(ValueError):
        madmap.decode(path.read_bytes(), [3, 3], 2, endian)


def test_madmap_filters_and_three_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f.{k}").write_bytes(madmap.encode_filter(0, 9, np.array([1.0, 0.5, k])))
    got = madmap.read_filters(spark, str(tmp_path / "f.*"), 2).orderBy("slice", "det").collect()
    assert [(r.slice, r.det, r.length, r.coef[2]) for r in got] == [(0, 0, 10, 0), (0, 1, 10, 1), (1, 0, 10, 2), (1, 1, 10, 3)]
    np.arange(4.0).tofile(tmp_path / "s")
    np.ones(4, np.float32).tofile(tmp_path / "w")
    np.arange(4, dtype=np.int32).tofile(tmp_path / "p")
    three = madmap.read_three(spark, *(str(tmp_path / x) for x in "swp"), [2], 2)
    assert sorted((r.det, r.t, r.value, r.pixel) for r in three.collect()) == [(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 2, 2), (1, 1, 3, 3)]


def test_frames(spark, tmp_path):
    n = 40
    signal = np.random.default_rng(0).normal(size=(2, 2, n))
    signal[0, 0, 5] = np.nan
    mask = np.zeros((2, 2, n), bool)
    mask[1, 1, 33] = True
    bbid = np.where(np.arange(n) < 4, 0, 0xCD2 << 16)
    status = {"BBID": bbid.astype(np.int64), "FINETIME": (np.arange(n) * 100_000).astype(np.int64), "RaArray": np.linspace(1, 2, n), "DecArray": np.zeros(n), "PaArray": np.zeros(n), "CHOPFPUANGLE": np.zeros(n)}
    path = str(tmp_path / "f.fits")
    fits.write_bytes(spark, path, observation.frames_bytes(signal, status, {"GLITCH": mask}))
    obs = observation.open_frames(spark, [f"{path}[3:38]"])
    t = obs.get_tod(subtract_mean=False)
    rows = {(r.det, r.t): (r.value, r.masked) for r in t.collect()}
    assert len(rows) == 4 * (38 - 4) and rows[3, 33][1] and rows[0, 5] == (0.0, True) and rows[1, 7] == (signal[0, 1, 7], False)
    assert "slice 0" in str(obs)


def test_simulation_modes(spark):
    def points(factor):
        return pointing.scan(spark, (10.0, 20.0), 0.1, 0.01, 0.01, observation.PERIOD * factor, 2)

    assert observation.simulate(spark, points(4), "blue", "prime")[1] == 4
    with pytest.raises(ValueError):
        observation.simulate(spark, points(8), "red", "prime")
    assert observation.simulate(spark, points(1), "red", "transparent", masks.Policy(turnaround="remove"))[0].filter("removed").count() == 0


def test_detector_order():
    order = observation.detector_order(32, 64, 16)
    assert len(order) == 2048 and order[15].tolist() == [0, 15] and order[16].tolist() == [1, 0] and order[256].tolist() == [0, 16]


def test_configuration(spark, tmp_path):
    m = spark.createDataFrame([(0, t, 0, t % 2, 1.0) for t in range(12)], "det int, t long, k int, pixel int, weight float")
    y = spark.createDataFrame([(0, t, float(t % 2 + 1), False) for t in range(12)], "det int, t long, value double, masked boolean")
    m.write.parquet(str(tmp_path / "m"))
    y.write.parquet(str(tmp_path / "y"))
    config = pipeline.read_config(f"[main]\ntod = {tmp_path}/y\nmatrix = {tmp_path}/m\noutput = {tmp_path}/out\n[deglitching]\nmethod = mad\nnsigma = 25\n[mapper]\nkind = rls\nhyper = 0\n")
    assert config["deglitching"]["nsigma"] == 25.0
    pipeline.run(spark, config)
    assert sorted((r.pixel, round(r.value, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1.0), (1, 2.0)]
    with pytest.raises(ValueError):
        pipeline.read_config("[other]\nx = 1\n")
    with pytest.raises(ValueError):
        pipeline.typed("maybe", bool)


def test_from_frames_to_a_map(spark, tmp_path):
    """Two slices of 512 detectors: the naive map is the dense back-projection's ratio, written as an image."""
    rng = np.random.default_rng(5)
    names = []
    for s in range(2):
        n = 6
        signal, mask = rng.normal(10, 1, (16, 32, n)), rng.uniform(size=(16, 32, n)) < 0.1
        status = {"BBID": np.full(n, 0xCD2 << 16, np.int64), "FINETIME": (np.arange(n) * 100_000).astype(np.int64), "RaArray": 30 + np.arange(n) / 3600 * 4, "DecArray": np.full(n, 20 + s * 3 / 3600), "PaArray": np.zeros(n), "CHOPFPUANGLE": np.zeros(n)}
        names.append(str(tmp_path / f"f{s}.fits"))
        fits.write_bytes(spark, names[-1], observation.frames_bytes(signal, status, {"GLITCH": mask}))
    text = f"[main]\nfiles = {','.join(names)}\nband = red\nsize = 6.4\noutput = {tmp_path}/map.fits\n[projection]\nresolution = 6.4\nmethod = nearest\n[mapper]\nkind = "
    naive = {r.pixel: r for r in pipeline.run(spark, pipeline.read_config(text + "naive")).collect()}
    tod, matrix, wcs = pipeline.observed(spark, names, "red", 6.4, 6.4, "nearest")
    y = {(r.slice, r.det, r.t): r for r in tod.collect()}
    sums = {}
    for e in matrix.collect():
        v = y[e.slice, e.det, e.t]
        a = sums.setdefault(e.pixel, [0.0, 0.0])
        if not v.masked:
            a[0], a[1] = a[0] + e.weight * v.value, a[1] + e.weight
    assert len(y) == 2 * 512 * 6 and {p for p, a in sums.items() if a[1]} == {p for p, r in naive.items() if r.coverage}
    for p, (a, b) in sums.items():
        if b:
            assert abs(naive[p].value - a / b) < 1e-6 and abs(naive[p].coverage - b) < 1e-3
    got = {r.i: r.value for r in fits.read_image(spark, str(tmp_path / "map.fits")).collect()}
    assert len(got) == wcs.naxis[0] * wcs.naxis[1] and all(abs(got[p] - r.value) < 1e-9 for p, r in naive.items() if r.coverage)
    with pytest.raises(ValueError):
        pipeline.run(spark, pipeline.read_config(text + "other"))


def test_compressed_maps(spark):
    rows = [(d, t, float(d + t), t == 3 and d == 0) for d in range(2) for t in range(4)]
    tod = spark.createDataFrame(rows, "det int, t long, value double, masked boolean")
    matrix = spark.createDataFrame([(d, t, 0, t // 2, 1.0) for d in range(2) for t in range(4)], "det int, t long, k int, pixel int, weight double")
    y, sky, share = pipeline.maps(tod, matrix, 2)
    assert sorted((r.det, r.t, r.value, r.masked) for r in y.collect()) == [(0, 0, 0.5, False), (0, 1, 2.5, True), (1, 0, 1.5, False), (1, 1, 3.5, False)]
    assert sorted((r.pixel, r.value, r.coverage) for r in sky.collect()) == [(0, 1.0, 2.0), (1, 3.5, 1.0)]
    assert sorted((r.pixel, r.value) for r in share.collect()) == [(0, 0.0), (1, 0.5)]
    with pytest.raises(ValueError):
        pipeline.maps(tod, matrix, 3)


def test_byte_ranges(spark, tmp_path, monkeypatch):
    """Several tasks read what one does; a file that is cut off is an error."""
    from mapforge.sources import ranges

    n = 3 * (5 + 4)
    value, weight, pixel = np.arange(n) * 1.5, np.ones((n, 1), np.float32), np.arange(n)[:, None]
    path = tmp_path / "tod.bin"
    path.write_bytes(madmap.encode(value, weight, pixel, 50))
    whole = [tuple(r) for r in madmap.read_tod(spark, str(path), [5, 4], 3).orderBy("slice", "det", "t").collect()]
    monkeypatch.setattr(ranges, "TASK_BYTES", 64)
    monkeypatch.setattr(madmap, "BLOCK", 4)
    tod = madmap.read_tod(spark, path.as_uri(), [5, 4], 3)
    assert tod.rdd.getNumPartitions() == 7 and [tuple(r) for r in tod.orderBy("slice", "det", "t").collect()] == whole
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        madmap.read_tod(spark, str(path), [5, 4], 3)
    cols = {"N": np.arange(100, dtype=np.int32), "X": np.linspace(0, 1, 100, dtype=np.float32)}
    table = str(tmp_path / "t.fits")
    fits.write_bytes(spark, table, fits.image_bytes(np.zeros(1, np.int32)) + fits.table_bytes(cols, "T"))
    fits.register(spark)
    read = spark.read.format("fits").option("extension", "t").load(table)
    assert read.dtypes == [("N", "int"), ("X", "float")] and [r.N for r in read.orderBy("N").collect()] == list(range(100))
    reader = fits.FitsTableSource({"path": table, "extension": "T"}).reader(None)
    monkeypatch.setattr(fits, "TASK_BYTES", 80)
    parts = reader.partitions()
    assert len(parts) == 10 and sum(b.num_rows for p in parts for b in reader.read(p)) == 100


def test_streams(spark, tmp_path):
    rows = [(i % 2, 1.0, float(i), i == 3) for i in range(6)]
    spark.createDataFrame(rows, "pixel int, weight double, value double, masked boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pixel int, weight double, value double, masked boolean").parquet(str(tmp_path / "in"))
    q = streaming.growing_map(stream).writeStream.format("memory").queryName("growing").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted((r.pixel, r.value, r.coverage) for r in spark.table("growing").collect()) == [(0, 2.0, 3.0), (1, 3.0, 2.0)]
    finally:
        q.stop()
    batch = spark.range(20).select(F.lit(0).alias("det"), F.timestamp_seconds(F.col("id") / 2).alias("at"), F.col("id").cast("double").alias("value"), F.lit(False).alias("masked"))
    assert sorted(r.value for r in streaming.compressed(batch, "at", 2.0).collect()) == [1.5, 5.5, 9.5, 13.5, 17.5]


def test_save_and_reload(spark, tmp_path):
    from mapforge.sources import instrument

    p = pointing.scan(spark, (10.0, 20.0), 0.1, 0.01, 0.05, 0.1, 2)
    n = p.count()
    tod = spark.range(4).crossJoin(spark.range(n).withColumnRenamed("id", "t")).select(F.col("id").cast("int").alias("det"), "t", (F.col("id") * 100 + F.col("t")).cast("double").alias("value"), (F.col("t") == 3).alias("masked"))
    path = str(tmp_path / "saved.fits")
    observation.save(tod, instrument.status_of(p), path, 2, 2)
    obs = observation.open_frames(spark, [path], masks.Policy(other="keep"))
    got = {(r.det, r.t): (r.value, r.masked) for r in obs.tod.collect()}
    assert got == {(r.det, r.t): (r.value, r.masked) for r in tod.collect()}
    same([r.ra for r in obs.pointing.orderBy("t").collect()], [r.ra for r in p.orderBy("t").collect()])


def test_instrument_keywords(spark):
    from mapforge.sources import instrument

    assert instrument.band({"CAMNAME": "Blue Photometer", "BLUE": "blue2"}) == "green" and instrument.band({"CAMNAME": "Red"}) == "red"
    assert instrument.compression_factor("Floating Average  : 4 values") == 4 and instrument.compression_factor("None") == 1
    for f, bad in ((instrument.band, {"CAMNAME": "x"}), (instrument.compression_factor, "zip"), (instrument.check_fine_sampling, 3)):
        with pytest.raises(ValueError):
            f(bad)
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, 3)], "x double, y bigint")
    assert instrument.widened([a, b]).dtypes == [("x", "double"), ("y", "bigint")]
    with pytest.raises(ValueError):
        instrument.widened([a, b.drop("y")])
    s = spark.createDataFrame([(0, "BS"), (1, "R "), (2, "BL")], "t long, band string")
    assert [r.invalid for r in instrument.invalid_band(s, "green").orderBy("t").collect()] == [True, True, False]
