"""Observations: frames files with signal, masks and status, and simulated ones.

Slices are files or sections of them (file[first:last]). Tables come out in the form of the data model: tod (slice, det,
t, value, masked), pointing (slice, t, time, ra, dec, pa, chop, info, masked, removed).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import section
from ..operators import masks, pointing, timeline
from . import fits
from .ranges import RangeFile, by_range

#: Time between samples before on-board compression, in seconds.
PERIOD = 0.024996
#: Detectors (rows, columns, size of a sub-array) of each band.
BANDS = {"blue": (32, 64, 16), "green": (32, 64, 16), "red": (16, 32, 8)}
#: On-board compression factors that each mode may have, by band.
MODES = {
    "prime": {"blue": (4,), "green": (4,), "red": (4,)}, "parallel": {"blue": (8,), "green": (8,), "red": (4,)},
    "transparent": {"blue": (1,), "green": (1,), "red": (1,)}, "unknown": {b: (1, 2, 4, 8) for b in ("blue", "green", "red")}, "calibration": {b: (4,) for b in ("blue", "green", "red")},
}


def detector_order(rows: int, columns: int, block: int) -> np.ndarray:
    """(row, column) of detectors in their order: sub-array by sub-array, row by row within."""
    out = [(r0 + r, c0 + c) for r0 in range(0, rows, block) for c0 in range(0, columns, block) for r in range(block) for c in range(block)]
    return np.array(out)


def detectors(spark: SparkSession, band: str, size: float = 1.0, transparent: bool = False, reject_bad_line: bool = False) -> DataFrame:
    """The detector table of a band: order, place, centre, corners, area; bad line and transparent mode reject some."""
    rows, columns, block = BANDS[band]
    order = detector_order(rows, columns, block)
    number = spark.createDataFrame([(int(r), int(c), i) for i, (r, c) in enumerate(order)], "row int, column int, det int")
    grid = pointing.detector_grid(spark, rows, columns, size).drop("det").join(number, ["row", "column"])
    off = F.lit(False)
    if reject_bad_line and band != "red":
        off = off | ((F.col("row") == 11) & F.col("column").between(16, 31))
    if transparent:
        off = off | ~((F.col("row") < block) & (F.col("column") < block))
    return grid.withColumn("area", F.lit(float(size * size))).withColumn("removed", off).withColumn("masked", F.lit(False))


@dataclass
class Observation:
    tod: DataFrame
    pointing: DataFrame
    unit: str = "Jy / detector"
    slices: list[dict] = field(default_factory=list)

    def get_tod(self, subtract_mean: bool = True, flat: DataFrame | None = None) -> DataFrame:
        """Signal of kept samples: over the detector's flat field, then less its mean; not finite becomes 0 and masked."""
        kept = self.pointing.filter("not removed").select("slice", "t", F.col("masked").alias("__p"))
        t = self.tod.join(kept, ["slice", "t"]).withColumn("masked", F.col("masked") | F.col("__p")).drop("__p")
        if flat is not None:
            t = t.join(F.broadcast(flat.select("det", "flat")), "det").withColumn("value", F.col("value") / F.col("flat")).drop("flat")
        t = masks.filter_nonfinite(t, "value")
        return timeline.subtract_mean(t, ["slice", "det"], "value", "masked") if subtract_mean else t

    def __str__(self) -> str:
        return "\n".join(f"slice {r['slice']}, phase {r['info']}: {r['kept']} kept, {r['masked']} masked, {r['removed']} removed" for r in masks.summary(self.pointing).orderBy("slice", "info").collect())


def frames_bytes(signal: np.ndarray, status: Mapping[str, np.ndarray], mask: Mapping[str, np.ndarray], header: Mapping[str, object] = {}, unit: str = "Jy / detector") -> bytes:
    """A frames file of a signal (row, column, time), status columns and masks (row, column, time), packed 32 samples a word."""
    out = fits.image_bytes(np.zeros((), np.int32).reshape(1), header) + fits.image_bytes(signal, {"QTTY____": unit}, "Signal") + fits.table_bytes(status, "Status")
    names = list(mask)
    out += fits.image_bytes(np.zeros(1, np.int32), {"DSETS___": len(names), **{f"DS_{i}": n for i, n in enumerate(names)}}, "MASK")
    for n in names:
        m = mask[n].astype(np.uint32)
        words = np.zeros((*m.shape[:2], -(-m.shape[2] // 32)), np.uint32)
        for b in range(32):
            part = m[:, :, b::32]
            words[:, :, : part.shape[2]] |= part << np.uint32(b)
        out += fits.image_bytes(words.view(np.int32), {"INFO____": ""}, n)
    return out


def open_frames(spark: SparkSession, files: list[str], policy: masks.Policy = masks.Policy(), use_masks: str | list[str] = "activated", period: float = PERIOD, extension: float = 0.0) -> Observation:
    """Frames files as an observation; each file is one slice, decoded by the executor that reads it."""
    tods, points, slices = [], [], []
    for s, name in enumerate(files):
        base = name.partition("[")[0]
        status = read_status(spark, base).withColumn("slice", F.lit(s))
        total = status.count()
        _, first, last = section(name[len(base) :], total)
        slices.append({"slice": s, "file": base, "first": first, "last": last})
        p = masks.flags(status, period, extension).select("slice", "t", "time", "ra", "dec", "pa", "chop", "info", F.lit(False).alias("invalid"))
        p = masks.apply_policy(p, policy)
        points.append(p.withColumn("removed", F.col("removed") | ~F.col("t").between(first - 1, last - 1)))
        tods.append(read_signal(spark, base, use_masks, first - 1, last).withColumn("slice", F.lit(s)))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return Observation(union(tods), union(points), slices=slices)


def read_status(spark: SparkSession, file: str) -> DataFrame:
    """(t, time_us, time, bbid, ra, dec, pa, chop) of a frames file."""

    with RangeFile(file) as f:
        header, place, size = fits.named(fits.units(f.read, f.size), "Status")
    width, total = int(header["NAXIS1"]), int(header["NAXIS2"])

    def decode(files, low, high):
        c = {k.lower(): v for k, v in fits.rows(files[0].read(place + low * width, (high - low) * width), header, high - low).items()}
        start = {k.lower(): v for k, v in fits.rows(files[0].read(place, width), header, 1).items()}["finetime"].astype(np.int64)[0]
        us = c["finetime"].astype(np.int64)
        cols = [np.arange(low, high), us, (us - start) / 1e6, c["bbid"].astype(np.int64), *(c[k].astype(float) for k in ("raarray", "decarray", "paarray", "chopfpuangle"))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["t", "time_us", "time", "bbid", "ra", "dec", "pa", "chop"])

    return by_range(spark, [file], total, 1 << 16, width, "t long, time_us long, time double, bbid long, ra double, dec double, pa double, chop double", decode)


def read_signal(spark: SparkSession, file: str, use_masks: str | list[str], first: int, stop: int) -> DataFrame:
    """(det, t, value, masked) of the samples [first, stop) of a frames file; detectors are numbered row by row.

    The driver reads headers; each task reads these samples of its detectors, and nothing else.
    """

    def chosen(name: str, active: bool) -> bool:
        if isinstance(use_masks, list):
            return name.lower() in [m.lower() for m in use_masks]
        return {"all": True, "activated": active, "deactivated": not active, "none": False}.get(use_masks, name.lower() == use_masks.lower())

    with RangeFile(file) as f:
        units = list(fits.units(f.read, f.size))
    h, place, _ = fits.named(units, "Signal")
    kind, n, ndetectors = np.dtype(fits.IMAGE[int(h["BITPIX"])]), int(h["NAXIS1"]), int(h["NAXIS2"]) * int(h["NAXIS3"])
    scale, zero, last = float(h.get("BSCALE", 1)), float(h.get("BZERO", 0)), min(stop, n)
    words, planes = -(-n // 32), []
    index = fits.named(units, "MASK")[0]
    for i in range(int(index.get("DSETS___", 0))):
        name = str(index[f"DS_{i}"])
        info, at, _ = fits.named(units, name)
        if chosen(name, "deactivated" not in str(info.get("INFO____", "")).lower()):
            planes.append(at)

    def decode(files, low, high):
        for det in range(low, high):
            raw = files[0].read(place + (det * n + first) * kind.itemsize, (last - first) * kind.itemsize)
            x, m = np.frombuffer(raw, kind).astype(float) * scale + zero, np.zeros(last - first, bool)
            w0, w1 = first // 32, -(-last // 32)
            for at in planes:
                packed = np.frombuffer(files[0].read(at + (det * words + w0) * 4, (w1 - w0) * 4), ">i4")
                bits = np.unpackbits(packed.astype("<i4").view(np.uint8), bitorder="little")
                m |= bits[first - 32 * w0 : last - 32 * w0].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, det, np.int32)), pa.array(np.arange(first, last)), pa.array(x), pa.array(m)], ["det", "t", "value", "masked"])

    width = max(last - first, 0) * kind.itemsize
    return by_range(spark, [file], ndetectors if width else 0, 16, width, "det int, t long, value double, masked boolean", decode)


def save(tod: DataFrame, status: DataFrame, path: str, rows: int, columns: int, unit: str = "Jy / detector", header: Mapping[str, object] = {}) -> None:
    """Writes one slice's signal and mask (det, t, value, masked) and its status as a frames file; a file fits the driver."""
    got = tod.select("det", "t", "value", "masked").toPandas()
    n = int(got["t"].max()) + 1
    signal, mask = np.full((rows * columns, n), np.nan), np.ones((rows * columns, n), bool)
    at = got["det"].to_numpy(), got["t"].to_numpy()
    signal[at], mask[at] = got["value"].to_numpy(float), got["masked"].to_numpy(bool)
    s = status.orderBy("t").drop("slice", "t", "interval").toPandas()
    data = frames_bytes(signal.reshape(rows, columns, n), {c: s[c].to_numpy() for c in s.columns}, {"MASTER": mask.reshape(rows, columns, n)}, header, unit)
    fits.write_bytes(tod.sparkSession, path, data)


def simulate(spark: SparkSession, points: DataFrame, band: str, mode: str, policy: masks.Policy = masks.Policy(), period: float = PERIOD) -> tuple[DataFrame, int]:
    """(pointing under a policy, compression factor) of a simulated observation; the factor comes from the median time step.

    A factor that the mode doesn't have in the band is an error.
    """
    got = masks.sampling(points, ["slice"], "t", "time", period).select("factor").distinct().collect()
    if len(got) != 1:
        raise ValueError("slices have different sampling intervals")
    factor = got[0][0]
    if mode not in MODES or factor not in MODES[mode][band]:
        raise ValueError(f"mode {mode!r} in band {band} has no compression factor {factor}")
    if "invalid" not in points.columns:
        points = points.withColumn("invalid", F.lit(False))
    return masks.apply_policy(points.drop("masked", "removed"), policy), factor


def noise_slice(noise: DataFrame, length: int, seed: int) -> DataFrame:
    """A contiguous run of `length` samples of real noise, at a place drawn from the seed, less each detector's mean."""
    total = noise.agg(F.max("t")).first()[0] + 1
    if length > total:
        raise ValueError(f"only {total} samples of noise")
    first = int(np.random.default_rng(seed).integers(0, total - length + 1))
    cut = noise.filter(F.col("t").between(first, first + length - 1)).withColumn("t", F.col("t") - first)
    return timeline.subtract_mean(cut, ["det"], "value")
