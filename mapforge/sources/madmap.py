"""MADMAP1 files: time-ordered data with their pointing matrix, and noise filters.

A file has an int64 header (first, last, pixels for each sample, pixels of the map), then slice by slice, detector by detector,
sample by sample a real64 value and for each of its pixels a real32 weight and an int32 number. Sizes are checked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import RangeFile, by_range

#: Records that a task takes apart at a time.
BLOCK = 1 << 17


def record(npps: int, endian: str) -> np.dtype:
    e = {"little": "<", "big": ">"}[endian]
    return np.dtype([("value", e + "f8"), ("pixels", [("weight", e + "f4"), ("pixel", e + "i4")], (npps,))])


def header(data: bytes, endian: str = "little") -> tuple[int, int, int, int]:
    """(first, last, pixels for each sample, pixels of the map)."""
    if len(data) < 32:
        raise ValueError("the header is cut off")
    return tuple(int(x) for x in np.frombuffer(data, {"little": "<i8", "big": ">i8"}[endian], 4))


def decode(data: bytes, slices: list[int], ndetectors: int, endian: str = "little") -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """All records, in the order of the file; slices are the samples of each slice."""
    h = header(data, endian)
    kind = record(h[2], endian)
    expected = 32 + sum(slices) * ndetectors * kind.itemsize
    if len(data) != expected:
        raise ValueError(f"the file has {len(data)} bytes, not {expected}")
    return np.frombuffer(data, kind, offset=32), h


def encode(values: np.ndarray, weights: np.ndarray, pixels: np.ndarray, npixels: int, first: int = 0, endian: str = "little") -> bytes:
    """The file of values (samples) and weights and pixels (samples, npps)."""
    out = np.zeros(len(values), record(weights.shape[1], endian))
    out["value"], out["pixels"]["weight"], out["pixels"]["pixel"] = values, weights, pixels
    return np.array([first, first + len(values) - 1, weights.shape[1], npixels], {"little": "<i8", "big": ">i8"}[endian]).tobytes() + out.tobytes()


def _places(slices: list[int], ndetectors: int, first: int, stop: int) -> list[pa.Array]:
    """slice, det and t of the records [first, stop)."""
    ends = np.cumsum(np.array(slices, np.int64) * ndetectors)
    at = np.arange(first, stop)
    s = np.searchsorted(ends, at, side="right")
    n = np.array(slices, np.int64)[s]
    inner = at - (ends[s] - n * ndetectors)
    return [pa.array(s.astype(np.int32)), pa.array((inner // n).astype(np.int32)), pa.array(inner % n)]


def read_tod(spark: SparkSession, path: str, slices: list[int], ndetectors: int, endian: str = "little") -> DataFrame:
    """(slice, det, t, value, entries array<struct<pixel, weight>>); entries stop at the first pixel of -1.

    The driver reads the header and checks the size; each task reads its own records.
    """
    with RangeFile(path) as f:
        kind = record(header(f.read(0, min(32, f.size)), endian)[2], endian)
        count = sum(slices) * ndetectors
        if f.size != 32 + count * kind.itemsize:
            raise ValueError(f"the file has {f.size} bytes, not {32 + count * kind.itemsize}")

    def decode_block(files, first, stop):
        part = np.frombuffer(files[0].read(32 + first * kind.itemsize, (stop - first) * kind.itemsize), kind)
        pix, w = part["pixels"]["pixel"].astype(np.int32), part["pixels"]["weight"].astype(np.float32)
        live = np.logical_and.accumulate(pix >= 0, axis=1)
        pairs = pa.StructArray.from_arrays([pa.array(pix[live]), pa.array(w[live])], ["pixel", "weight"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(live.sum(axis=1))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*_places(slices, ndetectors, first, stop), pa.array(part["value"].astype(float)), pa.ListArray.from_arrays(offsets, pairs)], ["slice", "det", "t", "value", "entries"])

    return by_range(spark, [path], count, BLOCK, kind.itemsize, "slice int, det int, t long, value double, entries array<struct<pixel:int,weight:float>>", decode_block)


def matrix_of(tod: DataFrame) -> DataFrame:
    """The pointing matrix (slice, det, t, k, pixel, weight) of read_tod()."""
    return tod.select("slice", "det", "t", F.posexplode("entries").alias("k", "e")).select("slice", "det", "t", "k", "e.pixel", "e.weight")


def read_three(spark: SparkSession, signal: str, weight: str, pixel: str, slices: list[int], ndetectors: int, endian: str = "little") -> DataFrame:
    """(slice, det, t, value, pixel, weight) of three files with one pixel for each sample; a task reads its range of all three."""
    e = {"little": "<", "big": ">"}[endian]
    kinds = [np.dtype(e + k) for k in ("f8", "i4", "f4")]
    paths, names, total = [signal, pixel, weight], ["value", "pixel", "weight"], sum(slices) * ndetectors
    for path, name, kind in zip(paths, names, kinds):
        with RangeFile(path) as f:
            if f.size != total * kind.itemsize:
                raise ValueError(f"{name} has {f.size / kind.itemsize:g} values, not {total}")

    def decode_block(files, first, stop):
        cols = [np.frombuffer(f.read(first * k.itemsize, (stop - first) * k.itemsize), k).astype(k.newbyteorder("=")) for f, k in zip(files, kinds)]
        yield pa.RecordBatch.from_arrays([*_places(slices, ndetectors, first, stop), *map(pa.array, cols)], ["slice", "det", "t", *names])

    return by_range(spark, paths, total, BLOCK, 16, "slice int, det int, t long, value double, pixel int, weight float", decode_block)


def decode_filter(data: bytes, endian: str = "little") -> tuple[int, int, np.ndarray]:
    """(first, last, coefficients) of a noise filter file."""
    e = {"little": "<", "big": ">"}[endian]
    first, last, n = (int(x) for x in np.frombuffer(data, e + "i8", 3))
    if len(data) != 24 + 8 * (n + 1):
        raise ValueError(f"the filter has {len(data)} bytes, not {24 + 8 * (n + 1)}")
    return first, last, np.frombuffer(data, e + "f8", n + 1, 24).astype(float)


def encode_filter(first: int, last: int, coef: np.ndarray, endian: str = "little") -> bytes:
    e = {"little": "<", "big": ">"}[endian]
    return np.array([first, last, len(coef) - 1], e + "i8").tobytes() + np.asarray(coef, e + "f8").tobytes()


def read_filters(spark: SparkSession, pattern: str, ndetectors: int, endian: str = "little") -> DataFrame:
    """(slice, det, length, coef) of the files name.0, name.1 ...: detectors of a slice follow each other and agree in length."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                first, last, coef = decode_filter(data.as_buffer().to_pybytes(), endian)
                k = int(path.rsplit(".", 1)[1])
                yield pa.RecordBatch.from_arrays([pa.array([k // ndetectors], pa.int32()), pa.array([k % ndetectors], pa.int32()), pa.array([last - first + 1], pa.int64()), pa.array([coef], pa.list_(pa.float64()))], ["slice", "det", "length", "coef"])

    out = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "slice int, det int, length long, coef array<double>")
    odd = out.groupBy("slice").agg(F.count("*").alias("n"), F.min("length").alias("a"), F.max("length").alias("b")).filter(f"n <> {ndetectors} or a <> b").limit(1).collect()
    if odd:
        raise ValueError(f"slice {odd[0].slice} has {odd[0].n} filters with lengths {odd[0].a} to {odd[0].b}")
    return out


def map_mask(sky: DataFrame, missing: float | None = None, value: str = "value") -> DataFrame:
    """(pixel, masked): masked where the value is not 0 or, if missing is given, where it is that value, NaN or infinite."""
    v = F.col(value)
    if missing is None:
        bad = v != 0
    elif missing != missing:
        bad = F.isnan(v)
    elif abs(missing) == float("inf"):
        bad = F.abs(v) == float("inf")
    else:
        bad = v == missing
    return sky.select("pixel", bad.alias("masked"))
