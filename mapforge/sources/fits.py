"""FITS images and binary tables, read by Spark from any store it reaches, written through its filesystem.

Headers are 80-character cards in blocks of 2880 bytes; keywords are case-insensitive, quotes in strings doubled.
`META_n` values are found by the names that `key.META_n` cards give them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import TASK_BYTES, RangeFile

BLOCK = 2880
IMAGE = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_COLUMN = {"L": "S1", "B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


class FitsError(ValueError):
    pass


def parse_value(text: str) -> object:
    text = text.strip()
    if text.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", text)
        return m[1].replace("''", "'").rstrip() if m else text
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E").replace("d", "e"))
        except ValueError:
            return text


def parse_header(data: bytes, at: int = 0) -> tuple[dict[str, object], int]:
    """(keywords, place behind the header)."""
    out: dict[str, object] = {}
    while at + 80 <= len(data):
        for card in range(BLOCK // 80):
            line = data[at + 80 * card : at + 80 * card + 80].decode("ascii", "replace")
            key = line[:8].strip().upper()
            if key == "END":
                return out, at + BLOCK
            if line.startswith("HIERARCH ") and "=" in line:
                name, _, value = line[9:].partition("=")
                out[name.strip().upper()] = parse_value(value)
            elif line[8:10] == "= ":
                out[key] = parse_value(line[10:])
        at += BLOCK
    raise FitsError("a header has no END")


def keyword(header: Mapping[str, object], name: str, *default: object) -> object:
    """A keyword's value, by its own name or that of a META_n card; an error if it is missing and no default is given."""
    name = name.upper()
    if name in header:
        return header[name]
    for k, v in header.items():
        if k.startswith("KEY.META_") and str(v).upper() == name:
            return header[k[4:]]
    if default:
        return default[0]
    raise FitsError(f"keyword {name} is missing")


def data_size(h: Mapping[str, object]) -> int:
    n = int(h.get("NAXIS", 0))
    if not n:
        return 0
    total = 1
    for i in range(1, n + 1):
        total *= int(h[f"NAXIS{i}"])
    return abs(int(h["BITPIX"])) // 8 * (total + int(h.get("PCOUNT", 0))) * int(h.get("GCOUNT", 1))


def hdus(data: bytes) -> Iterator[tuple[dict[str, object], int, int]]:
    """(header, start of its data, size) of each unit."""
    at = 0
    while at + BLOCK <= len(data):
        header, start = parse_header(data, at)
        size = data_size(header)
        if start + size > len(data):
            raise FitsError("a unit is cut off")
        yield header, start, size
        at = start + -(-size // BLOCK) * BLOCK


def units(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, object], int, int]]:
    """As hdus(), by read(at, n) of a file of `size` bytes: headers are read, data are not."""
    at = 0
    while at + BLOCK <= size:
        raw = read(at, BLOCK)
        while True:
            try:
                header, behind = parse_header(raw)
                break
            except FitsError:
                if at + len(raw) + BLOCK > size:
                    raise
                raw += read(at + len(raw), BLOCK)
        start, n = at + behind, data_size(header)
        if start + n > size:
            raise FitsError("a unit is cut off")
        yield header, start, n
        at = start + -(-n // BLOCK) * BLOCK


def extension(data: bytes, name: str | int | None) -> tuple[dict[str, object], int, int]:
    """The unit with this EXTNAME or number; without one the first that has data."""
    return named(hdus(data), name)


def named(all_units: Iterator[tuple[dict[str, object], int, int]], name: str | int | None) -> tuple[dict[str, object], int, int]:
    for i, (h, start, size) in enumerate(all_units):
        if (name is None and size) or (isinstance(name, int) and i == name) or (isinstance(name, str) and str(h.get("EXTNAME", "")).strip().lower() == name.lower()):
            return h, start, size
    raise FitsError(f"extension {name!r} is missing")


def image(data: bytes, name: str | int | None = None, first: int | None = None, last: int | None = None) -> tuple[np.ndarray, dict[str, object]]:
    """An image as an array with the fastest axis last, scaled by BSCALE and BZERO; first and last cut the slowest axis."""
    h, start, size = extension(data, name)
    shape = tuple(int(h[f"NAXIS{i}"]) for i in range(int(h["NAXIS"]), 0, -1))
    x = np.frombuffer(data, IMAGE[int(h["BITPIX"])], size // (abs(int(h["BITPIX"])) // 8), start).reshape(shape)
    x = x[first:last]
    if h.get("BSCALE", 1) != 1 or h.get("BZERO", 0) != 0:
        x = x * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))
    return x.astype(x.dtype.newbyteorder("=")), h


def table(data: bytes, name: str | int) -> tuple[dict[str, np.ndarray], dict[str, object]]:
    """A binary table's columns."""
    h, start, size = extension(data, name)
    return rows(data[start : start + size], h, int(h["NAXIS2"])), h


def rows(data: bytes, h: Mapping[str, object], count: int) -> dict[str, np.ndarray]:
    """The columns of `count` rows of a binary table with this header."""
    kinds = []
    for i in range(1, int(h["TFIELDS"]) + 1):
        m = re.match(r"(\d*)([A-Z])", str(h[f"TFORM{i}"]).strip())
        n, code = int(m[1] or 1), m[2]
        if code not in _COLUMN:
            raise FitsError(f"column format {h[f'TFORM{i}']} is not supported")
        label = str(h.get(f"TTYPE{i}", f"col{i}")).strip()
        kinds.append((label, f"S{n}") if code == "A" else (label, _COLUMN[code]) if n == 1 else (label, _COLUMN[code], (n,)))
    raw = np.frombuffer(data, np.dtype(kinds), count)
    out = {}
    for i, (label, *_) in enumerate(kinds, 1):
        c = raw[label]
        if str(h[f"TFORM{i}"]).strip().endswith("L"):
            out[label] = c == b"T"
        elif c.dtype.kind == "S":
            out[label] = np.char.rstrip(np.char.decode(c, "ascii"))
        else:
            out[label] = c.astype(c.dtype.newbyteorder("="))
    return out


def card(key: str, value: object) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{int(value):>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value)!r:>20}".replace("e", "E")
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    head = f"{key.upper():<8}= " if len(key) <= 8 and " " not in key and "." not in key else f"HIERARCH {key.upper()} = "
    return (head + text)[:80].ljust(80).encode("ascii", "replace")


_STRUCTURE = {"SIMPLE", "XTENSION", "BITPIX", "NAXIS", "EXTEND", "PCOUNT", "GCOUNT", "TFIELDS", "END", "BSCALE", "BZERO"}


def _header(cards: list[tuple[str, object]], extra: Mapping[str, object]) -> bytes:
    rows = [card(k, v) for k, v in cards] + [card(k, v) for k, v in extra.items() if k.upper() not in _STRUCTURE and not re.fullmatch(r"NAXIS\d+|T(TYPE|FORM|UNIT)\d+", k.upper()) and v is not None]
    raw = b"".join(rows) + b"END".ljust(80)
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def image_bytes(x: np.ndarray, header: Mapping[str, object] = {}, name: str | None = None) -> bytes:
    """An image unit (a primary one without a name), of int32, int64, float32 or float64; other kinds are widened."""
    x = np.asarray(x)
    kind = {"b": ">u1", "i": ">i8" if x.dtype.itemsize == 8 else ">i4", "u": ">i8", "f": ">f4" if x.dtype.itemsize == 4 else ">f8"}[x.dtype.kind]
    bits = {v: k for k, v in IMAGE.items()}[kind]
    cards = [("XTENSION", "IMAGE") if name else ("SIMPLE", True), ("BITPIX", bits), ("NAXIS", x.ndim), *[(f"NAXIS{i}", n) for i, n in enumerate(x.shape[::-1], 1)]]
    cards += [("PCOUNT", 0), ("GCOUNT", 1), ("EXTNAME", name)] if name else [("EXTEND", True)]
    raw = x.astype(kind).tobytes()
    return _header(cards, header) + raw.ljust(-(-len(raw) // BLOCK) * BLOCK, b"\0")


def table_bytes(columns: Mapping[str, np.ndarray], name: str, header: Mapping[str, object] = {}) -> bytes:
    kinds, forms, parts = [], [], []
    for label, c in columns.items():
        c = np.asarray(c)
        if c.dtype.kind == "b":
            c, code, kind = np.where(c, b"T", b"F"), "1L", "S1"
        elif c.dtype.kind in "US":
            c = np.char.encode(c.astype(str), "ascii", "replace")
            kind = f"S{max(c.dtype.itemsize, 1)}"
            code = kind[1:] + "A"
        else:
            code = {"i4": "1J", "i8": "1K", "i2": "1I", "u1": "1B", "f4": "1E", "f8": "1D"}[c.dtype.str[1:]]
            kind = ">" + c.dtype.str[1:]
        kinds.append((label, kind)), forms.append(code), parts.append(c)
    raw = np.zeros(len(parts[0]) if parts else 0, np.dtype(kinds))
    for (label, _), c in zip(kinds, parts):
        raw[label] = c
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", raw.dtype.itemsize), ("NAXIS2", len(raw)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(kinds))]
    for i, ((label, _), code) in enumerate(zip(kinds, forms), 1):
        cards += [(f"TTYPE{i}", label), (f"TFORM{i}", code)]
    body = raw.tobytes()
    return _header([*cards, ("EXTNAME", name)], header) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


# Spark


def read_image(spark: SparkSession, path: str, name: str | int | None = None) -> DataFrame:
    """(file, i, value): an image's values by their place, the fastest axis first."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content")):
                x = image(data.as_buffer().to_pybytes(), name)[0].ravel()
                for at in range(0, len(x), 1 << 20):
                    part = x[at : at + (1 << 20)].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["file", "i", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, i long, value double")


def read_header(spark: SparkSession, path: str, name: str | int | None = 0) -> DataFrame:
    """(file, keyword, value): cards of one unit, values as text."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content")):
                h = extension(data.as_buffer().to_pybytes(), name)[0]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(h)), pa.array(list(h)), pa.array([None if v is None else str(v) for v in h.values()], pa.string())], ["file", "keyword", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, keyword string, value string")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, by the filesystem of its path, from the driver: maps and small tables."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        out.close()


def write_map(sky: DataFrame, path: str, header: Mapping[str, object], value: str = "value", coverage: str | None = None) -> None:
    """A map (pixel, value, coverage) as an image, with its coverage as an extension. A map fits the driver: 2**31 - 1 pixels at most."""
    nx, ny = int(header["NAXIS1"]), int(header["NAXIS2"])
    got = sky.select("pixel", value, *([coverage] if coverage else [])).toPandas()

    def plane(c: str, empty: float) -> np.ndarray:
        x = np.full(nx * ny, empty)
        x[got["pixel"].to_numpy()] = got[c].to_numpy(float)
        return x.reshape(ny, nx)

    data = image_bytes(plane(value, np.nan), header)
    if coverage:
        data += image_bytes(plane(coverage, 0.0), header, "Coverage")
    write_bytes(sky.sparkSession, path, data)


class _TablePartition(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class FitsTableSource(DataSource):
    """spark.read.format("fits").option("extension", name).load(path): a binary table, whose rows are dealt by byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self):
        with RangeFile(self.options["path"]) as f:
            cols = rows(b"", _unit(f, self.options)[0], 0)
        kinds = {"b": "boolean", "U": "string"}
        width = {("u", 1): "short", ("i", 2): "short", ("i", 4): "int", ("i", 8): "long", ("f", 4): "float", ("f", 8): "double"}
        one = lambda c: kinds.get(c.dtype.kind) or width[(c.dtype.kind, c.dtype.itemsize)]
        return ", ".join(f"`{n}` {one(c) if c.ndim == 1 else f'array<{one(c)}>'}" for n, c in cols.items())

    def reader(self, schema):
        return _FitsTableReader(self.options)


def _unit(f: RangeFile, options: Mapping[str, str]) -> tuple[dict[str, object], int, int]:
    name = options.get("extension", "1")
    return named(units(f.read, f.size), int(name) if name.isdigit() else name)


class _FitsTableReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k: options[k] for k in ("path", "extension") if k in options}
        with RangeFile(self.options["path"]) as f:
            self.header, self.place, _ = _unit(f, self.options)
        self.width = int(self.header["NAXIS1"])

    def partitions(self):
        count, each = int(self.header["NAXIS2"]), max(1, TASK_BYTES // max(self.width, 1))
        return [_TablePartition(at, min(at + each, count)) for at in range(0, count, each)] or [_TablePartition(0, 0)]

    def read(self, partition):
        with RangeFile(self.options["path"]) as f:
            for at in range(partition.low, partition.high, 1 << 16):
                n = min(1 << 16, partition.high - at)
                cols = rows(f.read(self.place + at * self.width, n * self.width), self.header, n)
                cols = {k: c.astype(np.int16) if c.dtype.kind == "u" else c for k, c in cols.items()}
                yield pa.RecordBatch.from_arrays([pa.array(list(c) if c.ndim > 1 else c) for c in cols.values()], list(cols))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsTableSource)


def by_position(image_df: DataFrame, nx: int) -> DataFrame:
    """(x, y, value), 1-based, of read_image()."""
    return image_df.select((F.col("i") % nx + 1).alias("x"), (F.floor(F.col("i") / nx) + 1).alias("y"), "value")
