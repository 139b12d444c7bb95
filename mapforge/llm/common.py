"""Reading tables, and writing intermediate ones to the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch that goes to Python. Spark's own bound is 64 MB, and both sides hold a batch twice while it grows.
BATCH_BYTES = 8_000_000
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
#: Bytes of a shuffled part up to which a join holds it as a hash table; Spark asks for at least its advisory size of a part, by default this.
HASHED_BYTES = 64 << 20
_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
#: Characters of text that a Python worker takes apart at a time; bounds its memory whatever the batch holds.
CHUNK_CHARS = 3_000_000
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of all the word and line rules: [\\x20\\x09-\\x0D].
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mapforge-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder: lineage is cut, and a lost executor loses nothing.

    What the driver held for the step is garbage then. Collecting it at once lets Spark's cleaner delete the step's
    shuffle files, which else stay on the executors' disks until the driver happens to collect.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, name: str) -> DataFrame:
    """A small side of a join by a key that may be hot, as a table of its own.

    Right below a join, a grouped side would keep the optimiser from splitting the other side's largest partitions: its rows
    of one key would all go to one task.
    """
    return saved(df, name)


@contextmanager
def hashed_joins(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile join shuffled sides by hash, without sorting them, if no part of one is over HASHED_BYTES.

    That is decided by the sizes of the shuffled parts, so larger ones are sorted. A value that was chosen in the session stays.
    """
    before = spark.conf.get(_HASHED)
    if before.rstrip("b") == "0":
        spark.conf.set(_HASHED, str(HASHED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_HASHED, before)


def left_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns by a key that many rows of left may lack: those meet nothing, and are dealt evenly.

    An outer join deals rows by their key alone, so that all without one would go to one task. left is a written table,
    whose rows have the same numbers each time it is read; right has one row for each key.
    """
    salt = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).otherwise(F.lit(0).cast("long"))
    # Always 0, but not a constant, which the optimiser would take out of the join's keys again.
    none = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", none), [key, "__salt"], "left").drop("__salt")


def without_keys(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of docs, all columns, whose key is not in gone; those without a key, however many, stay and are not shuffled."""
    has = F.col(key).isNotNull()
    left = docs.filter(has).join(gone.select(key), key, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.filter(~has))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that is no longer read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_of(df: DataFrame) -> str:
    """The folder of a table made by saved()."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system. Workers are used again by later stages, whose own memory comes on top else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes, after which the worker gives back what it has freed.

    The bound is a setting of the session; one that was chosen there stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH).rstrip("b") == str(_BATCH_DEFAULT):
        conf.set(_BATCH, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches whose texts have about limit bytes together, with those texts (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(at, stop - at)
            yield part, ["" if t is None else t for t in texts.slice(at, stop - at).to_pylist()]
            at = stop


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive runs of values."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if offsets[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def column_names(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns; extra ones, whatever their names, don't reach an operator's own columns."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
