"""Byte ranges of one file, read by the tasks that need them, from any store that pyarrow.fs reaches or a mounted path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file for each task.
TASK_BYTES = 32 << 20


class RangeFile:
    """read(at, n) of an open file; an end of the file before that is an error."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self._file = store.open_input_file(inner)
        self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        out = self._file.read_at(n, at)
        if len(out) != n:
            raise ValueError("the file is cut off")
        return out

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()


def by_range(spark: SparkSession, paths: list[str], count: int, block: int, width: int, schema: str, decode: Callable[[list[RangeFile], int, int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """decode(files, from, to) for all blocks of at most `block` of `count` records; `width` is a record's bytes, which set the number of tasks."""
    blocks = -(-count // block)
    tasks = max(1, min(blocks, -(-count * width // TASK_BYTES)))

    def run(batches):
        files = [RangeFile(p) for p in paths]
        try:
            for b in batches:
                for i in b.column("id").to_pylist():
                    yield from decode(files, i * block, min((i + 1) * block, count))
        finally:
            for f in files:
                f.__exit__()

    return spark.range(0, blocks, 1, tasks).mapInArrow(run, schema)
