"""Packing documents into sequences: bounded-space online packing, then a merge of what is left over.

Each partition keeps a fixed number of open windows. A document is cut into full sequences, which are closed at
once, and a rest, which goes to the open window that it leaves least room in. If it fits in none, the fullest
window is emitted and a new one opened. The windows still open at the end of a partition are leftovers; groups of
partitions pack theirs again, level by level, until one group is left. Its open windows are the last sequences.

Which pieces go where depends only on the order of rows in a partition, and each level is a written table, so a
task that is run again after a loss places nothing twice.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, in_batches, pieces, saved
from .tokens import CHUNK, borrowed

#: Sequence length, open windows of a partition, and partitions whose leftovers one task merges.
LENGTH, OPEN, FAN_IN = 1024, 256, 32
#: Bits of a window's number within its task.
_BITS = 36


class Packer:
    """Places items of 1 to length tokens; windows are numbered from base."""

    def __init__(self, length: int = LENGTH, most: int = OPEN, base: int = 0):
        self.length, self.most, self.next = length, most, base
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.full: list[int] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of an item."""
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.full.append(self.open.pop(0)[1])
            room, window = self.length, self.new()
        if room > size:
            bisect.insort(self.open, (room - size, window))
        else:
            self.full.append(window)
        return window, self.length - room


def _placed(docs: DataFrame, path: str, end_id: int, length: int, most: int, payload: str) -> DataFrame:
    """(doc_id, start, length, doc_tokens, window, offset, part, closed, payload) of each piece."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        packer = Packer(length, most, part_id << _BITS)
        held: dict[int, list] = {}  # rows of open windows; these are few

        def batch(rows: list, closed: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 6
            out = [pa.array(c, k) for c, k in zip(cols[:6], kinds)]
            last = pa.array(cols[6], pa.list_(pa.int32()) if payload == "ids" else pa.int64())
            return pa.RecordBatch.from_arrays([*out, pa.array([part_id] * len(rows), pa.int64()), pa.array([closed] * len(rows), pa.bool_()), last], ["doc_id", "start", "length", "doc_tokens", "window", "offset", "part", "closed", payload])

        with borrowed(path) as own:
            for part, texts in pieces(batches, limit=CHUNK):
                flat, sizes = own.encode(texts)
                done: list = []
                at = 0
                for doc, n in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                    ids = np.empty(n + 1, np.uint32)
                    ids[:n], ids[n] = flat[at : at + n], end_id
                    at += n
                    for start in range(0, n + 1, length):
                        piece = ids[start : start + length]
                        said = zlib.crc32(piece.astype("<u4").tobytes()) if payload == "ids_crc32" else piece.astype(np.int32)
                        if len(piece) == length:
                            done.append((doc, start, length, n + 1, packer.new(), 0, said))
                            continue
                        window, offset = packer.place(len(piece))
                        held.setdefault(window, []).append((doc, start, len(piece), n + 1, window, offset, said))
                for window in packer.full:
                    done.extend(held.pop(window))
                packer.full.clear()
                yield batch(done, True)
        yield batch([row for rows in held.values() for row in rows], False)

    kind = "ids array<int>" if payload == "ids" else "ids_crc32 long"
    return in_batches(column_names(docs, "doc_id", "text"), run, f"doc_id long, start long, length long, doc_tokens long, window long, offset long, part long, closed boolean, {kind}")


def _merged(left: DataFrame, level: int, length: int, most: int) -> DataFrame:
    """(window, into, base, part, size, closed): each leftover window's place in a new one. One task for each FAN_IN parts."""

    def run(key, table):
        group = key[0].as_py()
        packer = Packer(length, most, ((level + 1) << 56) | (group << _BITS))
        rows = sorted(zip(table.column("size").to_pylist(), table.column("window").to_pylist()), reverse=True)
        placed = [(w, *packer.place(size)) for size, w in rows]
        still = dict((w, length - room) for room, w in packer.open)
        return pa.table({
            "window": pa.array([p[0] for p in placed], pa.int64()), "into": pa.array([p[1] for p in placed], pa.int64()), "base": pa.array([p[2] for p in placed], pa.int64()),
            "part": pa.array([group] * len(placed), pa.int64()), "size": pa.array([still.get(p[1], 0) for p in placed], pa.int64()), "closed": pa.array([p[1] not in still for p in placed]),
        })

    grouped = left.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group")
    return grouped.applyInArrow(run, "window long, into long, base long, part long, size long, closed boolean")


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, most: int = OPEN, payload: str = "ids") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, payload), one row for each piece.

    Every document (null text: empty) is its token ids and end_id; each id lies in exactly one piece. payload is
    "ids" for the pieces' ids, or "ids_crc32" for their checksum as little-endian unsigned 32-bit integers.
    Rows that repeat a doc_id, or have none, are packed each by itself. No rows give no sequences.
    A task holds the pieces of its open windows, at most most * length tokens, and FAN_IN * most leftovers when merging.
    """
    first = saved(_placed(docs, path, end_id, length, most, payload), "pieces")
    at = first.filter("not closed").select("window", F.col("window").alias("into"), F.lit(0).cast("long").alias("base"))
    left = saved(first.filter("not closed").groupBy("window", "part").agg(F.sum("length").alias("size")), "leftovers")
    level = 0
    while True:
        moved = saved(_merged(left, level, length, most), "merged")
        step = moved.select(F.col("window").alias("into"), F.col("into").alias("next"), F.col("base").alias("more"))
        at = saved(at.distinct().join(step, "into", "left").select("window", F.coalesce("next", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")), "places")
        if moved.select("part").distinct().count() <= 1:
            break
        left = saved(moved.filter("not closed").select(F.col("into").alias("window"), "part", "size").distinct(), "leftovers")
        level += 1
    open_rows = first.filter("not closed").join(at, "window").select("doc_id", "start", "length", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"), payload)
    return first.filter("closed").select("doc_id", "start", "length", "doc_tokens", F.col("window").alias("sequence_id"), "offset", payload).union(open_rows)


def restored(packed: DataFrame) -> DataFrame:
    """(doc_id, ids): the documents back from pieces with ids; for checks of a round trip. Rows that repeat a doc_id, or have none, are run together."""
    parts = packed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return parts.select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
