"""Token-id files with directly addressable codes, and tables of documents in them.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, and a
bitmap that says which of them go on in level k + 1; a rank directory (the number of set bits before every block
of 512) turns a place in one level into the place in the next. Any token is found by at most four such steps,
without decoding what lies before it.

File layout, little-endian:
    8 bytes   magic "MFDAC001"
    u64       documents, u64 ids, u64 levels
    documents * (i64 doc_id, u64 first id in the file, u64 number of ids); a doc_id of none is -2^63
    per level: u64 entries, u64 words of the bitmap, entries * u8, pad to 8, words * u64, (blocks + 1) * u64 ranks
    u32       crc32 of all before
Files are written under another name and moved, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_names, in_batches, new_path, partitions, pieces, saved
from .tokens import CHUNK, borrowed

MAGIC = b"MFDAC001"
CHUNK_BITS, BLOCK_BITS = 8, 512
NO_ID = -(2**63)
#: Ids after which a task begins another file; bounds what is in memory at a time.
FILE_IDS = 2_000_000


class Level:
    """One chunk level with its continuation bitmap and rank directory."""

    def __init__(self, chunks: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.chunks, self.words, self.ranks = chunks, words, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> Level:
        goes_on = (values >> CHUNK_BITS) > 0
        bits = np.packbits(goes_on, bitorder="little")
        words = np.zeros(-(-len(values) // BLOCK_BITS) * (BLOCK_BITS // 64), np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        per_block = np.bitwise_count(words).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint64)
        return cls((values & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), words, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint64))

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before place i."""
        out = self.ranks[i // BLOCK_BITS].astype(np.int64)
        first = (i // BLOCK_BITS) * (BLOCK_BITS // 64)
        for w in range(BLOCK_BITS // 64):
            inside = np.clip(i - (first + w) * 64, 0, 64)
            at = np.minimum(first + w, len(self.words) - 1)
            masked = np.where(inside >= 64, self.words[at], self.words[at] & ((np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1)))
            out += np.where(inside > 0, np.bitwise_count(masked), 0).astype(np.int64)
        return out


class IdFile:
    """Ids with random access: file[i], file.get(places), file.run(start, stop)."""

    def __init__(self, levels: list[Level], docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.levels, self.docs, self.starts, self.sizes = levels, docs, starts, sizes

    def __len__(self) -> int:
        return len(self.levels[0].chunks) if self.levels else 0

    @classmethod
    def of(cls, ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> IdFile:
        levels, values = [], np.asarray(ids, np.uint32)
        while len(values):
            level = Level.of(values)
            levels.append(level)
            values = values[values >> CHUNK_BITS > 0] >> CHUNK_BITS
        return cls(levels, np.asarray(docs, np.int64), np.cumsum(sizes) - sizes, np.asarray(sizes, np.int64))

    def get(self, places) -> np.ndarray:
        """The ids at any places."""
        at = np.asarray(places, np.int64)
        out, left = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[left] |= level.chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            on = level.bit(at)
            left, at = left[on], level.rank(at[on])
            if not len(left):
                break
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.get([i])[0])

    def run(self, start: int, stop: int) -> np.ndarray:
        """Consecutive ids: one rank lookup for each level, then the bitmap in order."""
        at, n, place = int(start), int(stop - start), None
        if not n:
            return np.zeros(0, np.uint32)
        out = self.levels[0].chunks[at : at + n].astype(np.uint32)
        for k, (level, above) in enumerate(zip(self.levels, self.levels[1:]), 1):
            bits = np.unpackbits(level.words.view(np.uint8)[at >> 3 : (at + n + 7) >> 3], bitorder="little")[at & 7 :][:n]
            on = np.flatnonzero(bits.view(bool))
            if not len(on):
                break
            place = on if place is None else place[on]
            at, n = int(level.rank(np.array([at]))[0]), len(on)
            out[place] |= above.chunks[at : at + n].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
        return out

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<3Q", len(self.docs), len(self), len(self.levels)), np.stack([self.docs, self.starts, self.sizes], 1).astype("<i8").tobytes()]
        for v in self.levels:
            raw = v.chunks.tobytes()
            out += [struct.pack("<2Q", len(raw), len(v.words)), raw, b"\0" * (-len(raw) % 8), v.words.astype("<u8").tobytes(), v.ranks.astype("<u8").tobytes()]
        body = b"".join(out)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data) -> IdFile:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC or zlib.crc32(view[:-4]) != struct.unpack("<I", view[-4:])[0]:
            raise ValueError("not a whole token-id file")
        docs, _, levels = struct.unpack("<3Q", view[8:32])
        at = 32 + 24 * docs
        table = np.frombuffer(view[32:at], "<i8").reshape(docs, 3)
        found = []
        for _ in range(levels):
            entries, words = struct.unpack("<2Q", view[at : at + 16])
            at += 16
            chunks = np.frombuffer(view[at : at + entries], np.uint8)
            at += entries + -entries % 8
            bitmap = np.frombuffer(view[at : at + 8 * words], "<u8")
            at += 8 * words
            blocks = words // (BLOCK_BITS // 64) + 1
            found.append(Level(chunks, bitmap, np.frombuffer(view[at : at + 8 * blocks], "<u8")))
            at += 8 * blocks
        return cls(found, table[:, 0], table[:, 1], table[:, 2])


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Writes the documents' ids in ascending order of doc_id; the manifest (part, n, file, docs, ids) comes back.

    The folder must be shared by all executors. Null ids come first; null texts count as empty. Equal doc_ids stay
    side by side, in an order that the text decides. They may go to several tasks, since the text, and for equal rows
    a number, are keys of the range partitioning too.
    """

    def run(batches):
        task = TaskContext.get()
        part = task.partitionId()
        store, base = _store(folder)
        flats: list = []
        names: list = []
        sizes: list = []
        held, n = 0, 0

        def flush():
            nonlocal held, n
            name = f"ids-{part:06d}-{n:04d}.mfdac"
            data = IdFile.of(np.concatenate(flats), np.array(names, np.int64), np.array(sizes, np.int64)).to_bytes()
            with store.open_output_stream(f"{base}/_{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            store.move(f"{base}/_{name}.{task.taskAttemptId()}", f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()), "file": pa.array([name]), "docs": pa.array([len(names)], pa.int64()), "ids": pa.array([held], pa.int64())})
            flats.clear(), names.clear(), sizes.clear()
            held, n = 0, n + 1
            return row

        with borrowed(path) as own:
            for batch, texts in pieces(batches, limit=CHUNK):
                flat, each = own.encode(texts)
                whole = np.full(len(flat) + len(each), end_id, np.uint32)
                ends = np.cumsum(each + 1) - 1
                mask = np.ones(len(whole), bool)
                mask[ends] = False
                whole[mask] = flat
                flats.append(whole)
                names.extend(NO_ID if x is None else x for x in batch.column("doc_id").to_pylist())
                sizes.extend((each + 1).tolist())
                held += len(whole)
                if held >= FILE_IDS:
                    yield flush()
            if names:
                yield flush()

    spark = docs.sparkSession
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    # A text's beginning and hash, not the text, are compared where partitions are cut: bounds come to the driver.
    keyed = column_names(docs, "doc_id", "text").withColumn("begin", F.substring("text", 1, 32)).withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "begin", "hash", "number"]
    placed = keyed.repartitionByRange(max(2, partitions(spark)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return saved(in_batches(placed, run, "part long, n long, file string, docs long, ids long"), "manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids array<int>): every document's ids from the files, start counting the ids of all before it.

    The manifest has one row for each file of up to FILE_IDS ids; one sum for each part goes to the driver.
    """
    spark = manifest.sparkSession
    before, rows = 0, []
    for part, n in manifest.groupBy("part").agg(F.sum("ids")).orderBy("part").collect():
        rows.append((part, before))
        before += n
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("inside", inside).join(spark.createDataFrame(rows, "part long, first long"), "part")
    table = files.select("file", (F.col("first") + F.col("inside")).alias("base")).repartition(max(1, manifest.count()))

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as f:
                    held = IdFile.from_bytes(f.read())
                at = 0
                while at < len(held.docs):
                    stop = max(at + 1, int(np.searchsorted(held.starts, held.starts[at] + 1_000_000)))
                    begin, end = held.starts[at], held.starts[stop - 1] + held.sizes[stop - 1]
                    ids = held.run(int(begin), int(end)).astype(np.int32)
                    offsets = pa.array(np.append(held.starts[at:stop] - begin, end - begin).astype(np.int32))
                    docs = held.docs[at:stop]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, mask=docs == NO_ID), pa.array(held.starts[at:stop] + first), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "start", "ids"]
                    )
                    at = stop

    return in_batches(table, run, "doc_id long, start long, ids array<int>")


def written_and_read(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """What read_ids() gives of the files that write_ids() has made of docs. No rows give no files and no rows."""
    folder = folder or new_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, path, folder, end_id), folder)


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ids: crc32 over little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_batches(rows.select("doc_id", "start", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
