"""Exact deduplication over an extendible-hash index on shared files.

A text's key is a 64-bit hash of it without white space. The directory has one entry for each value of the key's
top g bits and points to buckets, each with a depth of its own of at most g. A bucket that holds more bytes than a
page is split by its next bit; when its depth is that of the directory, the directory doubles. A bucket that cannot
be split further (many copies of one text) gets overflow pages, over which its rows are dealt by their ids.

The index is a folder of bucket pages, each one file with a single row group, sorted by key; the file format gives
a row group to one task only. An owner task walks its pages in key order and keeps a chain of the distinct texts of
the present key; a row is compared with them byte by byte. The chain's links are named by their SHA-256, so that the
pages of one bucket agree on names: bytes are compared within a page, and a group that is spread over overflow pages is
joined by key and SHA-256 alone. Only names and lengths, not texts, go on from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, apart, column_names, in_batches, new_path, partitions, saved, without_keys

#: Bytes of normalised text that a bucket page is meant to hold.
PAGE_BYTES = 32_000_000
#: Largest depth of the directory; it has 2 ** depth entries at most.
DEPTH = 20
#: Directory entries up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 1 << 16


class Directory:
    """An extendible-hash directory over counts of bytes by the key's top bits.

    Split by split, level by level: a level's splits need one doubling of the entries at most, so that all of them take time
    in proportion to the directory's final size. A bucket of depth d holds one value of the key's top d bits, hence a
    run of the sorted counts and a run of entries.
    """

    def __init__(self, sizes: dict[int, int], bits: int, page: int):
        """sizes: bytes for each value of the top `bits` bits that occurs."""
        self.bits, self.page, self.depth = bits, page, 0
        keys = np.array(sorted(sizes), np.int64)
        total = np.concatenate([[0], np.cumsum(np.array([sizes[k] for k in keys.tolist()], np.int64))])
        self.entries = np.zeros(1, np.int64)
        self.sizes, self.local = [int(total[-1])], [0]
        rows = [(0, 0, 0, len(keys))]  # bucket, prefix, and its run of counts
        while rows := [(b, p, i, j) for b, p, i, j in rows if self.sizes[b] > page and self.local[b] < bits and j - i > 1]:
            self.entries = np.repeat(self.entries, 2)
            self.depth += 1
            after = []
            for b, prefix, i, j in rows:
                middle = int(np.searchsorted(keys[i:j], (2 * prefix + 1) << (bits - self.depth))) + i
                new = len(self.sizes)
                self.sizes[b], held = int(total[middle] - total[i]), int(total[j] - total[middle])
                self.sizes.append(held)
                self.local[b] = self.depth
                self.local.append(self.depth)
                self.entries[2 * prefix + 1] = new
                after += [(b, 2 * prefix, i, middle), (new, 2 * prefix + 1, middle, j)]
            rows = after

    def size(self, b: int) -> int:
        return self.sizes[b]

    def pages(self, b: int) -> int:
        return max(1, -(-self.sizes[b] // self.page))

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(entry, bucket, number of its first page, its pages)."""
        pages = np.array([self.pages(b) for b in range(len(self.sizes))], np.int64)
        first = np.cumsum(pages) - pages
        own = self.entries
        return zip(range(len(own)), own.tolist(), first[own].tolist(), pages[own].tolist())


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def _keyed(docs: DataFrame) -> DataFrame:
    norm = column_names(docs, "doc_id", "text").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalised().alias("norm"))
    return norm.withColumn("key", F.xxhash64("norm"))


def directory(keyed: DataFrame, page: int, bits: int | None = None) -> Directory:
    """The directory for these rows. At most 2 ** DEPTH sums come to the driver, pre-aggregated; at first far fewer."""
    total = 0
    if bits is None:
        rough = keyed.groupBy(F.shiftrightunsigned("key", 56).alias("top")).agg(F.sum(F.octet_length("norm")).alias("n"))
        sizes = {r.top: r.n for r in rough.collect()}
        total = sum(sizes.values())
        bits = 8
        if total / page < 2**6:
            return Directory(sizes, bits, page)
        bits = min(DEPTH, max(9, (int(total / page)).bit_length() + 3))
    got = keyed.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("top")).agg(F.sum(F.octet_length("norm")).alias("n")).collect()
    return Directory({r.top: r.n for r in got}, bits, page)


def build_index(docs: DataFrame, page: int = PAGE_BYTES, bits: int | None = None) -> tuple[str, Directory]:
    """Writes the index; its folder and directory. Rows: bucket page, key, doc_id, points, normalised text."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    d = directory(keyed, page, bits)
    entries = list(zip(*d.rows()))
    kinds = ["entry", "bucket", "first", "pages"]
    table = spark.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(kinds, entries)}))
    if len(d.entries) <= BROADCAST_ENTRIES:
        table = F.broadcast(table)
    entry = F.shiftrightunsigned("key", 64 - d.depth) if d.depth else F.lit(0).cast("long")
    placed = keyed.withColumn("entry", entry).join(table, "entry").select(
        (F.col("first") + F.pmod(F.xxhash64("doc_id", "points"), "pages")).alias("page"), "key", "doc_id", "points", "norm"
    )
    folder = new_path(spark, "index")
    n = max(partitions(spark), min(sum(map(d.pages, range(len(d.sizes)))), 20 * partitions(spark)))
    # Pages are dealt in turn, so that no task gets several by chance. One row group for each file: only a page far beyond
    # its size, a single enormous text, could have two.
    placed.repartitionById(n, F.pmod("page", F.lit(n)).cast("int")).sortWithinPartitions("page", "key").write.option("parquet.block.size", str(1 << 30)).partitionBy("page").parquet(folder)
    return folder, d


def _owned(spark: SparkSession, folder: str) -> DataFrame:
    """(key, doc_id, points, row, link): each row with a number of its own and the name of its link in its key's chain."""

    def run(batches):
        page, key, chain = None, None, []
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            links = []
            norms = batch.column("norm")
            for i, (p, k) in enumerate(zip(batch.column("page").to_pylist(), batch.column("key").to_pylist())):
                if k != key or p != page:
                    page, key, chain = p, k, []
                own = norms[i].as_buffer().to_pybytes()
                for text, name in chain:
                    if text == own:
                        break
                else:
                    name = hashlib.sha256(own).digest()
                    chain.append((own, name))
                links.append(name)
            rows = pa.array(range(number, number + len(links)), pa.int64())
            number += len(links)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("points"), rows, pa.array(links, pa.binary())], ["key", "doc_id", "points", "row", "link"])

    kind = "page long, key long, doc_id long, points long, norm string"
    held = spark.read.schema(kind).parquet(folder)
    return in_batches(held.select("page", "key", "doc_id", "points", "norm"), run, "key long, doc_id long, points long, row long, link binary")


def exact_duplicates(docs: DataFrame, page: int = PAGE_BYTES, bits: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Texts are equal when they are identical without [\\x20\\x09-\\x0D]; null counts as empty, and empty texts are
    equal to each other. Of equal texts the row with the most code points stays, then the smallest doc_id. A row
    without a doc_id counts in its group but comes after all others of its length; if it stays, keep_id is null. Of
    rows that repeat both doc_id and length, all count in group_size and one at most is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder, _ = build_index(docs, page, bits)
    rows = saved(_owned(spark, folder), "owned")
    order = F.struct(F.col("points").alias("p"), F.col("doc_id").isNotNull().alias("q"), (-F.col("doc_id")).alias("d"), F.col("row").alias("r"))
    groups = rows.groupBy("key", "link").agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
    many = groups.filter("group_size > 1").select("key", "link", (-F.col("best.d")).alias("keep"), F.col("best.r").alias("stays"), "group_size")
    many = apart(many, "groups")
    joined = rows.join(many, ["key", "link"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("link")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that exact_duplicates() keeps.

    Rows without a doc_id stay. Of rows that repeat a doc_id those stay whose normalised text is kept, one for each.
    """
    rows = exact_duplicates(docs, **options)
    found = rows.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = found.filter("doc_id is not null and not kept").select("doc_id")
    left = without_keys(docs, gone, "doc_id")
    again = found.filter("doc_id is not null and n > 1").select("doc_id")
    texts = rows.join(again, "doc_id", "left_semi").groupBy("doc_id", F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("kept"))
    named = left.join(again, "doc_id", "left_semi").select(*docs.columns).withColumn("__sha", F.sha2(normalised(), 256))
    one = named.join(texts.filter("not kept").select("doc_id", "__sha"), ["doc_id", "__sha"], "left_anti").dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)
    return without_keys(left, again, "doc_id").union(one)
