"""Near-duplicate detection by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature is 60 symbols of 16 bits. It is split into 12 chunks of 5 symbols. Two signatures that
differ in at most 23 symbols have, by the pigeonhole principle, a chunk with at most one differing symbol; all
chunk values with one symbol left out are enumerated as bucket keys, so such a pair always meets in a bucket.
(At a similarity of 0.75 a pair whose distance is larger still misses every bucket with probability 6e-6.)

Buckets don't emit all their pairs. Documents with equal shingle sets are one class first. In each bucket every
class is compared with the smallest one; verified links give components; only in buckets that still hold two or
more components can a link be missing. The classes of those are compared by an exact prefix join: shingles are
ordered by how often they occur among these classes, and two sets with the required similarity must share one of
the rarest (1 - 0.75) n + 1 shingles. Large groups of that join are families of copies; their pairs are compared
in blocks, of which only spanning links come out. Every pair that comes out of a join is decided on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, column_names, in_batches, left_by_key, pieces, saved, without_keys
from .components import components
from .shingles import mix, shingle_sets, signatures

SYMBOLS, CHUNK = 60, 5
#: Largest distance that every pair is found for.
GUARANTEED = 2 * (SYMBOLS // CHUNK) - 1
#: Documents of a group up to which its pairs are looked at one by one, and documents of a block in larger groups.
SMALL, BLOCK_DOCS = 32, 256


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set, which don't depend on order."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    rows = np.flatnonzero(np.diff(bounds))
    if len(rows):
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[i, rows] = np.add.reduceat(mix(values ^ np.uint64(salt)), bounds[rows])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): size, 128-bit fingerprint and signature of each document's shingle set."""

    def run(batches):
        for part, texts in pieces(batches):
            values, bounds = shingle_sets(texts)
            sizes, sums = np.diff(bounds), fingerprints(values, bounds)
            sig = signatures(values, bounds, SYMBOLS)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "sig"],
            )

    return in_batches(column_names(docs, "doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def bucket_keys(sigs: DataFrame) -> DataFrame:
    """(key, doc_id): each chunk of a signature with each one symbol left out."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, SYMBOLS).astype(np.uint64)
            keys = np.empty((n, SYMBOLS), np.int64)
            for c in range(0, SYMBOLS, CHUNK):
                for left in range(CHUNK):
                    h = np.full(n, c + left + 1, np.uint64)
                    for j in range(CHUNK):
                        if j != left:
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c + j])
                    keys[:, c + left] = h.view(np.int64)
            ids = np.repeat(np.asarray(batch.column("doc_id")), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "doc_id"])

    return in_batches(sigs.select("doc_id", "sig"), run, "key long, doc_id long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        last, other = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            hubs, xs, ys = (batch.column(c) for c in ("b", "x", "y"))
            for i in range(batch.num_rows):
                hub = hubs[i].as_py()
                if hub != last or other is None:
                    last, other = hub, np.frombuffer(ys[i].as_buffer(), np.uint64)
                own = np.frombuffer(xs[i].as_buffer(), np.uint64)
                small, large = min(len(own), len(other)), max(len(own), len(other))
                if 100 * small >= percent * large:
                    both = np.sort(np.concatenate([own, other]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return in_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted shingle hashes of wanted classes (doc_id, real, f1, f2), from rows of the doc_id `real`."""

    def run(batches):
        for part, texts in pieces(batches):
            values, bounds = shingle_sets(texts)
            f = fingerprints(values, bounds).view(np.int64)
            keep = (f[0] == np.asarray(part.column("f1"))) & (f[1] == np.asarray(part.column("f2")))
            sets = pa.array([values[i:j].tobytes() if k else None for i, j, k in zip(bounds[:-1], bounds[1:], keep)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("node"), sets], ["doc_id", "shingles"]).filter(pa.array(keep))

    named = wanted.select(F.col("doc_id").alias("node"), F.col("real").alias("doc_id"), "f1", "f2")
    return in_batches(column_names(docs, "doc_id", "text").join(named, "doc_id").select("node", "text", "f1", "f2"), run, "doc_id long, shingles binary")


def _prefixes(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, component): the rarest shingles of each set that an equal enough set must share one of.

    Shingles are ordered by the number of these sets that have them. A shingle of one set only is shared with none, so
    that it just takes up places; frequencies and places are exact.
    """

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column("shingles")]
                sizes = np.array([len(h) for h in held], np.int32)
                ids = np.repeat(np.asarray(part.column("doc_id")), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(ids), pa.array(np.repeat(sizes, sizes))], ["key", "doc_id", "n"])

    rows = saved(in_batches(sets, spread, "key long, doc_id long, n int"), "shingles")
    often = apart(rows.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    both = rows.join(often, "key")
    own = Window.partitionBy("doc_id")  # a document's shingles
    ranked = both.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "key")))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return saved(prefix.select("key", "doc_id").join(labels, "doc_id"), "prefixes")


def _blocks(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the documents of large groups (key, doc_id), enough of them to join up each component.

    Groups with a document in common are one cluster. A cluster is dealt into blocks; a task compares two blocks by a
    matrix product of their incidence of shared shingles and returns links that span what is linked there: it never
    holds more than two blocks, and the pairs themselves are not written anywhere.
    """
    least = hot.groupBy("key").agg(F.min("doc_id").alias("b"))
    edges = hot.join(least, "key").select(F.col("doc_id").alias("a"), "b")
    members = saved(components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).join(sets, "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    twice = dealt.withColumn("other", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), "doc_id", "shingles")

    def run(table):
        ids = table.column("doc_id").to_numpy()
        held = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        sizes = np.array([len(s) for s in held], np.int64)
        values, back, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        rows, cols = np.repeat(np.arange(len(held)), sizes), back
        keep = counts[cols] > 1
        common = np.zeros((len(held), len(held)), np.int64)
        for at in range(0, int((counts > 1).sum()), 4096):  # some columns at a time
            part = keep & (shared[cols] >= at) & (shared[cols] < at + 4096)
            m = np.zeros((len(held), 4096), np.float32)
            m[rows[part], shared[cols[part]] - at] = 1
            common += (m @ m.T).astype(np.int64)
        x, y = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1))
        up = list(range(len(held)))

        def top(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        out = []
        for v, w in zip(x.tolist(), y.tolist()):
            p, q = top(v), top(w)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((v, w))
        return pa.table({"a": pa.array([ids[v] for v, _ in out], pa.int64()), "b": pa.array([ids[w] for _, w in out], pa.int64())})

    return twice.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Documents are linked when 100 * intersection >= percent * union of their sets of 5-word shingles; component_id
    is the smallest doc_id reachable over links. A document with fewer than five words has its word sequence as its
    only shingle; one without words (or a null text) has an empty set and no link. Rows that repeat a doc_id are one
    document with all their links. A row whose doc_id is null is linked with nothing: component_id is null and it
    is kept. Further columns are ignored.
    """
    sigs = saved(sketches(docs), "signatures")
    real = sigs.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets are one class; its smallest document stands for it.
    classes = real.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("m"), F.count("*").alias("n"))
    # A doc_id that stands for several classes, because it is in several rows, gets other numbers for all but one.
    first = F.row_number().over(Window.partitionBy("m.doc_id").orderBy("f1", "f2", "n_shingles")) == 1
    node = F.when(first, F.col("m.doc_id")).otherwise(F.xxhash64("m.doc_id", "f1", "f2", "n_shingles"))
    heads = saved(classes.select("f1", "f2", "n_shingles", node.alias("doc_id"), F.col("m.doc_id").alias("real"), F.col("m.sig").alias("sig")), "classes")
    hubs = bucket_keys(heads).groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = apart(hubs.select("key", "hub"), "hubs")
    shared = saved(bucket_keys(heads).join(hubs, "key").select("key", "doc_id", "hub"), "buckets")

    stars = shared.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = heads.select("doc_id", "real", "f1", "f2").join(shared.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = saved(_full_sets(docs, wanted), "sets")
    links = saved(_confirmed(stars, sets, percent), "links")
    first = saved(components(links), "components")

    # Buckets that hold several components may hide further links.
    member = shared.select("key", "doc_id").join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = saved(member, "members")
    open_keys = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_keys = apart(open_keys, "open-keys")
    rest = saved(member.join(open_keys, "key").select("doc_id", "component").distinct(), "open")
    keyed = _prefixes(sets.join(rest.select("doc_id"), "doc_id", "left_semi"), rest, percent)
    groups = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
    groups = apart(groups, "mixed")
    live = saved(keyed.join(groups, "key"), "groups")
    one, two = (live.filter(F.col("n") <= SMALL).select("key", F.col("doc_id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    pairs = one.join(two, "key").filter("a > b and ca <> cb").select("a", "b").distinct()
    more = saved(_confirmed(pairs, sets, percent), "links")
    spans = saved(_blocks(live.filter(F.col("n") > SMALL).select("key", "doc_id"), sets, percent), "links")

    # Other rows of a class are linked with its number; so are all rows of one doc_id with each other.
    same = real.select("doc_id", "f1", "f2", "n_shingles").join(heads.select("f1", "f2", "n_shingles", F.col("doc_id").alias("head")), ["f1", "f2", "n_shingles"])
    copies = same.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    found = components(links.union(more).union(spans).union(copies))
    # Rows without a doc_id, and then those without a link, have no key in these joins; most documents are of that kind.
    rows = saved(left_by_key(sigs, found.select(F.col("node").alias("doc_id"), "component"), "doc_id").select("doc_id", "n_shingles", "component"), "rows")
    smallest = apart(rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "smallest")
    return left_by_key(rows, smallest, "component").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce(F.coalesce("least", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near-duplicates.

    Rows without a doc_id stay; rows that repeat a doc_id are one document and stay or go together.
    """
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    return without_keys(docs, gone, "doc_id")
