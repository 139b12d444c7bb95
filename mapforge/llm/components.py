"""Connected components of an edge table.

Alternating large-star and small-star passes, which any size of table takes. A table of at most FINISH edges, which is
counted first, is joined up by union-find in one task instead: that is 16 MB of edges, and a pass costs more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, in_batches, path_of, remove, saved

#: Edges up to which one task finishes.
FINISH = 1_000_000


def _joined_up(e: DataFrame) -> DataFrame:
    """(node, component) by union-find in one task."""

    def run(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
        nodes = np.fromiter(up, np.int64, len(up))
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([top(x) for x in part.tolist()], pa.int64())], ["node", "component"])

    return in_batches(e.coalesce(1), run, "node long, component long")


def _large_star(e: DataFrame) -> DataFrame:
    """For each node, its larger neighbours point to the smallest of itself and its neighbours."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself point to the smallest of them. Edges have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, finish: int = FINISH) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge. Self-loops and nulls don't count.

    A pass costs one grouped minimum and one join on a node; a node with very many edges is pre-aggregated
    by the first and split by the optimiser's skew handling in the second.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = saved(e.distinct(), "edges")
    if e.count() <= finish:
        return _joined_up(e)
    spark = e.sparkSession
    mark = None
    for _ in range(most):
        now = saved(_small_star(_large_star(e).filter("a <> b").distinct()).filter("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if e.inputFiles():
            remove(spark, path_of(e))
        e, done, mark = now, seen == mark, seen
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    tops = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select(F.col("b").alias("node"), F.col("b").alias("component")))
