"""The driver's tables read as detector data: timelines, a pointing matrix, a map, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import number

PIXELS = 200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(det, t, value, masked): events of a user in time."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("det"), "ts", "event_id", "value", (F.col("event_type") == "error").alias("masked"))
    return number(e, ["det"], ["ts", "event_id"]).select("det", "t", "value", "masked")


TOD = "SELECT user_id AS det, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, event_type = 'error' AS masked FROM events"

_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(det, t, value, masked, part, quantity, discount): a supplier's lines."""
    li = read(spark, sf_dir, "lineitem").withColumn("det", F.col("l_suppkey"))
    out = number(li, ["det"], _ALL)
    return out.select("det", "t", F.col("l_extendedprice").alias("value"), (F.col("l_returnflag") == "R").alias("masked"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


SAMPLES = f"SELECT l_suppkey AS det, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_ALL)}) - 1 AS t, l_extendedprice AS value, l_returnflag = 'R' AS masked, l_partkey AS part, l_quantity AS quantity, l_discount AS discount FROM lineitem"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(det, t, k, pixel, weight): two entries for each sample, the second with the discount as weight."""
    s = samples(spark, sf_dir)
    entry = lambda k, p, w: F.struct(F.lit(k).alias("k"), (p % PIXELS).cast("int").alias("pixel"), w.cast("float").alias("weight"))
    both = F.array(entry(0, F.col("part"), F.col("quantity")), entry(1, F.col("part") + 1, F.col("discount") * 10))
    return s.select("det", "t", F.explode(both).alias("e")).select("det", "t", "e.k", "e.pixel", "e.weight")


MATRIX = f"SELECT det, t, 0 AS k, (part % {PIXELS})::INT AS pixel, quantity::FLOAT AS weight FROM s UNION ALL SELECT det, t, 1, ((part + 1) % {PIXELS})::INT, (discount * 10)::FLOAT FROM s"


def matrix_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(det, t, k, pixel, weight): one entry for each sample, with the quantity as weight."""
    s = samples(spark, sf_dir)
    return s.select("det", "t", F.lit(0).alias("k"), (F.col("part") % PIXELS).cast("int").alias("pixel"), F.col("quantity").cast("float").alias("weight"))


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel, value): mean price of a pixel's parts."""
    p = read(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % PIXELS).cast("int").alias("pixel")).agg(F.avg("p_retailprice").alias("value"))


SKY = f"SELECT (p_partkey % {PIXELS})::INT AS pixel, avg(p_retailprice) AS value FROM part GROUP BY 1"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, zone, ra, dec): customers on a patch of sky around (30, 20)."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zone"), (30 + F.col("c_acctbal") / 10000).alias("ra"), (20 + (F.col("c_custkey") % 1000 - 500) / 1000).alias("dec"))


POSITIONS = "SELECT c_custkey AS id, c_nationkey AS zone, 30 + c_acctbal / 10000 AS ra, 20 + (c_custkey % 1000 - 500) / 1000.0::DOUBLE AS dec FROM customer"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec_id, i, x): embeddings by component."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


VECTORS = "SELECT label, vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"


def pointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slice, t, time, ra, dec, pa, chop, info): orders of a month as a scan, by customer."""
    o = number(read(spark, sf_dir, "orders").withColumn("slice", F.col("o_custkey") % 10), ["slice"], ["o_orderkey"])
    info = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return o.select("slice", "t", (F.col("t") * 0.5).alias("time"), (30 + F.col("t") / 1000).alias("ra"), (20 + F.col("o_totalprice") / 1000000).alias("dec"), (F.col("o_orderkey") % 360).cast("double").alias("pa"), F.lit(0.0).alias("chop"), info.alias("info"))


POINTING = """SELECT o_custkey % 10 AS slice, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1 AS t, (row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1) * 0.5::DOUBLE AS time,
    30 + (row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1) / 1000.0::DOUBLE AS ra, 20 + o_totalprice / 1000000 AS dec, (o_orderkey % 360)::DOUBLE AS pa, 0.0::DOUBLE AS chop,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS info FROM orders"""
