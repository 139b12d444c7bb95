"""Every query with SQL gives its rows on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from mapforge.plans.registry import oracle_sql, queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, db, name):
    df = queries()[name](spark, D)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    cur = db.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    want = sorted(repr([plain(r[cols.index(c)]) for c in names]) for r in cur.fetchall())
    assert got == want


def test_entry_runs_without_the_other_parts(spark):
    import __spark_entry__

    assert set(oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_other_queries_run(spark, name):
    """Queries without SQL: their rows are held against dense arithmetic in other tests; here all of them run."""
    assert queries()[name](spark, D).count() > 0


@pytest.mark.parametrize("n", [190_000, 330_000])
def test_header_of_a_long_scan(spark, tmp_path, n):
    """One slice over 190 or 330 degrees: its header has more pixels than a map may have, and the SQL's numbers."""
    columns = "id AS o_orderkey, 0L AS o_custkey, 'F' AS o_orderstatus, double(1000 + id % 499000) AS o_totalprice"
    spark.range(n).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(oracle_sql()["map_header"]).fetchall()
    assert want[0][0] * want[0][1] > 2**31 - 1
    assert [tuple(r) for r in queries()["map_header"](spark, str(tmp_path)).collect()] == want
