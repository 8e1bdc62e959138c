"""Every registered query against its SQL at the smallest scale, and those that depend on thresholds at a larger one."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
LARGER = "/root/testdata/sf0.01"
#: thresholds and windows in these must leave rows at every scale
SCALED = ["calendar_gaps", "series_coverage", "asof_series_point", "first_nonempty_series", "indicator_last_change", "dense_window",
          "change_points", "event_changepoint_link", "hit_scores", "rank_events", "movement_explained", "rater_agreement"]
#: nothing at the smallest scale, and rightly so
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


OWN = sorted(n for n in QUERIES if n != "pipeline" and not n.startswith("op"))   # the others have their own tests


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        msg = compare(df, con, SQL[name])
        if name in MAY_BE_EMPTY and msg == "no rows on either side":
            return
        assert msg == "", msg
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", [n for n in SCALED if n in QUERIES])
def test_larger_scale(spark, name):
    assert compare(QUERIES[name](spark, LARGER), duck(LARGER), SQL[name]) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len({r["series_id"] for r in rows}) == 5
    assert all(r["direction"] in ("+", "-") for r in rows)


def test_series_points_that_repeat_a_place(spark, tmp_path):
    """Lines that come again at other prices, in any order: the dearest counts."""
    for name in ("orders", "customer"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    price = lambda e: line.withColumn("l_extendedprice", F.expr(e))
    again = price("l_extendedprice + (l_orderkey % 5 - 2) * 10").unionByName(line).unionByName(price("l_extendedprice - 1"))
    again.repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert compare(QUERIES["src_series"](spark, str(tmp_path)), con, SQL["src_series"]) == ""
