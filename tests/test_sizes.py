"""Queries against their SQL in DuckDB where the results once differed, and steps without a task that sees all rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tesserae.operators import running


def both(spark, folder, name, tables):
    """A query's rows and its SQL's on tables written to folder; tables: name to DuckDB SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return sorted(rows, key=str), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)


#: Ten customers with three small orders each, a hundred with one large order: the first ten differ altogether.
APART = "SELECT k AS o_orderkey, CASE WHEN k < 30 THEN k // 3 ELSE k END AS o_custkey, CASE WHEN k < 30 THEN 1.0 ELSE 1000.0 + k END::DOUBLE AS o_totalprice FROM range(130) t(k)"


@pytest.mark.parametrize("name", ["gain_recall", "recall_at_k"])
def test_nothing_in_both_tops(spark, tmp_path, name):
    got, wanted = both(spark, tmp_path, name, {"orders": APART})
    assert got == wanted
    assert name != "gain_recall" or (10, None) in got


#: Orders with equal sums, one of unknown quantity, and one of unknown key.
LINES = "SELECT CASE WHEN k < 3 THEN NULL ELSE k % 40 END AS l_orderkey, CASE WHEN k % 40 = 7 THEN NULL ELSE k % 5 END::DOUBLE AS l_quantity, (k * 37 % 101)::DOUBLE AS l_extendedprice FROM range(150) t(k)"


def plan(spark, folder, name):
    return __spark_entry__.queries()[name](spark, str(folder))._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["spearman_avg", "spearman_ordinal"])
@pytest.mark.parametrize("lines", [LINES, LINES.replace("k % 5", "1"), LINES + " WHERE k = 5"])
def test_ranks_as_in_sql(spark, tmp_path, name, lines):
    got, wanted = both(spark, tmp_path, name, {"lineitem": lines})
    assert str(got) == str(wanted)  # NaN too
    assert "row_number" not in plan(spark, tmp_path, name) and "rank(" not in plan(spark, tmp_path, name)  # each a window over all rows


@pytest.mark.parametrize("lines", [LINES, LINES + " WHERE k = 5", LINES + " WHERE k < 0", "SELECT NULL::DOUBLE AS l_extendedprice FROM range(3)"])
def test_bounds_as_in_sql(spark, tmp_path, lines):
    got, wanted = both(spark, tmp_path, "histogram_bounds", {"lineitem": lines})
    assert got == wanted and len(got) == 11
    assert "percentile(" not in plan(spark, tmp_path, "histogram_bounds")  # one buffer of all distinct values


def test_grid_as_in_sql(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "sample_grid", {"customer": "SELECT CASE WHEN k = 2 THEN NULL ELSE k END AS c_custkey FROM range(250) t(k)"})
    assert got == wanted
    assert plan(spark, tmp_path, "sample_grid").count("TakeOrderedAndProject") >= 3  # no task sorts its rows


def test_positions_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(500).selectExpr("id * 7 % 500 AS v", "id % 3 AS n")
        rows = running.in_order(df, [F.desc("v")], {"before": "n"}, "test").orderBy(F.desc("v")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    upto = 0
    for r in rows:
        assert r["before"] == upto
        upto += r["n"]
