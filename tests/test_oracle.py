"""Every query with SQL gives the rows of its SQL."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from sondegrid import queries as registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    compare(spark, con, QUERIES[name], SQL[name], sf)


@pytest.mark.parametrize("name", ["sc20_las_points", "sc16_las_ground", "pr15_class_filter", "sc22_las_dump", "ag30_return_stats", "ag12_las_envelope", "ct12_las_headers", "ct13_las_fields"])
def test_matches_sql_without_filter_pushdown(spark, con, sf, name):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        compare(spark, con, QUERIES[name], SQL[name], sf)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["ag30_return_stats", "ag12_las_envelope"])
def test_matches_sql_with_points_no_las_file_holds(spark, con, tmp_path, name):
    odd = {1: ("l_orderkey", "null"), 2: ("l_partkey", "null"), 3: ("l_extendedprice", "null"), 4: ("l_extendedprice", "9e8"), 5: ("l_orderkey", "-l_orderkey"), 6: ("l_quantity", "null"), 7: ("l_quantity", "7e4")}
    cols = {c: " ".join(f"WHEN {k} THEN {v}" for k, (of, v) in odd.items() if of == c) for c, _ in odd.values()}
    con.execute(f"COPY (SELECT * REPLACE ({', '.join(f'CASE l_orderkey % 50 {w} ELSE {c} END AS {c}' for c, w in cols.items())}) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    compare(spark, connect(str(tmp_path)), QUERIES[name], SQL[name], str(tmp_path))


def test_order_hulls_of_orders_without_points(spark, con, tmp_path):
    odd = "l_orderkey % 9 WHEN 1 THEN null WHEN 2 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, CASE l_orderkey % 7 WHEN 1 THEN null WHEN 2 THEN if(l_linenumber > 2, l_partkey, null) ELSE l_partkey END AS l_partkey"
    con.execute(f"COPY (SELECT * REPLACE (CASE {odd}) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    compare(spark, connect(str(tmp_path)), QUERIES["ve01_order_hulls"], SQL["ve01_order_hulls"], str(tmp_path))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
