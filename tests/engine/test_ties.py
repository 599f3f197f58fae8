"""Rows that an order leaves tied."""

import duckdb

import __spark_entry__ as entry


def test_upsert_of_equal_line_numbers_as_its_sql(spark, tmp_path):
    """Lines of one order with one number: the first in the table stays, in every file and whatever the price."""
    duck = duckdb.connect()
    (tmp_path / "lineitem.parquet").mkdir()
    duck.execute("CREATE TABLE lineitem AS SELECT i, i % 300 AS l_orderkey, (i // 600 % 3)::INTEGER AS l_linenumber, 50.0 AS l_quantity, (i * 7919 % 1009)::DOUBLE AS l_extendedprice FROM range(6000) r(i)")
    duck.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i::DOUBLE AS o_totalprice FROM range(250) r(i)")
    for n in range(3):
        duck.execute(f"COPY (SELECT * FROM lineitem WHERE i // 2000 = {n} ORDER BY i) TO '{tmp_path}/lineitem.parquet/part-{n}.parquet'")
    duck.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    duck.execute("SET threads = 1")
    got = sorted(map(tuple, entry.queries()["upsert"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.execute(entry.oracle_sql()["upsert"]).fetchall())
