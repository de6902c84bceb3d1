"""Queries against their SQL on tables made larger by repeating them with shifted keys."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.operators import history
from tidelog.plans import catalog

DATA = "/root/testdata/sf0.01"


def larger(folder, times):
    """DuckDB with ``events`` repeated so often, which are also written to the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    n, users = con.execute(f"SELECT max(event_id) + 1, max(user_id) + 1 FROM '{DATA}/events.parquet'").fetchone()
    con.execute(f"COPY (SELECT * REPLACE (event_id + i * {n} AS event_id, user_id + i * {users} AS user_id) FROM '{DATA}/events.parquet', range({times}) r(i)) TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


def same(spark, con, name, folder):
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == Counter(con.execute(f"SELECT {listed} FROM ({catalog.ORACLE[name]})").fetchall())
    return got


@pytest.mark.parametrize("times", [20])
def test_sizes_beyond_ten_kilobytes(spark, tmp_path, times):
    got = same(spark, larger(tmp_path, times), "console_sizes", tmp_path)
    assert any(float(size.split()[0]) >= 10 for size, _ in got)


def test_rows_are_numbered_whatever_range_they_lie_in(spark):
    values = [None, -(2**63), -(2**48) - 1, -1, 0, 1, 65_535, 65_536, 65_537, 2**32 - 1, 2**32, 2**48, 2**48 + 2**33, 2**63 - 1]
    rows = [(g, v) for g in (None, 0, 7) for v in values if g != 7 or v is None or v % 2]
    got = history.numbered(spark.createDataFrame(rows, "g bigint, v bigint"), "g", "v").collect()
    places = {g: [v for h, v in rows if h == g] for g in (None, 0, 7)}
    assert sorted((str(r.g), r["index"], str(r.v)) for r in got) == sorted((str(g), i + 1, str(v)) for g, of in places.items() for i, v in enumerate(of))


def largest_partition(spark, df):
    """The most rows in one partition."""
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("name", ["replica_gaps", "replica_convergence"])
def test_logs_of_few_groups_are_spread_over_tasks(spark, tmp_path, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        orders = spark.range(2_000_000, numPartitions=8).select(F.col("id").alias("o_orderkey"), (F.col("id") * 5).alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
        orders.write.parquet(str(tmp_path / "orders.parquet"))
        entries = catalog._entries(spark, str(tmp_path))
        assert largest_partition(spark, entries) < 400_000  # one group of 2,000,000
        rows = catalog.QUERIES[name](spark, str(tmp_path))
        want = {i for i in range(1, 2_000_001) if i % 211 == 0 or (name == "replica_gaps" and i % 300 == 0)}
        assert {r["index"] for r in rows.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
