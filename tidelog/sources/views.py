"""The canonical projections of the driver's tables: a command log, requests, tenants, usage, samples.

Each has the same definition in SQL (``SQL``), which the oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Latest hour boundary of the events, as "now" for ranges: fixed, so that results are.
NOW = 1706572800 + 3600 * 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with ``us``, microseconds since the epoch (their timestamps carry no zone and count as UTC)."""
    us = F.expr("unix_micros(cast(ts as timestamp))")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"), *columns)


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, log_index, op, key, value, expected, delta, client_id, seq; every tenth command is sent twice."""
    e = events(spark, sf_dir)
    tenant = F.concat(F.lit("tn"), (F.col("user_id") % 8).cast("string"))
    whole = F.floor("value").cast("bigint")
    op = (
        F.when(F.col("event_type") == "signup", "set").when(F.col("event_type").isin("purchase", "click"), "incr")
        .when(F.col("event_type") == "error", "delete").otherwise("cas")
    )
    value = F.when(F.col("event_id") % 11 == 0, F.lit("word")).otherwise((whole % 5).cast("string"))
    expected = F.when(F.col("event_id") % 2 == 0, F.lit(None)).otherwise((F.col("event_id") % 5).cast("string"))
    delta = F.when(F.col("event_id") % 97 == 0, F.lit(9223372036854775807)).otherwise(whole % 7 - 3)
    once = e.select(
        (F.col("user_id") % 3).alias("group_id"),
        ((F.col("us") * 500 + F.col("event_id") % 500) * 2).alias("log_index"),
        op.alias("op"),
        F.concat(F.lit("t:"), tenant, F.lit(":u"), F.col("user_id").cast("string")).alias("key"),
        F.when(op.isin("set", "cas"), F.encode(value, "UTF-8")).alias("value"),
        F.when(op == "cas", F.encode(expected, "UTF-8")).alias("expected"),
        F.when(op == "incr", delta).alias("delta"),
        F.concat(F.lit("c"), (F.col("user_id") % 16).cast("string")).alias("client_id"),
        # a client's commands are numbered by time; one in thirteen arrives with a number from before
        (F.col("us") - F.when(F.col("event_id") % 13 == 0, 7_200_000_000).otherwise(0)).alias("seq"),
        "event_id",
    )
    again = once.where("event_id % 10 = 0").withColumn("log_index", F.col("log_index") + 1)
    return once.unionByName(again).drop("event_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (seconds), tenant, op, status, latency_s, request_id."""
    return _as_requests(events(spark, sf_dir))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream over the files of ``events``."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a pattern may name one file
    us = F.expr("unix_micros(cast(ts as timestamp))")
    return _as_requests(raw.select("event_id", "user_id", "event_type", "value", us.alias("us")))


def _as_requests(e: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0), 429).otherwise(200)
    op = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "purchase", "incr").when(F.col("event_type") == "click", "get").when(F.col("event_type") == "error", "delete").otherwise("cas")
    return e.select(
        F.floor(F.col("us") / 1_000_000).cast("bigint").alias("ts"),
        F.concat(F.lit("tn"), (F.col("user_id") % 8).cast("string")).alias("tenant"),
        op.alias("op"), status.alias("status"), (F.col("value") / 1000).alias("latency_s"), F.col("event_id").alias("request_id"),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, quota_rps, quota_burst, created_at (seconds) from nations."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    return n.select(
        F.concat(F.lit("tn"), k.cast("string")).alias("id"), F.lower("n_name").alias("name"),
        F.when(k % 3 == 0, 0.0).otherwise(k * 1.5).alias("quota_rps"), F.when(k % 4 == 0, 0).otherwise(k * 2).cast("bigint").alias("quota_burst"),
        (F.lit(1704067200) + (k * 7919) % 86400).cast("bigint").alias("created_at"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix, hash, tenant_id, created_at, expires_at, revoked_at (seconds) from customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("k"), F.lpad(k.cast("string"), 9, "0")).alias("prefix"),
        F.sha2(F.col("c_name"), 256).alias("hash"),
        F.concat(F.lit("tn"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        (F.lit(1704067200) + k * 60).alias("created_at"),
        F.when(k % 3 == 0, F.lit(NOW - 86400) + (k % 5) * 43200).alias("expires_at"),
        F.when(k % 7 == 0, F.lit(NOW - 3600) - k).alias("revoked_at"),
    )


def group_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """us, node, group, leader_id, term, commit_index, last_applied: a status sample an event."""
    e = events(spark, sf_dir)
    return e.select(
        "us", "event_id", F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node"), F.concat(F.lit("g"), (F.col("event_id") % 4).cast("string")).alias("group"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("n"), (F.floor(F.col("value")) % 3).cast("string"))).alias("leader_id"),
        F.floor(F.col("us") / 3_600_000_000).cast("bigint").alias("term"),
        F.col("event_id").alias("commit_index"), (F.col("event_id") - F.floor(F.col("value") / 50).cast("bigint") + 2).alias("last_applied"),
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, ts, tenant, method, path, status: requests as the gateway sees them, some of them unauthenticated."""
    e = events(spark, sf_dir)
    method = F.when(F.col("event_type") == "signup", "PUT").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    k = F.col("event_id") % 5
    path = F.when(k == 0, "/kv").when(k == 1, "/v1/usage").when(k == 2, "/kv/").otherwise(F.concat(F.lit("/kv/k"), F.col("user_id").cast("string")))
    status = F.when(F.col("event_id") % 17 == 0, 401).when(F.col("event_type") == "error", 500).otherwise(200)
    tenant = F.concat(F.lit("tn"), (F.col("user_id") % 8).cast("string"))
    return e.select(F.col("event_id").alias("request_id"), F.floor(F.col("us") / 1_000_000).cast("bigint").alias("ts"), tenant.alias("tenant"), method.alias("method"), path.alias("path"), status.alias("status"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, email, tenant_id from customers; some nations are no tenants."""
    k = F.col("c_custkey")
    email = F.concat(F.lit(" User"), k.cast("string"), F.when(k % 9 == 0, " at").otherwise("@"), F.lit("Example.COM "))
    return table(spark, sf_dir, "customer").select(k.alias("id"), email.alias("email"), F.concat(F.lit("tn"), (F.col("c_nationkey") + F.when(k % 10 == 0, 100).otherwise(0)).cast("string")).alias("tenant_id"), "c_name")


def login_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_hash, user_id, expires_at (seconds) from orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.sha2(k.cast("string"), 256).alias("token_hash"), F.col("o_custkey").alias("user_id"), (F.lit(NOW - 3600) + k % 7200).alias("expires_at"))


_US = "epoch_us(ts)"
SQL = {
    "oplog": f"""
        once AS (SELECT user_id % 3 AS group_id, ({_US} * 500 + event_id % 500) * 2 AS log_index,
            CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'incr' WHEN 'click' THEN 'incr' WHEN 'error' THEN 'delete' ELSE 'cas' END AS op,
            't:tn' || (user_id % 8) || ':u' || user_id AS key,
            CASE WHEN event_type IN ('signup', 'view') THEN CASE WHEN event_id % 11 = 0 THEN 'word' ELSE (floor(value)::BIGINT % 5)::VARCHAR END END AS value,
            CASE WHEN event_type = 'view' AND event_id % 2 <> 0 THEN (event_id % 5)::VARCHAR END AS expected,
            CASE WHEN event_type IN ('purchase', 'click') THEN CASE WHEN event_id % 97 = 0 THEN 9223372036854775807 ELSE floor(value)::BIGINT % 7 - 3 END END AS delta,
            'c' || (user_id % 16) AS client_id, {_US} - CASE WHEN event_id % 13 = 0 THEN 7200000000 ELSE 0 END AS seq, event_id FROM events),
        oplog AS (SELECT * EXCLUDE (event_id) FROM once UNION ALL SELECT * EXCLUDE (event_id) REPLACE (log_index + 1 AS log_index) FROM once WHERE event_id % 10 = 0)""",
    "requests": f"""
        requests AS (SELECT ({_US} // 1000000) AS ts, 'tn' || (user_id % 8) AS tenant,
            CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'incr' WHEN 'click' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'cas' END AS op,
            CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'view' AND event_id % 7 = 0 THEN 429 ELSE 200 END AS status,
            value / 1000 AS latency_s, event_id AS request_id FROM events)""",
    "tenants": """
        tenants AS (SELECT 'tn' || n_nationkey AS id, lower(n_name) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 0.0 ELSE n_nationkey * 1.5 END::DOUBLE AS quota_rps,
            CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey * 2 END::BIGINT AS quota_burst, (1704067200 + (n_nationkey * 7919) % 86400)::BIGINT AS created_at FROM nation)""",
    "api_keys": f"""
        api_keys AS (SELECT 'k' || lpad(c_custkey::VARCHAR, 9, '0') AS prefix, sha256(c_name) AS hash, 'tn' || c_nationkey AS tenant_id, 1704067200 + c_custkey * 60 AS created_at,
            CASE WHEN c_custkey % 3 = 0 THEN {NOW - 86400} + (c_custkey % 5) * 43200 END AS expires_at, CASE WHEN c_custkey % 7 = 0 THEN {NOW - 3600} - c_custkey END AS revoked_at FROM customer)""",
    "routed": f"""
        routed AS (SELECT event_id AS request_id, {_US} // 1000000 AS ts, 'tn' || (user_id % 8) AS tenant, CASE event_type WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
            CASE event_id % 5 WHEN 0 THEN '/kv' WHEN 1 THEN '/v1/usage' WHEN 2 THEN '/kv/' ELSE '/kv/k' || user_id END AS path,
            CASE WHEN event_id % 17 = 0 THEN 401 WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events)""",
    "users": """
        users AS (SELECT c_custkey AS id, ' User' || c_custkey || CASE WHEN c_custkey % 9 = 0 THEN ' at' ELSE '@' END || 'Example.COM ' AS email,
            'tn' || (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END) AS tenant_id, c_name FROM customer)""",
    "login_sessions": f"""
        login_sessions AS (SELECT sha256(o_orderkey::VARCHAR) AS token_hash, o_custkey AS user_id, {NOW - 3600} + o_orderkey % 7200 AS expires_at FROM orders)""",
    "samples": f"""
        samples AS (SELECT {_US} AS us, event_id, 'n' || (user_id % 3) AS node, 'g' || (event_id % 4) AS "group",
            CASE WHEN event_type = 'error' THEN '' ELSE 'n' || (floor(value)::BIGINT % 3) END AS leader_id, {_US} // 3600000000 AS term,
            event_id AS commit_index, event_id - floor(value / 50)::BIGINT + 2 AS last_applied FROM events)""",
}


def sql(*names: str, recursive: bool = False) -> str:
    """WITH clause of these views, to be followed by ``, more AS (...)`` or a SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in names)
