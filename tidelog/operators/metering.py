"""Tenant metering: counters, hourly buckets, filled series, histograms, storage, limits, keys.

Requests have ts (seconds), tenant, op, status, latency_s. Usage buckets have tenant_id,
bucket (seconds, an hour's start), kind (req, rate, conc), op, status, count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR, DAY = 3600, 86400
#: Upper bounds of the latency histogram in seconds: fixed values.
LATENCY_BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
ACTIVE_KEYS = 10
BUCKET_KEY = ("tenant_id", "bucket", "kind", "op", "status")


def request_counts(requests: DataFrame) -> DataFrame:
    """requests by tenant, op and status; a missing tenant counts as ``none``."""
    tenant = F.when(F.coalesce(F.col("tenant"), F.lit("")) == "", "none").otherwise(F.col("tenant"))
    return requests.groupBy(tenant.alias("tenant"), "op", "status").agg(F.count("*").alias("requests"))


def limit_counts(requests: DataFrame, limited: int = 429) -> DataFrame:
    """Refused requests by tenant and kind of limit (column ``kind`` of the input)."""
    return requests.where(F.col("status") == limited).groupBy("tenant", "kind").agg(F.count("*").alias("refused"))


def rollup(requests: DataFrame) -> DataFrame:
    """tenant, requests, by_op, by_status (maps), rate_limited, concurrency_limited; the last where requests have ``kind``, that of a refusal."""
    kind = F.col("kind") if "kind" in requests.columns else F.lit("rate")
    refused = F.col("status") == 429
    by_op = requests.groupBy("tenant", "op").agg(F.count("*").alias("n"), F.count_if(refused & (kind == "rate")).alias("limited"), F.count_if(refused & (kind == "conc")).alias("crowded"))
    ops = by_op.groupBy("tenant").agg(
        F.sum("n").alias("requests"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("op", "n")))).alias("by_op"),
        F.sum("limited").alias("rate_limited"), F.sum("crowded").alias("concurrency_limited"),
    )
    by_status = requests.groupBy("tenant", F.col("status").cast("string").alias("status")).agg(F.count("*").alias("n"))
    statuses = by_status.groupBy("tenant").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    return ops.join(statuses, "tenant")


def hourly(requests: DataFrame) -> DataFrame:
    """Usage buckets of requests: every request counts as req, a refused one as rate too."""
    base = requests.select(F.col("tenant").alias("tenant_id"), (F.col("ts") - F.col("ts") % HOUR).alias("bucket"), "op", F.col("status").cast("int").alias("status"))
    kinds = F.explode(F.when(F.col("status") == 429, F.array(F.lit("req"), F.lit("rate"))).otherwise(F.array(F.lit("req"))))
    split = base.withColumn("kind", kinds)
    limit = F.col("kind") != "req"
    split = split.withColumn("op", F.when(limit, "").otherwise(F.col("op"))).withColumn("status", F.when(limit, 0).otherwise(F.col("status")))
    return split.groupBy(*BUCKET_KEY).agg(F.count("*").alias("count"))


def upsert(buckets: DataFrame, deltas: DataFrame) -> DataFrame:
    """Buckets with the deltas added by key; empty deltas and blank tenants are skipped."""
    fine = deltas.where("count <> 0 and coalesce(trim(tenant_id), '') <> ''")
    return buckets.unionByName(fine).groupBy(*BUCKET_KEY).agg(F.sum("count").alias("count"))


def flush_delta(now: DataFrame, flushed: DataFrame) -> DataFrame:
    """What cumulative counters (tenant_id, op, status, count) have gained since they were flushed."""
    key = ["tenant_id", "op", "status"]
    both = now.withColumnRenamed("count", "n").join(flushed.withColumnRenamed("count", "f"), key, "left")
    return both.select(*key, (F.col("n") - F.coalesce("f", F.lit(0))).alias("count")).where("count > 0")


def stored_totals(buckets: DataFrame, tenant: str) -> DataFrame:
    """kind, op, status, total, since of one tenant; totals of nothing are left out."""
    own = buckets.where(F.col("tenant_id") == tenant)
    return own.groupBy("kind", "op", "status").agg(F.sum("count").alias("total"), F.min("bucket").alias("since")).where("total > 0")


def usage(buckets: DataFrame) -> DataFrame:
    """Usage of each tenant from its buckets: requests, refusals of both kinds, first bucket."""
    total = lambda kind: F.sum(F.when((F.col("kind") == kind) & (F.col("count") > 0), F.col("count")).otherwise(0))
    return buckets.groupBy("tenant_id").agg(total("req").alias("requests"), total("rate").alias("rate_limited"), total("conc").alias("concurrency_limited"), F.min("bucket").alias("since"))


def add_usage(a: Column, b: Column) -> Column:
    """Sum of two maps by key."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,bigint>")), F.coalesce(b, F.create_map().cast("map<string,bigint>")), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def between(buckets: DataFrame, tenant: str, start: int, end: int) -> DataFrame:
    """Buckets of a tenant in [start, end)."""
    return buckets.where((F.col("tenant_id") == tenant) & (F.col("bucket") >= start) & (F.col("bucket") < end))


def parse_range(name: str, now: int) -> tuple[int, int, int]:
    """Start, end and step in seconds of ``24h`` (hours up to the next), ``7d`` or ``30d`` (UTC days up to midnight)."""
    if name in ("", "24h"):
        end = now - now % HOUR + HOUR
        return end - 24 * HOUR, end, HOUR
    if name in ("7d", "30d"):
        day = int(datetime.fromtimestamp(now, UTC).replace(hour=0, minute=0, second=0, microsecond=0).timestamp())
        return day + DAY - int(name[:-1]) * DAY, day + DAY, DAY
    raise ValueError(f"unknown range {name!r}")


def series(buckets: DataFrame, tenant: str, name: str, now: int) -> DataFrame:
    """start, requests, rate_limited, concurrency_limited and by_op of every step of a range, zeros included."""
    start, end, step = parse_range(name, now)
    points = buckets.sparkSession.range(start, end, step).select(F.col("id").alias("start"))
    own = between(buckets, tenant, start, end).withColumn("start", start + F.floor((F.col("bucket") - start) / step) * step)
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("count")).otherwise(0))
    sums = own.groupBy("start").agg(total("req").alias("requests"), total("rate").alias("rate_limited"), total("conc").alias("concurrency_limited"))
    zero = F.lit(0).cast("bigint")
    return points.join(sums, "start", "left").select("start", *[F.coalesce(c, zero).alias(c) for c in ("requests", "rate_limited", "concurrency_limited")])


def series_by_op(buckets: DataFrame, tenant: str, name: str, now: int) -> DataFrame:
    """start, op, requests: the steps' requests by op, for those that have some."""
    start, end, step = parse_range(name, now)
    own = between(buckets, tenant, start, end).where("kind = 'req' and op <> ''")
    return own.groupBy((start + F.floor((F.col("bucket") - start) / step) * step).alias("start"), "op").agg(F.sum("count").alias("requests"))


def with_live(buckets: DataFrame, live: DataFrame, now: int) -> DataFrame:
    """Buckets and what is not flushed yet (tenant_id, kind, op, status, count), which counts for the current hour."""
    return buckets.unionByName(live.select("tenant_id", F.lit(now - now % HOUR).cast("bigint").alias("bucket"), "kind", "op", "status", "count"))


def series_filled_by_op(buckets: DataFrame, tenant: str, name: str, now: int, ops: list[str]) -> DataFrame:
    """start, op, requests: every step of a range for each of ``ops``, zeros included."""
    start, end, step = parse_range(name, now)
    points = buckets.sparkSession.range(start, end, step).select(F.col("id").alias("start"), F.explode(F.array(*map(F.lit, ops))).alias("op"))
    return points.join(series_by_op(buckets, tenant, name, now), ["start", "op"], "left").withColumn("requests", F.coalesce("requests", F.lit(0).cast("bigint")))


def bucket_of(seconds: Column) -> Column:
    """Index of the first bound that is not below; their number stands for +Inf."""
    out = F.lit(len(LATENCY_BOUNDS))
    for i in range(len(LATENCY_BOUNDS) - 1, -1, -1):
        out = F.when(seconds <= LATENCY_BOUNDS[i], i).otherwise(out)
    return out


def histogram(requests: DataFrame) -> DataFrame:
    """op, bucket, count of the buckets that have some."""
    return requests.groupBy("op", bucket_of(F.col("latency_s")).alias("bucket")).agg(F.count("*").alias("count"), F.sum("latency_s").alias("seconds"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """op, bucket, cumulative count on the full grid of buckets."""
    grid = histogram.select("op").distinct().select("op", F.explode(F.sequence(F.lit(0), F.lit(len(LATENCY_BOUNDS)))).alias("bucket"))
    dense = grid.join(histogram, ["op", "bucket"], "left")
    upto = Window.partitionBy("op").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 13 rows an op
    return dense.select("op", "bucket", F.sum(F.coalesce("count", F.lit(0))).over(upto).alias("cumulative"))


def tenant_storage(state: DataFrame) -> DataFrame:
    """tenant, bytes, keys of the live keys ``t:<tenant>:<key>``; bytes are of the user's key and the value."""
    parts = F.split("key", ":", 3)
    mine = state.where((F.size(parts) == 3) & (parts[0] == "t") & (parts[1] != ""))
    return mine.groupBy(parts[1].alias("tenant")).agg(F.sum(F.octet_length(parts[2]) + F.octet_length("value")).cast("bigint").alias("bytes"), F.count("*").alias("keys"))


def latest_replica(reports: DataFrame) -> DataFrame:
    """tenant, bytes, keys, groups: each group's report with the highest applied index (then the first node), summed."""
    best = Window.partitionBy("group").orderBy(F.desc("applied"), "node")
    last = reports.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.explode("tenants").alias("tenant", "u"))
    return last.groupBy("tenant").agg(F.sum("u.bytes").alias("bytes"), F.sum("u.keys").alias("keys"), F.count("*").alias("groups"))


def token_bucket(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """tenant, ts, request_id, allowed, retry_after (seconds): a bucket a tenant, refilled by time, one token a request.

    Saturation makes it an ordered fold: a tenant's sorted requests stream past its bucket,
    and only the tokens and the last time are carried, however many requests there are.
    """
    full = float(burst)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, tenant, last, tokens = False, None, None, full
        for batch in batches:
            allowed, retry = [], []
            for who, ts in zip(batch.column("tenant").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if not started or who != tenant:
                    started, tenant, last, tokens = True, who, None, full
                passed = 0.0 if ts is None or last is None else max(ts - last, 0.0)
                tokens, last = min(full, tokens + passed * rate), ts
                allowed.append(tokens >= 1)
                retry.append(None if tokens >= 1 or not rate else (1 - tokens) / rate)
                tokens -= tokens >= 1
            new = [pa.array(allowed, pa.bool_()), pa.array(retry, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "allowed", "retry_after"])

    at = F.col("ts").cast("double").alias("at")
    rows = requests.select("tenant", at, F.col("request_id").cast("bigint").alias("request_id")).repartition("tenant").sortWithinPartitions("tenant", "at", "request_id")
    names = rows.columns
    kinds = [T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())]
    out = rows.mapInArrow(run, T.StructType([*rows.schema, *kinds]))
    return out.select("tenant", F.col("at").cast("bigint").alias("ts"), "request_id", "allowed", "retry_after")


def concurrency(requests: DataFrame) -> DataFrame:
    """tenant, peak: most requests in flight at once (ends count before starts of the same moment)."""
    flips = requests.select("tenant", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("finish").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("tenant", "e.*")
    flips = flips.groupBy("tenant", "t", "d").agg(F.sum("d").alias("d2"))
    upto = Window.partitionBy("tenant").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return flips.withColumn("open", F.sum("d2").over(upto)).groupBy("tenant").agg(F.max("open").alias("peak"))


def concurrency_cap(requests: DataFrame, cap: int) -> DataFrame:
    """tenant, start, finish, request_id, admitted: a request is refused where ``cap`` admitted ones are in flight.

    A refused request occupies nothing, so this is an ordered fold: a tenant's requests
    stream in order of start past at most ``cap`` ends. What ends at a start has ended.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, tenant, ends = False, None, []
        for batch in batches:
            admitted = []
            for who, begin, finish in zip(*(batch.column(c).to_pylist() for c in ("tenant", "start", "finish")), strict=True):
                if not started or who != tenant:
                    started, tenant, ends = True, who, []
                while ends and ends[0] <= begin:
                    heapq.heappop(ends)
                admitted.append(len(ends) < cap)
                if admitted[-1]:
                    heapq.heappush(ends, finish)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_())], names=[*names, "admitted"])

    order = ["tenant", "start", "request_id"]
    rows = requests.where("start is not null and finish is not null").select("tenant", "start", "finish", "request_id").repartition("tenant").sortWithinPartitions(*order)
    names = rows.columns
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("admitted", T.BooleanType())]))


def effective_quota(tenants: DataFrame, rps: float, burst: int) -> DataFrame:
    """Tenants with effective_rps and effective_burst: their own where positive, else the default."""
    return tenants.withColumn("effective_rps", F.when(F.col("quota_rps") > 0, F.col("quota_rps")).otherwise(F.lit(rps))).withColumn(
        "effective_burst", F.when(F.col("quota_burst") > 0, F.col("quota_burst")).otherwise(F.lit(burst).cast("bigint"))
    )


def key_status(now: int) -> Column:
    """revoked, else expired (from the moment of expiry on), else active."""
    return F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").otherwise("active")


def active_keys(keys: DataFrame, now: int, limit: int = ACTIVE_KEYS) -> DataFrame:
    """tenant_id, active, full."""
    n = F.count_if(key_status(now) == "active")
    return keys.groupBy("tenant_id").agg(n.alias("active"), (n >= limit).alias("full"))


def page_after(rows: DataFrame, order: str, after: str, limit: int) -> DataFrame:
    """The next page in keyset order; next_after is the last id if the page is full, else null."""
    page = rows.where(F.col(order) > after).orderBy(order).limit(limit)
    whole = Window.partitionBy(F.lit(0))  # a page
    return page.withColumn("next_after", F.when(F.count("*").over(whole) == limit, F.max(order).over(whole)))


def unexpired(sessions: DataFrame, now: int) -> DataFrame:
    """What an expiry purge leaves."""
    return sessions.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def purge_counts(sessions: DataFrame, now: int) -> DataFrame:
    """purged, kept: how many rows an expiry purge takes and leaves."""
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return sessions.agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


def revoke_results(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (prefix) with result: revoked, already_revoked, or not_found."""
    known = keys.select("prefix", F.struct("revoked_at").alias("k"))
    result = F.when(F.col("k").isNull(), "not_found").when(F.col("k.revoked_at").isNotNull(), "already_revoked").otherwise("revoked")
    return prefixes.join(known, "prefix", "left").select("prefix", result.alias("result"))


def revoke(keys: DataFrame, prefixes: list[str], at: int) -> DataFrame:
    """Keys with revoked_at set where it was null: revoking twice changes nothing."""
    return keys.withColumn("revoked_at", F.when(F.col("revoked_at").isNull() & F.col("prefix").isin(prefixes), F.lit(at)).otherwise(F.col("revoked_at")))


def route_op(method: Column, path: Column) -> Column:
    """The op label known from method and path alone."""
    key = F.startswith(path, F.lit("/kv/")) & (F.length(path) > 4)
    return (
        F.when(path == "/v1/usage", "usage").when((path == "/kv") & (method == "POST"), "kv_post")
        .when(key & (method == "GET"), "get").when(key & (method == "PUT"), "put").when(key & (method == "DELETE"), "delete").otherwise("other")
    )


def authenticate(requests: DataFrame, keys: DataFrame, tenants: DataFrame, now: int) -> DataFrame:
    """Requests (hash) of active keys with their tenant; others are refused."""
    live = keys.where(key_status(now) == "active").select("hash", "tenant_id")
    return requests.join(live, "hash").join(tenants.withColumnRenamed("id", "tenant_id"), "tenant_id")


def signed_in(tokens: DataFrame, sessions: DataFrame, users: DataFrame, tenants: DataFrame, now: int) -> DataFrame:
    """token_hash, user_id, email, tenant_id, tenant of unexpired sessions whose user and tenant exist; others are refused."""
    live = sessions.where(F.col("expires_at") > now).select("token_hash", "user_id")
    owner = users.select(F.col("id").alias("user_id"), "email", "tenant_id")
    return tokens.join(live, "token_hash").join(owner, "user_id").join(tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant")), "tenant_id")
