"""Token buckets over one long busy spell."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tidelog.operators import metering


def test_hot_tenant_streams(spark):
    n = 60_000
    hot = spark.range(n).select(F.lit("hot").alias("tenant"), F.col("id").alias("ts"), F.col("id").alias("request_id"))
    out = metering.token_bucket(hot.unionByName(hot.where("ts < 3").withColumn("tenant", F.lit(None).cast("string"))), 0.25, 3)
    with redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert "collect_list" not in plan.getvalue()  # no array of a tenant's requests
    got = {(r.tenant, r.ts): r for r in out.collect()}
    tokens, last = 3.0, 0
    for t in range(n):
        tokens, last = min(3.0, tokens + (t - last) * 0.25), t
        assert got["hot", t].allowed == (tokens >= 1)
        assert got["hot", t].retry_after == (None if tokens >= 1 else (1 - tokens) / 0.25)
        tokens -= tokens >= 1
    assert len(got) == n + 3 and all(got[None, t].allowed for t in range(3))
