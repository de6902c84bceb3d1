"""Status samples of replicated groups, and dashboard queries over scraped counters.

Rates are increases in a window over its length, resets counted, not extrapolated to
the window's edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.metering import LATENCY_BOUNDS, bucket_of


def leader_changes(samples: DataFrame) -> DataFrame:
    """node, group, changes: moves to another known leader; the first one counts."""
    order = Window.partitionBy("node", "group").orderBy("us", "event_id")
    known = samples.where("leader_id <> ''").withColumn("before", F.lag("leader_id").over(order))
    return known.where("before is null or before <> leader_id").groupBy("node", "group").agg(F.count("*").alias("changes"))


def gauges(samples: DataFrame) -> DataFrame:
    """Latest term, is_leader, commit_index, last_applied and apply_lag (not below zero) of each node and group."""
    now = samples.groupBy("node", "group").agg(F.max_by(F.struct("term", "leader_id", "commit_index", "last_applied"), F.struct("us", "event_id")).alias("s"))
    return now.select(
        "node", "group", "s.term", (F.col("s.leader_id") == F.col("node")).cast("int").alias("is_leader"), "s.commit_index", "s.last_applied",
        F.greatest(F.lit(0), F.col("s.commit_index") - F.col("s.last_applied")).alias("apply_lag"),
    )


def increases(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Scrapes (t, keys, v) with gain: growth since the scrape before; after a reset all of it."""
    order = Window.partitionBy(*keys).orderBy("t")
    before = F.lag("v").over(order)
    return samples.withColumn("gain", F.when(before.isNull(), 0).when(F.col("v") < before, F.col("v")).otherwise(F.col("v") - before))


def rate(samples: DataFrame, keys: list[str], by: list[str], window: int) -> DataFrame:
    """Per-second rate by ``by`` in each window of so many seconds."""
    start = F.col("t") - F.col("t") % window
    return increases(samples, keys).groupBy(*by, start.alias("start")).agg((F.sum("gain") / window).alias("rate"))


def scrape(requests: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Cumulative counters by ``keys`` as a scraper sees them: t, v at each interval with requests."""
    t = F.col("ts") - F.col("ts") % every + every
    counts = requests.groupBy(*keys, t.alias("t")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*keys, "t", F.sum("n").over(upto).alias("v"))


def bucket_quantile(cumulative: DataFrame, by: list[str], q: float, bounds: tuple[float, ...]) -> DataFrame:
    """Quantile by linear interpolation in the first bucket that reaches its rank; the top bound for +Inf."""
    order = Window.partitionBy(*by).orderBy("bucket")
    total = F.max("cumulative").over(Window.partitionBy(*by))
    rank = F.lit(q) * total
    edges = F.array(*[F.lit(0.0), *map(F.lit, bounds)])
    ranked = cumulative.withColumn("below", F.coalesce(F.lag("cumulative").over(order), F.lit(0))).withColumn("rank", rank)
    hit = ranked.where("cumulative >= rank and below < rank and rank > 0")
    low, high = edges[F.col("bucket")], F.get(edges, F.col("bucket") + 1)
    value = F.when(F.col("bucket") >= len(bounds), F.lit(bounds[-1])).otherwise(low + (high - low) * (F.col("rank") - F.col("below")) / (F.col("cumulative") - F.col("below")))
    return hit.select(*by, value.alias("value"))


def windowed_quantiles(requests: DataFrame, quantiles: list[float], every: int, window: int) -> DataFrame:
    """start, q, value: quantiles of the latencies counted in each window, from scraped bucket counters' increases."""
    counters = requests.select("ts", "op", bucket_of(F.col("latency_s")).alias("bucket"))
    gained = increases(scrape(counters, ["op", "bucket"], every), ["op", "bucket"])
    start = (F.col("t") - F.col("t") % window).alias("start")
    sums = gained.groupBy(start, "bucket").agg(F.sum("gain").alias("n"))
    dense = sums.select("start").distinct().select("start", F.explode(F.sequence(F.lit(0), F.lit(len(LATENCY_BOUNDS)))).alias("bucket")).join(sums, ["start", "bucket"], "left")
    upto = Window.partitionBy("start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 13 rows a window
    total = dense.select("start", "bucket", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("cumulative"))
    parts = [bucket_quantile(total, ["start"], q, LATENCY_BOUNDS).select("start", F.lit(q).alias("q"), "value") for q in quantiles]
    return reduce(DataFrame.unionByName, parts)


def status_matches(pattern: str) -> Column:
    """A status label against a pattern that has to match all of it."""
    return F.col("status").cast("string").rlike(f"^(?:{pattern})$")
