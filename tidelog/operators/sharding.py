"""Slots of keys, groups of slots, and shard configurations as range tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 16384
#: FNV-1a's 64-bit offset and prime, modulo 2**14: xor and product never look upward, so the rest can go. Fixed values.
FNV_OFFSET, FNV_PRIME = 8997, 435


def slot_of(key: Column) -> Column:
    """FNV-1a (64 bits) of the key's UTF-8 bytes modulo the number of slots."""
    digits = F.hex(F.encode(key, "UTF-8"))
    places = lambda n, step: F.when(n > 0, F.sequence(F.lit(1), n, F.lit(step))).otherwise(F.array().cast("array<int>"))
    folded = lambda at, code: F.aggregate(at, F.lit(FNV_OFFSET), lambda h, i: (h.bitwiseXOR(code(i)) * FNV_PRIME) % SLOTS)
    plain = folded(places(F.length(key), 1), lambda i: F.ascii(F.substring(key, i, F.lit(1))))
    other = folded(places(F.length(digits), 2), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(key) == F.octet_length(key), plain).otherwise(other).cast("bigint")  # ASCII alone is read several times as fast


def default_group(slot: Column, groups: int) -> Column:
    """The group of a slot where no ranges are given."""
    return F.floor(slot * groups / SLOTS).cast("bigint")


def default_ranges(spark: SparkSession, groups: int, version: int = 1) -> DataFrame:
    """version, groups, start, end, group: one range a group."""
    g = F.col("id")
    bound = lambda x: F.floor(x * SLOTS / groups).cast("bigint")
    return spark.range(groups).select(F.lit(version).cast("bigint").alias("version"), F.lit(groups).cast("bigint").alias("groups"), bound(g).alias("start"), bound(g + 1).alias("end"), g.alias("group"))


def slot_groups(ranges: DataFrame) -> DataFrame:
    """slot, group: a configuration by slot; at most as many rows as slots for each range."""
    return ranges.where("start < end").select("group", F.explode(F.sequence("start", F.col("end") - 1)).alias("slot"))


def route(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """``keys`` with slot and group; null where no range holds the slot.

    A configuration has 16,384 slots, so its slot table is broadcast and the join is an
    equi-join; of overlapping ranges the one that starts first counts.
    """
    first = ranges.where("start < end").select(F.explode(F.sequence("start", F.col("end") - 1)).alias("slot"), "start", "group")
    owner = first.groupBy("slot").agg(F.min_by("group", "start").alias("group"))
    return keys.withColumn("slot", slot_of(F.col("key"))).join(F.broadcast(owner), "slot", "left")


def problems(ranges: DataFrame) -> DataFrame:
    """problem, at: what makes a configuration invalid; no rows if it is valid."""
    bad = ranges.select(
        F.when((F.col("start") < 0) | (F.col("end") > SLOTS) | (F.col("start") >= F.col("end")), "bounds").when(F.col("group") >= F.col("groups"), "group").alias("problem"),
        F.col("start").alias("at"),
    ).where("problem is not null")
    covered = slot_groups(ranges.where(f"start >= 0 and end <= {SLOTS}")).groupBy("slot").count()
    every = ranges.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(covered, "slot", "left")
    cover = every.select(F.when(F.col("count").isNull(), "gap").when(F.col("count") > 1, "overlap").alias("problem"), F.col("slot").alias("at")).where("problem is not null")
    return bad.unionByName(cover)


def move(ranges: DataFrame, start: int, end: int, to_group: int) -> DataFrame:
    """The configuration of the next version with slots [start, end) at another group, in maximal ranges."""
    moved = slot_groups(ranges).select("slot", F.when((F.col("slot") >= start) & (F.col("slot") < end), to_group).otherwise(F.col("group")).alias("group"))
    order = Window.orderBy("slot")  # 16,384 rows
    first = F.when((F.lag("group").over(order) == F.col("group")) & (F.lag("slot").over(order) == F.col("slot") - 1), 0).otherwise(1)
    islands = moved.withColumn("first", first).withColumn("island", F.sum("first").over(order))
    version, groups = ranges.agg(F.max("version") + 1, F.max("groups")).first()
    out = islands.groupBy("island").agg(F.min("slot").alias("start"), (F.max("slot") + 1).alias("end"), F.first("group").cast("bigint").alias("group"))
    return out.select(F.lit(version).cast("bigint").alias("version"), F.lit(groups).cast("bigint").alias("groups"), "start", "end", "group")


def any_key_in(state: DataFrame, start: int, end: int) -> DataFrame:
    """found: whether a live key lies in the slots [start, end)."""
    hit = state.where((slot_of(F.col("key")) >= start) & (slot_of(F.col("key")) < end)).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def newer_than(configs: DataFrame, version: int) -> DataFrame:
    """The latest configuration's ranges if it is newer than ``version``, else none."""
    latest = configs.agg(F.max("version").alias("version"))
    return configs.where(F.col("version") > version).join(F.broadcast(latest), "version", "left_semi")


def distribution(keys: DataFrame, groups: int) -> DataFrame:
    """group, keys, slots: how evenly distinct keys fall."""
    slotted = keys.select("key").distinct().withColumn("slot", slot_of(F.col("key")))
    return slotted.groupBy(default_group(F.col("slot"), groups).alias("group")).agg(F.count("*").alias("keys"), F.countDistinct("slot").alias("slots"))


def move_problems(ranges: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (version, start, end, from_group, to_group) with problem: why the configuration refuses it, null if it does not.

    The first reason counts: version not newer, start not below end, end out of range,
    a group out of range, slots that no single range of from_group holds.
    """
    version, groups = ranges.agg(F.max("version"), F.max("groups")).first()
    own = ranges.select(F.col("group").alias("from_group"), F.col("start").alias("low"), F.col("end").alias("high"))
    # a configuration has at most as many ranges as slots
    inside = moves.select("start", "end", "from_group").distinct().join(F.broadcast(own), "from_group").where("start >= low and end <= high")
    owned = inside.select("start", "end", "from_group").distinct().withColumn("owned", F.lit(True))
    reason = (
        F.when(F.col("version") <= version, "version").when(F.col("start") >= F.col("end"), "empty").when(F.col("end") > SLOTS, "end")
        .when(F.col("from_group") >= groups, "from_group").when(F.col("to_group") >= groups, "to_group").when(F.col("owned").isNull(), "not_owned")
    )
    return moves.join(owned, ["start", "end", "from_group"], "left").withColumn("problem", reason).drop("owned")


def adopt(current: DataFrame, offered: DataFrame) -> DataFrame:
    """The offered configuration if its version is newer than the current one's, else the current one."""
    now = current.agg(F.max("version")).first()[0]
    newer = newer_than(offered, now if now is not None else -1)
    return current if newer.isEmpty() else newer.select(*current.columns)
