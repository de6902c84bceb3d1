"""Structured Streaming twins: hourly usage, session dedup and last-write state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators import metering


#: Micro-batches between two compactions of a kept table.
COMPACT = 16


def _paths(spark: SparkSession, target: str) -> tuple[int, list[str]]:
    """The last compacted batch (-1: none), and the folders that make up the table: its base and the batches after it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    done = {p.getName(): p.toString() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    base = max((int(n[5:]) for n in done if n.startswith("base=")), default=-1)
    parts = [p for n, p in done.items() if n.startswith("part=") and int(n[5:]) > base]
    return base, [done[f"base={base}"], *parts] if base >= 0 else parts


def _merge(stream: DataFrame, target: str, checkpoint: str, combine: Callable[[DataFrame], DataFrame], every: int = COMPACT) -> None:
    """Every micro-batch adds its own combined rows under ``target``, and every so many are combined into a new base.

    A batch that runs again after a failure writes its folder again, or finds itself in the
    base and does nothing, so nothing counts twice. What a base holds is removed.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n <= _paths(spark, target)[0]:
            return
        combine(batch).write.mode("overwrite").parquet(f"{target}/part={n}")
        if (n + 1) % every == 0:
            old = _paths(spark, target)[1]
            combine(spark.read.parquet(*old)).write.mode("overwrite").parquet(f"{target}/base={n}")
            for path in map(spark._jvm.org.apache.hadoop.fs.Path, old):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*metering.BUCKET_KEY).agg(F.sum("count").alias("count"))


def hourly_usage(requests: DataFrame, target: str, checkpoint: str, every: int = COMPACT) -> None:
    """Usage buckets kept by event hour: late requests go into their own hour (no watermark drops them)."""

    def combine(rows: DataFrame) -> DataFrame:
        return _usage(rows if "bucket" in rows.columns else metering.hourly(rows))

    _merge(requests, target, checkpoint, combine, every)


def usage_table(spark: SparkSession, target: str) -> DataFrame:
    """The usage buckets that ``hourly_usage`` has kept so far."""
    return _usage(spark.read.parquet(*_paths(spark, target)[1]))


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("group_id", "key").agg(F.max_by(F.struct("op", "value", "log_index"), "log_index").alias("w"))
    return newest.select("group_id", "key", "w.*")


def last_writes(log: DataFrame, target: str, checkpoint: str, every: int = COMPACT) -> None:
    """group_id, key, op, value, log_index: the newest set or delete of every key."""
    _merge(log, target, checkpoint, lambda rows: _newest(rows.where("op in ('set', 'delete')").select("group_id", "key", "op", "value", "log_index")), every)


def last_writes_table(spark: SparkSession, target: str) -> DataFrame:
    """What ``last_writes`` has kept so far."""
    return _newest(spark.read.parquet(*_paths(spark, target)[1]))


def session_decisions(log: DataFrame) -> DataFrame:
    """group_id, client_id, log_index, seq, decision; the last applied sequence of a client is its state.

    Commands of one micro-batch are decided in order of log_index.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("log_index")
        last = state.get[0] if state.exists else None
        out = []
        for seq in rows["seq"].tolist():
            out.append("apply" if not key[1] or last is None or seq > last else "duplicate" if seq == last else "stale")
            last = seq if last is None else max(last, seq)
        state.update((last,))
        yield pd.DataFrame({"group_id": key[0], "client_id": key[1], "log_index": rows["log_index"].to_numpy(), "seq": rows["seq"].to_numpy(), "decision": out})

    return (
        log.select("group_id", "client_id", "log_index", "seq").groupBy("group_id", "client_id")
        .applyInPandasWithState(decide, "group_id bigint, client_id string, log_index bigint, seq bigint, decision string", "last bigint", "append", GroupStateTimeout.NoTimeout)
    )


def session_replays(commands: DataFrame) -> DataFrame:
    """group_id, client_id, log_index, seq, decision, applied, result, error: repeats get the first result back.

    commands: group_id, client_id, log_index, seq, and applied, result, error as the engine
    gives them where the command is new. A client's state is its last applied sequence with
    its result; a stale command gets an error.
    """

    def replay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("log_index")
        last = tuple(state.get) if state.exists else None
        out = []
        for index, seq, applied, result, error in rows[["log_index", "seq", "applied", "result", "error"]].itertuples(index=False, name=None):
            if not key[1] or last is None or seq > last[0]:
                last = (seq, applied, result, error)
                out.append((index, seq, "apply", applied, result, error))
            elif seq == last[0]:
                out.append((index, seq, "duplicate", *last[1:]))
            else:
                out.append((index, seq, "stale", False, None, "stale_sequence"))
        state.update(last)
        frame = pd.DataFrame(out, columns=["log_index", "seq", "decision", "applied", "result", "error"])
        frame.insert(0, "client_id", key[1])
        frame.insert(0, "group_id", key[0])
        yield frame

    return (
        commands.select("group_id", "client_id", "log_index", "seq", "applied", "result", "error").groupBy("group_id", "client_id")
        .applyInPandasWithState(
            replay, "group_id bigint, client_id string, log_index bigint, seq bigint, decision string, applied boolean, result string, error string",
            "last bigint, applied boolean, result string, error string", "append", GroupStateTimeout.NoTimeout,
        )
    )


def windowed_usage(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by tenant and hour of event time behind a watermark, for sinks in update mode."""
    timed = requests.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "tenant").agg(F.count("*").alias("requests"))
