"""Session dedup: per client, a sequence above the last applied is new, equal is a repeat, below is stale."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import kv_log

#: Clients a group remembers; within it, at most once holds.
CAPACITY = 65_536


def _judged(log: DataFrame, capacity: int) -> DataFrame:
    """``log`` with decision, source (log_index of the client's last applied command before) and birth (of its session).

    In a group that never has more clients than ``capacity`` nobody is forgotten, and the
    last applied sequence is a running maximum, since only larger ones are recorded. Other
    groups go through the table in order, see ``_streamed``.
    """
    large = fits(log, capacity).where(~F.col("fits")).select("group_id")
    if large.isEmpty():
        return _windowed(log)
    rest = log.join(large, "group_id", "left_anti").select(*log.columns)
    return _windowed(rest).unionByName(_streamed(log.join(large, "group_id", "left_semi").select(*log.columns), capacity))


def _windowed(log: DataFrame) -> DataFrame:
    """Commands without a client always apply, so they stay out of the windows: they are no group."""
    anonymous = F.coalesce(F.col("client_id"), F.lit("")) == ""
    none = F.lit(None).cast("bigint")
    free = log.where(anonymous).select("*", F.lit("apply").alias("decision"), none.alias("source"), none.alias("birth"))
    return _windowed_clients(log.where(~anonymous)).unionByName(free)


def _windowed_clients(log: DataFrame) -> DataFrame:
    before = Window.partitionBy("group_id", "client_id").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("seq").over(before)
    decision = F.when(last.isNull() | (F.col("seq") > last), "apply").when(F.col("seq") == last, "duplicate").otherwise("stale")
    decided = log.withColumn("decision", decision)
    source = F.last(F.when(F.col("decision") == "apply", F.col("log_index")), ignorenulls=True).over(before)
    birth = F.coalesce(F.min("log_index").over(before), F.col("log_index"))
    return decided.select("*", source.alias("source"), birth.alias("birth"))


def _streamed(log: DataFrame, capacity: int) -> DataFrame:
    """The session table itself, one group after the other: a task holds ``capacity`` sessions and a batch of rows.

    A full table forgets its oldest session when a new client comes; who comes back is new.
    """
    schema = T.StructType([*log.schema, T.StructField("decision", T.StringType()), T.StructField("source", T.LongType()), T.StructField("birth", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sessions = None, {}  # client: [last seq, source, birth], in order of birth
        for batch in batches:
            decisions, sources, births = [], [], []
            for g, client, seq, index in zip(*(batch.column(c).to_pylist() for c in ("group_id", "client_id", "seq", "log_index")), strict=True):
                if g != group:
                    group, sessions = g, {}
                known = sessions.get(client) if client else None
                decision = "apply" if known is None or seq > known[0] else "duplicate" if seq == known[0] else "stale"
                decisions.append(decision)
                sources.append(known and known[1])
                if client and known is None:
                    if len(sessions) >= capacity:
                        del sessions[next(iter(sessions))]
                    known = sessions[client] = [seq, index, index]
                elif client and decision == "apply":
                    known[0], known[1] = seq, index
                births.append(known and known[2])
            new = [pa.array(decisions, pa.string()), pa.array(sources, pa.int64()), pa.array(births, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return log.repartition("group_id").sortWithinPartitions("group_id", "log_index").mapInArrow(run, schema)


def decide(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``log`` with decision: apply, duplicate or stale. Commands without a client always apply, as does a new client's first."""
    return _judged(log, capacity).drop("source", "birth")


def apply_once(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every command's result: new ones fold, repeats get the first result back, stale ones an error."""
    return _results(log, capacity).drop("birth")


def _results(log: DataFrame, capacity: int) -> DataFrame:
    """A repeat stands with the command whose result it gets in one window: no table is joined with itself."""
    known = ["client_id", "seq", "decision", "source", "birth"]
    decided = _judged(log, capacity)
    new = kv_log.apply_results(decided.where("decision = 'apply'"), *known).withColumnRenamed("value", "result")
    nothing = {"applied": "boolean", "result": "binary", "error": "string"}
    rest = decided.where("decision <> 'apply'").select("group_id", "key", "log_index", "op", *known, *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    both = new.unionByName(rest)
    origin = F.when(F.col("decision") == "duplicate", F.col("source")).otherwise(F.col("log_index"))
    first = F.first(F.struct("applied", "result", "error")).over(Window.partitionBy("group_id", origin).orderBy("log_index"))
    stale = F.struct(F.lit(False).alias("applied"), F.lit(None).cast("binary").alias("result"), F.lit("stale_sequence").alias("error"))
    got = both.withColumn("r", F.when(F.col("decision") == "stale", stale).otherwise(first))
    return got.select("group_id", "log_index", "client_id", "seq", "key", "op", "decision", "birth", "r.applied", "r.result", "r.error")


def table(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The session table after the log: last sequence of each client, with its cached result and birth."""
    results = _results(log, capacity).where("decision = 'apply' and client_id <> ''")
    last = results.groupBy("group_id", "client_id", "birth").agg(F.max_by(F.struct("seq", "applied", "result", "error"), "log_index").alias("r"))
    live = last.withColumn("age", _age()).where(F.col("age") <= capacity)
    return live.select("group_id", "client_id", F.col("r.seq").alias("last_seq"), "r.applied", "r.result", "r.error", "birth")


def _age() -> Column:
    """Rank of a session in its group, the youngest 1. The oldest goes first, so those up to the capacity live."""
    return F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("birth")))


def evicted(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sessions that the table forgot: a client that comes back is born again, and may be forgotten again."""
    births = _judged(log, capacity).where("client_id <> ''").select("group_id", "client_id", "birth").distinct()
    return births.withColumn("age", _age()).where(F.col("age") > capacity).drop("age")


def oldest_clients(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All but the ``capacity`` youngest clients by first birth in each group: ``evicted`` if no client comes back."""
    births = log.where("client_id <> ''").groupBy("group_id", "client_id").agg(F.min("log_index").alias("birth"))
    return births.withColumn("age", _age()).where(F.col("age") > capacity).drop("age")


def fits(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """group_id, clients, fits: whether no client is ever forgotten."""
    return log.where("client_id <> ''").groupBy("group_id").agg(F.countDistinct("client_id").alias("clients")).withColumn("fits", F.col("clients") <= capacity)


def number(log: DataFrame) -> DataFrame:
    """``log`` with seq counted anew for each client and group, from one."""
    return log.withColumn("seq", F.row_number().over(Window.partitionBy("group_id", "client_id").orderBy("log_index")).cast("bigint"))


def write_table(sessions: DataFrame, path: str) -> None:
    """A snapshot of the session table: clients in order within files, so that equal tables give equal rows."""
    sessions.repartitionByRange("group_id", "client_id").sortWithinPartitions("group_id", "client_id").write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The session table of a snapshot; errors are the texts that they were written as."""
    return spark.read.schema("group_id bigint, client_id string, last_seq bigint, applied boolean, result binary, error string, birth bigint").parquet(path)
