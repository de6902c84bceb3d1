"""Key-value state as a deterministic fold of an ordered command log.

A log has group_id, log_index, op, key, value (binary), expected (binary, null: must be
absent), delta. Within a key, order is log_index. State is (group_id, key, value), one
row a live key; an absent key has no row, an empty value is an empty binary.

set and delete forget what was there, so they cut a key's log into segments that fold
independently. A segment's sorted commands stream past its value: nothing is gathered, and
work is linear in the commands however many a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("set", "delete", "cas", "incr", "get", "exists")


def as_of(log: DataFrame, index: Column | int) -> DataFrame:
    """Commands that a read at this log position sees."""
    return log.where(F.col("log_index") <= index)


def committed(log: DataFrame, commit_index: Column | int, payload: str = "op") -> DataFrame:
    """Commands up to the commit index; a leader's empty entries (null payload) are skipped."""
    return as_of(log, commit_index).where(F.col(payload).isNotNull())


def parse_int64(value: Column) -> Column:
    """A counter's text as a number, null if it is none: an optional sign and digits in range."""
    text = F.decode(value, "UTF-8")
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def integer_of(value: bytes | None) -> int | None:
    """``parse_int64`` of an engine value; an absent one counts as zero."""
    if value is None:
        return 0
    digits = value[1:] if value[:1] in (b"+", b"-") else value
    number = int(value) if digits.isdigit() and len(digits) < 200 else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def step(v: bytes | None, op: str, value: bytes | None, expected: bytes | None, delta: int | None) -> tuple:
    """The value after a command, and its result: applied, shown value, error."""
    if op == "set":
        return value, True, None, None
    if op == "delete":
        return None, True, None, None
    if op == "cas":
        return (value, True, None, None) if v == expected else (v, False, None, None)
    if op == "incr":
        number = integer_of(v)
        if number is None or delta is None:
            return v, False, None, "not_integer"
        if not -(2**63) <= number + delta < 2**63:
            return v, False, None, "overflow"
        counted = str(number + delta).encode()
        return counted, True, counted, None
    if op == "get":
        return v, v is not None, v, None if v is not None else "not_found"
    if op == "exists":
        return v, v is not None, None, None
    return v, False, None, "unknown_op"


def _segments(log: DataFrame) -> DataFrame:
    by_key = Window.partitionBy("group_id", "key").orderBy("log_index").rowsBetween(Window.unboundedPreceding, 0)
    segment = F.sum(F.when(F.col("op").isin("set", "delete"), 1).otherwise(0)).over(by_key)
    return log.withColumn("segment", segment)


def _streamed(segments: DataFrame, keep: list[str], last_only: bool) -> DataFrame:
    """``keep`` columns of every command (or of a segment's last) with state (the value after it), applied, value, error."""
    marks = ["group_id", "key", "segment"]
    given = ["op", "value", "expected", "delta"]
    rows = segments.select(*marks, "log_index", *[F.col(c).alias(f"__{c}") for c in given], *[F.col(c).alias(f"keep_{c}") for c in keep])
    names = [*keep, "state", "applied", "value", "error"]
    kinds = [T.BinaryType(), T.BooleanType(), T.BinaryType(), T.StringType()]
    schema = T.StructType([*(T.StructField(c, segments.schema[c].dataType) for c in keep), *(T.StructField(c, k) for c, k in zip(names[len(keep) :], kinds, strict=True))])
    types = [pa.binary(), pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v, waiting = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*marks, *(f"__{c}" for c in given))]
            out, ends = [], []
            for i, (*key, op, value, expected, delta) in enumerate(zip(*columns, strict=True)):
                if key != now:
                    if i:
                        ends.append(i - 1)
                    elif waiting is not None:
                        yield waiting
                    now, v = key, None
                v, applied, shown, error = step(v, op, value, expected, delta)
                out.append((v, applied, shown, error))
            new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else []
            if not new:
                continue
            done = pa.RecordBatch.from_arrays([*(batch.column(f"keep_{c}") for c in keep), *new], names=names)
            if not last_only:
                yield done
                continue
            if ends:
                yield done.take(pa.array(ends))
            waiting = done.slice(done.num_rows - 1)
        if waiting is not None:
            yield waiting

    return rows.repartition(*marks).sortWithinPartitions(*marks, "log_index").mapInArrow(run, schema)


def apply_results(log: DataFrame, *keep: str) -> DataFrame:
    """group_id, key, log_index, op, applied, value, error of every command, and its columns ``keep``."""
    return _streamed(_segments(log), ["group_id", "key", "log_index", "op", *keep], False).drop("state")


def final_state(log: DataFrame) -> DataFrame:
    """group_id, key, value after the whole log: only the commands from a key's last set or delete on are folded."""
    by_key = Window.partitionBy("group_id", "key")
    last = F.max(F.when(F.col("op").isin("set", "delete"), F.col("log_index"))).over(by_key)
    tail = log.withColumn("segment", F.coalesce(last, F.lit(-1).cast("bigint"))).where("log_index >= segment or segment = -1")
    after = _streamed(tail, ["group_id", "key"], True)
    return after.where("state is not null").select("group_id", "key", F.col("state").alias("value"))


def last_write(log: DataFrame) -> DataFrame:
    """State of a log of set and delete alone: the last write of a key wins, a delete leaves none."""
    last = log.groupBy("group_id", "key").agg(F.max_by(F.struct("op", "value"), "log_index").alias("w"))
    return last.where("w.op = 'set'").select("group_id", "key", "w.value")


def running_counters(log: DataFrame) -> DataFrame:
    """Counters after each incr, by running sums, no fold: group_id, key, log_index, total.

    A key's log is cut at set and delete. Of its segments those count that start from a
    number or nothing, see no cas, and never leave the range of a bigint: there no incr is
    refused, so a value is the start and the sum of the deltas. Other segments need the
    fold (``apply_results``). Every command is read.
    """
    cut = _segments(log)
    part = Window.partitionBy("group_id", "key", "segment")
    upto = part.orderBy("log_index").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("op") == "set", F.struct("value"))).over(upto)  # a segment begins with its set or delete
    start = F.when(first.isNull(), F.lit(0).cast("bigint")).otherwise(parse_int64(first["value"]))
    total = start.cast("decimal(38,0)") + F.sum(F.when(F.col("op") == "incr", F.col("delta")).cast("decimal(38,0)")).over(upto)
    summed = cut.select("group_id", "key", "log_index", "op", "segment", total.alias("total"), start.isNull().alias("odd"))
    low, high = F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")
    bad = F.col("odd") | (F.col("op") == "cas") | (F.col("total") < low) | (F.col("total") > high)
    fine = ~F.coalesce(F.bool_or(bad).over(part), F.lit(False))
    return summed.withColumn("fine", fine).where("fine and op = 'incr'").select("group_id", "key", "log_index", "total")


def get(state: DataFrame, key: str) -> DataFrame:
    """The key's row; none if it is absent."""
    return state.where(F.col("key") == key)


def exists(state: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with found."""
    known = state.select("key").distinct().withColumn("found", F.lit(True))
    return keys.join(known, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def decrement_if_positive(log: DataFrame) -> DataFrame:
    """Results of a log in which an incr of -1 applies only while the counter is above zero.

    ``incr`` commands with a negative delta that would go below zero are refused with
    error ``below_zero``, those beyond a bigint with ``overflow`` and those without a delta with
    ``not_integer``; others apply. Keys hold counters alone. A key's sorted commands stream past
    its counter, so no key is gathered.
    """
    top = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for batch in batches:
            out = []
            for *key, delta in zip(*(batch.column(c).to_pylist() for c in ("group_id", "key", "delta")), strict=True):
                if key != now:
                    now, total = key, 0
                error = "not_integer" if delta is None else "below_zero" if delta < 0 and total + delta < 0 else "overflow" if total + delta > top else None
                if error is None:
                    total += delta
                out.append((error is None, total, error))
            new = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.bool_(), pa.int64(), pa.string()), strict=True)] if out else []
            if new:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=["group_id", "key", "log_index", "applied", "total", "error"])

    rows = log.select("group_id", "key", "log_index", "delta").repartition("group_id", "key").sortWithinPartitions("group_id", "key", "log_index")
    kinds = [T.StructField("applied", T.BooleanType()), T.StructField("total", T.LongType()), T.StructField("error", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *kinds]))
