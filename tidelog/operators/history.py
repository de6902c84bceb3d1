"""Recorded operation histories: benchmark summaries, log checks, linearizability.

Histories have history_id, id, client_id, key, type, input, output, start, finish
(numbers in one unit), success.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Recorded output of a read that found nothing, and what parts the two values of a cas: fixed values of the format.
ABSENT, CAS_SEPARATOR = "<absent>", "\x00"
NODE_BUDGET = 5_000_000
#: Remembered results of single operations: the bound of a cache, no result depends on it.
KNOWN = 100_000
WRITES = ("set", "delete", "incrby", "cas")


def nearest_rank(p: float, value: str) -> Column:
    """Smallest value with at least a share p of the values at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("bigint")


def bench_summary(ops: DataFrame, by: list[str], window_s: float) -> DataFrame:
    """Attempts, errors, throughput and latencies (us; errors left out; mean rounded down) of each run."""
    ok = F.col("error").isNull()
    lat = "case when error is null then latency_us end"
    return ops.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("is_read")).alias("reads"), F.count_if(~F.col("is_read")).alias("writes"), F.count_if(~ok).alias("errors"),
        (F.count_if(ok) / window_s).alias("ops_per_sec"), *[nearest_rank(p, lat).alias(f"p{round(p * 100)}_us") for p in (0.5, 0.95, 0.99)],
        F.expr(f"max({lat})").alias("max_us"), F.expr(f"sum({lat}) div count({lat})").alias("mean_us"),
    )


def error_codes(ops: DataFrame, by: list[str]) -> DataFrame:
    """Errors by code, or by the first 60 characters of their message."""
    code = F.coalesce(F.col("code"), F.substring("error", 1, 60))
    return ops.where("error is not null").groupBy(*by, code.alias("code")).agg(F.count("*").alias("errors"))


def missing(expected: DataFrame, state: DataFrame) -> DataFrame:
    """Expected keys that the state lacks."""
    return expected.select("key").distinct().join(state.select("key"), "key", "left_anti")


def workload(spark, keyspace: int, workers: int) -> DataFrame:
    """k, key, worker: keys dealt round to workers."""
    return spark.range(keyspace).select(F.col("id").alias("k"), F.format_string("bench-%06d", "id").alias("key"), (F.col("id") % workers).alias("worker"))


def completion_ids(ops: DataFrame) -> DataFrame:
    """Operations numbered in the order they finished, within each history."""
    return ops.withColumn("id", F.row_number().over(Window.partitionBy("history_id").orderBy("finish", "start")))


def predecessors(ops: DataFrame) -> DataFrame:
    """history_id, key, id, n: how many operations on the key had finished before this one started.

    A count of earlier finishes, by one ordered pass over starts and finishes: the pairs
    themselves are never made.
    """
    points = ops.select("history_id", "key", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(0).alias("k"), "id"), F.struct(F.col("finish").alias("t"), F.lit(1).alias("k"), "id"))).alias("p")).select("history_id", "key", "p.*")
    upto = Window.partitionBy("history_id", "key").orderBy("t", "k", "id").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("n", F.sum("k").over(upto)).where("k = 0").select("history_id", "key", "id", "n")


def quorum_index(matches: DataFrame, voters: int) -> DataFrame:
    """group, commit_index: the highest index that a majority holds."""
    majority = voters // 2 + 1
    return matches.groupBy("group").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m")).select("group", F.element_at("m", majority).alias("commit_index"))


def advance_commit(matches: DataFrame, entries: DataFrame, nodes: DataFrame, voters: int) -> DataFrame:
    """group, commit_index: the majority's index where its entry is of the current term, else the old commit index.

    matches: group, match_index; entries: group, index, term; nodes: group, term, commit_index.
    An entry of an earlier term, or one that the log lacks, is not committed by counting.
    """
    held = quorum_index(matches, voters).withColumnRenamed("commit_index", "index")
    own = nodes.select("group", F.col("term").alias("now"), F.col("commit_index").alias("old"))
    seen = own.join(held, "group", "left").join(entries.select("group", "index", "term"), ["group", "index"], "left")
    fine = (F.col("index") > F.col("old")) & (F.col("term") == F.col("now"))
    return seen.select("group", F.when(fine, F.col("index")).otherwise(F.col("old")).alias("commit_index"))


def numbered(rows: DataFrame, group: str, by: str, tasks: int | None = None) -> DataFrame:
    """``rows`` with index: 1, 2, ... by a bigint within each group, as row_number gives, but no group is sorted in one task.

    Values are cut into ranges of 2**16, these into ranges of 2**32 and of 2**48. A row's number
    is its place in its smallest range and the counts of the ranges before it, which are summed level by
    level; so no window holds more than 65,536 values or ranges.
    """
    least = -(2**63)  # nulls come first
    parts = ["__group", "__48", "__32", "__16"]
    ranges = {f"__{b}": F.coalesce(F.shiftright(F.col(by).cast("bigint"), b), F.lit(least >> b).cast("bigint")) for b in (48, 32, 16)}
    cut = rows.withColumns({"__group": F.struct(F.col(group)), **ranges})  # a struct of null equals another
    counts = cut.groupBy(*parts).agg(F.count("*").alias("n"))
    offsets = None
    for level in (1, 2, 3):
        within, every = parts[:level], parts[: level + 1]
        earlier = Window.partitionBy(*within).orderBy(every[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.groupBy(*every).agg(F.sum("n").alias("n")).select(*every, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        offsets = sums if offsets is None else sums.join(offsets.withColumnRenamed("before", "above"), within).select(*every, (F.col("before") + F.col("above")).alias("before"))
    spread = cut.repartition(tasks, *parts) if tasks else cut
    place = spread.withColumn("index", F.row_number().over(Window.partitionBy(*parts).orderBy(by)))
    return place.join(offsets, parts).withColumn("index", F.col("index") + F.col("before")).drop(*parts, "before")


def log_faults(entries: DataFrame) -> DataFrame:
    """group, index, fault: gaps in a log's indexes, and entries whose stored crc differs from their payload's."""
    before = F.lag("index").over(Window.partitionBy("group").orderBy("index"))
    fault = F.when(before.isNotNull() & (F.col("index") != before + 1), "gap").when(F.crc32("payload") != F.col("crc"), "crc")
    return entries.withColumn("fault", fault).where("fault is not null").select("group", "index", "fault")


def truncate_conflicts(local: DataFrame, leader: DataFrame) -> DataFrame:
    """The local log without the suffix from the first index whose term differs from the leader's."""
    clash = local.alias("a").join(leader.alias("b"), (F.col("a.group") == F.col("b.group")) & (F.col("a.index") == F.col("b.index"))).where("a.term <> b.term")
    first = clash.groupBy(F.col("a.group").alias("group")).agg(F.min("a.index").alias("first"))
    return local.join(first, "group", "left").where("first is null or index < first").drop("first")


def _by_index(replicas: DataFrame, tasks: int | None) -> DataFrame:
    """Rows of an index together, in so many tasks: Spark's own number goes by compressed bytes, of which sorted logs have few."""
    return replicas.repartition(tasks, "group", "index") if tasks else replicas


def divergent(replicas: DataFrame, tasks: int | None = None) -> DataFrame:
    """Indexes at which replicas of a group hold different payloads."""
    return _by_index(replicas, tasks).groupBy("group", "index").agg(F.count_distinct("payload").alias("n")).where("n > 1").select("group", "index")


def lacking(replicas: DataFrame, tasks: int | None = None) -> DataFrame:
    """group, index, held, replicas: indexes that some replica of a group lacks, though it or another holds later ones."""
    of_group = replicas.groupBy("group").agg(F.count_distinct("replica").alias("replicas")).withColumn("part", F.explode(F.expr("sequence(0L, 63L)")))
    held = _by_index(replicas, tasks).groupBy("group", "index").agg(F.count_distinct("replica").alias("held")).withColumn("part", F.pmod(F.col("index"), F.lit(64)))
    return held.join(of_group, ["group", "part"]).where("held < replicas").drop("part")  # in parts: a group need not fit a task


# ---- linearizability: local to a key (Herlihy and Wing 1990), so keys are searched apart ----


def _integer(text: str) -> int | None:
    digits = text[1:] if text[:1] in ("+", "-") else text
    return int(text) if digits.isascii() and digits.isdigit() and -(2**63) <= int(text) < 2**63 else None


def after(kind: str, given: str, state: str | None) -> tuple[str | None, str | None]:
    """The value after an operation, and the output it must have shown; output None: it cannot have succeeded."""
    if kind == "set":
        return given, ""
    if kind == "delete":
        return None, ""
    if kind == "get":
        return state, ABSENT if state is None else state
    if kind == "incrby":
        step, now = _integer(given), 0 if state is None else _integer(state)
        if step is None or now is None or not -(2**63) <= now + step < 2**63:
            return state, None
        return str(now + step), str(now + step)
    if kind == "cas" and CAS_SEPARATOR in given:
        old, new = given.split(CAS_SEPARATOR, 1)
        if state is None if old == ABSENT else state == old:
            return new, "true"
        return state, "false"
    return state, None


def explains(ops: list[tuple], budget: int = NODE_BUDGET, known: dict | None = None) -> bool | None:
    """Is there an order of the operations (kind, input, output, start, finish, success) on one key that explains them?

    Operations of which one finished before another started keep that order. Failed writes
    may have happened at any later time or never; failed reads say nothing. The history is
    cut where nothing is in flight, and only the values possible there are carried on, so
    a search is as large as what overlaps. None if the budget of visited states runs out.
    ``known`` remembers results of ``after`` from key to key.
    """
    known = {} if known is None else known
    told = sorted((o for o in ops if o[5] or o[0] in WRITES), key=lambda o: o[3])
    pieces: list[list[tuple]] = []
    until = float("-inf")
    for o in told:
        if not pieces or until < o[3]:
            pieces.append([])
        pieces[-1].append(o)
        until = max(until, o[4] if o[5] else float("inf"))  # a failed write may still happen
    states: set = {None}
    for piece in pieces:
        found = outcomes(piece, states, budget, known)
        if not found:
            return None if found is None else False
        states = found
    return True


def outcomes(ops: list[tuple], states: set, budget: int, known: dict) -> set | None:
    """Values that orders of these operations can end with, from one of ``states``; None if the budget runs out.

    Failed writes are tried only if the others alone explain nothing. The search goes by the
    number of operations placed, and holds the visited states (set of placed operations,
    value) of one number. Of the others, taken by start, all before the first one not placed are; it
    and what started before its finish can come next, so the work is linear in a long
    history of which little overlaps.
    """
    must = sorted((o for o in ops if o[5]), key=lambda o: o[3])
    may = sorted((o for o in ops if not o[5]), key=lambda o: o[3])
    if any(o[4] < o[3] for o in must):
        return set()
    n = len(must)
    for extra in ([], may) if may else ([],):
        level, visited, ends = {(0, 0, 0, s) for s in states}, len(states), set()
        while level:
            following: set = set()
            for first, placed, used, state in level:  # placed: bits of what is placed from the first one not placed on
                if first == n:
                    ends.add(state)
                    continue
                steps, limit, i = [], float("inf"), first
                while i < n and must[i][3] <= limit:
                    if not placed >> (i - first) & 1:
                        kind, given, output, _, finish, _ = must[i]
                        if (done := known.get((kind, given, state))) is None:
                            if len(known) >= KNOWN:
                                known.clear()
                            done = known[kind, given, state] = after(kind, given, state)
                        value, shown = done
                        if shown == output:
                            at, bits = first, placed | 1 << (i - first)
                            while bits & 1:
                                at, bits = at + 1, bits >> 1
                            steps.append((at, bits, used, value))
                        if finish < limit:
                            limit = finish
                    i += 1
                for j, o in enumerate(extra):
                    if o[3] > limit:
                        break
                    if not used >> j & 1:
                        steps.append((first, placed, used | 1 << j, after(o[0], o[1], state)[0]))
                for step in steps:
                    if step not in following:
                        if visited >= budget:
                            return None
                        visited += 1
                        following.add(step)
            level = following
        if ends:
            return ends
    return set()


def check_linearizable(ops: DataFrame, budget: int = NODE_BUDGET) -> DataFrame:
    """history_id, verdict (yes, no, unknown), keys, ops: every history's keys are searched in parallel.

    Sorted operations stream past, and a key's are searched when the next key begins.
    """
    told = ["type", "input", "output", "start", "finish", "success"]

    def search(history_id, rows: list[tuple], known: dict) -> tuple:
        found = explains(rows, budget, known)
        return history_id, "unknown" if found is None else "yes" if found else "no", len(rows)

    def packed(verdicts: list[tuple]) -> pa.RecordBatch:
        columns = zip(*verdicts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["history_id", "verdict", "ops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, known = None, [], {}
        for batch in batches:
            done = []
            marks, values = (zip(*(batch.column(c).to_pylist() for c in names), strict=True) for names in (["history_id", "key"], told))
            for mark, row in zip(marks, values, strict=True):
                if mark != now:
                    if rows:
                        done.append(search(now[0], rows, known))
                    now, rows = mark, []
                rows.append(row)
            if done:
                yield packed(done)
        if rows:
            yield packed([search(now[0], rows, known)])

    sorted_ops = ops.select("history_id", "key", *told).repartition("history_id", "key").sortWithinPartitions("history_id", "key", "start")
    per_key = sorted_ops.mapInArrow(run, "history_id bigint, verdict string, ops bigint")
    worst = F.when(F.count_if(F.col("verdict") == "no") > 0, "no").when(F.count_if(F.col("verdict") == "unknown") > 0, "unknown").otherwise("yes")
    return per_key.groupBy("history_id").agg(worst.alias("verdict"), F.count("*").alias("keys"), F.sum("ops").alias("ops"))
