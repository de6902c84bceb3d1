"""Readers and writers of the reference's files, as tables.

Benchmark results (JSON lines), shard configurations (JSON), node storage reports
(JSON), segment logs (binary records), state snapshots (Parquet), metric expositions
(text).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.metering import LATENCY_BOUNDS
from tidelog.operators.sessions import read_table, write_table
from tidelog.operators.sharding import default_ranges

#: Fields of a benchmark result: fixed by the format. Error codes vary, so the schema is never inferred.
BENCH_SCHEMA = (
    "label string, shards int, addrs string, read_ratio double, concurrency int, duration_s double, warmup_s double, keyspace bigint, payload int, started_at string, "
    "attempts bigint, reads bigint, writes bigint, errors bigint, error_codes map<string,bigint>, ops_per_sec double, read_ops_per_sec double, write_ops_per_sec double, "
    "p50_us bigint, p95_us bigint, p99_us bigint, max_us bigint, mean_us bigint, read_p50_us bigint, read_p95_us bigint, read_p99_us bigint, "
    "write_p50_us bigint, write_p95_us bigint, write_p99_us bigint, preload_errors bigint, sweep_reads bigint, sweep_missing bigint"
)
STORAGE_SCHEMA = "map<string, struct<applied: bigint, tenants: map<string, struct<bytes: bigint, keys: bigint>>>>"
CONFIG_SCHEMA = "version bigint, groups bigint, ranges array<struct<start: bigint, end: bigint, group: bigint>>"


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH_SCHEMA).json(path)


def append_bench(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def read_shard_config(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of the configuration in a JSON file; without ranges, the default ones."""
    config = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    given = config.where("size(ranges) > 0").select("version", "groups", F.explode("ranges").alias("r")).select("version", "groups", "r.start", "r.end", "r.group")
    bare = config.where("ranges is null or size(ranges) = 0").first()  # one object a file
    return given if bare is None else default_ranges(spark, bare["groups"], bare["version"])


def shard_config_json(ranges: DataFrame) -> DataFrame:
    """version, json: one object a version, ranges in order."""
    r = F.sort_array(F.collect_list(F.struct("start", "end", "group")))
    return ranges.groupBy("version", "groups").agg(r.alias("ranges")).select("version", F.to_json(F.struct("version", "groups", "ranges")).alias("json"))


def storage_reports(documents: DataFrame) -> DataFrame:
    """node, group, applied, tenants from nodes' JSON reports (node, body)."""
    return documents.select("node", F.explode(F.from_json("body", STORAGE_SCHEMA)).alias("group", "r")).select("node", "group", "r.applied", "r.tenants")


def write_snapshot(state: DataFrame, path: str) -> None:
    """A state snapshot: key order within files, so that equal states give equal rows."""
    state.repartitionByRange("group_id", "key").sortWithinPartitions("group_id", "key").write.mode("overwrite").parquet(path)


def write_machine(state: DataFrame, sessions: DataFrame, path: str) -> None:
    """A state machine's snapshot: the engine's keys and the session table (with births), two tables under one path."""
    write_snapshot(state, f"{path}/engine")
    write_table(sessions, f"{path}/sessions")


def read_machine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_snapshot(spark, f"{path}/engine"), read_table(spark, f"{path}/sessions")


def backup(table: DataFrame, path: str) -> DataFrame:
    """A copy of a stored table as it is now, read back."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("group_id bigint, key string, value binary").parquet(path)


# ---- segment logs, a fixed format: [length u32][crc u32][index u64][term u64][payload], little endian; the crc covers all but itself ----

HEADER = 24


def encode_record(index: int, term: int, payload: bytes) -> bytes:
    length = struct.pack("<I", 16 + len(payload))
    rest = struct.pack("<QQ", index, term) + payload
    return length + struct.pack("<I", zlib.crc32(length + rest)) + rest


def decode_records(data: bytes) -> Iterator[tuple[int, int | None, int | None, bytes | None, str | None]]:
    """(offset, index, term, payload, fault) of a file's records; reading ends at a torn or corrupt one."""
    at = 0
    while at < len(data):
        if at + HEADER > len(data):
            yield at, None, None, None, "torn"
            return
        length, crc, index, term = struct.unpack_from("<IIQQ", data, at)
        end = at + 8 + length
        if length < 16 or end > len(data):
            yield at, None, None, None, "torn" if length >= 16 else "corrupt"
            return
        if zlib.crc32(data[at + 8 : end], zlib.crc32(data[at : at + 4])) != crc:
            yield at, index, term, None, "torn" if end == len(data) else "corrupt"
            return
        yield at, index, term, data[at + HEADER : end], None
        at = end


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, index, term, payload, fault: the records of binary segment files, a task a file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, *r) for r in decode_records(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "offset", "index", "term", "payload", "fault"]).astype({"index": "Int64", "term": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, offset bigint, index bigint, term bigint, payload binary, fault string")


# ---- text exposition of metrics -------------------------------------------------------------------------------------


def _quoted(text: Column) -> Column:
    """A label's value: backslash, quote and newline escaped."""
    return F.replace(F.replace(F.replace(text.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _line(name: str, labels: list[tuple[str, Column]], value: Column) -> Column:
    parts: list[Column] = [F.lit(name + "{")]
    for i, (label, column) in enumerate(labels):
        parts += [F.lit(f'{"," if i else ""}{label}="'), _quoted(column), F.lit('"')]
    return F.concat(*parts, F.lit("} "), value.cast("string"))


def _place(metric: int, a: Column | str = "", b: Column | str = "", c: Column | int = 0) -> Column:
    """Where a line stands: by metric, then by its labels; heads (c of -1) first."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(metric).alias("metric"), as_column(a).cast("string").alias("a"), as_column(b).cast("string").alias("b"), as_column(c).cast("int").alias("c")).alias("place")


def _head(spark: SparkSession, metric: int, name: str, kind: str, help_text: str) -> DataFrame:
    lines = F.explode(F.array(F.struct(F.lit(-2).alias("c"), F.lit(f"# HELP {name} {help_text}").alias("line")), F.struct(F.lit(-1).alias("c"), F.lit(f"# TYPE {name} {kind}").alias("line"))))
    return spark.range(1).select(lines.alias("h")).select(_place(metric, c=F.col("h.c")), "h.line")


def expose_counter(counts: DataFrame, metric: int, name: str, help_text: str, labels: list[str], value: str) -> DataFrame:
    """place, line of a counter with up to two labels, its head included; lines go by the labels."""
    own = [F.col(x) for x in labels]
    lines = counts.select(_place(metric, *own), _line(name, [(x, F.col(x)) for x in labels], F.col(value)).alias("line"))
    return _head(counts.sparkSession, metric, name, "counter", help_text).unionByName(lines)


def expose_gauges(gauges: DataFrame, metric: int, prefix: str, names: dict[str, str]) -> DataFrame:
    """place, line of each gauge (column: help text) by node and group."""
    out = None
    for i, (name, help_text) in enumerate(names.items()):
        lines = gauges.select(_place(metric + i, F.col("node"), F.col("group")), _line(prefix + name, [("node", F.col("node")), ("group", F.col("group"))], F.col(name)).alias("line"))
        both = _head(gauges.sparkSession, metric + i, prefix + name, "gauge", help_text).unionByName(lines)
        out = both if out is None else out.unionByName(both)
    return out


def expose_gateway(requests: DataFrame, limits: DataFrame, histogram: DataFrame, cumulative: DataFrame, prefix: str = "gateway_") -> DataFrame:
    """place, line: request counters, both limits' counters, and latency buckets with sum and count by op, heads included."""
    spark = requests.sparkSession
    out = _head(spark, 0, prefix + "requests_total", "counter", "HTTP requests handled, by tenant, op and status.").unionByName(expose_requests(requests, prefix + "requests_total"))
    for metric, kind, name, text in ((1, "rate", "rate_limited_total", "Requests rejected by the rate limit."), (2, "conc", "concurrency_limited_total", "Requests rejected by the concurrency cap.")):
        out = out.unionByName(expose_counter(limits.where(F.col("kind") == kind), metric, prefix + name, text, ["tenant"], "refused"))
    name = prefix + "request_duration_seconds"
    sums = histogram.groupBy("op").agg(F.sum("seconds").alias("seconds"), F.sum("count").alias("count"))
    buckets = expose_histogram(cumulative, name).withColumn("place", _place(3, F.col("place.a"), "", F.col("place.c")))
    total = sums.select(_place(3, F.col("op"), "", 100), _line(name + "_sum", [("op", F.col("op"))], F.format_string("%.6f", "seconds")).alias("line"))
    count = sums.select(_place(3, F.col("op"), "", 101), _line(name + "_count", [("op", F.col("op"))], F.col("count")).alias("line"))
    return out.unionByName(_head(spark, 3, name, "histogram", "Request latency, by op.")).unionByName(buckets).unionByName(total).unionByName(count)


def in_order(lines: DataFrame) -> DataFrame:
    """n, line: the lines of one exposition page numbered in order; a page holds counters, not requests."""
    return lines.select(F.row_number().over(Window.orderBy("place")).alias("n"), "line")


def expose_requests(counts: DataFrame, name: str = "requests_total") -> DataFrame:
    """place, line: request counters in order of tenant, op and status."""
    place = F.struct(F.lit(0).alias("metric"), F.col("tenant").alias("a"), F.col("op").alias("b"), F.col("status").cast("int").alias("c"))
    return counts.select(place.alias("place"), _line(name, [("tenant", F.col("tenant")), ("op", F.col("op")), ("status", F.col("status"))], F.col("requests")).alias("line"))


def expose_histogram(cumulative: DataFrame, name: str = "request_duration_seconds") -> DataFrame:
    """place, line: cumulative buckets in order of op and bound."""
    bound = F.lit("+Inf")
    for i, b in enumerate(LATENCY_BOUNDS):
        bound = F.when(F.col("bucket") == i, f"{b:g}").otherwise(bound)
    place = F.struct(F.lit(1).alias("metric"), F.col("op").alias("a"), F.lit("").alias("b"), F.col("bucket").alias("c"))
    return cumulative.select(place.alias("place"), _line(name + "_bucket", [("op", F.col("op")), ("le", bound)], F.col("cumulative")).alias("line"))


def parse_exposition(lines: DataFrame) -> DataFrame:
    """metric, labels (map), value of exposition lines (column ``line``); comments and blanks are left out."""
    pattern = r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})? (\S+)$"
    kept = lines.where(F.col("line").rlike(pattern) & ~F.startswith("line", F.lit("#")))
    pairs = F.regexp_extract_all(F.regexp_extract("line", pattern, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    entry = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1).alias("k"), F.regexp_extract(p, r'="(.*)"$', 1).alias("v")))
    return kept.select(F.regexp_extract("line", pattern, 1).alias("metric"), F.map_from_entries(entry).alias("labels"), F.regexp_extract("line", pattern, 3).try_cast("double").alias("value"))
