"""Small cases with known results, and random logs against a plain interpreter."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators import history, kv_log, metering, monitoring, sessions, sharding
from tidelog.sources import formats
from tidelog.streaming import streams

LOG = "group_id bigint, log_index bigint, op string, key string, value binary, expected binary, delta bigint, client_id string, seq bigint"
TOP = 9223372036854775807


def log_of(spark, ops):
    rows = []
    for i, (op, key, *rest) in enumerate(ops, 1):
        value = expected = delta = None
        if op == "set":
            value = rest[0].encode()
        elif op == "cas":
            expected, value = (None if rest[0] is None else rest[0].encode()), rest[1].encode()
        elif op == "incr":
            delta = rest[0]
        rows.append((0, i, op, key, value, expected, delta, "c", i))
    return spark.createDataFrame(rows, LOG)


def results(spark, ops):
    out = {r.log_index: (r.applied, r.value and bytes(r.value).decode(), r.error) for r in kv_log.apply_results(log_of(spark, ops)).collect()}
    return [out[i] for i in range(1, len(ops) + 1)]


def state(spark, ops):
    return {r.key: bytes(r.value).decode() for r in kv_log.final_state(log_of(spark, ops)).collect()}


def test_compare_and_swap(spark):
    ops = [("cas", "a", None, "v"), ("cas", "b", "old", "v"), ("set", "c", "old"), ("cas", "c", "old", "new"), ("set", "d", "x"), ("cas", "d", "y", "z"), ("set", "e", ""), ("cas", "e", None, "z"), ("cas", "e", "", "q")]
    assert [r[0] for r in results(spark, ops)] == [True, False, True, True, True, False, True, False, True]
    assert state(spark, ops) == {"a": "v", "c": "new", "d": "x", "e": "q"}


def test_increments(spark):
    ops = [("incr", "n", 1), ("incr", "n", 41), ("incr", "n", -1), ("incr", "m", -1), ("set", "h", "hello"), ("incr", "h", 1), ("set", "t", str(TOP)), ("incr", "t", 1), ("set", "b", str(-TOP - 1)), ("incr", "b", -1)]
    ops += [("set", "p", "+5"), ("incr", "p", 1), ("set", "z", "007"), ("incr", "z", 1), ("set", "s", " 5 "), ("incr", "s", 1), ("get", "nope"), ("get", "n"), ("boom", "n"), ("delete", "n"), ("delete", "n"), ("incr", "n", 2)]
    got = results(spark, ops)
    assert [g[1] for g in got[:4]] == ["1", "42", "41", "-1"]
    assert [got[i][2] for i in (5, 7, 9, 15, 16, 18)] == ["not_integer", "overflow", "overflow", "not_integer", "not_found", "unknown_op"]
    assert (got[11][1], got[13][1], got[17][1], got[21][1]) == ("6", "8", "41", "2")
    assert got[19][0] and got[20][0]
    assert state(spark, ops)["t"] == str(TOP)


def interpret(ops):
    now, out = {}, []
    for op, key, *rest in ops:
        v = now.get(key)
        if op == "set":
            now[key] = rest[0]
            out.append((True, None, None))
        elif op == "delete":
            now.pop(key, None)
            out.append((True, None, None))
        elif op == "cas":
            ok = v is None if rest[0] is None else v == rest[0]
            if ok:
                now[key] = rest[1]
            out.append((ok, None, None))
        else:
            try:
                total = int(v or 0) + rest[0]
            except ValueError:
                out.append((False, None, "not_integer"))
                continue
            if not -TOP - 1 <= total <= TOP:
                out.append((False, None, "overflow"))
                continue
            now[key] = str(total)
            out.append((True, str(total), None))
    return now, out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    r = random.Random(seed)
    ops = []
    for _ in range(1_500):
        key = r.choice(["a", "b", "c", "d", "cnt0", "cnt1"])
        kind = r.choices(["set", "delete", "incr", "cas"], [7, 1, 8, 6])[0]
        ops.append((kind, key, *{"set": [r.choice(["v0", "1", "2", str(TOP)])], "delete": [], "incr": [r.choice([-3, -1, 1, 3, TOP])], "cas": [r.choice([None, "1", "v0"]), r.choice(["2", "v1"])]}[kind]))
    want_state, want = interpret(ops)
    assert results(spark, ops) == want
    assert state(spark, ops) == want_state


def test_sessions(spark):
    rows = [(0, 1, "incr", "k", None, None, 1, "A", 42), (0, 2, "incr", "k", None, None, 1, "A", 42), (0, 3, "incr", "k", None, None, 1, "A", 43), (0, 4, "set", "v", b"v3", None, None, "c", 3), (0, 5, "set", "v", b"v1", None, None, "c", 1), (0, 6, "set", "v", b"v5", None, None, "c", 5)]
    rows += [(0, 7, "set", "h", b"hello", None, None, "d", 1), (0, 8, "incr", "h", None, None, 1, "d", 2), (0, 9, "set", "h", b"5", None, None, "e", 1), (0, 10, "incr", "h", None, None, 1, "d", 2), (0, 11, "set", "w", b"a", None, None, "", 0), (0, 12, "set", "w", b"b", None, None, None, None)]
    log = spark.createDataFrame(rows, LOG)
    out = {r.log_index: r for r in sessions.apply_once(log).collect()}
    assert [out[i].decision for i in range(1, 13)] == ["apply", "duplicate", "apply", "apply", "stale", "apply", "apply", "apply", "apply", "duplicate", "apply", "apply"]
    assert bytes(out[2].result) == b"1" and bytes(out[3].result) == b"2" and out[10].error == "not_integer" and out[5].error == "stale_sequence"
    kept = sessions.decide(log).where("decision = 'apply'")
    assert {r.key: bytes(r.value) for r in kv_log.final_state(kept).collect()} == {"k": b"2", "v": b"v5", "h": b"5", "w": b"b"}
    table = {r.client_id: r.last_seq for r in sessions.table(log).collect()}
    assert table == {"A": 43, "c": 5, "d": 2, "e": 1}
    assert sessions.fits(log, 3).first().fits is False


def fnv(key):
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h % 16384


def test_slots(spark):
    keys = ["", "a", "t:acme:k1", "ключ", "日本", "x" * 300]
    got = {r.key: r.slot for r in spark.createDataFrame([(k,) for k in keys], "key string").withColumn("slot", sharding.slot_of(F.col("key"))).collect()}
    assert got == {k: fnv(k) for k in keys}


def test_split_formulas_differ_where_they_should(spark):
    slots = spark.range(sharding.SLOTS).withColumnRenamed("id", "slot")
    by_formula = slots.withColumn("f", sharding.default_group(F.col("slot"), 3))
    by_range = sharding.slot_groups(sharding.default_ranges(spark, 3))
    differ = by_formula.join(by_range, "slot").where("f <> `group`")
    assert {r.slot for r in differ.collect()} == {5461, 10922}


def test_storage(spark):
    def usage(rows):
        return {r.tenant: (r.bytes, r["keys"]) for r in metering.tenant_storage(spark.createDataFrame([(0, k, v.encode()) for k, v in rows.items()], "group_id bigint, key string, value binary")).collect()}

    rows = {"t:acme:k1": "hello", "t:acme:k2": "xx", "t:beta:k1": "y", "plain-key": "zzzz", "t:acme": "q", "acme:k": "q", "t:": "q"}
    assert usage(rows) == {"acme": (11, 2), "beta": (3, 1)}
    assert usage({"t:acme:k1": "hi", "t:acme:a:b:c": ""}) == {"acme": (9, 2)}


def test_latest_replica(spark):
    use = lambda b, k: {"bytes": b, "keys": k}
    body = [
        ("node1", {"0": {"applied": 50, "tenants": {"acme": use(1000, 10), "beta": use(7, 1)}}, "1": {"applied": 40, "tenants": {"acme": use(500, 5)}}}),
        ("node2", {"0": {"applied": 30, "tenants": {"acme": use(9999, 99)}}, "1": {"applied": 45, "tenants": {"acme": use(600, 6)}}}),
    ]
    import json

    reports = formats.storage_reports(spark.createDataFrame([(n, json.dumps(b)) for n, b in body], "node string, body string"))
    assert {(r.tenant, r.bytes, r["keys"], r.groups) for r in metering.latest_replica(reports).collect()} == {("acme", 1600, 16, 2), ("beta", 7, 1, 1)}


def test_ranges():
    assert metering.parse_range("24h", 90_000) == (7_200, 93_600, 3_600)
    assert metering.parse_range("7d", 90_000) == (172_800 - 7 * 86_400, 172_800, 86_400)
    with pytest.raises(ValueError):
        metering.parse_range("year", 0)


def test_histogram_bounds(spark):
    values = [(0.0, 0), (0.001, 0), (0.0011, 1), (5.0, 11), (5.1, 12)]
    got = spark.createDataFrame([(v,) for v, _ in values], "v double").select(metering.bucket_of(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [b for _, b in values]


def test_routes(spark):
    rows = [("GET", "/v1/usage", "usage"), ("POST", "/kv", "kv_post"), ("GET", "/kv/a", "get"), ("PUT", "/kv/a", "put"), ("DELETE", "/kv/a", "delete"), ("GET", "/kv/", "other"), ("POST", "/kv/a", "other"), ("GET", "/kv", "other")]
    got = spark.createDataFrame([r[:2] for r in rows], "m string, p string").select(metering.route_op(F.col("m"), F.col("p")).alias("o")).collect()
    assert [r.o for r in got] == [r[2] for r in rows]


def test_counter_resets(spark):
    rows = [(0, "a", 5), (10, "a", 9), (20, "a", 2), (30, "a", 4)]
    got = monitoring.increases(spark.createDataFrame(rows, "t bigint, k string, v bigint"), ["k"]).agg(F.sum("gain")).first()[0]
    assert got == 8


S = history.CAS_SEPARATOR
CASES = {
    "sequential": ([("x", "set", "1", "", 0, 10, True), ("x", "get", "", "1", 11, 20, True), ("n", "incrby", "5", "5", 21, 30, True), ("n", "get", "", "5", 31, 40, True), ("x", "cas", f"1{S}2", "true", 41, 50, True), ("x", "get", "", "2", 51, 60, True)], "yes"),
    "later write": ([("x", "get", "", "1", 0, 10, True), ("x", "set", "1", "", 20, 30, True)], "no"),
    "concurrent": ([("x", "set", "1", "", 0, 10, True), ("x", "set", "2", "", 0, 10, True), ("x", "get", "", "2", 11, 20, True)], "yes"),
    "impossible": ([("x", "set", "1", "", 0, 5, True), ("x", "get", "", "1", 6, 10, True), ("x", "get", "", "2", 7, 15, True)], "no"),
    "failed write seen": ([("x", "set", "1", "", 0, 10, False), ("x", "get", "", "1", 11, 20, True)], "yes"),
    "cas of absent": ([("x", "cas", f"{history.ABSENT}{S}1", "true", 0, 1, True), ("x", "cas", f"{history.ABSENT}{S}2", "false", 2, 3, True), ("x", "get", "", history.ABSENT, 0, 9, True)], "yes"),
}


def test_linearizable(spark):
    names = list(CASES)
    rows = [(h, k, t, i, o, s, f, ok) for h, name in enumerate(names) for k, t, i, o, s, f, ok in CASES[name][0]]
    ops = spark.createDataFrame(rows, "history_id bigint, key string, type string, input string, output string, start bigint, finish bigint, success boolean")
    assert {names[r.history_id]: r.verdict for r in history.check_linearizable(ops).collect()} == {n: v for n, (_, v) in CASES.items()}
    assert history.explains([("set", str(i), "", 0, 9, True) for i in range(12)] + [("get", "", "x", 10, 11, True)], budget=50) is None


def test_segments(spark, tmp_path):
    good = b"".join(formats.encode_record(i, 1, f"p{i}".encode()) for i in range(1, 4))
    (tmp_path / "a.log").write_bytes(good)
    (tmp_path / "b.log").write_bytes(good[:-2])
    bad = bytearray(good)
    bad[30] ^= 1
    (tmp_path / "c.log").write_bytes(bytes(bad))
    (tmp_path / "d.log").write_bytes(b"")
    rows = formats.read_segments(spark, str(tmp_path)).collect()
    by = lambda n: [(r["index"], r.payload and bytes(r.payload), r.fault) for r in rows if r.path.endswith(n)]
    assert by("a.log") == [(1, b"p1", None), (2, b"p2", None), (3, b"p3", None)]
    assert by("b.log")[-1][2] == "torn" and len(by("b.log")) == 3
    assert by("c.log")[-1][2] == "corrupt"
    assert not by("d.log")


def test_snapshot_and_config(spark, tmp_path):
    rows = [(0, "b", b""), (0, "a", b"1")]
    s = spark.createDataFrame(rows, "group_id bigint, key string, value binary")
    formats.write_snapshot(s, str(tmp_path / "s"))
    assert {(r.key, bytes(r.value)) for r in formats.read_snapshot(spark, str(tmp_path / "s")).collect()} == {("b", b""), ("a", b"1")}
    (tmp_path / "c.json").write_text('{"version":1,"groups":3}')
    ranges = formats.read_shard_config(spark, str(tmp_path / "c.json"))
    assert ranges.count() == 3
    (tmp_path / "d.json").write_text(formats.shard_config_json(ranges).first().json)
    assert sorted(map(tuple, formats.read_shard_config(spark, str(tmp_path / "d.json")).collect())) == sorted(map(tuple, ranges.collect()))
    assert sharding.problems(ranges).count() == 0


def test_bench_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"label":"x","attempts":5,"errors":1,"error_codes":{"Unavailable":1},"ops_per_sec":1.5,"p99_us":7}\n')
    row = formats.read_bench(spark, str(tmp_path / "r.jsonl")).first()
    assert (row.attempts, row.error_codes, row.p99_us, row.reads) == (5, {"Unavailable": 1}, 7, None)


def test_formatting(spark):
    sizes = [(0, "0 B"), (999, "999 B"), (1_000, "1.00 KB"), (12_345, "12.3 KB"), (1_600_000, "1.60 MB"), (10**9, "1.00 GB")]
    got = spark.createDataFrame([(s,) for s, _ in sizes], "s bigint").select(text.format_bytes(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [t for _, t in sizes]


def test_streams(spark, tmp_path):
    rows = [(7_200 + i * 600, f"tn{i % 2}", "get", 429 if i % 5 == 0 else 200, 0.1, i) for i in range(40)]
    requests = spark.createDataFrame(rows, "ts bigint, tenant string, op string, status int, latency_s double, request_id bigint")
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1)
    for part in range(4):  # files that arrive one after the other; every second is compacted
        requests.where(F.col("request_id") % 4 == part).coalesce(1).write.mode("append").parquet(source)
        streams.hourly_usage(stream.parquet(source), str(tmp_path / "out"), str(tmp_path / "check"), every=2)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"base=3"}
    got = streams.usage_table(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*metering.BUCKET_KEY, "count").collect())) == sorted(map(tuple, metering.hourly(requests).select(*metering.BUCKET_KEY, "count").collect()))


def test_session_stream(spark, tmp_path):
    r = random.Random(9)
    rows = [(0, i, "set", "k", b"v", None, None, f"c{r.randrange(3)}", r.randrange(1, 30)) for i in range(80)]
    log = spark.createDataFrame(rows, LOG)
    source = str(tmp_path / "log")
    log.where("log_index < 40").coalesce(1).write.mode("append").parquet(source)
    for step in range(2):
        decided = streams.session_decisions(spark.readStream.schema(log.schema).parquet(source))
        decided.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        if not step:
            log.where("log_index >= 40").coalesce(1).write.mode("append").parquet(source)
    got = {r.log_index: r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.log_index: r.decision for r in sessions.decide(log).collect()}


def test_last_writes_stream(spark, tmp_path):
    r = random.Random(2)
    rows = [(0, i, r.choice(["set", "delete", "incr"]), f"k{r.randrange(9)}", str(i).encode(), None, 1, "c", i) for i in range(90)]
    log, source = spark.createDataFrame(rows, LOG), str(tmp_path / "log")
    for step in range(3):
        log.where(F.col("log_index") % 3 == step).coalesce(1).write.mode("append").parquet(source)  # out of order
        streams.last_writes(spark.readStream.schema(log.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "c"), every=2)
    want = {}
    for x in rows:
        if x[2] != "incr":
            want[x[3]] = x[1]
    assert {r.key: r.log_index for r in streams.last_writes_table(spark, str(tmp_path / "out")).collect()} == want
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"base=1", "part=2"}


def test_session_replay_stream(spark, tmp_path):
    r = random.Random(5)
    rows = [(0, i, "incr", f"k{i % 3}", None, None, 1, f"c{r.randrange(3)}", r.randrange(1, 30)) for i in range(80)]
    log = spark.createDataFrame(rows, LOG)
    want = {x.log_index: (x.decision, x.applied, x.result and bytes(x.result).decode(), x.error) for x in sessions.apply_once(log).collect()}
    # what the engine says of new commands; others' own results are never shown
    engine = [(g, c, i, q, *(want[i][1:] if want[i][0] == "apply" else (True, "wrong", None))) for g, i, *_, c, q in rows]
    commands, source = spark.createDataFrame(engine, "group_id bigint, client_id string, log_index bigint, seq bigint, applied boolean, result string, error string"), str(tmp_path / "in")
    for step in range(2):
        commands.where(F.col("log_index") >= 40 if step else F.col("log_index") < 40).coalesce(1).write.mode("append").parquet(source)
        told = streams.session_replays(spark.readStream.schema(commands.schema).parquet(source))
        told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {x.log_index: (x.decision, x.applied, x.result, x.error) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_windowed_usage_drops_what_is_too_late(spark, tmp_path):
    rows = [(3_600 * h + m, "tn1", i) for i, (h, m) in enumerate([(5, 0), (5, 10), (9, 0), (6, 0), (9, 5)])]
    source = str(tmp_path / "in")
    kind = "ts bigint, tenant string, request_id bigint"
    for step, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        counts = streams.windowed_usage(stream).select(F.unix_seconds("hour.start").alias("hour"), "tenant", "requests")
        save = lambda batch, n, step=step: batch.write.mode("append").parquet(str(tmp_path / f"out{step}"))
        counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {r.hour: r.requests for r in spark.read.parquet(str(tmp_path / "out0")).collect()}
    more = {r.hour: r.requests for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert last == {18_000: 2, 32_400: 1} and more == {32_400: 2}  # the request of hour 6 came after the watermark


def test_configurations_are_gated(spark):
    now = sharding.default_ranges(spark, 3, 3)
    assert sharding.adopt(now, sharding.default_ranges(spark, 2, 3)).count() == 3
    assert sharding.adopt(now, sharding.default_ranges(spark, 2, 4)).count() == 2


def test_anonymous_commands_always_apply(spark):
    rows = [(0, i, "incr", "k", None, None, 1, [None, "", "c"][i % 3], 1) for i in range(9)]
    got = {r.log_index: r.decision for r in sessions.decide(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {i: "duplicate" if i in (5, 8) else "apply" for i in range(9)}


def test_benchmark_lines_are_appended(spark, tmp_path):
    path = str(tmp_path / "bench")
    one = spark.createDataFrame([("a", 3, {"Unavailable": 2})], "label string, shards int, error_codes map<string,bigint>")
    formats.append_bench(one, path)
    formats.append_bench(one.withColumn("label", F.lit("b")), path)
    got = formats.read_bench(spark, path)
    assert sorted((r.label, r.shards, r.error_codes, r.p50_us) for r in got.collect()) == [("a", 3, {"Unavailable": 2}, None), ("b", 3, {"Unavailable": 2}, None)]


def test_labels_are_escaped(spark):
    rows = spark.createDataFrame([('a"b\\c\nd', 2)], "tenant string, n bigint")
    lines = formats.in_order(formats.expose_counter(rows, 1, "x_total", "Text.", ["tenant"], "n")).collect()
    assert [r.line for r in lines] == ["# HELP x_total Text.", "# TYPE x_total counter", 'x_total{tenant="a\\"b\\\\c\\nd"} 2']
