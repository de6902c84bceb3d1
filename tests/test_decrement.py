"""Guarded counters over every increment, against a plain loop."""

from tidelog.operators import kv_log
from tidelog.plans import catalog

DATA = "/root/testdata/sf0.001"
TOP = 2**63 - 1


def test_overflow_leaves_the_counter(spark):
    steps = [TOP, TOP, -1, 1, 1, -TOP, -1]
    log = spark.createDataFrame([(0, i, "k", d) for i, d in enumerate(steps)], "group_id bigint, log_index bigint, key string, delta bigint")
    got = [(r.applied, r.total, r.error) for r in kv_log.decrement_if_positive(log).orderBy("log_index").collect()]
    over = (False, TOP, "overflow")
    assert got == [(True, TOP, None), over, (True, TOP - 1, None), (True, TOP, None), over, (True, 0, None), (False, 0, "below_zero")]


def test_query_over_every_increment(spark):
    want, totals = [], {}
    for r in catalog.views.oplog(spark, DATA).where("op = 'incr'").orderBy("log_index").collect():
        total = totals.get(r.key, 0)
        error = "below_zero" if r.delta < 0 and total + r.delta < 0 else "overflow" if total + r.delta > TOP else None
        totals[r.key] = total if error else total + r.delta
        want.append((r.key, r.log_index, not error, totals[r.key], error or ""))
    got = catalog.QUERIES["kv_decrement_whole"](spark, DATA).na.fill("", ["error"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {e for *_, e in want} == {"", "below_zero", "overflow"}
