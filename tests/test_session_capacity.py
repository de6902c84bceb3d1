"""Sessions against a sequential table that forgets its oldest."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import sessions
from tidelog.plans import catalog

LOG = "group_id bigint, log_index bigint, op string, key string, value binary, expected binary, delta bigint, client_id string, seq bigint"


def replay(rows, capacity):
    tables, values, out, gone = {}, {}, [], []
    for g, index, _, key, _, _, delta, client, seq in sorted(rows):
        t = tables.setdefault(g, {})
        have = t.get(client)
        if have and seq == have[0]:
            out.append((g, index, "duplicate", have[1]))
            continue
        if have and seq < have[0]:
            out.append((g, index, "stale", None))
            continue
        values[g, key] = values.get((g, key), 0) + delta
        if client:
            if not have and len(t) >= capacity:
                old = min(t, key=lambda c: t[c][2])
                gone.append((g, old, t.pop(old)[2]))
            t[client] = (seq, values[g, key], have[2] if have else index)
        out.append((g, index, "apply", values[g, key]))
    return out, gone, [(g, c, *v) for g, t in tables.items() for c, v in t.items()]


def number(data):
    return None if data is None else int(bytes(data))


@pytest.mark.parametrize("capacity", [1, 3, 100])
def test_clients_that_return(spark, capacity):
    r = random.Random(capacity)
    rows = [(g, i, "incr", f"k{r.randrange(3)}", None, None, 1, r.choice([f"c{r.randrange(7 if g else 3)}", "", None]), r.randrange(0, 6)) for g in range(3) for i in range(1, 121)]
    want, gone, live = replay(rows, capacity)
    log = spark.createDataFrame(rows, LOG).repartition(5)
    got = sessions.apply_once(log, capacity).collect()
    assert sorted((x.group_id, x.log_index, x.decision, number(x.result)) for x in got) == sorted(want)
    assert sorted(map(tuple, sessions.evicted(log, capacity).collect())) == sorted(gone)
    table = sessions.table(log, capacity).collect()
    assert sorted((x.group_id, x.client_id, x.last_seq, number(x.result), x.birth) for x in table) == sorted(live)


def test_first_sequence_applies(spark):
    log = spark.createDataFrame([(0, 1, "incr", "k", None, None, 1, "a", 0), (0, 2, "incr", "k", None, None, 1, "a", 0)], LOG)
    assert [x.decision for x in sessions.decide(log).orderBy("log_index").collect()] == ["apply", "duplicate"]


def test_forgotten_query(spark):
    data = "/root/testdata/sf0.001"
    log = catalog.views.oplog(spark, data).select(*[c.split()[0] for c in LOG.split(", ")])
    rows = [tuple(x) for x in log.withColumn("delta", F.lit(0)).withColumn("value", F.lit(None)).withColumn("expected", F.lit(None)).collect()]
    got = catalog.QUERIES["session_forgotten"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(replay(rows, 5)[1])
