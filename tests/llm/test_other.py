"""Vectors, urls, chats, mixing, components, the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import chat, components, mixing, url_filter, vector_dedup
from tidelog.llm.queries import RULES


@pytest.mark.parametrize("heavy", [1_000, 3])
def test_components(spark, heavy, monkeypatch):
    monkeypatch.setattr(components, "HEAVY", heavy)  # at 3 most nodes are joined apart
    r = random.Random(0)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16))
    rows = []
    for i, b in enumerate(base):
        rows += [(len(rows) + k, (b * (1 + k) + 0.05 * k * r.standard_normal(16)).tolist()) for k in range(i % 5)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, rows[0][1]), (905, rows[0][1]), (None, rows[0][1])]
    rows += [(906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e200, 2e200])]
    out = vector_dedup.link_vectors(spark.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<double>, n_links int"), block=4)
    got = {x.vec_id: x for x in out.collect()}
    fine = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            fine[i] = np.array(x) / np.abs(x).max()
    near = {i: {j for j in fine if j != i and len(fine[j]) == len(fine[i]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= 0.95} for i in fine}
    assert {i: got[i].n_links for i in fine} == {i: len(n) for i, n in near.items()}
    for i in fine:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, None))


def naive_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
    return host, path, max(fits, key=lambda x: (len(x.key), len(x.host)), default=None)


def test_vector_recall(spark):
    """Pairs at the bound itself: as many are found as the constants promise, whatever the depth of the lists."""
    r = np.random.default_rng(1)
    n, size = 1_500, 32
    a = r.standard_normal((n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.standard_normal((n, size))
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(2 * i + k, v[i].tolist()) for i in range(n) for k, v in enumerate((a, b))]
    for meetings in (vector_dedup.MEETINGS, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vector_dedup, "MEETINGS", meetings)
            out = vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
            assert out.where("n_links > 0").count() >= 0.99 * 2 * n
    assert vector_dedup.plan(10**6, 0.95)[1] > vector_dedup.plan(10**3, 0.95)[1]
    assert vector_dedup.link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_urls(spark):
    hosts = ["net", "example.net", "a.Example.NET", "xexample.net", "example.com", "b.c.example.com", "org", "y.org", "net.org", "", "é.net", "a..net", "." * 300 + "net"]
    tails = ["", "/", "/en/", "/en", "/de/x?y#z", "/fr/", "?a=/fr/", "#://net/", "/fr/://net/", "/en/" + "x" * 5_000, "\n/fr/"]
    urls = [f"{s}{h}{t}" for s in ("http://", "://", "") for h in hosts for t in tails] + [None, "://", "mailto:x@net", "http://net/", "http://net/"]
    rows = [(i, u, "r") for i, u in enumerate(urls)]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, Rule string"), RULES)
    for r in out.collect():
        host, path, rule = naive_rule(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.key, rule.verdict if rule else "allow"), r.url
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows[:3], "page_id bigint, url string, x string"), []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    """Many keys, so that several levels are needed."""
    listed = spark.range(0, 3_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("key"))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) >= 2
    got = {r.key for r in universe.where(url_filter.in_cascade(F.col("key"), levels)).collect()}
    assert got == {r.key for r in listed.collect()}
    # each level halves, about, the keys of the level two before it
    sizes = [x.bits * math.log(2) ** 2 / -math.log(0.5) for x in levels[1:]]
    assert all(b < 0.8 * a for a, b in zip(sizes, sizes[2:], strict=False) if a > 150) and len(levels) < 16


def test_sharded_cascade_is_exact(spark, monkeypatch):
    """A list too long for one filter: every key asks the cascade of its shard."""
    monkeypatch.setattr(url_filter, "FILTER_BYTES", 16)
    hosts = [f"h{i}.com" for i in range(500)]
    rules = [url_filter.Rule(h, "/", "block" if i % 3 else "allow") for i, h in enumerate(hosts) if i % 2] + [url_filter.Rule("h1.com", "/", "other")]
    pages = spark.createDataFrame([(i, f"http://w.{h}/x") for i, h in enumerate(hosts)], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, "none").collect()}
    assert got == {i: (f"h{i}.com/", "block" if i % 3 else "allow") if i % 2 else (None, "none") for i in range(500)}
    monkeypatch.setattr(url_filter, "ALL_BYTES", 16)
    with pytest.raises(ValueError, match="several calls"):
        url_filter.judge_urls(pages, rules)


NASTY = st.lists(st.sampled_from(["\\", "#", "###", "### ", "</turn>", "</turn>\n", "<", "/", "\n", ": ", "User", "Assistant", "é", "a", "$1", " "]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5), st.sampled_from(["user", "assistant", "User", "tool: x", "", "\\"]) | st.none(), NASTY | st.none()), min_size=1, max_size=60))
def test_chats(spark, turns):
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    want = {}
    for c, t, r, x in turns:
        want.setdefault(c, []).append((t, r or "", x or ""))
    got = {r.conv_id: r for r in out.collect()}
    for c, own in want.items():
        own.sort()
        assert got[c].identical
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss == "".join(x for _, r, x in own if r == "assistant")
        texts = got[c].formatted.split("</turn>\n")
        assert len(texts) == len(own) + 1 and all("</turn>" not in t for t in texts)


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(20_000).selectExpr("1 conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('said ### ', id) text", "'x' TURNS")
    out = chat.format_chats(rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert out.n_turns == 20_000 and out.identical and out.loss == "".join(f"said ### {i}" for i in range(1, 20_000, 2))


def test_chat_limits(spark):
    rows = [(None, 0, "user", "x"), (1, 0, "assistant", "y" * 300_000), (1, None, None, None)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert out[None].n_turns == 1 and out[1].n_turns == 2 and out[1].identical
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_mixing(spark, bound, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bound)  # at 0 tokens are joined with their ratios
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        kind = ["news", "code", "junk"][i % 3 if i % 9 else 0]
        pool = {"news": "said today people city", "code": "def return self import", "junk": "%% && ## **"}[kind].split()
        rows.append((i, " ".join(r.choice(pool + ["the", "of"]) for _ in range(r.randint(5, 60)))))
        if i % 2:
            labels.append((i, kind))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("RATE", F.lit(1)), spark.createDataFrame([*labels, (None, "news"), (7, None)], "doc_id bigint, domain string")
    weights = {"news": 2.0, "code": 1.0, "junk": 1.0}
    out = mixing.mix(docs, table, weights).collect()
    p = np.array([x.posterior for x in out])
    t, rate = np.array([x.n_tokens for x in out]), np.array([x.rate for x in out])
    share = (t * rate) @ p / t.sum()
    assert np.allclose(share, [0.25, 0.25, 0.5], atol=1e-3)  # code, junk, news
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert abs(np.mean([x.n_copies for x in out]) - rate.mean()) < 0.15
    # the same rates come out of projected gradient steps in memory
    target = np.array([0.25, 0.25, 0.5]) * t.sum()

    def rates(steps):
        x = np.ones(len(t))
        for g in steps:
            x = np.maximum(0, x - p @ g)
        return x

    def passed(steps):
        x = rates(steps)
        return (t * x) @ p, (p * (t * (x > 0))[:, None]).T @ p

    assert np.allclose(rates(mixing.descend(passed, target)[0]), rate, atol=1e-6)


def test_mixing_posteriors_by_hand(spark):
    """The posteriors from whole counts, however many words there are: 60,000 rare ones tell nothing and cut none off."""
    rows = [(i, " ".join(["apple" if i % 2 else "pear"] * 2 + [f"w{i}x{j}" for j in range(1_000)])) for i in range(60)]
    docs, table = spark.createDataFrame([*rows, (90, "apple q"), (91, "pear " * 100_000)], "doc_id bigint, text string"), spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "doc_id bigint, domain string")
    out = {x.doc_id: x.posterior for x in mixing.posteriors(docs, table)[0].collect()}
    counts, n = np.array([[0.0, 30], [30, 0]]), np.array([30 + 30_000.0] * 2)  # apple, pear by domain
    shared = (counts.sum(1) + 0.5) / (60_060 + 0.5 * 60_002)
    taken = np.maximum(counts - 3, 0) / n
    rest = 1 - taken.sum(0)
    assert np.allclose(mixing.domain_logs(counts, n, 60_060, 60_002), np.log((taken + rest * shared[:, None]) / (rest * shared[:, None])))
    assert all(out[i][i % 2] > 0.6 for i in range(60)) and out[90][1] > 0.9 and out[91][0] > 0.9
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert mixing.mix(none, table, {"a": 1.0}).count() == 0


def test_mixing_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    out = mixing.mix(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), none, {"a": 1.0}).collect()
    assert {x.rate for x in out} == {1.0}


def test_pipeline_against_brute_force(spark):
    """Every stage's decision made again in plain Python, but for the toxicity scores, on the smallest tables."""
    import corpus_pipeline
    from tests.llm.test_text import brute_leaks, brute_texts
    from tidelog.llm import minhash, toxicity
    from tidelog.llm.common import words_of
    from tidelog.llm.queries import MIX_WEIGHTS, quality_domains

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    flagged = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").select("doc_id").collect()}
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in flagged)
    texts = {doc: text for (doc, _), text in zip(left, brute_texts(left), strict=True)}
    bags = {i: Counter(minhash.shingles_of(words_of((t or "").encode()))) for i, t in texts.items()}
    class_of = {i: i for i in bags}

    def find(x):
        while class_of[x] != x:
            x = class_of[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bags[a] and bags[b] and minhash.weighted_jaccard(bags[a], bags[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                class_of[y] = x
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {i for i in ids if find(i) == i and not brute_leaks(texts[i], items)[1]}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(out) == kept and len(out) < len(left) < docs.count()
    assert all(r.text == texts[i] and r.n_chars == len(r.text) and r.n_tokens == len(words_of(r.text.encode())) for i, r in out.items())
    # rates: those of projected gradient steps in memory. So few labels teach little, the targets are out of reach, and no small change comes nearer
    final = spark.createDataFrame([(i, texts[i]) for i in sorted(kept)], "doc_id bigint, text string")
    scored, domains = mixing.posteriors(final, quality_domains(spark, d))
    p = {r.doc_id: np.array(r.posterior) for r in scored.collect()}
    t, rate = np.array([out[i].n_tokens for i in sorted(kept)]), np.array([out[i].rate for i in sorted(kept)])
    post, target = np.stack([p[i] for i in sorted(kept)]), t.sum() * np.array([MIX_WEIGHTS[x] for x in domains])

    def rates(steps):
        x = np.ones(len(t))
        for g in steps:
            x = np.maximum(0, x - post @ g)
        return x

    def passed(steps):
        x = rates(steps)
        return (t * x) @ post, (post * (t * (x > 0))[:, None]).T @ post

    assert np.allclose(rates(mixing.descend(passed, target)[0]), rate, atol=1e-6) and (rate >= 0).all()
    assert np.abs((t * rate) @ post - target).sum() <= np.abs(t @ post - target).sum()
    assert all(np.floor(r.rate) <= r.n_copies <= np.floor(r.rate) + 1 for r in out.values())


CLASH = ["score", "predicted", "llr", "held_out", "n_words", "hit_spans", "n_hit", "items", "n_lines", "n_dropped", "dropped_lines", "kept_sha256", "copy_of", "class_id", "kept", "n_tokens", "rate", "n_copies", "posterior", "Text2"]


def test_stages_keep_what_they_do_not_decide(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids and columns named like results, stage by stage; and no rows at all."""
    import corpus_pipeline

    r = random.Random(8)
    for name, rows, kind in (("labels", [(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = [" ".join(r.choice("red green blue white black grey pink".split()) + str(r.randrange(50)) for _ in range(30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "?!"), (53, "word " * 60_000), (None, "lone text"), (None, None), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{i}{c}" for c in CLASH]) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH))
    seen = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        own = ["n_tokens", "rate", "n_copies"] if n == 4 else []
        assert out.columns == [c for c in docs.columns if c not in own] + own, name
        got = out.collect()
        for c in set(CLASH) - set(own):
            assert all(x[c] == f"{x.doc_id}{c}" for x in got), (name, c)
        assert {x.doc_id for x in got} >= {50, 51, 52, 53, None} and sum(x.doc_id is None for x in got) == 2, name
        assert sum(x.doc_id == 3 for x in got) == (1 if name == "minhash_dedup" else 2), name
        assert stage(spark, seen.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_html_extract", "op7_chat_format"])
def test_query_columns(spark, name):
    import __spark_entry__

    out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    want = {"op1_html_extract": ["page_id", "url", "text", "n_chars"], "op7_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]}[name]
    assert out.columns[: len(want)] == want
    if name == "op7_chat_format":
        said = r"\### Assistant: </turn> ok"
        row = out.where("conv_id = -7").first()
        assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and row.loss_chars == 26
