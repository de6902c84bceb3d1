"""HTML, lines, toxicity, language, decontamination, near duplicates."""

import hashlib
import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, html_text, language, line_dedup, minhash, toxicity
from tests.llm.pages import PAGES
from tidelog.llm.common import words_of

DOC = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def html_model(spark):
    return html_text.train(spark, 600)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("plain words only", ["plain words only"]),
        ("<p>one<p>two &amp; three", ["one", "two & three"]),
        ("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>a\n  b<br>c</p></article><footer>f</footer>", ["T", "a b c"]),
        ("<header><h1>Site</h1></header><main><p>x</p><div class='ad'>buy now</div><p>&lt;y&gt;&nbsp;z</p></main><aside>s</aside>", ["x", "<y> z"]),
        ("<article><p>x</p><section id='comments'><article class='comment'><p>reader speaks at some length here</p></article></section></article>", ["x"]),
        ("<div class='cookie-notice'><p>We use cookies.</p></div><div class='post'><p>Hi.</p></div><form><label>n</label><button>go</button></form>", ["Hi."]),
        ("<article><script>var a='</p>';</script><style>p{}</style><p>only this</p><!-- <p>not this</p> --></article>", ["only this"]),
        ("<article><p>cut of", ["cut of"]),
    ],
)
def test_pages(html_model, page, blocks):
    assert html_text.blocks_of([html_text.Page(page)], *html_model) == [blocks]


def test_pages_that_no_generator_wrote(spark):
    """Whole main texts; three short blocks beside them are taken in too: a skip link, a heading of comments, a shop's name."""
    html_model = html_text.train(spark)
    right = wrong = missed = 0
    for page, want in PAGES:
        got = html_text.blocks_of([html_text.Page(page)], *html_model)[0]
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert right == sum(len(want) for _, want in PAGES) and not missed and wrong <= 3, (right, wrong, missed)


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '\">", "</b", "<script ", "<!-", "<x y=\"'> ", "<x-y>", "<p><x>", "<x></y>", "<"])
def test_broken_pages_take_time_in_proportion(piece):
    def seconds(n: int) -> float:
        page = "<p>word " + piece * (n // len(piece))
        begin = time.process_time()
        html_text.Page(page)
        return time.process_time() - begin

    assert seconds(1_000_000) < 20


def test_foreign_elements(html_model):
    page = "<article><p>one <svg viewBox='0 0 1 1'/> two</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><text>no</text></svg><p>a < b</p></article>"
    assert html_text.blocks_of([html_text.Page(page)], *html_model) == [["one two", "so x=2 holds", "a < b"]]


def test_marginals_equal_enumeration(html_model):
    table, edges = html_model
    page = html_text.Page("<div class='post'><p>a b c</p><aside>d</aside></div>")
    n = len(page.parent)
    node = [[sum(table[f][s] for f in fs if f in table) for s in range(html_text.STATES)] for fs in page.features]
    total = np.zeros((n, html_text.STATES))
    for states in itertools.product(range(html_text.STATES), repeat=n):
        if states[0] != html_text.MIXED:
            continue
        score = sum(node[i][states[i]] + edges[int(i in page.texts)][states[page.parent[i]]][states[i]] for i in range(1, n))
        for i in range(n):
            total[i, states[i]] += np.exp(score)
    total /= total.sum(axis=1, keepdims=True)
    want = np.stack([total[:, 0] + total[:, 3], total[:, 1] + total[:, 4], total[:, 2]], 1)
    assert np.allclose(html_text.marginals([page], table, edges), want, atol=1e-9)


def test_held_out_labelled_pages(html_model):
    right = wrong = 0
    for seed in range(50_000, 50_060):
        page = html_text.Page(html_text.labelled_page(seed))
        p = html_text.marginals([page], *html_model)
        for i in page.texts:
            same = (page.label[i] == html_text.CONTENT) == (p[i, html_text.CONTENT] >= 0.5)
            right, wrong = right + same, wrong + (not same)
    assert right > 0.95 * (right + wrong)


def test_extract_rows(spark):
    rows = [(1, None, "old"), (2, "", "old"), (3, "<p>" + "word " * 50_000, "old"), (3, "<p>" + "word " * 50_000, "old")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, html string, TEXT string"), 200).orderBy("page_id").collect()
    assert [len(r["text"]) for r in out] == [0, 0, 249_999, 249_999]
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, html string"), 100).count() == 0


def test_perfect_hash():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 64, 65, 3_000):
        keys = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        p = line_dedup.PerfectHash.load(line_dedup.PerfectHash(keys).dump())
        assert sorted(p.index(keys)) == list(range(len(keys)))


def brute_kept(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    docs = {}
    for doc, text in rows:
        for k in map(key, (text or "").split("\n")):
            if len(k) >= min_chars:
                docs.setdefault(k, set()).add(-(2**63) if doc is None else doc)
    for doc, text in rows:
        own = -(2**63) if doc is None else doc
        yield [line for line in (text or "").split("\n") if len(docs.get(key(line), ())) < min_docs or max(docs[key(line)]) == own]


def brute_texts(rows):
    return [None if text is None else "\n".join(kept) for (_, text), kept in zip(rows, brute_kept(rows), strict=True)]


def brute_lines(rows):
    out = []
    for (doc, text), kept in zip(rows, brute_kept(rows), strict=True):
        n = len((text or "").split("\n"))
        out.append((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("bound", "passes"), [(1 << 26, 4), (1, 1 << 20), (1, 0)])
def test_lines(spark, bound, passes, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)  # many shards; at a bound of one byte a pass for each, or probes sent to them
    monkeypatch.setattr(line_dedup, "MOST_PASSES", passes)
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 12)
    r = random.Random(1)
    pool = [f"line number {i} é with Some Words" for i in range(25)] + ["short", "", "   ", "x" * 19, "é" * 20, "A" * 20, "a" * 20 + "\t"]
    rows = [(None if i == 7 else i % 37, None if i == 3 else "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(99, "a b " * 30_000), (99, "a b " * 30_000), (100, ""), (101, "\n\n")]
    got = line_dedup.dedup_lines(spark.createDataFrame([(*x, "k") for x in rows], DOC + ", N_LINES string"), broadcast_bytes=bound)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == brute_lines(rows)


def test_lines_of_equal_half_hashes(spark):
    """Keys whose first 64 bits are equal are told apart by the others, and none is lost."""
    stats = [(1, 1, 3, 9), (1, 2, 4, 8), (1, 3, 5, 7), (2, 1, 3, 6)]
    shards = [tuple(r) for r in line_dedup.build_shards(spark.createDataFrame(stats, "h1 bigint, h2 bigint, n_docs bigint, last_doc bigint"), 1).collect()]
    found, last = line_dedup.Probe(shards, 1).last_docs(np.array([1, 1, 1, 2, 1, 3]), np.array([1, 2, 3, 1, 4, 9]))
    assert found.tolist() == [True] * 4 + [False] * 2 and last[:4].tolist() == [9, 8, 7, 6]


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def toxic_rows(n=240):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [r.choice("the of and to in on by with from over under into".split()) + r.choice(["", "ing", "ed"]) for _ in range(r.randint(8, 80))]
        if bad:
            words[:: max(1, len(words) // 4)] = [r.choice(["vile", "nasty", "horrid"])] * len(words[:: max(1, len(words) // 4)])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_word_ratios_by_hand():
    """The two models' probabilities written out: each sums to one over all words, and rare words have the backoff's ratio."""
    r = np.random.default_rng(0)
    size = 400
    uni = np.stack([r.integers(0, 40, size), r.integers(0, 6, size)], 1).astype(float)
    uni[:5, 1] += 30
    shared = r.random(size)
    shared /= shared.sum()
    n = uni.sum(0)
    for d in (2.0, 6.0):
        got = toxicity.word_ratios(uni, shared, d, n, size)
        p = np.zeros((size, 2))
        for c in (0, 1):
            kept = []
            for w in range(size):
                explained = n[c] * (uni[w].sum() + 0.5) / (uni.sum() + 0.5 * size)
                kept.append(max(uni[w, c] - explained - d * explained**0.5, 0) / n[c] if uni[w].sum() > 1 else 0.0)
            p[:, c] = np.array(kept) + (1 - sum(kept)) * shared
        assert np.allclose(p.sum(0), 1)
        low = [w for w in range(size) if not toxicity.left_over(uni, d, n, size)[w].any()]
        plain = np.log(p[low[0], 1] / p[low[0], 0])
        assert np.allclose(got, np.log(p[:, 1] / p[:, 0]) - plain) and np.allclose(got[low], 0) and (got[:5] > 0.9).all()
        kept = [w for w in range(size) if w not in low]  # words that tell nothing need not be kept
        assert np.allclose(toxicity.word_ratios(uni[kept], shared[kept], d, n, size), got[kept])


def test_toxicity_of_many_words(spark, monkeypatch):
    """Scores are the same whether the words that tell something are broadcast or joined; 90,000 words that tell nothing cut none off."""
    rows, labels = toxic_rows()
    rows = [(i, t + " " + " ".join(f"x{i}y{j}" for j in range(400))) for i, t in rows]
    docs, table = spark.createDataFrame([*rows, (2000, None), (2001, "vile " * 50_000)], DOC), spark.createDataFrame([*labels, (0, 0), (None, 1)], "doc_id bigint, toxic int")
    one = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, table).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_BYTES", 0)
    two = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, table).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
    assert sum((one[i] >= 0.3) == bool(y) for i, y in labels) > 0.97 * len(labels) and one[2001] > 0.3 > one[2000]
    assert toxicity.score_toxicity(spark.createDataFrame([], DOC), table).count() == 0


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "?!"), (0, rows[0][1])], DOC).withColumn("Score", F.lit("x"))
    kind = "doc_id bigint, toxic int"
    one = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, kind)).collect()}
    held = [(i, y) for i, y in labels if one[i].held_out]
    assert len(held) > 30
    assert sum(one[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in one.values())
    assert one[1000].score == one[1001].score == one[1002].score < 0.3
    # labels of held-out documents are never read
    flipped = [(i, 1 - y if one[i].held_out else y) for i, y in labels]
    two = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame(flipped, kind)).collect()}
    assert all(abs(one[i].score - two[i]) < 1e-9 for i in one)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], DOC)
    out = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert {r.score for r in out} == {0.5}


def test_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "<0xC3>", "<0xA9>"]
    lattice = language.Lattice({p: i for i, p in enumerate(pieces)})
    r = np.random.default_rng(0)
    prob = r.random((len(pieces), 2)) / 4

    def brute(s, k):
        if not s:
            return 1.0
        total = sum(prob[pieces.index(s[:j]), k] * brute(s[j:], k) for j in range(1, len(s) + 1) if s[:j] in pieces)
        if s[0] not in pieces:
            total += prob[6, k] * prob[7, k] * brute(s[1:], k)
        return total

    words = ["▁a", "▁abba", "▁éab", "▁bab", "▁ééé"]
    total, _ = language.forward(lattice, words, prob)
    for w, row in zip(words, total, strict=True):
        assert np.allclose(row, [brute(w, 0), brute(w, 1)])
    # expected counts: derivative of the log likelihood by the log probability
    counts = np.array([1.0, 2.0, 1.0, 1.0, 3.0])
    got = language.expected(lattice, words, counts, prob[:, :1])
    for i in range(len(pieces)):
        up = prob[:, :1].copy()
        up[i] *= 1 + 1e-6
        change = (counts * (np.log(language.forward(lattice, words, up)[0][:, 0]) - np.log(total[:, 0]))).sum() / 1e-6
        assert abs(change - got[i]) < 1e-3


def test_long_words_are_not_cut(monkeypatch):
    """Logarithms in stretches give what the products give, pieces across any place included."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aab", "<0xC3>", "<0xA9>"]
    lattice = language.Lattice({p: i for i, p in enumerate(pieces)})
    r = np.random.default_rng(4)
    prob = r.random((len(pieces), 2)) / 2
    words = ["▁" + "".join(r.choice(list("abé"), n)) for n in (3, 30, 47, 60, 23, 24)] + [""]
    plain, _ = language.forward(lattice, words[:-1], prob)
    counts = np.array([1.0, 2, 3, 4, 5, 6, 7])
    want = language.expected(lattice, words[:-1], counts[:-1], prob[:, :1])
    for stretch in (4, 4_096):
        monkeypatch.setattr(language, "STRETCH", stretch)
        got = language.log_likelihoods(lattice, words, prob)
        assert np.allclose(got[:-1], np.log(plain)) and not got[-1].any()
        assert np.allclose(language.expected_pieces(lattice, words, counts, prob[:, :1]), want)
    far = language.log_likelihoods(lattice, ["▁" + "ab" * 20_000], prob)
    assert np.isfinite(far).all() and (far < -5_000).all()


def test_language_clashing_and_empty(spark):
    kind = DOC + ", lang string, SCORE string, Lang_Pred int"
    rows = [(1, "the cat", "aa", "s", 1), (1, "the cat", "aa", "s", 1), (2, None, "bb", "s", 2)]
    out = language.identify(spark.createDataFrame(rows, kind)).collect()
    assert [r.lang_pred for r in out if r.doc_id == 1] == ["aa", "aa"] and len(out) == 3
    assert language.identify(spark.createDataFrame([], kind)).count() == 0


def test_language(spark):
    r = random.Random(2)
    ends = {"aa": ["ing", "the", "tion"], "bb": ["ung", "der", "keit"], "cc": ["ción", "los", "aje"]}
    rows = []
    for i in range(150):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join(r.choice("bdfglmnprst") + r.choice("aeiou") + r.choice(ends[lang]) for _ in range(r.randint(5, 60))), None if i % 29 == 0 else lang))
    rows += [(500, None, "aa"), (501, "12 34 !!", "bb"), (502, "", None), (503, "x" * 5_000, "aa"), (0, rows[0][1], None)]
    out = {x.doc_id: x for x in language.identify(spark.createDataFrame(rows, DOC + ", lang string")).collect()}
    for i in (500, 501, 502):
        assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
    assert out[503].lang_pred in ends
    held = [x for x in rows[:150] if out[x[0]].held_out]
    assert all(out[i].lang_pred == ["aa", "bb", "cc"][i % 3] for i, _, _ in held)
    nothing = language.identify(spark.createDataFrame([(1, "abc", None)], DOC + ", lang string")).first()
    assert nothing.lang_pred == "und"


def brute_leaks(text, items, size=10):
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        for w in decontaminate.windows_of(words_of((t or "").encode()), size):
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_leaks(spark, bound):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("a b c the É".split()) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, "?!"), (None, "a a a"), (3, "a b c")]
    docs = [(i, text(r.randint(0, 60)) + (" " + r.choice(items[:12])[1].upper().replace(" ", ", ") if i % 2 else "")) for i in range(40)]
    docs += [(100, None), (101, ""), (100, "É, the A"), (102, "b " * 20_000)]
    out = decontaminate.find_leaks(spark.createDataFrame([(*d, 1) for d in docs], DOC + ", N_HIT int"), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=bound)
    got = Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in out.collect())
    known = [x for x in items if x[0] is not None]
    want = Counter((d, *(lambda a, b, c: (a, b, tuple(c)))(*brute_leaks(t, known))) for d, t in docs)
    assert got == want


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_leaks(spark.createDataFrame([(1, "a")], DOC), none).first().n_hit == 0
    assert decontaminate.find_leaks(spark.createDataFrame([], DOC), none).count() == 0


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    off = []
    for _ in range(40):
        n, m = 150, 320
        base, wa = r.integers(0, 2**63, n).astype(np.uint64), r.integers(1, 7, n)
        wb = np.where(r.random(n) < 0.6, wa, r.integers(0, 9, n))
        k = wb > 0
        s = minhash.signatures(np.r_[np.zeros(n, np.int32), np.ones(k.sum(), np.int32)], np.r_[base, base[k]], np.r_[wa, wb[k]], 2, m)
        off.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(off)) < 4 * np.std(off) / len(off) ** 0.5 + 1e-3
    assert np.std(off) < 0.06


def test_near_duplicates(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        for k in range(9):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w) if k % 2 else " ".join(w).upper() + "!"))
    shared = " ".join(word() for _ in range(40))  # a passage that many hold is no near copy
    rows += [(len(rows) + i, shared + " " + " ".join(word() for _ in range(50))) for i in range(12)]
    rows += [(900, None), (901, ""), (902, ""), (903, "a b"), (904, "A, b"), (905, "b a"), (None, "a b"), (0, rows[0][1]), (906, "z " * 4_000), (907, "z " * 4_100)]
    out = minhash.near_duplicates(spark.createDataFrame([(*x, "c") for x in rows], DOC + ", class_id string"))
    got = {x.doc_id: x for x in out.collect()}
    bags = {d: Counter(minhash.shingles_of(words_of((t or "").encode()))) for d, t in rows if d is not None}
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if bags[a] and bags[b] and minhash.weighted_jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {d: got[d].class_id for d in bags} == {d: find(d) for d in bags}
    assert got[None].kept and all(got[d].kept == (got[d].class_id == d) for d in bags)
    assert got[904].copy_of == 903
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
