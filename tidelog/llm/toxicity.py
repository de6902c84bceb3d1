"""Toxicity by two class-conditional Kneser-Ney models with a shared backoff.

An expression (a word) has one higher-order context, the class. Its probability there is
its discounted share of the class's documents, and the discounted mass goes to a backoff
that both classes share: Kneser-Ney's continuation probability, the number of distinct
contexts (documents of the whole corpus, labelled or not) in which the word occurs. As in
modified Kneser-Ney the discount goes by the count: it is what the word's share of both
classes explains, and some standard deviations of that. A word that one class has more of
by chance is left to the backoff in both and tells nothing, and a word of a language with
few labelled texts counts once no chance explains it.
Words count once a document, in fitting as in scoring; a line repeated a hundred times is
no evidence a hundred times. A text's score is the logistic of its length-normalised
log-likelihood ratio. The discount, the
power of the length that normalises and the logistic are fitted on scores from models that
have not seen the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import BROADCAST_BYTES, TOKEN_BYTES, attach, emit, held_out, joined_sums, raw, stash, words_of

#: Labelled documents of each class that the models are fitted on, about (a sample by hashed id).
SAMPLE = 6_000
#: Discounts tried, in standard deviations.
DISCOUNTS = (2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
#: Powers of the length tried: evidence in a long text is thin by the word and plenty in sum.
POWERS = (1.0, 0.75, 0.5)
FOLDS = 4


def word_ratios(uni: np.ndarray, shared: np.ndarray, discount: float, n: np.ndarray, size: int) -> np.ndarray:
    """log p(word | label 1) - log p(word | label 0).

    uni: words x 2 document counts, shared: their backoff probabilities, n: all words'
    counts by class, size: number of distinct words. The ratio of the two backoff masses is
    taken off: it is that of any word that neither class has more of, of unknown words too,
    and these are to tell nothing. A word that no discount leaves anything of has ratio 0,
    so it need not be kept: no vocabulary is cut.
    """
    taken = left_over(uni, discount, n, size) / np.maximum(n, 1.0)
    rest = np.maximum(1 - taken.sum(0), 1e-6)
    p = taken + rest * shared[:, None]
    return np.log(p[:, 1]) - np.log(p[:, 0]) - math.log(rest[1] / rest[0])


def left_over(uni: np.ndarray, discount: float, n: np.ndarray, size: int) -> np.ndarray:
    """words x 2: what the discount leaves of the counts; nothing of a word of a single document."""
    common = (uni.sum(1) + 0.5) / (n.sum() + 0.5 * size)
    explained = np.maximum(n, 1.0) * common[:, None]
    return np.maximum(uni - explained - discount * np.sqrt(explained), 0) * (uni.sum(1) > 1)[:, None]


def ratios(texts: list[bytes | None], ids: dict[bytes, int], word: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed ratios (texts x columns of ``word``, or ``sums``) and number of distinct words; unknown words tell nothing."""
    total, sizes = np.zeros((len(texts), word.shape[1])), np.zeros(len(texts), np.int64)
    for row, data in enumerate(texts):
        words = set(words_of(data))
        sizes[row] = len(words)
        known = sorted(ids[w] for w in words if w in ids)  # sorted: sums don't depend on the order of a set
        if known:
            total[row] = word[known].sum(axis=0)
    return (total if sums is None else sums), sizes


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return beta


def features(total: np.ndarray, sizes: np.ndarray, power: float) -> np.ndarray:
    """A constant, and the ratio normalised by the length to a power."""
    return np.stack([np.ones(len(total)), total / (sizes + 5.0) ** power], 1)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y, weight, fold, text): about ``per_class`` labelled rows of each class, none held out.

    Rows are taken by hashed id, so any cluster takes the same; weight is one over the
    fraction taken. The ids (twice ``per_class``, about) are small enough to broadcast.
    """
    learn = labels.where(~held_out()).where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    learn = stash(learn, "labelled")
    n = dict(learn.groupBy("y").count().collect())
    part = F.lit(1.0)
    for y, rows in n.items():
        part = F.when(F.col("y") == y, min(1.0, per_class / rows)).otherwise(part)
    roll = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    taken = learn.where(roll < part).select("doc_id", "y", (1 / part).alias("weight"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"))
    return stash(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").where("text is not null"), "sample")


SLOTS = range(2 * FOLDS)
#: The folds that models are fitted on: all but one, and all.
FITTED = [[f for f in range(FOLDS) if f != out] for out in range(FOLDS)] + [list(range(FOLDS))]


def _document_counts(sample: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """(w, s0, s1, ...): in how many documents of each fold and class every word occurs; number of words; sums (folds x 2)."""

    def make():
        def run(batch):
            c: Counter = Counter()
            for f, y, data in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), raw(batch, "text"), strict=True):
                c.update((f * 2 + y, w) for w in set(words_of(data)))
            return [[s for s, _ in c], [w for _, w in c], list(c.values())]

        return run

    wide = [F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in SLOTS]
    counts = stash(emit(sample, "slot int, w binary, n bigint", make).groupBy("w").agg(*wide), "words")
    whole = counts.agg(F.count("*"), *[F.sum(f"s{s}") for s in SLOTS]).first()
    return counts, whole[0], np.array([x or 0 for x in whole[1:]], float).reshape(FOLDS, 2)


def _telling(counts: DataFrame, size: int, n: np.ndarray) -> DataFrame:
    """Words that the smallest discount leaves something of, in a class, in one of the models; all others tell nothing."""
    left = [F.lit(-1.0)]
    for own in FITTED:
        of = n[own].sum(0)
        class_counts = [sum((F.col(f"s{f * 2 + c}") for f in own), F.lit(0)) for c in (0, 1)]
        common = (class_counts[0] + class_counts[1] + 0.5) / float(of.sum() + 0.5 * size)
        for c in (0, 1):
            explained = common * float(max(of[c], 1.0))
            left.append(F.when(class_counts[0] + class_counts[1] > 1, class_counts[c] - explained - min(DISCOUNTS) * F.sqrt(explained)).otherwise(-1.0))
    return counts.where(F.greatest(*left) > -1e-6)  # a little more than the exact sums, which decide


def continuation(docs: DataFrame, words: DataFrame, ids) -> tuple[DataFrame, float]:
    """``words`` with docs, the documents of the whole corpus that hold each; all words' such counts together.

    The shared backoff is their share. ``ids``: a broadcast of the words, None if they are too many.
    """

    def make():
        known = None if ids is None else ids.value

        def run(batch):
            c: Counter = Counter()
            total = 0
            for data in raw(batch, "text"):
                own = set(words_of(data))
                total += len(own)
                c.update(own if known is None else own & known)
            return [[None, *c], [total, *c.values()]]

        return run

    rows = stash(emit(docs.select("text"), "w binary, docs bigint", make).groupBy("w").agg(F.sum("docs").alias("docs")), "continuation")
    total = rows.where("w is null").agg(F.sum("docs")).first()[0] or 0
    return words.join(rows, "w", "left").withColumn("docs", F.coalesce("docs", F.lit(0))), float(total)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """``docs`` with held_out, llr (per distinct word), score (0 to 1) and predicted (1 if score >= cut).

    docs: doc_id, text; labels: doc_id, toxic (0 or 1). Labels of held-out ids (crc32 of
    the id as text leaves 2 when divided by 4) are never read; of several labels of one id
    the largest counts, and of repeated rows each is a document. Null, empty and wordless
    texts have llr 0 and the score of that; texts may have any length, and equal texts get
    equal scores. Where the labels teach no difference between texts (none or one class of
    them, too few, or wordless texts) every score is the share of label 1, 0.5 without
    labels, and predicted is 0: that share is no evidence against any one text. An empty
    table gives an empty one. Input columns named like a result give way to it, in any case
    of letters. Words that tell something are broadcast, or joined where they would take
    more than ``BROADCAST_BYTES``.
    """
    sc = docs.sparkSession.sparkContext
    rows = sample_rows(docs, labels, "toxic", sample)
    counts, size, n = _document_counts(rows)
    telling = stash(_telling(counts, size, n), "telling")
    k = len(DISCOUNTS)
    wide = telling.count() * (TOKEN_BYTES + 8 * len(FITTED) * k) > BROADCAST_BYTES
    if not wide:
        ids = sc.broadcast(frozenset(bytes(r[0]) for r in telling.select("w").collect()))
    counted, total = continuation(docs, telling, None if wide else ids)

    def figures(table, rests: list | None = None) -> np.ndarray:
        """words x (models x discounts) ratios; with ``rests``, the words are a part of all, whose taken masses those are."""
        uni = np.stack([np.asarray(table[f"s{s}"], float) for s in SLOTS], 1).reshape(-1, FOLDS, 2)
        shared = (np.asarray(table["docs"], float) + 0.5) / max(total + 0.5 * size, 1.0)
        out = []
        for i, own in enumerate(FITTED):
            for j, d in enumerate(DISCOUNTS):
                args = (uni[:, own].sum(1), shared, d, n[own].sum(0), size)
                out.append(word_ratios(*args) if rests is None else part_ratios(*args, rests[i * k + j]))
        return np.stack(out, 1)

    if wide:
        table, known, columns = _joined_ratios(counted, figures, n, size), sc.broadcast({}), sc.broadcast(np.zeros((0, len(FITTED) * k)))
        rows = joined_sums(rows, table, lambda data: set(words_of(data)))
    else:
        table = counted.toPandas()
        table["w"] = table["w"].map(bytes)
        table = table.sort_values("w")
        known, columns = sc.broadcast({w: i for i, w in enumerate(table["w"])}), sc.broadcast(figures(table))

    def sums_of(batch) -> np.ndarray | None:
        return np.array(batch.column("__sums").to_pylist()).reshape(batch.num_rows, -1) if "__sums" in batch.schema.names else None

    def cross():
        def run(batch):
            total, sizes = ratios(raw(batch, "text"), known.value, columns.value, sums_of(batch))
            own = [total[i, f * k : f * k + k].tolist() for i, f in enumerate(batch.column("fold").to_pylist())]
            return [batch.column("y"), batch.column("weight"), own, sizes]

        return run

    seen = emit(rows, "y int, weight double, totals array<double>, n bigint", cross).toPandas()  # about ``sample`` rows a class
    seen["totals"] = seen["totals"].map(tuple)
    seen = seen.sort_values(["n", "y", "weight", "totals"])  # sums that don't depend on the order of rows
    y, weight = seen["y"].to_numpy(float), seen["weight"].to_numpy(float)
    toxic, clean = (weight * y).sum(), (weight * (1 - y)).sum()
    beta, best_at, power = np.array([math.log((toxic + 0.5) / (clean + 0.5)), 0.0]), 0, 1.0
    if 0 < y.sum() < len(y):
        totals, best = np.array(seen["totals"].tolist()), math.inf
        for i, e in product(range(k), POWERS):
            x = features(totals[:, i], seen["n"].to_numpy(), e)
            b = _logistic(x, y, weight)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
            if loss < best and b[1] > 0:
                best, beta, best_at, power = loss, b, i, e
    bound = cut if beta[1] > 0 else math.inf
    chosen = FOLDS * k + best_at

    def make():
        final = columns.value[:, chosen : chosen + 1]

        def run(batch):
            sums = sums_of(batch)
            total, sizes = ratios(raw(batch, "text"), known.value, final, None if sums is None else sums[:, chosen : chosen + 1])
            x = features(total[:, 0], sizes, power)
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
            return [total[:, 0] / np.maximum(sizes, 1), p, (p >= bound).astype(np.int32)]

        return run

    docs = joined_sums(docs, table, lambda data: set(words_of(data))) if wide else docs
    fields = [T.StructField("llr", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return attach(docs, "text", fields, make).drop("__sums").withColumn("held_out", held_out())


def part_ratios(uni, shared, discount, n, size, taken_all: list) -> np.ndarray:
    """``word_ratios`` of some of the words; taken_all: the masses that the discount leaves all words, by class."""
    rest = np.maximum(1 - np.asarray(taken_all), 1e-6)
    p = left_over(uni, discount, n, size) / np.maximum(n, 1.0) + rest * shared[:, None]
    return np.log(p[:, 1]) - np.log(p[:, 0]) - math.log(rest[1] / rest[0])


def _joined_ratios(counted: DataFrame, figures: Callable, n: np.ndarray, size: int) -> DataFrame:
    """(w, x): ratios of words that are too many for one process, from masses summed over all."""

    def columns_of(batch) -> dict:
        return {c: batch.column(c).to_numpy() for c in batch.schema.names if c != "w"}

    def masses():
        def run(batch):
            table = columns_of(batch)
            uni = np.stack([table[f"s{s}"] for s in SLOTS], 1).astype(float).reshape(-1, FOLDS, 2)
            each = [left_over(uni[:, own].sum(1), d, n[own].sum(0), size).sum(0) / np.maximum(n[own].sum(0), 1.0) for own in FITTED for d in DISCOUNTS]
            return [[np.concatenate(each).tolist()]]

        return run

    width = 2 * len(FITTED) * len(DISCOUNTS)
    sums = emit(counted, "x array<double>", masses).select(*[F.sum(F.col("x")[i]) for i in range(width)]).first()
    rests = np.array([x or 0.0 for x in sums]).reshape(-1, 2).tolist()

    def make():
        return lambda batch: [batch.column("w"), figures(columns_of(batch), rests).tolist()]

    return stash(emit(counted, "w binary, x array<double>", make), "ratios")
