"""Soft-membership mixing of documents to target weights.

A classifier fitted on a labelled table gives every document posteriors over the table's
domains. Document rates (expected copies) then minimise the weighted squared distance
between expected domain token totals and targets, over nonnegative rates, by projected
gradient steps from rates of one. A step changes a rate by the inner product of its
posteriors with one short vector, so the rates are never stored: every pass replays the
vectors so far, sums tokens by domain over all documents, and yields the next vector.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import BROADCAST_BYTES, TOKEN_BYTES, attach, emit, joined_sums, raw, stash, without, words_of

#: Labelled documents of each domain that the classifier is fitted on, about (a sample by hashed id).
SAMPLE = 4_000
DISCOUNT = 3.0
FOLDS = 4
STEPS, TOLERANCE = 40, 1e-5


def tokens_of(data: bytes | None) -> list[bytes]:
    """White-space separated pieces: marks and separators tell domains apart as words do."""
    return (data or b"").split()


def _scores(texts: list[bytes | None], ids: dict[bytes, int], logs: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised sums of the distinct tokens' ratios by column of ``logs`` (or from ``sums``); number of words."""
    out, sizes = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts), np.int64)
    for row, data in enumerate(texts):
        tokens = set(tokens_of(data))
        sizes[row] = len(words_of(data))
        known = sorted(ids[w] for w in tokens if w in ids)
        if sums is not None:
            out[row] = sums[row]
        elif known:
            out[row] = logs[known].sum(axis=0)
        out[row] /= (len(tokens) + 5.0) ** 0.75
    return out, sizes


def domain_logs(counts: np.ndarray, n: np.ndarray, total: float, size: int) -> np.ndarray:
    """Log ratios of tokens' probabilities in each domain to those of tokens that no domain has more of.

    counts: tokens x domains; n: all tokens' counts by domain; total: their sum, size: number
    of distinct tokens. A domain's probability is its discounted share, and the rest of it
    goes to the domains' common distribution. A token that the discount leaves nothing of
    has a ratio of one, as an unknown one has, so it need not be kept: no vocabulary is cut.
    """
    n = np.maximum(n, 1.0)
    shared = (counts.sum(1) + 0.5) / (total + 0.5 * size)
    taken = np.maximum(counts - DISCOUNT * n / n.min(), 0) / n
    rest = np.maximum(1 - taken.sum(0), 1e-6)
    return np.log(taken + rest * shared[:, None]) - np.log(rest * shared[:, None])


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Scale and offsets of the softmax that fit the labels of texts the tables have not seen."""
    k = scores.shape[1]
    scale, offset = 1.0, np.log(np.maximum(np.bincount(y, weight, k), 1e-9) / weight.sum())
    target = np.eye(k)[y]
    total = weight.sum()
    x = scores - scores.mean(axis=1, keepdims=True)
    spread = max((weight[:, None] * x * x).sum() / total, 1e-9)
    for _ in range(400):
        p = _softmax(scale * x + offset)
        g = weight[:, None] * (p - target)
        scale = max(0.0, scale - (g * x).sum() / total / spread)
        offset = offset - g.sum(axis=0) / total * 2
    return scale, offset


def fit_posteriors(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[Callable[[DataFrame], DataFrame], list[str]]:
    """A function that adds n_tokens (words) and posterior (over the domains, in order) to texts; the domains.

    labelled: doc_id, domain. Null ids and domains are left out; a document with several
    domains counts for the smallest. Texts without known tokens get the prior. Every token
    of the sample is counted; those that the discount leaves something of are broadcast, or
    joined where they would take more than ``BROADCAST_BYTES``.
    """
    sc = docs.sparkSession.sparkContext
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    known = stash(known, "labelled")
    sizes = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    k = max(1, len(domains))
    part, index = F.lit(1.0), F.lit(0)
    for i, d in enumerate(domains):
        part = F.when(F.col("domain") == d, min(1.0, sample / sizes[d])).otherwise(part)
        index = F.when(F.col("domain") == d, i).otherwise(index)
    roll = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # at most about ``sample`` ids a domain
    taken = known.where(roll < part).select("doc_id", index.alias("y"), (1 / part).alias("weight"), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = stash(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"), "sample")

    def counts_make():
        def run(batch):
            c: Counter = Counter()
            for f, y, data in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), raw(batch, "text"), strict=True):
                c.update((f * k + y, w) for w in set(tokens_of(data)))
            return [[s for s, _ in c], [w for _, w in c], list(c.values())]

        return run

    slots = range(FOLDS * k)
    wide = [F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in slots]
    every = stash(emit(rows, "slot int, w binary, n bigint", counts_make).groupBy("w").agg(*wide), "tokens")
    whole = every.agg(F.count("*"), *[F.sum(f"s{s}") for s in slots]).first()
    size, n = whole[0], np.array([x or 0 for x in whole[1:]], float).reshape(FOLDS, k)
    # the discount is DISCOUNT counts or more: no other token keeps anything, in all folds or without one
    kept = every.where(F.greatest(F.lit(0), *[sum((F.col(f"s{f * k + y}") for f in range(FOLDS)), F.lit(0)) for y in range(k)]) > DISCOUNT)
    wide_table = kept.count() * (TOKEN_BYTES + 8 * (FOLDS + 1) * k) > BROADCAST_BYTES
    left_out = [[f for f in range(FOLDS) if f != out] for out in range(FOLDS)] + [list(range(FOLDS))]

    def logs_of(counts: np.ndarray) -> np.ndarray:
        """tokens x (folds + 1) x k: ratios of the models without each fold, and of that with all."""
        return np.stack([domain_logs(counts[:, own].sum(1), n[own].sum(0), n[own].sum(), size) for own in left_out], 1)

    def counts_of(table) -> np.ndarray:
        return np.stack([np.asarray(table[f"s{s}"], float) for s in slots], 1).reshape(-1, FOLDS, k)

    if wide_table:

        def logs_make():
            return lambda batch: [batch.column("w"), logs_of(counts_of({c: batch.column(c).to_numpy() for c in batch.schema.names if c != "w"})).reshape(batch.num_rows, -1).tolist()]

        table = stash(emit(kept, "w binary, x array<double>", logs_make), "ratios")
        ids, held = sc.broadcast({}), sc.broadcast(np.zeros((0, FOLDS + 1, k)))
        rows = joined_sums(rows, table, lambda data: set(tokens_of(data)))
    else:
        table = kept.toPandas()
        ids = sc.broadcast({bytes(w): i for i, w in enumerate(table["w"])})
        held = sc.broadcast(logs_of(counts_of(table)))

    def sums_of(batch, at: int) -> np.ndarray | None:
        return np.array(batch.column("__sums").to_pylist()).reshape(batch.num_rows, FOLDS + 1, k)[:, at] if "__sums" in batch.schema.names else None

    def crossed_make():
        def run(batch):
            texts, folds = raw(batch, "text"), np.array(batch.column("fold").to_pylist())
            out = np.zeros((len(texts), k))
            for f in range(FOLDS):
                at, sums = np.flatnonzero(folds == f), sums_of(batch, f)
                out[at] = _scores([texts[i] for i in at], ids.value, held.value[:, f], None if sums is None else sums[at])[0]
            return [batch.column("y"), batch.column("weight"), out.tolist()]

        return run

    scale, offset = 1.0, np.zeros(k)
    if len(domains) > 1 and size:
        seen = emit(rows, "y int, weight double, s array<double>", crossed_make).toPandas()  # about ``sample`` rows a domain
        seen["s"] = seen["s"].map(tuple)
        seen = seen.sort_values(["y", "weight", "s"])  # sums that don't depend on the order of rows
        scale, offset = calibrate(np.array(seen["s"].tolist()), seen["y"].to_numpy(np.int64), seen["weight"].to_numpy())

    def make():
        final = held.value[:, FOLDS]

        def run(batch):
            s, words = _scores(raw(batch, "text"), ids.value, final, sums_of(batch, FOLDS))
            p = _softmax(scale * (s - s.mean(axis=1, keepdims=True)) + offset)
            return [words, p.tolist()]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]

    def add(texts: DataFrame) -> DataFrame:
        texts = joined_sums(texts, table, lambda data: set(tokens_of(data))) if wide_table else texts
        return attach(texts, "text", fields, make).drop("__sums")

    return add, domains


def posteriors(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_tokens and posterior, and the domains; see ``fit_posteriors``."""
    add, domains = fit_posteriors(docs, labelled, sample)
    return add(docs), domains


def rate_of(posterior: Column, steps: list[np.ndarray]) -> Column:
    """The rate after these steps: each subtracts the posteriors' inner product with it, not below zero."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in steps])

    def inner(g: Column) -> Column:
        return F.aggregate(F.zip_with(posterior, g, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - inner(g)))


def fit_rates(members: DataFrame, target: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient, and the domain totals they lead to.

    members: n_tokens, posterior. target: wanted expected tokens of each domain. The
    squared distance is weighted by the inverse second moments of the documents whose
    rates are free (above zero), so that small domains converge as fast as large ones; a
    step that makes the distance larger halves those after it. Every pass sums k totals
    and k * k moments, whatever the number of documents.
    """
    k = len(target)

    def passed(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rated = members.withColumn("rate", rate_of(F.col("posterior"), steps))
        p, t = F.col("posterior"), F.col("n_tokens")
        free = F.when(F.col("rate") > 0, t).otherwise(0)
        totals = [F.sum(t * F.col("rate") * p[i]).alias(f"a{i}") for i in range(k)]
        moments = [F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]
        row = [x or 0.0 for x in rated.agg(*totals, *moments).first()]
        return np.array(row[:k], float), np.array(row[k:], float).reshape(k, k)

    return descend(passed, target)


def descend(passed: Callable, target: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps up to the best totals; ``passed`` gives totals and free moments after steps."""
    steps: list[np.ndarray] = []
    reached, second = passed(steps)
    best, scale, before = (math.inf, 0, reached), 1.0, math.inf
    for _ in range(STEPS):
        error = float(np.abs(reached - target).sum() / max(target.sum(), 1e-9))
        if error < best[0]:
            best = (error, len(steps), reached)
        if error <= TOLERANCE:
            break
        scale, before = scale / 2 if error > before else scale, error
        steps.append(scale * (np.linalg.pinv(second, rcond=1e-9, hermitian=True) @ (reached - target)))
        reached, second = passed(steps)
    return steps[: best[1]], best[2]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], sample: int = SAMPLE, tokens: float | None = None) -> DataFrame:
    """``docs`` with n_tokens, posterior, rate (0 or more) and n_copies.

    weights: wanted share of each domain of ``labelled`` (doc_id, domain); they are scaled
    to sum to one, and domains without one get none. tokens: wanted expected tokens in all
    (as many as there are, if None). Where nonnegative rates cannot reach the targets they
    come as near as they can. n_copies is the rate rounded down or up by a hash of the id,
    so that its mean is the rate. Null, empty and wordless texts have no tokens and the
    prior's rate; texts may have any length; repeated rows get equal results. Without labelled
    rows every rate is one; an empty table gives an empty one. Input columns named like a
    result give way to it, in any case of letters.
    """
    add, domains = fit_posteriors(docs, labelled, sample)
    steps: list[np.ndarray] = []
    if domains:
        members = stash(add(docs.select("text")).select("n_tokens", "posterior"), "posteriors")
        total = members.agg(F.sum("n_tokens")).first()[0] or 0
        share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
        if share.sum() > 0 and total:
            steps, _ = fit_rates(members, share / share.sum() * (tokens or total))
    roll = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = add(without(docs, ["rate", "n_copies"])).withColumn("rate", rate_of(F.col("posterior"), steps))
    return out.withColumn("n_copies", F.floor(F.col("rate") + roll).cast("bigint"))
