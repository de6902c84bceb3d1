"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Every vector has many random projections of two kinds. ``m`` of them are counted: a pair
collides in one where either vector lies in the window around the other, and a pair that
collides in at least ``least`` of them is verified by its cosine in double precision.

All pairs' collisions would be a count of quadratic size, so the other projections, in
``tuples`` tuples of ``depth`` groups of ``AXES``, choose the pairs to count. In each
group a vector is listed under the projection that it is most extreme in, with its sign;
a tuple's lists are those of its groups together. A list is sorted by the value of the
first group's projection, and a window slides over it: pairs in one window are counted.
The more vectors, the more groups, so that the pairs counted for a vector stay about
constant. Window, count, depth and number of tuples follow from the wanted recall for a
pair at the cosine bound, by the normal distribution and by simulated pairs.

Lists of many vectors are split into blocks, and block meets block; nobody holds a whole
list. A pair that shares several lists is counted in the first alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import emit, stash
from tidelog.llm.components import components

#: Projections that are counted, and projections in a group that lists are made from.
PROJECTIONS, AXES = 32, 64
RECALL = 0.999
#: Half the sliding window of a list, in deviations of a pair at the bound.
LIST_WINDOW = 5.0
#: Pairs of unlike vectors that share a list, for each vector, at most; decides the depth.
MEETINGS = 256
#: Vectors in a block of a list; lists up to SMALL slide in one piece with their neighbours.
BLOCK, SMALL = 512, 64
#: Simulated pairs that the number of tuples is calibrated on.
TRIALS = 40_000


def calibrate(cosine: float, m: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int]:
    """Window half-width, and the count that a pair at the bound reaches with the wanted recall."""
    deviation = math.sqrt(2 - 2 * cosine)
    width = 2.0 * deviation
    p = 2 * NormalDist().cdf(2.0) - 1
    below, least = 0.0, 0
    while least < m:
        below += math.comb(m, least) * p**least * (1 - p) ** (m - least)
        if below > 1 - recall:
            break
        least += 1
    return width, least


@lru_cache
def listed_together(cosine: float) -> tuple[float, float]:
    """Share of pairs at the bound, and of unlike pairs, that one group lists together (within the list's window).

    A pair's values in a group depend on its cosine alone, so two correlated normal draws stand for it.
    """
    r = np.random.default_rng(11)
    a, z = r.standard_normal((2, TRIALS, AXES))
    n = np.arange(TRIALS)
    b = cosine * a + math.sqrt(1 - cosine**2) * z
    i, j = np.abs(a).argmax(1), np.abs(b).argmax(1)
    same = (i == j) & (np.abs(a[n, i] - b[n, j]) <= LIST_WINDOW * math.sqrt(2 - 2 * cosine))
    return float(same.mean()), 1 / (2 * AXES)


def plan(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(tuples, depth) for ``n`` vectors: the least depth at which a vector meets few unlike ones, and its tuples."""
    near, unlike = listed_together(cosine)
    depth = 1
    while True:
        tuples = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**depth)))
        if n * tuples * unlike**depth <= MEETINGS or depth == 6:
            return tuples, depth
        depth += 1


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that can link; others are null, zero or not finite."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    return vectors.where("embedding is not null and vec_id is not null").where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("x"))


def to_unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two (exactly, so that squares stay finite), and unit vectors."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def lists_of(x: np.ndarray, tuples: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n x tuples x depth list numbers (projection and sign) of unit vectors, and n x tuples values to sort by."""
    n, size = x.shape
    at, value = np.zeros((n, tuples, depth), np.uint8), np.zeros((n, tuples))
    for t in range(tuples):
        for g in range(depth):
            p = x @ np.random.default_rng([seed, size, t, g]).standard_normal((size, AXES))
            top = np.abs(p).argmax(axis=1)
            own = p[np.arange(n), top]
            at[:, t, g] = 2 * top + (own < 0)
            if not g:
                value[:, t] = own
    return at, value


def arrays(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of a list column without nulls, and its rows."""
    column = batch.column(name)
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return np.diff(offsets), np.split(flat, offsets[1:-1])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces: one pair of blocks, or short lists (p < 0) that are whole, about a batch of them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def whole() -> pa.RecordBatch:
        out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("p", "q", "t", "key")], 1)
        if held and tuple(marks[0]) != last:
            yield whole()
        change = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        short = change[marks[change, 0] < 0]
        start = 0
        for cut in sorted({*change[marks[change, 0] >= 0].tolist(), *short[:1].tolist(), *short[-1:].tolist()}):
            held.append(batch.slice(start, cut - start))
            yield whole()
            start = cut
        held.append(batch.slice(start))
        last = tuple(marks[-1])
    if held:
        yield whole()


class Meeting:
    """Counts and verifies pairs of one length of vectors; adds up links, and one edge for each component joined."""

    def __init__(self, cosine: float, m: int, seed: int, depth: int):
        self.cosine, self.m, self.seed, self.depth = cosine, m, seed, depth
        self.width, self.least = calibrate(cosine, m)
        self.window = LIST_WINDOW * math.sqrt(2 - 2 * cosine)

    def load(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, unit = to_unit(np.stack(rows))
        counted = unit @ np.random.default_rng([self.seed + 1, x.shape[1]]).standard_normal((x.shape[1], self.m))
        return x, np.sqrt((x * x).sum(axis=1)), counted

    def verified(self, a: np.ndarray, b: np.ndarray, t: np.ndarray, x, norms, counted, sig) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (a, b) of rows that collide often enough, have the cosine and met in no earlier tuple than ``t``."""
        hits = np.zeros(len(a), np.int16)
        for j in range(self.m):  # a pair that cannot reach the count any more is dropped
            hits += np.abs(counted[a, j] - counted[b, j]) <= self.width
            if j % 8 == 7 and len(a) > 1000:
                on = hits >= self.least - (self.m - 1 - j)
                a, b, t, hits = a[on], b[on], t[on], hits[on]
        on = hits >= self.least
        a, b, t = a[on], b[on], t[on]
        on = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b]) >= self.cosine
        a, b, t = a[on], b[on], t[on]
        return self.first(a, b, t, sig)

    def first(self, a, b, t, sig):
        """Pairs that share no list of a tuple before ``t``."""
        if len(a):
            same = (sig[a] == sig[b]).reshape(len(a), -1, self.depth).all(axis=2)
            on = same.argmax(axis=1) == t
            a, b = a[on], b[on]
        return a, b

    def summed(self, a, b, ids, weight) -> tuple:
        """Members with links, their numbers of links, and the smallest member that they reach here."""
        n = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        by_rank = np.sort(ids)
        while True:  # one edge a member, not one a link
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(n)
        return ids[some], n[some].astype(np.int64), by_rank[root[some]]

    def small(self, t, key, value, ids, weight, rows, sig) -> tuple | None:
        """Links in whole lists, sorted by t, key, value: row i meets row i + 1, i + 2, ... while the window lasts."""
        x, norms, counted = self.load(rows)
        order = np.lexsort((value, key, t))
        t, key, value, ids, weight, x, norms, counted, sig = (c[order] for c in (t, key, value, ids, weight, x, norms, counted, sig))
        found_a, found_b = [], []
        left, step = np.arange(len(ids)), 0
        while len(left):
            step += 1
            left = left[left + step < len(ids)]
            right = left + step
            on = (t[left] == t[right]) & (key[left] == key[right]) & (value[right] - value[left] <= self.window)
            left = left[on]  # sorted: a later row is farther
            a, b = self.verified(left, left + step, t[left], x, norms, counted, sig)
            found_a.append(a)
            found_b.append(b)
        a, b = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_a, found_b))
        if not len(a):
            return None
        # a vector may stand in several lists: rows of one id are one member
        unique, inverse = np.unique(ids, return_inverse=True)
        heavy = np.zeros(len(unique))
        heavy[inverse] = weight
        return self.summed(inverse[a], inverse[b], unique, heavy)

    def blocks(self, t: int, same: bool, value, ids, weight, first_block, rows, sig) -> tuple | None:
        """Links of two blocks of a long list (or within one): strips of the sorted first block meet their window of the second."""
        x, norms, counted = self.load(rows)
        left = np.flatnonzero(first_block)
        left = left[np.argsort(value[left], kind="stable")]
        right = left if same else np.flatnonzero(~first_block)
        right = right[np.argsort(value[right], kind="stable")]
        found_a, found_b = [], []
        for i in range(0, len(left), 128):
            strip = left[i : i + 128]
            low, high = np.searchsorted(value[right], value[strip[0]] - self.window), np.searchsorted(value[right], value[strip[-1]] + self.window, "right")
            other = right[low:high]
            if not len(other):
                continue
            on = np.abs(value[strip][:, None] - value[other][None]) <= self.window
            if same:
                on &= np.arange(i, i + len(strip))[:, None] < np.arange(low, high)[None]
            hits = np.zeros(on.shape, np.uint8)
            for j in range(self.m):
                hits += np.abs(counted[strip, j][:, None] - counted[other, j][None]) <= self.width
            on &= hits >= self.least
            if on.any():
                on &= (x[strip] @ x[other].T) / (norms[strip][:, None] * norms[other][None]) >= self.cosine
                a, b = np.nonzero(on)
                a, b = self.first(strip[a], other[b], np.full(len(a), t), sig)
                found_a.append(a)
                found_b.append(b)
        a, b = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_a, found_b))
        return self.summed(a, b, ids, weight) if len(a) else None


def link_vectors(vectors: DataFrame, cosine: float = 0.95, m: int = PROJECTIONS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors (vec_id, embedding) link where their cosine in double precision is at least
    ``cosine``; no pair below it links, and a pair at it is found with the recall that
    the module's constants stand for (all but certainly for closer ones). Null, zero and
    non-finite vectors, and null ids, link with nothing; vectors of different lengths are
    kept apart, and any length works. Equal vectors are one node and link with each other.
    component_id is the smallest vec_id reachable, kept marks it. Rows that share a vec_id
    are one vector (the first in array order). An empty table gives an empty table; other
    columns, whatever their names, are left out.
    """
    unit = unit_vectors(vectors).groupBy("vec_id").agg(F.min("x").alias("x"))
    members = stash(unit.withColumn("k1", F.xxhash64("x")).withColumn("k2", F.xxhash64(F.lit(1), "x")), "vectors")
    # equal vectors are one node with a weight
    nodes = stash(members.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x")), "nodes")
    tuples, depth = plan(nodes.count(), cosine)

    def lists_make():
        def run(batch):
            ids = batch.column("id").to_numpy()
            lengths, rows = arrays(batch, "x")
            out: list[list] = [[], [], [], [], []]
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                lists, value = lists_of(to_unit(np.stack([rows[i] for i in at]))[1], tuples, depth, seed)
                key = np.full(lists.shape[:2], size, np.int64)
                with np.errstate(over="ignore"):
                    for g in range(depth):
                        key = key * np.int64(2 * AXES) + lists[:, :, g]
                out[0].append(np.repeat(ids[at], tuples))
                out[1].append(np.tile(np.arange(tuples, dtype=np.int32), len(at)))
                out[2].append(key.ravel())
                out[3].append(value.ravel())
                out[4] += [row.tobytes() for row in np.repeat(lists.reshape(len(at), -1), tuples, axis=0)]
            return [*(pa.array(np.concatenate(c)) for c in out[:4]), pa.array(out[4], pa.binary())]

        return run

    lists = stash(emit(nodes.select("id", "x"), "id bigint, t int, key bigint, value double, sig binary", lists_make), "lists")
    sizes = lists.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    # a long list of b blocks meets itself in b * (b + 1) / 2 pairs of blocks; each vector goes to the b pairs of its block
    blocks = F.when(F.col("size") > SMALL, F.ceil(F.col("size") / block)).otherwise(0).cast("int")
    placed = lists.join(sizes, ["t", "key"]).withColumn("blocks", blocks)
    own = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))).otherwise(-1).cast("int")
    others = F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("id", "t", "key", "value", "sig", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    work = dealt.join(nodes.select("id", "n", "x"), "id")

    def run_lists(batches):
        meeting = Meeting(cosine, m, seed, depth)
        columns = ("t", "key", "value", "id", "n")
        names = ["id", "n_links", "root"]

        def met(part: pa.RecordBatch):
            """The links of whole lists: short ones together, a pair of blocks of a long one alone."""
            _, rows = arrays(part, "x")
            t, key, value, ids, n = (part.column(c).to_numpy() for c in columns)
            sig = np.stack([np.frombuffer(s, np.uint8) for s in part.column("sig").to_pylist()])
            p, q, mine = (part.column(c).to_numpy() for c in ("p", "q", "own"))
            if p[0] < 0:
                lengths = np.array([len(r) for r in rows])
                for size in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == size)
                    yield meeting.small(t[at], key[at], value[at], ids[at], n[at].astype(float), [rows[i] for i in at], sig[at])
            else:
                yield meeting.blocks(int(t[0]), bool(p[0] == q[0]), value, ids, n.astype(float), mine == p[0], rows, sig)

        for part in pieces(batches):
            for out in met(part):
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    # a task holds one pair of blocks at a time, or a batch of short lists
    sorted_work = work.repartition("t", "key", "p", "q").sortWithinPartitions("p", "q", "t", "key")
    found = stash(sorted_work.mapInArrow(run_lists, "id bigint, n_links bigint, root bigint"), "found")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("near"))
    joined = stash(components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()), "components")
    node = nodes.select("k1", "k2", "id", "n").join(counts, "id", "left").join(joined, "id", "left")
    node = node.select("k1", "k2", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = members.select("vec_id", "k1", "k2").join(node, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
    out = ids.join(linked, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
