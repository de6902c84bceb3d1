"""Near-duplicate documents by BagMinHash signatures, banding and exact verification.

A document is the multiset of its shingles (``size`` consecutive words). The weight of
a shingle is its count, discretised on the whole numbers. Each shingle owns one Poisson
process of points (time, level, register): a node of the hierarchy stands for a range
of levels (0,1], (1,2], (2,4], (4,8], ... and throws points at a rate proportional to
its width, each at a uniform level of the range and a uniform register. A register
keeps the smallest time of the points whose level is within the weight. Two documents
agree in a register with probability equal to their weighted Jaccard similarity. Points
come in the order of time, so a shingle stops once its next point is later than every
register's minimum.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_BYTES, emit, raw, runs, stash, words_of
from tidelog.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: 320 registers; long bands keep documents that merely share a passage out of each other's buckets.
BANDS, ROWS = 40, 8
#: Bytes of an id in a broadcast table, at most.
BROADCAST_ROW = 64
#: Documents of a bucket in a block, of those outside its largest component and of those within.
REST_BLOCK, BULK_BLOCK = 256, 1024
#: Shingles that a task remembers of documents it meets again.
REMEMBERED = 4_000_000
#: Shingles that are sketched together, about; bounds memory, not results.
SLICE = 400_000


def shingles_of(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """All shingles in order; a text of fewer words is one shingle, one without words has none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles in order, from the words' hashes."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(len(words[:size])))
    with np.errstate(over="ignore"):
        for i in range(min(size, len(words))):
            out = _mix(out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n])
    return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    if len(b) < len(a):
        a, b = b, a
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer (fixed constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m registers (64-bit fingerprints of the winning points).

    docs: the document (0 .. n_docs-1) of each distinct shingle; hashes: its 64-bit
    hash; weights: its count. Each (document, shingle, node) is one stream of points.
    """
    times = np.full(n_docs * m, np.inf)
    marks = np.zeros(n_docs * m, np.uint64)
    node = 0
    low, width = 0, 1
    live = np.arange(len(docs))
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(live):
        d, w = docs[live].astype(np.int64), weights[live]
        with np.errstate(over="ignore"):
            seed = _mix(hashes[live] + np.uint64(node + 1) * np.uint64(0xD6E8FEB86659FD93))
        t = np.zeros(len(live))
        worst = times.reshape(n_docs, m).max(axis=1)
        k = 0
        while len(d):
            k += 1
            with np.errstate(over="ignore"):
                r = _mix(seed + np.uint64(k) * step)
                place = _mix(r + step)
            t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
            more = t < worst[d]
            d, seed, t, w, r, place = d[more], seed[more], t[more], w[more], r[more], place[more]
            register = (place % np.uint64(m)).astype(np.int64)
            if width > 1:
                level = low + 1 + ((place >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
                inside = level <= w
                at, tt, rr = (d * m + register)[inside], t[inside], r[inside]
            else:
                at, tt, rr = d * m + register, t, r
            better = tt < times[at]
            at, tt, rr = at[better], tt[better], rr[better]
            np.minimum.at(times, at, tt)
            won = times[at] == tt
            marks[at[won]] = rr[won]
            if k == 1 or k % 4 == 0:
                worst = times.reshape(n_docs, m).max(axis=1)
        low, node = low + width, node + 1
        width = low if low > 1 else 1
        live = live[weights[live] > low]
    return marks.reshape(n_docs, m)


def band_hashes(marks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands signed 64-bit hashes; equal registers in a band give equal hashes."""
    out = np.zeros((len(marks), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(marks), np.uint64(b + 1) * np.uint64(0xA24BAED4963EE407))
            for r in range(rows):
                h = _mix(h * np.uint64(0x9FB21C651E98DF25) + marks[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def sketch(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, bands): a 128-bit key of the word sequence and the band hashes, for texts with words."""

    def make():
        def run(batch):
            ids, k1, k2, out = [], [], [], []
            owner, hashed, counts, n = [], [], [], 0
            pending = 0

            def flush():
                nonlocal owner, hashed, counts, n, pending
                if n:
                    marks = signatures(np.concatenate(owner), np.concatenate(hashed), np.concatenate(counts), n, bands * rows)
                    out.append(band_hashes(marks, bands, rows))
                owner, hashed, counts, n, pending = [], [], [], 0, 0

            for doc, data in zip(batch.column("doc_id").to_pylist(), raw(batch, "text"), strict=True):
                words = words_of(data)
                if not words or doc is None:
                    continue
                key = xxhash.xxh3_128_intdigest(b" ".join(words))
                ids.append(doc)
                k1.append(((key >> 64) ^ (1 << 63)) - (1 << 63))
                k2.append(((key & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)) - (1 << 63))
                distinct, weight = np.unique(shingle_hashes(words, size), return_counts=True)
                owner.append(np.full(len(distinct), n, np.int32))
                hashed.append(distinct)
                counts.append(weight)
                n, pending = n + 1, pending + len(distinct)
                if pending >= SLICE:
                    flush()
            flush()
            if not ids:
                return []
            flat = np.concatenate(out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands, dtype=np.int32)), pa.array(flat.ravel()))
            return [ids, k1, k2, lists.cast(pa.list_(pa.field("element", pa.int64())))]

        return run

    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return emit(rows_in, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>", make)


def verify(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, score, linked) of candidate pairs: exact weighted Jaccard similarity of their texts."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def make():
        last: list = [None, None]

        def run(batch):
            scores = []
            for ta, tb in zip(raw(batch, "ta"), raw(batch, "tb"), strict=True):
                if tb != last[0]:
                    last[0], last[1] = tb, Counter(shingles_of(words_of(tb), size))
                scores.append(weighted_jaccard(Counter(shingles_of(words_of(ta), size)), last[1]))
            return [batch.column("a"), batch.column("b"), scores, [s >= similarity for s in scores]]

        return run

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return emit(joined, "a bigint, b bigint, score double, linked boolean", make)


def bridges(placed: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): links that join all components that links within buckets join.

    placed: h, id, c (bucket, document, component). In a bucket of several components,
    the largest one's members (the bulk) are never compared with each other. The rest is
    split into blocks, which meet each other and the blocks of the bulk; a meeting
    computes all exact overlaps of its two blocks from the postings of their shingles,
    and gives one link for each two components that it joins.
    """
    counts = placed.groupBy("h", "c").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("h").agg(F.max_by("c", F.struct("n", "c")).alias("bulk"), F.max("n").alias("n_bulk"), F.sum("n").alias("n_all"), F.count("*").alias("cs")).where("cs > 1")
    rest_blocks = F.ceil((F.col("n_all") - F.col("n_bulk")) / REST_BLOCK).cast("int")
    bulk_blocks = F.ceil(F.col("n_bulk") / BULK_BLOCK).cast("int")
    rows = placed.join(mixed.select("h", "bulk", rest_blocks.alias("nr"), bulk_blocks.alias("nb")), "h").withColumn("side", (F.col("c") == F.col("bulk")).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("side") == 1, F.col("nb")).otherwise(F.col("nr"))).cast("int"))

    def meetings(n, make):
        return F.transform(F.sequence(F.lit(0), n - 1), make)

    def meeting(p, q, kind):
        return F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(kind).alias("kind"))

    own, nr, nb = F.col("own"), F.col("nr"), F.col("nb")
    of_bulk = meetings(nr, lambda i: meeting(i, own, 1))
    of_rest = F.concat(meetings(nb, lambda j: meeting(own, j, 1)), meetings(nr, lambda i: meeting(F.least(own, i), F.greatest(own, i), 0)))
    dealt = rows.withColumn("m", F.explode(F.when(F.col("side") == 1, of_bulk).otherwise(of_rest))).select("h", "id", "c", "side", "own", "m.*")
    work = dealt.join(texts.withColumnRenamed("doc_id", "id"), "id").repartition("h", "p", "q", "kind").sortWithinPartitions("h", "p", "q", "kind")

    def run(batches):
        memory: dict[int, np.ndarray] = {}
        held = 0
        for (_, p, q, kind), table in runs(batches, ["h", "p", "q", "kind"]):
            ids, comps, side, own = (table[c].to_numpy() for c in ("id", "c", "side", "own"))
            text = table["text"]
            left = np.flatnonzero((side == 0) & (own == p))
            right = np.flatnonzero(side == 1) if kind else np.flatnonzero(own == q)
            bags: dict[int, np.ndarray] = {}
            for i in np.union1d(left, right).tolist():
                key = int(ids[i])
                if key not in memory:
                    memory[key] = elements(words_of((text[i].as_py() or "").encode()), size)
                    held += len(memory[key])
                bags[i] = memory[key]
            if held > REMEMBERED:
                memory, held = {}, 0
            links = meet(left, right, ids, comps, bags, lambda i: (text[i].as_py() or "").encode(), size, similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return work.mapInArrow(run, "a bigint, b bigint").distinct()


def elements(words: list[bytes], size: int) -> np.ndarray:
    """The multiset of shingles as a set of 64-bit hashes: each of a shingle and the number of its occurrence."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.sort(shingle_hashes(words, size))
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    with np.errstate(over="ignore"):
        return _mix(h + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def meet(left, right, ids, comps, bags: dict, text_of, size: int, similarity: float) -> list[tuple[int, int]]:
    """Links of pairs from left x right that join two components each.

    Equal shingles have equal hashes, so no overlap is missed; a pair that joins
    components is verified on its texts.
    """
    keys = np.concatenate([bags[i] for i in left.tolist()])
    owner = np.repeat(np.arange(len(left)), [len(bags[i]) for i in left.tolist()])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    sizes = np.array([len(bags[i]) for i in left.tolist()])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for j in right.tolist():
        low = np.searchsorted(keys, bags[j])
        n = np.searchsorted(keys, bags[j], "right") - low
        total = int(n.sum())
        if not total:
            continue
        # the postings of all its elements, one after the other
        at = np.arange(total) + np.repeat(low - (np.cumsum(n) - n), n)
        overlap = np.bincount(owner[at], minlength=len(left))
        for place in np.flatnonzero(overlap >= (similarity - 1e-9) * (sizes + len(bags[j]) - overlap)).tolist():
            i = int(left[place])
            x, y = find(int(comps[i])), find(int(comps[j]))
            if x == y or ids[i] == ids[j]:
                continue
            a, b = (Counter(shingles_of(words_of(text_of(k)), size)) for k in (i, j))
            if weighted_jaccard(a, b) >= similarity:
                root[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, copy_of (smallest doc_id of the same words), class_id, kept.

    Documents are linked where the weighted Jaccard similarity of their shingle multisets
    is ``similarity`` or more and they share a band (at 0.8 and the standard bands one
    pair in 1,500 does not, at 0.85 one in 300,000); classes are the connected components of all links, class_id
    the smallest doc_id in one, kept marks it. Texts of equal words are copies and meet as
    one node. Rows that share a doc_id are one document; null, empty and wordless texts, and
    null doc_ids, link with nothing and are kept. Texts may have any length; one of fewer
    words than a shingle is one shingle. An empty table gives an empty one; other columns,
    whatever their names, are left out.

    No bucket gives all its pairs. Members are first verified against their bucket's
    smallest, which joins most of a group; only documents that then still lie in
    different components of a bucket are compared, block by block.
    """
    # docs and keys with their bands; one row a key, with the smallest doc_id
    sketched = stash(sketch(docs, size, bands, rows), "sketch")
    groups = stash(sketched.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")), "groups")
    copies = sketched.select("doc_id", "k1", "k2").join(groups.select("k1", "k2", "rep").where("n > 1"), ["k1", "k2"]).select("doc_id", F.col("rep").alias("copy_of"))
    banded = groups.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "h")).select("id", F.xxhash64("band", "h").alias("h"))
    pivots = banded.groupBy("h").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot <> top").select("h", "pivot")
    members = stash(banded.join(pivots, "h"), "members")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    if wanted.count() * BROADCAST_ROW < BROADCAST_BYTES:
        wanted = F.broadcast(wanted)  # else the texts are shuffled once to find those of candidates
    texts = stash(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), "texts")
    stars = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    linked = verify(stars, texts, size, similarity).where("linked").select("a", "b")
    copy_links = copies.where("doc_id <> copy_of").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b"))
    links = stash(linked.union(copy_links).distinct(), "links")
    found = stash(components(links), "components")

    # links between different components of a bucket, that no pivot has shown
    placed = members.join(found, "id", "left").select("h", "id", F.coalesce("component", "id").alias("c"))
    extra = stash(bridges(placed, texts, size, similarity), "bridges")
    if not extra.isEmpty():
        found = stash(components(links.union(extra)), "components")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    first_copy = copies.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"))
    out = ids.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(first_copy, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("component", "doc_id").alias("class_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
