"""Line deduplication over a sharded minimal perfect hash.

Line keys get 128-bit hashes; lines are counted by hash over all documents. The
hashes of repeated lines are split into shards, and each shard becomes a minimal
perfect hash (levels of bit arrays: a key sits at the first level where no other key
of the shard shares its place, its index is the rank of that bit) over three compact
arrays: fingerprint, document count, last document. Documents probe the arrays;
lines are never joined with documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import BROADCAST_BYTES, attach, emit, raw, stash

#: Characters stripped from both ends of a line for its key.
EDGE = b" \t\n\x0b\x0c\r"
#: Keys in a shard, about; the last levels' exceptions are kept in a list.
SHARD_KEYS = 50_000
GAMMA, LEVELS = 1.6, 24
NO_DOC = -(2**63)
#: Columns of a shard.
ARRAYS = ("mph", "fingerprints", "counts", "last_docs", "twins")
#: Bytes of a line's entries in a shard, about.
ENTRY = 32
#: Broadcasts (each a pass over the documents) up to which arrays go to the documents; beyond,
#: probes go to the arrays, but for lines of so many documents, which stay broadcast.
MOST_PASSES, HOT_DOCS = 4, 100_000


def key_of(line: bytes) -> bytes:
    """The line stripped of ``EDGE`` at both ends, A-Z in lower case."""
    return line.strip(EDGE).lower()


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer (murmur3's constants, fixed values) salted with the level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """index() maps n distinct 64-bit keys to 0 .. n-1; other keys map anywhere or to -1."""

    def __init__(self, keys: np.ndarray):
        left, self.levels, base = np.asarray(keys, np.uint64), [], 0
        while len(left) and len(self.levels) < LEVELS:
            m = int(len(left) * GAMMA) + 1
            at = _mix(left, len(self.levels)) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            ranks = np.cumsum(alone, dtype=np.int32) + np.int32(base - 1)
            self.levels.append((np.packbits(alone), m, ranks[::64].copy(), base))
            base += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.rest = np.sort(left)
        self.base = base

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, m, _, base) in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[left[hit]] = self._rank(level, at[hit])
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.searchsorted(self.rest, keys[left])
            ok = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left])
            out[left[ok]] = self.base + at[ok]
        return out

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Rank of set bits: the sampled rank of each 64 bits plus the bits set after it."""
        bits, _, sampled, _ = self.levels[level]
        block = at >> 6
        padded = np.zeros((-(-len(bits) // 8)) * 8, np.uint8)
        padded[: len(bits)] = bits
        words = padded.view(">u8").astype(np.uint64)
        # bits 1 .. at-block*64 of the word, most significant first; the sample counts bit 0
        k = (at & 63).astype(np.uint64)
        mask = np.where(k == 63, np.uint64(0xFFFFFFFFFFFFFFFF), ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (k + np.uint64(1))))
        mask &= np.uint64(0x7FFFFFFFFFFFFFFF)
        return sampled[block] + np.bitwise_count(words[block] & mask)

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps((self.levels, self.rest, self.base), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        import pickle

        new = cls.__new__(cls)
        new.levels, new.rest, new.base = pickle.loads(data)
        return new


def hashed(data: bytes | None, min_chars: int) -> list[tuple[int, int, int]]:
    """(line number, h1, h2) of the lines whose keys have at least ``min_chars`` code points; signed halves of 128 bits."""
    out = []
    for n, line in enumerate((data or b"").split(b"\n")):
        if len(line) < min_chars:
            continue
        k = key_of(line)
        if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars):
            h = xxhash.xxh3_128_intdigest(k)
            out.append((n, ((h >> 64) ^ (1 << 63)) - (1 << 63), ((h & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)) - (1 << 63)))
    return out


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): the distinct line keys of every document."""

    def make():
        def lines(batch):
            h1, h2, ids = [], [], []
            for doc, data in zip(batch.column("doc_id").to_pylist(), raw(batch, "text"), strict=True):
                own = {x[1:] for x in hashed(data, min_chars)}
                h1 += [x for x, _ in own]
                h2 += [x for _, x in own]
                ids += [NO_DOC if doc is None else doc] * len(own)
            return [h1, h2, ids]

        return lines

    return emit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "h1 bigint, h2 bigint, doc_id bigint", make)


def line_stats(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of every line key of at least ``min_chars`` code points."""
    rows = document_lines(docs, min_chars)
    return rows.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_shards(stats: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard: perfect hash, fingerprints, document counts, last documents, twins, as bytes.

    Twins (h1, h2, last document) are keys whose h1 another key of the shard has too, about
    one pair in 2**64; the perfect hash has the first of such keys.
    """

    def build(key, pdf):
        again = pdf.duplicated("h1").to_numpy()
        twins = pdf.loc[again, ["h1", "h2", "last_doc"]].to_numpy(np.int64)
        pdf = pdf[~again]
        hashed = PerfectHash(pdf.h1.to_numpy().view(np.uint64))
        at = hashed.index(pdf.h1.to_numpy().view(np.uint64))
        arrays = []
        for column, kind in (("h2", np.int64), ("n_docs", np.int64), ("last_doc", np.int64)):
            a = np.empty(len(pdf), kind)
            a[at] = pdf[column].to_numpy()
            arrays.append(a.tobytes())
        return pd.DataFrame([(key[0], hashed.dump(), *arrays, twins.tobytes())], columns=["shard", *ARRAYS])

    sharded = stats.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(build, "shard int, " + ", ".join(f"{c} binary" for c in ARRAYS))


class Probe:
    """Shards of a broadcast, opened once in each task."""

    def __init__(self, shards: list, n_shards: int):
        self.n = n_shards
        self.shards = {s[0]: (PerfectHash.load(s[1]), *[np.frombuffer(b, np.int64) for b in s[2:]]) for s in shards}

    def last_docs(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash: is it a repeated line of these shards, and the document that keeps it."""
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        shard = np.mod(h1, self.n)
        for s in np.unique(shard):
            if (arrays := self.shards.get(int(s))) is None:
                continue
            rows = np.flatnonzero(shard == s)
            hashed, fingerprints, _, docs, twins = arrays
            at = hashed.index(h1[rows].view(np.uint64))
            ok = (at >= 0) & (at < len(fingerprints))
            ok[ok] = fingerprints[at[ok]] == h2[rows][ok]
            found[rows[ok]], last[rows[ok]] = True, docs[at[ok]]
            for a, b, doc in twins.reshape(-1, 3).tolist():
                twin = rows[(h1[rows] == a) & (h2[rows] == b)]
                found[twin], last[twin] = True, doc
        return found, last


def routed(docs: DataFrame, shards: DataFrame, n_shards: int, hot: list, n_hot: int, min_chars: int) -> DataFrame:
    """(doc_id, gone): hashes of the lines that each document loses, by probes sent to the shards.

    A shard's arrays come first in its partition and its probes stream past them. Lines
    in ``hot`` shards are left to the documents, so no shard gets a very common line.
    """
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def cold_make():
        probe = Probe(held.value, n_hot)

        def run(batch):
            found, _ = probe.last_docs(batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            cold = pa.array(~found)
            return [batch.column(c).filter(cold) for c in ("h1", "h2", "doc_id")]

        return run

    probes = emit(document_lines(docs, min_chars), "h1 bigint, h2 bigint, doc_id bigint", cold_make)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    arrays = shards.select("shard", F.lit(0).alias("kind"), *ARRAYS, *none("bigint", "h1", "h2", "doc_id"))
    asked = probes.select(F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), *none("binary", *ARRAYS), "h1", "h2", "doc_id")
    rows = arrays.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def answer(batches):
        probe: Probe | None = None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0)) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), len(shard)], strict=True):
                part = batch.slice(start, end - start)
                if kind[start] == 0:
                    one = part.to_pylist()[0]
                    probe = Probe([(one["shard"], *(one[c] for c in ARRAYS))], n_shards)
                elif probe is not None and int(shard[start]) in probe.shards:
                    h1, h2, ids = (part.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
                    found, last = probe.last_docs(h1, h2)
                    lose = found & (last != ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x[lose]) for x in (ids, h1, h2)], names=["doc_id", "h1", "h2"])

    lost = rows.mapInArrow(answer, "doc_id bigint, h1 bigint, h2 bigint")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with its text stripped of repeated lines, and n_lines, n_dropped, dropped_lines, kept_sha256.

    A text is split at newlines (null or empty: one empty line). Keys of at least
    ``min_chars`` code points that occur in at least ``min_docs`` documents (distinct
    doc_id; null ids are one document, the smallest) lose their lines except in the
    largest doc_id that holds them; rows that share that doc_id all keep them, and repeated
    rows get equal results. A null text stays null; a text may have any length, and an empty
    table gives an empty one. dropped_lines holds the 0-based line numbers. Input columns
    named like a result give way to it, in any case of letters. Shards go to the documents in broadcasts of
    ``broadcast_bytes``, a pass each; where that would take more than ``MOST_PASSES``,
    the documents' probes go to the shards instead.
    """
    spark = docs.sparkSession
    repeated = stash(line_stats(docs, min_chars).where(F.col("n_docs") >= min_docs), "lines")
    n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
    shards = stash(build_shards(repeated, n_shards), "shards")
    groups: list[list[int]] = [[]]
    sizes = shards.select("shard", sum(F.length(c) for c in shards.columns[1:]).alias("bytes"))
    if (sizes.agg(F.sum("bytes")).first()[0] or 0) <= broadcast_bytes * MOST_PASSES:
        total = 0
        for shard, size in sizes.orderBy("shard").collect():  # a row a shard
            if groups[-1] and total + size > broadcast_bytes:
                groups.append([])
                total = 0
            groups[-1].append(shard)
            total += size
        parts = [([tuple(r) for r in shards.where(F.col("shard").isin(g)).collect()] if g else [], n_shards) for g in groups]
        out = docs
    else:
        least = HOT_DOCS
        while (n_common := repeated.where(F.col("n_docs") >= least).count()) * ENTRY > max(broadcast_bytes, ENTRY * SHARD_KEYS):
            least *= 2  # the most common lines that fit into a broadcast
        common = repeated.where(F.col("n_docs") >= least)
        n_hot = max(1, -(-n_common // SHARD_KEYS))
        hot = [tuple(r) for r in build_shards(common, n_hot).collect()]
        parts = [(hot, n_hot)]
        gone = stash(routed(docs, shards, n_shards, hot, n_hot, min_chars), "gone").withColumnRenamed("doc_id", "__id")
        out = docs.join(gone, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC)) == F.col("__id"), "left").drop("__id")

    for i, (part, n) in enumerate(parts):
        held = spark.sparkContext.broadcast(part)
        first, last_pass = i == 0, i == len(parts) - 1

        def make(held=held, n=n, first=first, last_pass=last_pass):
            probe = Probe(held.value, n)

            def run(batch):
                ids = np.array([NO_DOC if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
                texts = raw(batch, "text")
                before = [()] * len(ids) if first else batch.column("dropped_lines").to_pylist()
                lost = batch.column("__gone").to_pylist() if "__gone" in batch.schema.names else None
                lines = [(row, *x) for row, data in enumerate(texts) for x in hashed(data, min_chars)]
                owner, number, h1, h2 = (np.array(c, np.int64) for c in (zip(*lines, strict=True) if lines else ((), (), (), ())))
                found, last = probe.last_docs(h1, h2)
                lose = found & (last != ids[owner])
                dropped: list[set[int]] = [set(b or ()) for b in before]
                for j in np.flatnonzero(lose).tolist():
                    dropped[owner[j]].add(int(number[j]))
                if lost is not None:
                    sent = [{(g["h1"], g["h2"]) for g in x or ()} for x in lost]
                    for row, line, a, b in lines:
                        if (a, b) in sent[row]:
                            dropped[row].add(line)
                if not last_pass:
                    return [texts_as(texts), [0] * len(ids), [0] * len(ids), [sorted(d) for d in dropped], [None] * len(ids)]
                kept, digests, sizes = [], [], []
                for data, bad in zip(texts, dropped, strict=True):
                    split = (data or b"").split(b"\n")
                    text = b"\n".join(x for n, x in enumerate(split) if n not in bad)
                    sizes.append(len(split))
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(None if data is None else text)
                return [texts_as(kept), sizes, list(map(len, dropped)), [sorted(d) for d in dropped], digests]

            return run

        fields = [
            T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
            T.StructField("dropped_lines", T.ArrayType(T.LongType())), T.StructField("kept_sha256", T.StringType()),
        ]
        out = attach(out.withColumn("doc_id", F.col("doc_id").cast("bigint")), "text", fields, make, replace_text=True)
        if not last_pass:
            out = stash(out, "probed")
    return out.drop("__gone")


def texts_as(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, type=pa.binary()).cast(pa.string())
