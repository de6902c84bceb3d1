"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item (the whole item where it is
shorter). For exact containment the prefix that a pair has to share is one word, so
each window is joined under its rarest word alone. The rarity order is counted over
all documents. A document word that is such a prefix word proposes a window through
its offset in it (positional bound); the window has to fit into the document (length
bound). Proposals then meet the windows in a join on all their words.

Documents learn which words are prefixes, and which proposals are worth sending, from
bit sets of bounded size; a bit set may let too much through, never too little, and the
join decides. So nothing is sized by the benchmark: it may have any number of items.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import BROADCAST_BYTES, attach, emit, raw, stash, without, words_of
from tidelog.llm.url_filter import build_level

#: Bits of a set: for each key, and at most.
KEY_BITS, MOST_BITS = 32, 1 << 29
#: Bytes of a window or of a document's result in a broadcast, about.
WINDOW_BYTES, RESULT_BYTES = 200, 400
#: Documents of a batch whose words are held at once.
ROWS = 1_000
#: Parts that a window's proposals are split into where windows are shuffled.
SALTS = 8
KEY = ["doc_id", "k1", "k2"]


def windows_of(words: list, size: int) -> list[list]:
    if len(words) <= size:
        return [words] if words else []
    return [words[i : i + size] for i in range(len(words) - size + 1)]


class BitSet:
    """Two bits a 64-bit hash."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> BitSet:
        """The hashes in column ``h``; ``n`` of them, about. The driver gets ``MOST_BITS`` / 64 words at most."""
        bits = min(MOST_BITS, 1 << max(6, (KEY_BITS * n - 1).bit_length()))
        places = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))))
        words = hashes.select(places.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toPandas()
        out = np.zeros(bits // 64, np.uint64)
        out[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
        return cls(bits, out)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(h.shape, bool)
        for part in (h, h >> np.uint64(32)):
            at = part & np.uint64(self.bits - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def hash_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def signed(h: int) -> int:
    return (h ^ (1 << 63)) - (1 << 63)


def shaped(h: np.ndarray, offset: int, length: int) -> np.ndarray:
    """Hashes of words as the prefixes of windows of a length, at an offset."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(offset * 4096 + length + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def known_words(flat: list[bytes], known: BitSet) -> list[bytes]:
    """The distinct words that the set may hold."""
    some = list(set(flat))
    return [w for w, ok in zip(some, known.has(np.fromiter(map(hash_of, some), np.uint64, len(some))).tolist(), strict=True) if ok]


def word_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(w, n) over all documents for the words of a broadcast bit set."""

    def make():
        known = vocabulary.value

        def count(batch):
            c = Counter(chain.from_iterable(map(words_of, raw(batch, "text"))))
            some = known_words(list(c), known)
            return [some, [c[w] for w in some]]

        return count

    return emit(docs.select("text"), "w binary, n bigint", make).groupBy("w").agg(F.sum("n").alias("n"))


def prefixed_windows(items: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(window, item_id, h, at, offset, length): every item's windows under the hash ``at`` of their rarest word's place; h is the window's hash."""
    sc = items.sparkSession.sparkContext

    def spell():
        return lambda batch: [batch.column("item_id"), [words_of(t) for t in raw(batch, "text")]]

    spelled = emit(items, "item_id string, words array<binary>", spell).where("size(words) > 0")
    spelled = stash(spelled.withColumn("row", F.monotonically_increasing_id()), "items")

    def hashes():
        return lambda batch: [[signed(hash_of(w)) for w in raw(batch, "w")]]

    vocabulary = stash(spelled.select(F.explode("words").alias("w")).distinct(), "vocabulary")
    known = sc.broadcast(BitSet.of(emit(vocabulary, "h bigint", hashes), vocabulary.count()))
    counted = vocabulary.join(word_counts(docs, known), "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    placed = spelled.select("row", F.posexplode("words").alias("pos", "w")).join(counted, "w")
    ranked = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "w"))).alias("ws")).join(spelled.select("row", "item_id"), "row")

    def make():
        def run(batch):
            out: list[list] = [[], [], [], [], [], []]
            for item, ws in zip(batch.column("item_id").to_pylist(), batch.column("ws").to_pylist(), strict=True):
                for w in windows_of(ws, size):
                    offset = min(range(len(w)), key=lambda i: (w[i]["n"], w[i]["w"], i))
                    joined = b" ".join(x["w"] for x in w)
                    at = shaped(np.array([hash_of(w[offset]["w"])], np.uint64), offset, len(w))
                    for column, x in zip(out, (joined, item, signed(hash_of(joined)), signed(int(at[0])), offset, len(w)), strict=True):
                        column.append(x)
            return out

        return run

    return stash(emit(ranked.select("item_id", "ws"), "window binary, item_id string, h bigint, at bigint, offset int, length int", make).distinct(), "windows")


def proposals(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, start, length, window): document windows that the bit sets take for item windows."""
    sc = docs.sparkSession.sparkContext
    shapes = sorted(tuple(r) for r in windows.select("offset", "length").distinct().collect())  # window sizes and offsets: few
    n = windows.count()
    prefixes = sc.broadcast(BitSet.of(windows.select(F.col("at").alias("h")), n))
    whole = sc.broadcast(BitSet.of(windows.select("h"), n))

    def make():
        def run(batch):
            row, start, size, text = [], [], [], []
            for at in range(0, batch.num_rows, ROWS):
                texts = [words_of(t) for t in raw(batch.slice(at, ROWS), "text")]
                some = list(set(chain.from_iterable(texts)))
                h = np.fromiter(map(hash_of, some), np.uint64, len(some))
                fits: dict[bytes, list[tuple[int, int]]] = {}
                for offset, length in shapes:
                    for i in np.flatnonzero(prefixes.value.has(shaped(h, offset, length))).tolist():
                        fits.setdefault(some[i], []).append((offset, length))
                for r, words in enumerate(texts, at):
                    for i in [i for i, w in enumerate(words) if w in fits]:
                        for offset, length in fits[words[i]]:
                            first = i - offset
                            if first >= 0 and first + length <= len(words):
                                row.append(r)
                                start.append(first)
                                size.append(length)
                                text.append(b" ".join(words[first : first + length]))
            on = np.flatnonzero(whole.value.has(np.fromiter(map(hash_of, text), np.uint64, len(text))))
            at = pa.array([row[i] for i in on.tolist()], pa.int64())
            return [*(batch.column(c).take(at) for c in KEY), [start[i] for i in on], [size[i] for i in on], [text[i] for i in on]]

        return run

    kind = T.StructType([*(docs.schema[c] for c in KEY), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("window", T.BinaryType())])
    return emit(docs.select(*KEY, "text"), kind, make)


def joined(hits: DataFrame, windows: DataFrame, how: str, broadcast: bool) -> DataFrame:
    """Hits joined with windows on the window; a window of very many hits is split by salt where windows are not broadcast."""
    if broadcast:
        return hits.join(F.broadcast(windows), "window", how)
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)).cast("int")).join(salted, ["window", "salt"], how).drop("salt")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (word spans [start, end)), n_hit and items (ids as strings, sorted).

    docs: any columns with doc_id and text; items: item_id and text. Null, empty and
    wordless texts have no words, hits or items; an item without words, a null item_id and
    a null item text have no window. Texts may have any length. Repeated rows get equal
    results; rows that share a doc_id each get those of their own text. Either table may be
    empty. Input columns named like a result give way to it, in any case of letters.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    base = without(docs, ["n_words", "hit_spans", "n_hit", "items"])
    keyed = base.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text").where("text is not null")
    windows = prefixed_windows(items, keyed, window)
    small = windows.count() * WINDOW_BYTES <= broadcast_bytes
    hits = stash(joined(proposals(keyed, windows), windows.select("window").distinct(), "left_semi", small).distinct(), "hits")

    def make():
        def run(batch):
            spans = [_union([(s["start"], s["end"]) for s in own]) for own in batch.column("spans").to_pylist()]
            return [*(batch.column(c) for c in KEY), [[{"start": a, "end": b} for a, b in s] for s in spans]]

        return run

    span = T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    spans = hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"))
    merged = emit(spans, T.StructType([*(hits.schema[c] for c in KEY), span]), make)
    named = joined(hits.select(*KEY, "window").distinct(), windows.select("window", "item_id"), "inner", small)
    names = named.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k1"] == b["k1"]) & (a["k2"] == b["k2"])
    found = merged.join(names, same(merged, names)).select(*(merged[c] for c in KEY), "hit_spans", "items")
    found = stash(found.select(F.col("doc_id").alias("__doc"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "hit_spans", "items"), "leaks")


    def count():
        return lambda batch: [[len(words_of(t)) for t in raw(batch, "text")]]

    marked = attach(base, "text", [T.StructField("n_words", T.LongType())], count)
    k1 = F.xxhash64("text")
    match = F.col("doc_id").eqNullSafe(F.col("__doc")) & (k1 == F.col("__k1")) & (F.xxhash64(F.lit(1), "text") == F.col("__k2"))
    empty = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("hit_spans", "items")]
    kept = [F.col(f"`{c}`") for c in marked.columns]
    n = found.count()
    if n * RESULT_BYTES <= broadcast_bytes:
        out = marked.join(F.broadcast(found), match, "left").select(*kept, *empty)
    else:  # documents without hits, most of them, are not shuffled: a filter of the others' keys lets them by
        level = build_level(found.select(F.col("__k1").cast("string").alias("key")), min(n, MOST_BITS // 16), 0.01, 5)
        maybe = F.coalesce(level.has(k1.cast("string")), F.lit(False))
        hit = marked.where(maybe).join(found, match, "left").select(*kept, *empty)
        none = [F.array().cast(found.schema[c].dataType).alias(c) for c in ("hit_spans", "items")]
        out = hit.unionByName(marked.where(~maybe).select(*kept, *none))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_hit", n_hit)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
