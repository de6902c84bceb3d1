"""URL rules by a cascade of Bloom filters, in native functions only.

Level 0 encodes the listed keys, level 1 the keys of the corpus that level 0 lets
through wrongly, level 2 the listed keys that level 1 lets through, and so on until a
level lets nothing through wrongly. A key of the corpus is listed exactly if the first
level that refuses it has an odd number. The key universe is every (host suffix, path
prefix) of the corpus's urls that a rule could name, so membership is exact for it and
no url is joined with a rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import shared_dir, stash, without

#: No filter is larger than this; longer lists are sharded by their keys' hashes.
FILTER_BYTES = 16 << 20
#: All filters of a verdict together, which the plan carries: a few hundred million rules.
ALL_BYTES = 512 << 20
#: 64-bit words of a filter in a row on its way to the driver.
WORDS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A cascade halves its keys at each level or so; it ends long before this.
MOST_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, rules: list[Rule]) -> Column:
    """array<struct<size, host_size, key>>: the keys of a url that have a rule's number of labels and path length."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    keys = []
    for labels, length in shapes:
        suffix = F.substring_index(host, ".", -labels)
        key = F.concat(suffix, F.substring(path, 1, length))
        fits = (dots >= labels - 1) & (F.length(path) >= length) & (host != "")
        keys.append(F.when(fits, F.struct(F.length(key).alias("size"), F.length(suffix).alias("host_size"), key.alias("key"))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


@dataclass(frozen=True)
class Level:
    """A Bloom filter; bit ``at`` is bit at % 64 of its word at // 64, words big endian."""

    bits: int
    hashes: int
    data: bytes
    salt: int

    def has(self, key: Column) -> Column:
        """Every bit of the key is set. The filter is one literal, bound once and shared by all its probes."""

        def every(data: Column) -> Column:
            out = F.lit(True)
            for at in _places(key, self.salt, self.hashes, self.bits):
                byte = F.shiftright(at, 6) * 8 + 8 - F.shiftright(at.bitwiseAND(F.lit(63)), 3)
                code = F.ascii(F.decode(F.substring(data, byte.cast("int"), F.lit(1)), "ISO-8859-1"))
                out = out & (F.getbit(code, at.bitwiseAND(F.lit(7)).cast("int")) == 1)
            return out

        return F.exists(F.array(F.lit(self.data)), every)


def _places(key: Column, salt: int, hashes: int, bits: int) -> list[Column]:
    """Bits of a key by double hashing."""
    a, b = (F.pmod(F.xxhash64(F.lit(salt), F.lit(i), key), F.lit(bits)) for i in (0, 1))
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]


def size_of(n: int, rate: float) -> int:
    """Bits of a filter of ``n`` keys that lets ``rate`` of others pass, in whole words."""
    return 64 * max(1, math.ceil(n * -math.log(rate) / (math.log(2) ** 2) / 64))


def build_level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the ``n`` keys in column ``key``; ``rate`` of other keys pass."""
    hashes, bits = max(1, round(-math.log2(rate))), size_of(n, rate)
    places = F.array(*_places(F.col("key"), salt, hashes, bits))
    words = keys.select(F.explode(places).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
    # blocks of words as hexadecimal text: the driver gets bits / 8 / WORDS rows
    own = F.map_from_entries(F.collect_list(F.struct((F.col("word") % WORDS).cast("int"), "set")))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.col("own")[i], F.lit(0).cast("bigint"))), 16, "0")), "")
    blocks = words.groupBy(F.expr(f"word div {WORDS}").alias("block")).agg(own.alias("own")).select("block", text.alias("text"))
    data = bytearray(bits // 8 + WORDS * 8)
    for block, found in blocks.collect():
        data[block * WORDS * 8 : (block + 1) * WORDS * 8] = bytes.fromhex(found)
    return Level(bits, hashes, bytes(data[: bits // 8]), salt)


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Exact for listed keys and the universe: refused first by an odd level, or by none of an odd number."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 0) -> list[Level]:
    """Levels for the keys in ``listed`` against those in ``universe`` (both with a column ``key``, without repeats)."""
    n, others = listed.count(), universe.count()
    if not n:
        return []
    levels = [build_level(listed, n, first_rate(n, others), salt)]
    # what level 0 lets through of the universe, without the listed keys: about as many as are listed
    false = universe.where(levels[0].has(F.col("key"))).select("key").join(listed, "key", "left_anti").checkpoint()
    sides = [listed, false]
    while len(levels) < MOST_LEVELS:
        side = sides[len(levels) % 2]
        for i in range(len(levels) - 1, -1, -2):  # keys that every level of the other side lets through
            side = side.where(levels[i].has(F.col("key")))
        left = side.count()
        if not left:
            return levels
        levels.append(build_level(side, left, 0.5, salt + len(levels)))
    raise RuntimeError("the cascade does not end")


def first_rate(n: int, others: int) -> float:
    """Share of unlisted keys that level 0 lets through: the sizes of all levels together are about least there."""
    return min(0.5, math.sqrt(0.5) * n / max(others, 1))


def build_shards(listed: DataFrame, universe: DataFrame, salt: int) -> list[list[Level]]:
    """Cascades of keys sharded by hash, so that no filter is larger than ``FILTER_BYTES``."""
    listed, universe = listed.where("key is not null").distinct().checkpoint(), universe.distinct()
    n, others = listed.count(), universe.count()
    shards = max(1, -(-size_of(n, first_rate(n, others)) // (8 * FILTER_BYTES))) if n else 1
    if shards * FILTER_BYTES > ALL_BYTES and shards > 1:
        raise ValueError(f"{n} rules need filters of more than {ALL_BYTES} bytes in all: judge the urls in several calls")
    own = _shard(F.col("key"), shards)
    return [build_cascade(listed.where(own == s), universe.where(own == s), salt) for s in range(shards)]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(77), key), F.lit(shards))


def listed_in(key: Column, shards: list[list[Level]]) -> Column:
    """The key is listed: the cascade of its shard says so."""
    out = F.lit(False)
    for s, levels in enumerate(shards):
        out = F.when(_shard(key, len(shards)) == s, in_cascade(key, levels)).otherwise(out) if len(shards) > 1 else in_cascade(key, levels)
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (its key or null) and verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's
    path. The longest key wins; of equally long ones that with the longer host; of rules
    with one key the first in the list. A null or empty url, or one without ``://``, has
    empty host and path and gets ``otherwise``; a url may have any length. Repeated rows
    are judged alike; an empty table gives an empty one, no rules give ``otherwise``. Input
    columns named like a result give way to it, in any case of letters.
    """
    spark = pages.sparkSession
    shared_dir(spark)
    base = without(pages, ["host", "path", "rule", "verdict"])
    found = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not rules:
        return found.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    rules = list({r.key: r for r in reversed(rules)}.values())
    keyed = found.withColumn("__keys", candidates(F.col("host"), F.col("path"), rules))
    universe = stash(keyed.select(F.explode("__keys.key").alias("key")).distinct(), "keys")
    cascades = {}
    for i, verdict in enumerate(sorted({r.verdict for r in rules})):
        listed = spark.createDataFrame([(r.key,) for r in rules if r.verdict == verdict], "key string")
        cascades[verdict] = build_shards(listed, universe, salt=1000 * i)

    def judged(k: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, shards in cascades.items():
            verdict = F.when(listed_in(k["key"], shards), F.lit(name)).otherwise(verdict)
        return F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform("__keys", judged), lambda k: k["verdict"].isNotNull()))
    return (
        keyed.withColumn("__best", best).withColumn("rule", F.col("__best.key"))
        .withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit(otherwise)))
        .drop("__keys", "__best")
    )
