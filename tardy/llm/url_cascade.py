"""URL filter by a Bloom filter cascade, DataFrame functions only.

Rules are keys: a host and a path prefix (``net/es/``). A url's candidate keys
are the suffixes of its host joined with the prefixes of its path; the longest
candidate that is listed decides. Listed keys are recognised by a cascade:
level 1 is a Bloom filter of the listed keys, level 2 one of those keys of the
corpus that pass level 1 without being listed, level 3 one of the listed keys
that pass level 2, and so on until nothing passes wrongly. Over the corpus's
complete key universe membership is then exact, and a url is judged inside its
row, without a join.

Defined results: a null url or one without ``://`` has empty host and path and
fits no rule; urls that fit none get the default verdict; a key listed twice
counts once, one under both verdicts blocks. Ties and repeated rows are judged
alike; an empty table or an empty list is allowed. Other columns aren't read.

Scale: the universe is the distinct candidate keys, deduplicated before the
shuffle. All levels together take about 1.44 log2(s/r) + 4.2 bits for each of r
listed keys against s others, so the filters are bounded by the list, and
checked against ``max_filter_bytes``; a longer list takes the exact shuffled
join in ``judge_by_join``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import lower_ascii, small_side, whole


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(whole(url), "://")
    return F.when(at > 0, F.substring(whole(url), at + 3, 2**31 - 1)).otherwise("")


def split_rule(key: str) -> tuple[str, str]:
    host, slash, path = key.partition("/")
    return host, slash + path


def candidates(host: Column, path: Column, labels: int, path_lengths: Sequence[int]) -> Column:
    """Every key a rule could have that fits: the last 1 to ``labels`` labels
    of the host (and the whole host) with path prefixes of the lengths that
    the rules have. Longest key first, then longest host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    lengths = F.filter(F.array(*[F.lit(x) for x in sorted(set(path_lengths))]), lambda x: x <= F.length(path))
    keys = F.flatten(
        F.transform(hosts, lambda h: F.transform(lengths, lambda x: F.struct((F.length(h) + x).alias("n"), F.length(h).alias("h"), F.concat(h, F.substring(path, F.lit(1), x)).alias("key"))))
    )
    return F.transform(F.sort_array(keys, asc=False), lambda x: x["key"])


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]
    salt: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        # One string, which the optimiser folds into an array literal once.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for at in self.positions(key):
            word = F.get(words, F.floor(at / 64).cast("int"))
            hit = hit & F.getbit(word, F.pmod(at, F.lit(64)).cast("int")).eqNullSafe(1)
        return hit


def _filter(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """Bloom filter of the ``n`` rows of ``keys``; its words are or-ed by a
    partial aggregate, at most bits / 64 rows reach the driver."""
    bits = max(64, 64 * math.ceil(n * 1.44 * math.log2(1 / rate) / 64))
    empty = Level(bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1, (), salt)
    empty = Level(bits, min(empty.hashes, 24), (), salt)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("b"))
    found = {r["w"]: r["b"] for r in words.collect()}
    return Level(bits, empty.hashes, tuple(found.get(i, 0) for i in range(bits // 64)), salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe and listed keys."""
        out = F.lit(len(self.levels) % 2 == 1)  # passed all levels
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out

    @property
    def size_bytes(self) -> int:
        return sum(x.bits for x in self.levels) // 8


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
    """``listed`` and ``universe``: written tables of distinct ``key``."""
    inside = listed
    outside = materialize(universe.join(small_side(listed), "key", "left_anti"), "keys_outside")
    r, s = inside.count(), outside.count()
    if r == 0:
        return Cascade(())
    levels: list[Level] = []
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * r / max(s, 1)))
    while r:
        level = _filter(inside, r, rate, seed + len(levels))
        levels.append(level)
        # What passes wrongly is what the next level encodes.
        inside, outside = materialize(outside.where(level.passes(F.col("key"))), "keys_passing"), inside
        r, rate = inside.count(), 0.5
    return Cascade(tuple(levels))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
    max_filter_bytes: int = 4 << 20,
) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule`` (the longest listed key that fits,
    else null) and ``verdict`` of each row. ``rules``: (verdict, key)."""
    spark = pages.sparkSession
    by = {v: sorted({k for w, k in rules if w == v}) for v in ("block", "allow")}
    every = sorted({k for _, k in rules})
    if len(every) * 4 > max_filter_bytes:  # about 30 bits a key
        return judge_by_join(pages, rules, url, keep, default)
    labels = max([split_rule(k)[0].count(".") + 1 for k in every], default=1)
    lengths = sorted({len(split_rule(k)[1]) for k in every}) or [0]
    rows = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    keyed = rows.withColumn("_keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = materialize(keyed.select(F.explode("_keys").alias("key")).distinct(), "url_keys")
    cascades = {v: build_cascade(materialize(spark.createDataFrame([(k,) for k in keys], "key string"), "listed_keys"), universe) for v, keys in by.items()}
    fits = lambda v: (lambda k: cascades[v].contains(k))
    known = lambda k: cascades["block"].contains(k) | cascades["allow"].contains(k)
    ruled = keyed.withColumn("rule", F.get(F.filter("_keys", known), F.lit(0)))
    return ruled.select(
        *keep, "host", "path", "rule", F.when(F.col("rule").isNull(), default).when(fits("block")(F.col("rule")), "block").otherwise("allow").alias("verdict")
    )


def judge_by_join(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """The same result for lists beyond the filters' bound: candidate keys are
    joined with the list, and the longest of a row is picked by an aggregate."""
    table = pages.sparkSession.createDataFrame([(k, v) for v, k in rules], "_key string, _v string").groupBy("_key").agg(F.max("_v").alias("_v"))
    labels = max([split_rule(k)[0].count(".") + 1 for _, k in rules], default=1)
    lengths = sorted({len(split_rule(k)[1]) for _, k in rules}) or [0]
    rows = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "url_rows")
    keyed = rows.select("_id", F.posexplode(candidates(F.col("host"), F.col("path"), labels, lengths)).alias("_at", "_key"))
    best = keyed.join(table, "_key").groupBy("_id").agg(F.min(F.struct("_at", "_key", "_v")).alias("_b"))
    return rows.join(best, "_id", "left").select(
        *keep, "host", "path", F.col("_b._key").alias("rule"), F.coalesce(F.when(F.col("_b._v") == "block", "block").when(F.col("_b._v").isNotNull(), "allow"), F.lit(default)).alias("verdict")
    )
