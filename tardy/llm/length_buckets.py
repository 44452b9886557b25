"""Packing into optimal length buckets.

The lengths of all documents are counted in one global histogram. Dynamic
programming chooses the bucket boundaries that minimise the padding when each
document is padded to its bucket's boundary; inside each bucket, batches are
filled up to a token budget.

Every distinct length is a histogram cell of its own, so that the boundaries are
optimal among all. Best cuts move up with the lengths (the padding is a Monge
cost), which lets each of the programme's rounds search n log n pairs.

Defined results: a null or empty text has length 1 (its end token) and lies in
the first bucket. A bucket whose boundary exceeds the budget holds one document a batch.
Repeated rows and equal lengths are placed one by one; rows without an id come
first in their shard. An empty table gives an empty result.

Scale: the histogram is a partial aggregate; only it reaches the driver, two
numbers for each distinct length, at most as many as the longest text has
words. Rows are numbered inside shards by id (rows without one are spread), whose number grows
with the square root of the rows, and shard offsets make the numbers run on
through a bucket, so no bucket is gathered in one task and each bucket has at
most one batch that isn't full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import WS, small_side, whole


@dataclass(frozen=True)
class Packing:
    buckets: int = 16
    token_budget: int = 65_536


def word_count(text: str = "text") -> Column:
    """Words and one end token, the length that is packed."""
    trimmed = F.regexp_replace(whole(text), f"^{WS}+|{WS}+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WS + "+"))).cast("bigint") + 1


def _first_best(prev: np.ndarray, end: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of cells j > 0: the least prev[i] + end[j-1] * (below[j] -
    below[i]) over i < j, and its first i. The first best i never falls as j grows,
    so the middle of a range of j halves the search of both its sides."""
    n = len(end)
    now, at = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    low, high = np.array([1]), np.array([n])
    first, last = np.array([0]), np.array([n - 1])
    while len(low):
        mid = (low + high) // 2
        size = np.minimum(last, mid - 1) - first + 1
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(mid)), size)
        i = np.arange(size.sum()) - start[of] + first[of]
        total = prev[i] + end[mid[of] - 1] * (below[mid[of]] - below[i])
        least = np.minimum.reduceat(total, start)
        hit = np.flatnonzero(total == least[of])
        best = i[hit[np.unique(of[hit], return_index=True)[1]]]
        now[mid], at[mid] = least, best
        parts = [np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, best), (best, last))]
        open_ = parts[0] <= parts[1]
        low, high, first, last = (x[open_] for x in parts)
    return now, at


def best_boundaries(ends: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the largest end) of at most
    ``buckets`` buckets that minimise sum(boundary * documents); of equally
    good choices the one with earlier cuts."""
    n = len(ends)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    end = np.asarray(ends, dtype=np.int64)
    cost = [np.concatenate([[0], end * below[1:]])]  # one bucket for the first j cells
    cut = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        now, at = _first_best(cost[-1], end, below)
        cost.append(now)
        cut.append(at)
    level = int(np.argmin([c[n] for c in cost]))
    out, j = [], n
    while j > 0:
        out.append(int(ends[j - 1]))
        j = int(cut[level][j]) if level else 0
        level -= 1
    return out[::-1]


def boundaries(lengths: DataFrame, packing: Packing = Packing()) -> list[int]:
    """From ``_n`` of all rows: a row for each distinct length is collected."""
    cells = sorted((r["_n"], r["docs"]) for r in lengths.groupBy("_n").agg(F.count(F.lit(1)).alias("docs")).collect())
    return best_boundaries([e for e, _ in cells], [d for _, d in cells], packing.buckets)


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", packing: Packing = Packing(), length: Column | None = None) -> DataFrame:
    """Per row: id, ``n_tokens``, ``bucket`` (from 0), ``boundary`` (padded
    length), ``batch`` (from 0 inside the bucket), ``slot`` (from 0 inside the
    batch), ``padding``. The text is read once; the short rows are written."""
    n = word_count(text) if length is None else length
    rows = materialize(docs.select(F.col(id_col).alias("_id"), n.cast("bigint").alias("_n"), F.monotonically_increasing_id().alias("_row")), "lengths")
    total = rows.count()
    shards = 4 * max(1, math.isqrt(total))
    ends = boundaries(rows, packing)
    if not ends:
        ends = [0]
    limits = F.array(*[F.lit(int(e)) for e in ends])
    bucket = F.size(F.filter(limits, lambda e: e < F.col("_n")))
    spread = F.pmod(F.when(F.col("_id").isNull(), F.xxhash64("_row")).otherwise(F.xxhash64("_id")), F.lit(shards)).cast("int")
    placed = rows.select("_id", "_n", bucket.alias("bucket"), spread.alias("_shard"))
    within = Window.partitionBy("_shard", "bucket").orderBy("_id", "_n")
    numbered = placed.repartition("_shard").withColumn("_k", F.row_number().over(within).cast("bigint") - 1)
    shard_rows = placed.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(shard_rows.select("bucket", "_shard", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o")), "shard_offsets")
    room = F.greatest(F.floor(F.lit(packing.token_budget) / F.greatest(limits[F.col("bucket")], F.lit(1))), F.lit(1)).cast("bigint")
    at = F.col("_o") + F.col("_k")
    return numbered.join(small_side(offsets), ["_shard", "bucket"]).select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_tokens"),
        "bucket",
        limits[F.col("bucket")].cast("bigint").alias("boundary"),
        F.floor(at / room).cast("bigint").alias("batch"),
        (at % room).alias("slot"),
        (limits[F.col("bucket")] - F.col("_n")).cast("bigint").alias("padding"),
    )
