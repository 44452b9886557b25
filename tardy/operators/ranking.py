"""Ordered statistics inside groups: average-tie ranks, percentile ranks and
exact quantiles, safe against hot groups.

A plain ``Window.partitionBy(group)`` puts every row of a group into one
task. That is fine while groups are bounded, but a single group holding a
third of all rows would then be sorted by one task. The ``range`` strategy
avoids that:

1. ties are collapsed first: ``(group, value) -> n`` with map-side partial
   aggregation, so a hot tie costs nothing; the pairs are written once;
2. they are range partitioned on ``(group, value)`` into slices of at most
   about ``SLICE_VALUES`` pairs, however many there are; Spark samples the
   bounds, so a hot group is spread over many tasks;
3. each task walks its sorted slice once (pandas, vectorised) and records,
   per distinct value, the count of smaller values of the same group inside
   the slice; the result is checkpointed so that partition ids stay fixed
   if executors are lost and the slice is recomputed;
4. only groups cut by a partition boundary need an offset from earlier
   slices. At most two groups per slice touch its edges, so the offset table
   has at most ``2 * num_partitions`` rows -- a proven bound, and it is the
   only table that is broadcast.

The ``window`` strategy is the direct window plan (one exchange, one sort);
tests check that both give identical results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.tables import materialize

STRATEGY_CONF = "tardy.rank.strategy"
#: Distinct (group, value) pairs one task may hold.
SLICE_VALUES = 1_000_000


def _strategy(df: DataFrame, strategy: str | None) -> str:
    s = strategy or df.sparkSession.conf.get(STRATEGY_CONF, "range")
    if s not in ("range", "window"):
        raise ValueError(f"unknown rank strategy {s!r}")
    return s


def _keys_not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _local_pass(keys: list[str], counts: list[str]):
    """Per range partition: running sums of the counts of smaller values per group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        # A slice has about SLICE_VALUES distinct pairs at most.
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        grp = pdf.groupby(keys, sort=False, dropna=False)
        for c in counts:
            pdf[f"_lb{c}"] = (grp[c].cumsum() - pdf[c]).astype("int64")
            pdf[f"_seg{c}"] = grp[c].transform("sum").astype("int64")
        first_of_key = ~pdf.duplicated(subset=keys, keep="first")
        key_tuple = pdf[keys].iloc[[0, -1]]
        is_first = np.ones(len(pdf), dtype=bool)
        is_last = np.ones(len(pdf), dtype=bool)
        for k in keys:
            is_first &= (pdf[k] == key_tuple[k].iloc[0]).to_numpy()
            is_last &= (pdf[k] == key_tuple[k].iloc[1]).to_numpy()
        pdf["_edge"] = first_of_key.to_numpy() & (is_first | is_last)
        pdf["_pid"] = np.int32(pid)
        yield pdf

    return run


def is_timestamp(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp: pandas' own end in 1677 and 2262."""
    ntz = df.schema[column].dataType.typeName() == "timestamp_ntz"
    zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'" if ntz else "timestamp_micros(0)"
    return F.expr(f"timestampdiff(MICROSECOND, {zero}, `{column}`)")


def value_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    strategy: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Distinct non-null ``(keys, value)`` with

    ``_n``     number of rows holding that value in the group,
    ``_below`` number of rows of the group with a smaller value,
    ``_total`` number of rows of the group with a non-null value.

    Rows with a null key or a null value are left out (pandas semantics).
    """
    keys = list(keys)
    vc = (
        df.where(_keys_not_null(keys) & F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if _strategy(df, strategy) == "window":
        w = Window.partitionBy(*keys).orderBy(value)
        return vc.select(
            *keys,
            value,
            "_n",
            F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )

    pos = running_counts(vc, keys, value, ["_n"], num_partitions)
    return pos.select(*keys, value, "_n", F.col("_below_n").alias("_below"), F.col("_total_n").alias("_total"))


def running_counts(
    vc: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str], num_partitions: int | None = None
) -> DataFrame:
    """``vc`` (distinct non-null ``keys``, ``value`` and count columns) with, for
    each count column ``c``, ``_below{c}``: its sum over the smaller values of the
    group, and ``_total{c}``: its sum over the group. Several counts (one per
    subset of the rows) are summed in the same pass over the same sorted slices."""
    keys, counts = list(keys), list(counts)
    spark = vc.sparkSession
    ensure_checkpoint_dir(spark)
    vc = materialize(vc.select(*keys, value, *counts), "value_counts")
    p = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(vc.count() / SLICE_VALUES))
    ranged = vc.repartitionByRange(p, *keys, value).sortWithinPartitions(*keys, value)
    sums = [T.StructField(f"{kind}{c}", T.LongType()) for c in counts for kind in ("_lb", "_seg")]
    marks = [T.StructField("_edge", T.BooleanType()), T.StructField("_pid", T.IntegerType())]
    out_schema = T.StructType([*vc.schema.fields, *sums, *marks])
    loc = ranged.mapInPandas(_local_pass(keys, counts), out_schema).checkpoint(eager=True)
    edges = loc.where("_edge").select("_pid", *keys, *[f"_seg{c}" for c in counts])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy(*keys)
    offsets = edges.select(
        "_pid",
        *keys,
        *[F.coalesce(F.sum(f"_seg{c}").over(before), F.lit(0)).alias(f"_off{c}") for c in counts],
        *[F.sum(f"_seg{c}").over(of_key).alias(f"_tot{c}") for c in counts],
    )
    # offsets has <= 2 rows per range partition: safe to broadcast.
    return loc.join(F.broadcast(offsets), ["_pid", *keys], "left").select(
        *keys,
        value,
        *counts,
        *[(F.coalesce(f"_off{c}", F.lit(0)) + F.col(f"_lb{c}")).alias(f"_below{c}") for c in counts],
        *[F.coalesce(f"_tot{c}", f"_seg{c}").alias(f"_total{c}") for c in counts],
    )


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rank_col: str,
    pct_col: str | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """Add the average-tie rank of ``value`` inside ``keys`` (ascending, 1-based)
    and optionally its percentile form rank / non-null count. Null values and
    rows with a null key get null ranks."""
    keys = list(keys)
    if _strategy(df, strategy) == "window":
        v = F.col(value)
        w = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
        ties = Window.partitionBy(*keys, value)
        ok = _keys_not_null(keys) & v.isNotNull()
        rank = F.when(ok, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
        out = df.withColumn(rank_col, rank)
        if pct_col:
            out = out.withColumn(pct_col, F.col(rank_col) / F.count(v).over(Window.partitionBy(*keys)))
        return out

    if is_timestamp(df, value):
        with_micros = df.withColumn("_micros", micros(df, value))
        return average_rank(with_micros, keys, "_micros", rank_col, pct_col, "range").drop("_micros")

    pos = value_positions(df, keys, value, strategy="range")
    cols = [*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(rank_col)]
    if pct_col:
        cols.append(((F.col("_below") + (F.col("_n") + 1) / 2.0) / F.col("_total")).alias(pct_col))
    return df.join(pos.select(*cols), [*keys, value], "left")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    strategy: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation (as Spark ``percentile``,
    numpy and pandas) per group: one row per group with a non-null value,
    one column per entry of ``probs``."""
    keys = list(keys)
    pos = value_positions(df, keys, value, strategy=strategy)
    aggs = []
    for name, q in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(q))
        lo = F.floor(h) + 1  # 1-based positions
        hi = F.ceil(h) + 1
        frac = h - F.floor(h)

        def covers(p: Column) -> Column:
            return (F.col("_below") < p) & (p <= F.col("_below") + F.col("_n"))

        aggs += [
            F.max(F.when(covers(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(covers(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(frac).alias(f"_fr_{name}"),
        ]
    g = pos.groupBy(*keys).agg(*aggs)
    out = [*keys]
    for name in probs:
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        out.append(F.when(fr == 0, lo).otherwise(lo + fr * (hi - lo)).alias(name))
    return g.select(*out)


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", strategy: str | None = None) -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5}, strategy=strategy)
