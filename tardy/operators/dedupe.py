"""Row choice per key (``DISTINCT ON``, ``head(1)`` per group) by hash aggregates.

``min(struct(order..., rest...))`` per key picks the row in one aggregate, but
Spark can only sort for it: its hash aggregate needs buffers of fixed width. Here
the order is packed into one number instead. The columns of few distinct
combinations (types, states, demographics) become codes from a dictionary of their
sorted combinations; a leading integer column and the code are one decimal; its
minimum per key is a hash aggregate, combined map-side, and is unpacked again.
A dictionary beyond ``SMALL_ROWS`` combinations falls back to the struct.

Ordering is field by field with nulls first, which gives a total,
engine-independent tie-break when ``order`` ends in unique columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .joinback import SMALL_ROWS, join_back

INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: A code has 20 bits, so that 64 bits of a leading integer fit a decimal too.
CODES = 1 << 20

def with_codes(
    df: DataFrame, columns: Sequence[str], name: str = "_code", max_rows: int = SMALL_ROWS, nulls_last: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame] | None:
    """``df`` with ``name``, the place of its ``columns`` among their sorted
    distinct combinations (nulls first, or last if named), and the dictionary of
    these; None if there are more than ``max_rows`` of them (at most ``CODES``)."""
    combos = materialize(df.select(*columns).distinct(), "combinations")
    if combos.count() > min(max_rows, CODES):
        return None
    order = [F.col(c).asc_nulls_last() if c in nulls_last else F.col(c).asc_nulls_first() for c in columns]
    numbered = combos.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    numbered = materialize(numbered, "dictionary")  # counted: few rows
    same = reduce(lambda a, b: a & b, [F.col(f"_d.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in columns])
    coded = df.alias("_r").join(F.broadcast(numbered.alias("_d")), same).select("_r.*", F.col(f"_d.{name}"))
    return coded, numbered


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], nulls_last: Sequence[str] = (), max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Keep one row per ``keys``: the smallest by ``order`` (ascending, nulls
    first unless named in ``nulls_last``), remaining columns as further
    tie-breaks. Null keys form their own group, as in ``DISTINCT ON``."""
    keys = list(keys)
    ordered = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    lead = ordered[0] if dict(df.dtypes)[ordered[0]] in INTEGERS else None
    rest = ordered[1:] if lead else ordered
    made = with_codes(df, rest, "_code", max_rows, nulls_last) if rest else (df.withColumn("_code", F.lit(0)), None)
    if made is None:
        return _first_by_struct(df, keys, ordered, nulls_last)
    coded, dictionary = made
    if lead is None:
        best = coded.groupBy(*keys).agg(F.min("_code").alias("_code"))
    else:
        offset, null = F.lit(str(2**63 + 1)).cast("decimal(20,0)"), 2**64 + 1 if lead in nulls_last else 0
        at = F.coalesce(F.col(lead).cast("decimal(20,0)") + offset, F.lit(str(null)).cast("decimal(20,0)")).cast("decimal(20,0)")
        packed = (at * F.lit(CODES).cast("decimal(8,0)") + F.col("_code")).cast("decimal(38,0)")
        code = F.col("_p") % F.lit(CODES).cast("decimal(8,0)")
        place = ((F.col("_p") - code) / F.lit(CODES).cast("decimal(8,0)")).cast("decimal(21,0)")
        best = coded.groupBy(*keys).agg(F.min(packed).alias("_p")).select(
            *keys, F.when(place != F.lit(str(null)).cast("decimal(20,0)"), (place - offset).cast(df.schema[lead].dataType)).alias(lead), code.cast("int").alias("_code")
        )
    if dictionary is not None:
        best = best.join(F.broadcast(dictionary), "_code")
    return best.select(*df.columns)


def _first_by_struct(df: DataFrame, keys: Sequence[str], ordered: Sequence[str], nulls_last: Sequence[str]) -> DataFrame:
    at = lambda c, i: ([F.col(c).isNull().alias(f"_n{i}")] if c in nulls_last else []) + [F.col(c).alias(f"_o{i}")]
    packed = F.struct(*[x for i, c in enumerate(ordered) for x in at(c, i)])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return best.select(*keys, *[F.col(f"_first._o{i}").alias(c) for i, c in enumerate(ordered)]).select(*df.columns)


def first_values(df: DataFrame, keys: Sequence[str], carried: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``keys`` and the ``carried`` columns of the first row by ``order`` (then by
    these columns). Mostly all rows of a key agree in them: the distinct
    combinations are taken by a hash aggregate, and only the rows of keys that
    have several are put in order."""
    keys, carried = list(keys), list(carried)
    combos = materialize(df.select(*keys, *carried).distinct(), "carried_values")
    several = materialize(combos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), "carried_several")
    if several.isEmpty():
        return combos
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)])
    unsure = join_back(df, several, keys, "left_semi", "carried_several").groupBy(*keys).agg(F.min(packed).alias("_first"))
    chosen = unsure.select(*keys, *[F.col(f"_first._c{i}").alias(c) for i, c in enumerate(carried)])
    return join_back(combos, several, keys, "left_anti", "carried_several").unionByName(chosen)
