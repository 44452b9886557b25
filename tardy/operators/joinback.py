"""Rows joined to a table that was aggregated from them.

Written as one plan, ``rows.join(rows.groupBy(k).agg(...), k)`` cannot be split:
the aggregate already has its rows by the join's key, so that the join reuses
that partitioning and one task gets all rows of a hot key. ``join_back`` writes the
aggregate first. Then

* a table of few rows (counted, ``SMALL_ROWS``) is broadcast, and the rows are not
  shuffled at all;
* a larger one is shuffled like the rows, and adaptive execution splits the hot
  partitions of the rows, as neither side is tied to an aggregate any more. That
  needs an exchange under both sides: rows that come from a join or an aggregate
  on the same keys should be joined to one table holding all columns instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Aggregates of at most so many rows (a few numbers each) are broadcast.
SMALL_ROWS = 200_000
#: The same for tables of one integer key and a code at most: some 50 bytes a row.
NARROW_ROWS = 3_000_000


def small_or_shuffled(written: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``max_rows`` rows."""
    return F.broadcast(written) if written.count() <= max_rows else written


def join_back(
    rows: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "left", name: str = "join_back", max_rows: int = SMALL_ROWS
) -> DataFrame:
    """``rows`` joined (left, inner, left_semi or left_anti) to ``table``, an
    aggregate with one row per ``keys``, which is written under ``name`` first."""
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"the rows' side must be kept whole to be split: {how}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    return rows.join(small_or_shuffled(materialize(table, name), max_rows), keys, how)
