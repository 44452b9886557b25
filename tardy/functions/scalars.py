"""Column-level helpers. All are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ETHNICITY_REMAP

# ---- fixed values: texts pandas reads as missing by default ---------------
PANDAS_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ---------------------------------------------------------------------------


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(c: str | Column, n: int) -> Column:
    """Integer division of a non-negative integral column (SQL ``div``)."""
    c = col_of(c)
    return ((c - c % n) / n).cast("long")


def ethnicity_remap(c: str | Column = "ethnicity") -> Column:
    """Relabel the ethnicity codes (CASE chain: stays inside codegen)."""
    c = col_of(c)
    expr = None
    for src, dst in ETHNICITY_REMAP.items():
        expr = F.when(c == src, F.lit(dst)) if expr is None else expr.when(c == src, F.lit(dst))
    return expr.otherwise(c)


def null_tokens(c: str | Column, tokens: Iterable[str] = PANDAS_NULL_TOKENS) -> Column:
    """Turn the missing-value spellings pandas recognises into SQL NULL."""
    c = col_of(c)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def parse_timestamp(c: str | Column, lenient: bool = False) -> Column:
    """Text -> TIMESTAMP_NTZ. Strict mode fails on malformed text (ANSI),
    lenient mode returns NULL for it."""
    c = col_of(c)
    if lenient:
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return F.to_timestamp_ntz(c)
