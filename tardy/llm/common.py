"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, the only separator of words in every contract.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
#: Tables of at most so many small rows may be broadcast, after a count.
BROADCAST_ROWS = 200_000


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def each_text(column, rows: int = 64) -> Iterator:
    """The values of an Arrow column, turned into Python objects a few rows at
    a time, as a batch of long texts takes several times its size at once."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable, so that
    lambdas inside ``body`` read it and don't compute it again per element)."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def small_side(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written ``table`` marked for broadcast if a count shows at most
    ``max_rows`` rows of it; else as it is, and the join shuffles both sides
    (adaptive execution splits its skewed partitions)."""
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def prefix_sums(lengths: Column, block: int = 128) -> Column:
    """Running sums before each element of a ``array<bigint>``, in two levels:
    sums inside blocks of ``block`` elements and the offsets of the blocks, so
    that long arrays don't cost the square of their length. ``lengths`` should
    be a column or a bound variable, as it is read for each block."""

    def running(values: Column, start: Column) -> Column:
        first = F.array(start.cast("bigint"))
        sums = F.aggregate(values, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 1, F.size(values))

    starts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(block))
    totals = F.transform(
        starts, lambda s: F.aggregate(F.slice(lengths, s + 1, block), F.lit(0).cast("bigint"), lambda a, x: a + x)
    )
    return bind(
        bind(totals, lambda t: running(t, F.lit(0))),
        lambda offsets: F.flatten(F.transform(starts, lambda s, k: running(F.slice(lengths, s + 1, block), offsets[k]))),
    )


#: Characters of a block that ``cut_text`` looks into.
TEXT_BLOCK = 8192


def text_blocks(text: Column) -> Column:
    """The text as consecutive blocks of ``TEXT_BLOCK`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut_text(blocks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text given as its blocks: reads only the
    blocks concerned, where ``substring`` would walk the text from its start."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    last = F.floor(F.greatest(end - 1, start) / TEXT_BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, (start - first * TEXT_BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")
