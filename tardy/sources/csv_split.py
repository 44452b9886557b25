"""CSV files with line breaks inside fields, read in splits.

A reader that starts in the middle of such a file can't tell whether it is inside
a quoted field. The number of quotes before it tells: a field is open where it is
odd (a quote inside a field is doubled and counts twice). So the files are read as
plain lines, which Spark splits anywhere, and

1. a first pass notes per split the parity of its quotes and whether a record can
   start in it if a field is open at its start: one row a split;
2. the parities are summed up along each file (over those rows alone), which gives
   every split its state at the start, and the split that owns its first lines:
   the nearest one before it in which a record starts;
3. a second pass cuts each split into records. What hangs over its ends (at most a
   head and a tail a split) is put together at the owner;
4. Spark's own CSV parser reads the records, each whole.

Both passes keep no more than the record at hand. Files are expected to quote like
PostgreSQL and ``export_csv``: a field holding a quote is quoted.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import materialize

RECORD, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and the split it is in: ``_split``, ``_file``, ``_start``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return lines.select("value", F.xxhash64(file, start).alias("_split"), file.alias("_file"), start.alias("_start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """(split, first row, row after the last) of each run of rows of one split."""
    split = batch.column("_split").to_numpy()
    edges = np.flatnonzero(np.diff(split)) + 1
    for first, end in zip([0, *edges], [*edges, len(split)], strict=True):
        yield int(split[first]), int(first), int(end)


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False)


def _note_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split (in pieces): quotes, and whether a line has an odd number of
    quotes before it, counted from the piece's start, or an even one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        quotes = _quotes(batch.column("value"))
        for split, first, end in _runs(batch):
            before = np.cumsum(quotes[first:end]) - quotes[first:end]
            odd = before % 2 == 1
            columns = [[split], [int(quotes[first:end].sum() % 2)], [bool(odd.any())], [bool((~odd).any())]]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_split", "odd", "any_odd", "any_even"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each split in order, as one row: its parity, and whether a
    record starts in it if a field is open at its start."""
    now: list | None = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.bool_())], names=["_split", "odd", "opens"])

    for batch in _note_parity(batches):
        split, odd, any_odd, any_even = (batch.column(i)[0].as_py() for i in range(4))
        if now is not None and now[0] != split:
            yield row()
            now = None
        if now is None:
            now = [split, 0, False]
        now[2] = now[2] or (any_odd if now[1] == 0 else any_even)
        now[1] ^= odd
    if now is not None:
        yield row()


def split_states(lines: DataFrame) -> DataFrame:
    """Written, a row a split: ``_split``, ``_file``, ``_start``, ``_open`` (a field is open
    at its start) and ``_owner``, the start of the split that owns its first lines."""
    noted = lines.select("value", "_split").mapInArrow(_fold, "_split bigint, odd int, opens boolean")
    places = lines.select("_split", "_file", "_start").distinct()
    order = Window.partitionBy("_file").orderBy("_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = noted.join(places, "_split").withColumn("_open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    starts = F.when(~F.col("_open") | F.col("opens"), F.col("_start"))
    states = states.withColumn("_owner", F.when(F.col("_open"), F.last(starts, ignorenulls=True).over(before)).otherwise(F.col("_start")))
    return materialize(states.select("_split", "_file", "_start", "_open", "_owner"), "csv_splits")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (``value``, ``_split``, ``_open``, ``_first``: the split begins the
    file) to whole records, and the head and tail that a split has."""
    names = ["_split", "kind", "header", "value"]
    split, held, kind, header, odd = None, [], RECORD, False, False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        quotes, values = _quotes(batch.column("value")), batch.column("value")
        for now, first, end in _runs(batch):
            if now != split:
                if held:
                    yield out([(split, TAIL if kind == RECORD else kind, header, "\n".join(held))])
                split, held = now, []
                odd = bool(batch.column("_open")[first].as_py())
                kind, header = (HEAD, False) if odd else (RECORD, bool(batch.column("_first")[first].as_py()))
            after = (np.cumsum(quotes[first:end]) + odd) % 2 == 1
            before = np.concatenate([[odd], after[:-1]])
            odd = bool(after[-1])
            alone = ~before & ~after
            if header or held or kind == HEAD:
                alone[0] = False
            rows = []
            for i in np.flatnonzero(~alone):
                held.append(values[first + int(i)].as_py())
                if not after[i]:
                    rows.append((split, kind, header, "\n".join(held)))
                    held, kind, header = [], RECORD, False
            whole = np.flatnonzero(alone) + first
            if rows:
                yield out(rows)
            if len(whole):
                n = len(whole)
                columns = [pa.array(np.full(n, split)), pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool)), values.take(pa.array(whole))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    if held:
        yield out([(split, TAIL if kind == RECORD else kind, header, "\n".join(held))])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``header`` (the first record of its file) and ``value`` of every record."""
    lines = _lines(spark, path)
    states = split_states(lines)
    # A broadcast keeps the lines in order. It holds ten bytes a split, a ten
    # millionth of the files, for which the driver holds a task each anyway.
    state = F.broadcast(states.select("_split", "_open", (F.col("_start") == 0).alias("_first")))
    known = lines.select("value", "_split").join(state, "_split")
    cut = known.mapInArrow(_cut, "_split bigint, kind int, header boolean, value string")
    parts = materialize(cut.where(F.col("kind") != RECORD).join(states.select("_split", "_file", "_start", "_owner"), "_split"), "csv_parts")
    # A split's head belongs to its owner; its tail starts a record of its own.
    owner = F.when(F.col("kind") == TAIL, F.col("_start")).otherwise(F.col("_owner")).alias("_owner")
    merged = parts.groupBy("_file", owner).agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("_start", "kind", "value"))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda x: x["value"]), "\n")
    return cut.where(F.col("kind") == RECORD).select("header", "value").unionByName(merged.select("header", text.alias("value")))


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """The headed CSV files of ``path`` with all columns as text. Files whose
    header differs from the first one's fail the job."""
    found = records(spark, path)
    lead = materialize(found.where("header").select("value").distinct(), "csv_header").limit(2).collect()
    if not lead:
        raise ValueError(f"no header in {path}")
    heads = [next(csv.reader([r["value"].rstrip("\r")])) for r in lead]
    if len(heads) > 1:
        raise ValueError(f"files of {path} have different headers: {heads[0]}, {heads[1]}")
    names = heads[0]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    rows = found.where(~F.col("header") & F.col("value").rlike(r"[^\x00-\x20]"))
    return rows.select(F.from_csv(F.regexp_replace("value", r"\r$", ""), schema, options).alias("r")).select("r.*")
