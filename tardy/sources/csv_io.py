"""CSV hand-over files: the analysis extract and query exports.

The export follows PostgreSQL's ``COPY ... WITH CSV HEADER``: fields quoted
with ``"`` when needed, quotes doubled, NULL as an empty unquoted field and
timestamps with microseconds. The reader takes every column as text
(no schema inference), turns the missing-value spellings pandas knows into
NULL and casts to the declared types, so a malformed timestamp fails the
job unless ``lenient`` is set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import null_tokens, parse_timestamp
from .csv_split import read_split_csv

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Declared types of the analysis extract.
ANALYSIS_TYPES = {
    "submitted_at": "timestamp_ntz",
    "due_date": "timestamp_ntz",
    "course_id": "long",
    "course_name": "string",
    "user_id": "long",
    "assignment_id": "long",
    "final_score": "double",
    "ethnicity": "string",
    "gender": "string",
    "is_a_urm": "string",
    "first_gen_status": "string",
}


def query_to_csv(spark: SparkSession, sql: str, path: str) -> None:
    """The rows of a caller's SQL text, over registered views, as CSV."""
    export_csv(spark.sql(sql), path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Write ``df`` as headed CSV parts into the folder ``path``. Compressed parts
    (``gzip``) are read whole by one task each: for tables written in bounded files."""
    (
        df.write.mode(mode)
        .option("compression", compression)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", TS_FORMAT)
        .option("timestampFormat", TS_FORMAT)
        .csv(path)
    )


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    types: dict[str, str] | None = None,
    lenient: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Read headed CSV, keep ``columns`` (in the file's order) and cast them.
    Files are read in splits also where fields hold line breaks
    (``csv_split``); ``multi_line=False`` saves its passes over the quotes for
    files that are known to hold none."""
    if multi_line:
        raw = read_split_csv(spark, path)
    else:
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    types = types or {}
    wanted = [c for c in raw.columns if columns is None or c in columns]
    missing = [c for c in (columns or []) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns not in file: {missing}")
    out = []
    for c in wanted:
        v = null_tokens(F.col(f"`{c}`"))
        t = types.get(c, "string")
        if t in ("timestamp_ntz", "timestamp"):
            v = parse_timestamp(v, lenient=lenient)
        elif t != "string":
            v = v.try_cast(t) if lenient else v.cast(t)
        out.append(v.alias(c))
    return raw.select(*out)


def read_analysis_csv(spark: SparkSession, path: str, lenient: bool = False, multi_line: bool = True) -> DataFrame:
    """The analysis extract: the 11 columns of the submission table."""
    return read_csv(spark, path, list(ANALYSIS_TYPES), ANALYSIS_TYPES, lenient=lenient, multi_line=multi_line)
