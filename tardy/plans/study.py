"""The study from a CSV extract to its two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import CleanConfig
from ..sources.csv_io import read_analysis_csv
from . import clean as C
from . import scores as S


@dataclass(frozen=True)
class Study:
    submissions: DataFrame
    #: None unless fully cleaned.
    students: DataFrame | None


def from_csv(
    spark: SparkSession,
    path: str,
    cfg: CleanConfig = CleanConfig(),
    full_clean: bool = True,
    lenient: bool = False,
    multi_line: bool = False,
) -> Study:
    """Read the analysis extract and relabel ethnicities; with ``full_clean``
    also filter, rank and score. Without it the rows are only loaded. The file
    is read in splits; ``multi_line`` is for files with line breaks in fields."""
    loaded = C.analysis_frame(read_analysis_csv(spark, path, lenient, multi_line))
    if not full_clean:
        return Study(loaded, None)
    ranked = S.add_assignment_ranks(C.clean(loaded, cfg))
    return Study(S.with_scores(ranked), S.student_course_level(ranked))
