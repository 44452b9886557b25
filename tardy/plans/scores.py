"""Submission ranks, procrastination scores and the student-course table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import first_values
from ..operators.joinback import join_back
from ..operators.ranking import average_rank

PCT = "assignment_percentile_ranks"
SCORE_COLS = (
    "mean_rank", "procrastination_mean_rank", "procrastination_median_rank",
    "procrastination_var_rank", "procrastination_std_rank",
)
# Per (user, course) the study keeps the first row; these columns are
# carried from it (the others are per-course values or dropped).
STUDENT_COURSE_COLS = (
    "course_id", "course_name", "user_id", "final_score", "ethnicity", "gender", "is_a_urm",
    "first_gen_status", "course_size", "course_mean", "n_assignments", "n_assignments_updated",
    "n_students_updated",
)


def add_assignment_ranks(df: DataFrame, extra_keys: Sequence[str] = (), strategy: str | None = None) -> DataFrame:
    """Average-tie rank of submitted_at within each assignment (later = higher)
    and its percentile form (rank / non-null submissions of the assignment)."""
    return average_rank(
        df, [*extra_keys, "assignment_id"], "submitted_at", "assignment_ranks", PCT, strategy=strategy
    )


def _score_aggs() -> list:
    # The native median counts a group's distinct values in one buffer: a
    # (user, course) has one value per assignment of the course at most.
    return [
        F.avg("assignment_ranks").alias("mean_rank"),
        F.avg(PCT).alias("procrastination_mean_rank"),
        F.median(PCT).alias("procrastination_median_rank"),
        F.var_samp(PCT).alias("procrastination_var_rank"),
        F.stddev_samp(PCT).alias("procrastination_std_rank"),
    ]


def procrastination_scores(ranked: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Per (user, course): mean raw rank and mean / median / variance / std of
    the percentile ranks (sample variance, null for a single value)."""
    keys = [*extra_keys, "user_id", "course_id"]
    rows = ranked.where(F.col("user_id").isNotNull() & F.col("course_id").isNotNull())
    return rows.groupBy(*keys).agg(*_score_aggs()).select(*keys, *SCORE_COLS)


def with_scores(ranked: DataFrame) -> DataFrame:
    """Submission-level rows with the five per-(user, course) scores joined back."""
    return join_back(ranked, procrastination_scores(ranked), ["user_id", "course_id"], "left", "scores")


def first_rows(ranked: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per (user, course): the earliest due date (nulls last), then
    earliest submission, then lowest assignment id; remaining columns break
    any further tie."""
    keys = [*extra_keys, "user_id", "course_id"]
    carried = [c for c in STUDENT_COURSE_COLS if c not in keys and c in ranked.columns]
    order = [F.col("due_date").isNull(), F.col("due_date"), F.col("submitted_at"), F.col("assignment_id")]
    return first_values(ranked, keys, carried, order)


def student_course_level(ranked: DataFrame, strategy: str | None = None) -> DataFrame:
    """The student-course table: first row per (user, course), the five scores,
    and the average / percentile rank of final_score within the course."""
    keys = ["user_id", "course_id"]
    rows = ranked.where(F.col("user_id").isNotNull() & F.col("course_id").isNotNull())
    first = first_rows(rows).join(procrastination_scores(rows), keys)
    return average_rank(
        first, ["course_id"], "final_score", "final_score_ranks", "final_score_percentile_ranks", strategy=strategy,
    )
