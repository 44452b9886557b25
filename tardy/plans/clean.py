"""Cleaning stage: group filters on courses, assignments and students.

Each group filter of the study (a Python predicate per pandas group) is a
native aggregate, combined map-side, that is written and joined back
(``operators.joinback``): broadcast if counted small, else a join whose hot keys
adaptive execution can split. Order of the steps: course stats -> course filter
-> assignment filter -> student filter -> course invariants. Every comparison is
strict ``>``.

``clean`` and the audit decide on cells, the distinct (course, student,
assignment) triples with their row counts: all filters keep or drop whole cells.
The wide rows are read once to make the cells and once to be filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions.scalars import ethnicity_remap
from ..operators.joinback import NARROW_ROWS, join_back
from ..sources.tables import materialize

# Columns of the analysis extract, in file order of the submission table.
ANALYSIS_COLS = (
    "course_id", "course_name", "assignment_id", "due_date", "submitted_at", "user_id",
    "gender", "ethnicity", "is_a_urm", "first_gen_status", "final_score",
)


def analysis_frame(submissions: DataFrame) -> DataFrame:
    """The 11 analysis columns of the submission table, ethnicity relabelled."""
    return submissions.select(*ANALYSIS_COLS).withColumn("ethnicity", ethnicity_remap("ethnicity"))


def course_stats(df: DataFrame) -> DataFrame:
    """Per course: distinct students (before any filter) and the mean final
    score over submission rows (a row-weighted mean, nulls skipped)."""
    return (
        df.where(F.col("course_id").isNotNull())
        .groupBy("course_id")
        .agg(F.countDistinct("user_id").alias("course_size"), F.avg("final_score").alias("course_mean"))
    )


def with_course_stats(df: DataFrame) -> DataFrame:
    return join_back(df, course_stats(df), "course_id", "left", "course_stats")


def course_filter(df: DataFrame) -> DataFrame:
    """Keep courses whose mean final score is not 0. An all-null course has a
    null mean and is kept (NaN != 0 in the study); null course ids go."""
    m = F.col("course_mean")
    return df.where(F.col("course_id").isNotNull() & (m.isNull() | (m != 0)))


def assignment_ratios(df: DataFrame, students: Column | None = None) -> DataFrame:
    """``assignment_id``, ``_ratio``: its distinct students over the course's.
    An assignment that belongs to two courses fails the job: the study's ranks
    and filters know one course for each. Where an assignment of one course has a
    row a student, ``students`` may count rows instead."""
    students = F.countDistinct("user_id") if students is None else students
    one_course = F.min("course_id").eqNullSafe(F.max("course_id"))
    size = F.when(one_course, F.min("course_size")).otherwise(
        F.raise_error(F.lit("an assignment belongs to more than one course"))
    )
    return df.where(F.col("assignment_id").isNotNull()).groupBy("assignment_id").agg(
        (students / size).alias("_ratio")
    )


def assignment_filter(df: DataFrame, a_thres: float) -> DataFrame:
    """Keep assignments submitted by more than ``a_thres`` of the course's
    (unfiltered) students."""
    keep = assignment_ratios(df).where(F.col("_ratio") > F.lit(float(a_thres))).select("assignment_id")
    return join_back(df, keep, "assignment_id", "left_semi", "kept_assignments", NARROW_ROWS)


def assignment_counts(df: DataFrame, name: str = "n_assignments") -> DataFrame:
    return df.where(F.col("course_id").isNotNull()).groupBy("course_id").agg(
        F.countDistinct("assignment_id").alias(name)
    )


def student_filter(df: DataFrame, s_thres: float) -> DataFrame:
    """Attach the course's assignment count, then keep student-courses with
    more than floor(n_assignments * s_thres) distinct assignments."""
    df = join_back(df, assignment_counts(df), "course_id", "left", "assignment_counts")
    per = (
        df.where(F.col("user_id").isNotNull() & F.col("course_id").isNotNull())
        .groupBy("user_id", "course_id")
        .agg(F.countDistinct("assignment_id").alias("_na"), F.max("n_assignments").alias("_nc"))
    )
    keep = per.where(F.col("_na") > F.floor(F.col("_nc") * F.lit(float(s_thres)))).select("user_id", "course_id")
    return join_back(df, keep, ["user_id", "course_id"], "left_semi", "kept_students")


def course_invariants(df: DataFrame, a_n: int, s_n: int) -> DataFrame:
    """Recount students and assignments per course after the filters and keep
    courses with more than ``s_n`` students and more than ``a_n`` assignments.
    Both counts are taken before either test, so one predicate does both."""
    counts = course_invariant_counts(df, a_n, s_n).where("kept").drop("kept")
    return join_back(df, counts, "course_id", "inner", "course_invariants")


@dataclass(frozen=True)
class Decisions:
    """What the filters keep, as written tables."""

    #: course_id, user_id, assignment_id, n of the courses that pass the course
    #: filter, with course_size.
    cells: DataFrame
    #: assignment_id, _ratio of the same courses.
    ratios: DataFrame
    #: user_id, course_id that pass the student filter.
    students: DataFrame
    #: course_id, course_size, course_mean, n_assignments, n_students_updated,
    #: n_assignments_updated of the courses that pass all filters.
    courses: DataFrame


def cells_of(df: DataFrame) -> DataFrame:
    """Distinct (course, user, assignment) with ``n`` rows and the sum and count
    of their final scores, written."""
    return materialize(
        df.groupBy("course_id", "user_id", "assignment_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("final_score").alias("_s"), F.count("final_score").alias("_k")
        ),
        "clean_cells",
    )


def decide(cells: DataFrame, cfg: CleanConfig = CleanConfig()) -> Decisions:
    """All filters, on cells alone. A cell is one assignment of one student, so
    a count of cells is a count of distinct assignments or students."""
    course = cells.where(F.col("course_id").isNotNull()).groupBy("course_id").agg(
        F.countDistinct("user_id").alias("course_size"), F.expr("sum(_s) / nullif(sum(_k), 0)").alias("course_mean")
    )
    course = materialize(course_filter(course), "clean_courses")
    of_course = join_back(cells, course.drop("course_mean"), "course_id", "inner", "clean_course_sizes")
    s1 = materialize(of_course.select("course_id", "user_id", "assignment_id", "course_size", "n"), "clean_cells_1")
    ratios = materialize(assignment_ratios(s1, F.count("user_id")), "clean_ratios")
    enough = F.col("_ratio") > F.lit(float(cfg.a_thres))
    s2 = join_back(s1, ratios.where(enough).select("assignment_id"), "assignment_id", "left_semi", "clean_assignments", NARROW_ROWS)
    per = s2.where(F.col("user_id").isNotNull()).groupBy("user_id", "course_id").agg(F.count("assignment_id").alias("_na"))
    total = materialize(assignment_counts(s2), "clean_totals")
    many = F.col("_na") > F.floor(F.col("n_assignments") * F.lit(float(cfg.s_thres)))
    students = materialize(join_back(per, total, "course_id", "inner", "clean_totals").where(many).select("user_id", "course_id"), "clean_students")
    s3 = join_back(s2, students, ["user_id", "course_id"], "left_semi", "clean_students")
    kept = (
        course.join(total, "course_id")
        .join(students.groupBy("course_id").agg(F.count("user_id").alias("n_students_updated")), "course_id")
        .join(assignment_counts(s3, "n_assignments_updated"), "course_id")
        .where((F.col("n_students_updated") > cfg.s_n) & (F.col("n_assignments_updated") > cfg.a_n))
    )
    return Decisions(s1, ratios, students, materialize(kept, "clean_kept_courses"))


def clean(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Full cleaning of an analysis frame (already typed). An assignment of
    two courses fails the job."""
    d = decide(cells_of(df), cfg)
    passing = d.ratios.where(F.col("_ratio") > F.lit(float(cfg.a_thres))).select("assignment_id")
    out = join_back(df, passing, "assignment_id", "left_semi", "clean_assignments", NARROW_ROWS)
    out = join_back(out, d.students, ["user_id", "course_id"], "left_semi", "clean_students")
    return join_back(out, d.courses, "course_id", "inner", "clean_kept_courses")


STAGES = ("loaded", "course_filter", "assignment_filter", "student_filter", "invariants")


def stage_reached(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Distinct (course, user, assignment) with ``n`` rows and ``reached``: the
    number of filters passed in a row. Every filter keeps or drops all rows of
    such a triple, so the audit reads the submissions once."""
    cells = cells_of(df)
    d = decide(cells, cfg)
    students = d.students.withColumn("_p3", F.lit(1))
    courses = d.courses.select("course_id", F.lit(1).alias("_p4"))
    tagged = join_back(d.cells, d.ratios, "assignment_id", "left", "audit_ratios")
    tagged = join_back(tagged, students, ["user_id", "course_id"], "left", "audit_students")
    tagged = join_back(tagged, courses, "course_id", "left", "audit_courses")
    passed2 = F.coalesce(F.col("_ratio") > F.lit(float(cfg.a_thres)), F.lit(False))
    tagged = tagged.select(
        "course_id", "user_id", "n",
        F.when(~passed2, 1).when(F.col("_p3").isNull(), 2).when(F.col("_p4").isNull(), 3).otherwise(4).alias("reached"),
    )
    lost = join_back(cells, d.cells.select("course_id").distinct(), "course_id", "left_anti", "audit_kept")
    return tagged.unionByName(lost.select("course_id", "user_id", "n", F.lit(0).alias("reached")))


def filter_audit(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Rows, (course, user) pairs and courses after every stage, and how many
    pairs/courses each stage removed. Pair counts skip null keys."""
    stages = range(len(STAGES))
    at_least = [F.sum(F.when(F.col("reached") >= i, F.col("n"))).alias(f"_r{i}") for i in stages]
    pairs = stage_reached(df, cfg).groupBy("course_id", "user_id").agg(F.max("reached").alias("_m"), *at_least)
    known = F.col("course_id").isNotNull() & F.col("user_id").isNotNull()
    courses = pairs.groupBy("course_id").agg(
        F.max("_m").alias("_m"),
        *[F.sum(f"_r{i}").alias(f"_r{i}") for i in stages],
        *[F.count_if(known & (F.col("_m") >= i)).alias(f"_p{i}") for i in stages],
    )
    total = courses.agg(
        *[F.coalesce(F.sum(f"_r{i}"), F.lit(0)).alias(f"_r{i}") for i in stages],
        *[F.coalesce(F.sum(f"_p{i}"), F.lit(0)).alias(f"_p{i}") for i in stages],
        *[F.count_if(F.col("course_id").isNotNull() & (F.col("_m") >= i)).alias(f"_c{i}") for i in stages],
    )

    def line(i: int) -> F.Column:
        before = F.lit(None).cast("long")
        return F.struct(
            F.lit(i).alias("stage_no"), F.lit(STAGES[i]).alias("stage"), F.col(f"_r{i}").alias("rows"),
            F.col(f"_p{i}").alias("student_course_obs"), F.col(f"_c{i}").alias("course_obs"),
            (F.col(f"_p{i - 1}") - F.col(f"_p{i}") if i else before).alias("excluded_student_course"),
            (F.col(f"_c{i - 1}") - F.col(f"_c{i}") if i else before).alias("excluded_courses"),
        )

    return total.select(F.inline(F.array(*[line(i) for i in stages])))


def course_invariant_counts(df: DataFrame, a_n: int, s_n: int) -> DataFrame:
    """Per course after the student filter: the recounted students and
    assignments and whether the course passes both invariants."""
    counts = df.where(F.col("course_id").isNotNull()).groupBy("course_id").agg(
        F.countDistinct("assignment_id").alias("n_assignments_updated"),
        F.countDistinct("user_id").alias("n_students_updated"),
    )
    return counts.withColumn(
        "kept", (F.col("n_students_updated") > s_n) & (F.col("n_assignments_updated") > a_n)
    )
