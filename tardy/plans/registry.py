"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query starts from the driver tables in ``sf_dir`` (through the fixture
warehouse) so its work grows with them. Double columns are rounded to
``DIGITS`` places so results compare exactly with the DuckDB twins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleanConfig
from ..sources import store
from ..sources.fixtures import forget_warehouse, source_version, warehouse_tables
from ..sources.tables import remove_all_scratch, scratch_path, write_scratch
from . import clean as C
from . import scores as S
from . import study
from . import warehouse as W

DIGITS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = [
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn

    return deco


# ---- shared lazy inputs -----------------------------------------------------
def wh(spark, sf):
    return warehouse_tables(spark, sf)


_STAGES: dict[tuple, str] = {}


def stage(spark, sf, name, build, *config):
    """Table ``name``, written once per source version and configuration in a
    session and read by every later query. ``forget_stages`` drops them."""
    key = (spark.sparkContext.applicationId, source_version(spark, sf), name, *config)
    if key not in _STAGES:
        _STAGES[key] = write_scratch(build(), name)
    return spark.read.parquet(_STAGES[key])


def forget_stages(spark: SparkSession) -> None:
    """Delete every table this session has written: stages, exports and the
    scratch tables of operators. DataFrames made before can't be read any more."""
    app = spark.sparkContext.applicationId
    for known in (_STAGES, _EXPORTS, _FRAMES):
        for key in [k for k in known if k[0] == app]:
            del known[key]
    for key in [k for k in _TABLES if k[0] == app]:
        store.drop_table(spark, _TABLES.pop(key))
    forget_warehouse(spark)
    remove_all_scratch(spark)


_TABLES: dict[tuple, str] = {}


def submission_table(spark, sf) -> str:
    """The name of the stored submission table of a data folder, replaced once per
    source version in a session; stored by due date, as the study stores it."""
    key = (spark.sparkContext.applicationId, source_version(spark, sf))
    if key not in _TABLES:
        name = f"submissions_{hashlib.sha256(key[1][0].encode()).hexdigest()[:12]}"
        store.replace_table(W.submissions(wh(spark, sf)), name, ("due_date", "submission_id"))
        _TABLES[key] = name
    return _TABLES[key]


def subs(spark, sf):
    """The submission table, written once (the study's CREATE TABLE AS)."""
    return store.read_table(spark, submission_table(spark, sf))


def analysis(spark, sf):
    return C.analysis_frame(subs(spark, sf))


def cleaned(spark, sf, cfg: CleanConfig = CleanConfig()):
    return stage(spark, sf, "clean_submissions", lambda: C.clean(analysis(spark, sf), cfg), cfg)


def ranked(spark, sf):
    return stage(spark, sf, "ranked", lambda: S.add_assignment_ranks(cleaned(spark, sf)))


def student(spark, sf):
    return stage(spark, sf, "student_course", lambda: S.student_course_level(ranked(spark, sf)))


# ---- warehouse ---------------------------------------------------------------
@query("valid_enrollment")
def q_valid_enrollment(spark, sf):
    return W.valid_enrollment(wh(spark, sf))


@query("stu_demographics")
def q_stu_demographics(spark, sf):
    return W.stu_demographics(wh(spark, sf))


@query("course_enrollments")
def q_course_enrollments(spark, sf):
    return W.course_enrollments(wh(spark, sf))


@query("course_assignments")
def q_course_assignments(spark, sf):
    return W.course_assignments(wh(spark, sf))


@query("course_submissions")
def q_course_submissions(spark, sf):
    return W.course_submissions(wh(spark, sf))


@query("course_meta")
def q_course_meta(spark, sf):
    return W.course_meta(wh(spark, sf))


@query("eligible_courses")
def q_eligible_courses(spark, sf):
    return W.eligible_courses(wh(spark, sf))


@query("top_courses")
def q_top_courses(spark, sf):
    return W.ordered_by_count(W.course_enrollments(wh(spark, sf)), "enrollments")


@query("submissions")
def q_submissions(spark, sf):
    return subs(spark, sf)


@query("submissions_due_range")
def q_submissions_due_range(spark, sf):
    """Half a year of due dates: only the files of the stored table that hold it."""
    first, last = datetime(1996, 1, 1), datetime(1996, 6, 30, 23, 59, 59)
    return store.read_range(spark, submission_table(spark, sf), "due_date", first, last)


@query("submissions_sis_only")
def q_submissions_sis_only(spark, sf):
    return W.submissions(wh(spark, sf), sis_only=True)


@query("submissions_quiz_only")
def q_submissions_quiz_only(spark, sf):
    return W.submissions(wh(spark, sf), quiz_only=True)


@query("sql_query")
def q_sql_query(spark, sf):
    """A SQL text run by Spark SQL over the warehouse registered as views."""
    return W.query(wh(spark, sf), "SELECT course_canvas_id, assignments FROM course_assignments")


@query("submissions_by_due_date")
def q_submissions_by_due_date(spark, sf):
    return W.ordered_by_due_date(subs(spark, sf))


# ---- cleaning ------------------------------------------------------------------
@query("ethnicity_remap")
def q_ethnicity_remap(spark, sf):
    return analysis(spark, sf)


@query("course_stats")
def q_course_stats(spark, sf):
    return C.course_stats(analysis(spark, sf))


@query("course_filter")
def q_course_filter(spark, sf):
    return C.course_filter(C.with_course_stats(analysis(spark, sf)))


@query("assignment_filter")
def q_assignment_filter(spark, sf):
    cfg = CleanConfig()
    return C.assignment_filter(C.course_filter(C.with_course_stats(analysis(spark, sf))), cfg.a_thres)


@query("course_assignment_counts")
def q_course_assignment_counts(spark, sf):
    cfg = CleanConfig()
    s2 = C.assignment_filter(C.course_filter(C.with_course_stats(analysis(spark, sf))), cfg.a_thres)
    return C.assignment_counts(s2)


@query("student_filter")
def q_student_filter(spark, sf):
    cfg = CleanConfig()
    s2 = C.assignment_filter(C.course_filter(C.with_course_stats(analysis(spark, sf))), cfg.a_thres)
    return C.student_filter(s2, cfg.s_thres)


@query("course_student_counts")
def q_course_student_counts(spark, sf):
    cfg = CleanConfig()
    s2 = C.assignment_filter(C.course_filter(C.with_course_stats(analysis(spark, sf))), cfg.a_thres)
    s3 = C.student_filter(s2, cfg.s_thres)
    return s3.groupBy("course_id").agg(F.countDistinct("user_id").alias("n_students"))


@query("clean_submissions")
def q_clean_submissions(spark, sf):
    return cleaned(spark, sf)


@query("filter_audit")
def q_filter_audit(spark, sf):
    return C.filter_audit(analysis(spark, sf))


# ---- ranks and scores ------------------------------------------------------------
@query("assignment_ranks")
def q_assignment_ranks(spark, sf):
    return ranked(spark, sf)


@query("procrastination_scores")
def q_procrastination_scores(spark, sf):
    return S.procrastination_scores(ranked(spark, sf))


@query("ranks_submission_level")
def q_ranks_submission_level(spark, sf):
    return S.with_scores(ranked(spark, sf))


@query("student_course_lvl")
def q_student_course_lvl(spark, sf):
    return student(spark, sf)


@query("final_score_ranks")
def q_final_score_ranks(spark, sf):
    return student(spark, sf).select(
        "user_id", "course_id", "final_score", "final_score_ranks", "final_score_percentile_ranks"
    )


@query("student_course_dropna")
def q_student_course_dropna(spark, sf):
    """The student table with rows holding any null removed (opt-in)."""
    return student(spark, sf).dropna()


# ---- exploratory statistics -----------------------------------------------------
from . import explore as X  # noqa: E402


def scored(spark, sf):
    """Submission-level rows with the per-student scores joined back."""
    return S.with_scores(ranked(spark, sf))


@query("course_grade_stats")
def q_course_grade_stats(spark, sf):
    return X.course_grade_stats(student(spark, sf))


@query("group_se_gender")
def q_group_se_gender(spark, sf):
    return X.group_stats(student(spark, sf), dims=("gender",))


@query("group_se_first_gen")
def q_group_se_first_gen(spark, sf):
    return X.group_stats(student(spark, sf), dims=("first_gen_status",))


@query("group_se_ethnicity")
def q_group_se_ethnicity(spark, sf):
    return X.group_stats(student(spark, sf), dims=("ethnicity",))


@query("se_plot_data")
def q_se_plot_data(spark, sf):
    return X.group_stats(student(spark, sf), main_ethnicity_only=True)


@query("main_ethnicity_filter")
def q_main_ethnicity_filter(spark, sf):
    return X.main_ethnicity_filter(student(spark, sf))


@query("user_mean_rank")
def q_user_mean_rank(spark, sf):
    return X.user_mean_rank(ranked(spark, sf))


@query("student_bands")
def q_student_bands(spark, sf):
    return X.student_bands(ranked(spark, sf))


@query("student_time_series")
def q_student_time_series(spark, sf):
    return X.student_time_series(ranked(spark, sf))


@query("course_counts_check")
def q_course_counts_check(spark, sf):
    return X.course_counts_check(cleaned(spark, sf))


@query("course_sizes")
def q_course_sizes(spark, sf):
    return X.course_sizes(cleaned(spark, sf))


@query("kde_by_gender")
def q_kde_by_gender(spark, sf):
    return X.kde_by(scored(spark, sf), "gender")


@query("kde_by_first_gen")
def q_kde_by_first_gen(spark, sf):
    return X.kde_by(scored(spark, sf), "first_gen_status")


@query("kde_by_ethnicity")
def q_kde_by_ethnicity(spark, sf):
    return X.kde_by(scored(spark, sf), "ethnicity")


@query("course_density_matrix")
def q_course_density_matrix(spark, sf):
    return X.course_density_matrix(scored(spark, sf))


@query("course_grade_box")
def q_course_grade_box(spark, sf):
    return X.course_grade_box(student(spark, sf))


@query("course_grade_box_outliers")
def q_course_grade_box_outliers(spark, sf):
    return X.course_grade_box_outliers(student(spark, sf))


@query("course_grade_hist")
def q_course_grade_hist(spark, sf):
    return X.course_grade_hist(student(spark, sf))


# ---- regression --------------------------------------------------------------------
from ..operators import ols as O  # noqa: E402
from . import grid as G  # noqa: E402


def fitted(spark, sf, name, build, tables=("terms", "cov", "fit_stats", "levels")):
    """The ``tables`` of a fit, each written once; ``build`` runs if one is missing."""
    made: dict = {}

    def part(table):
        made.update({} if made else build())
        return made[table]

    return {t: stage(spark, sf, f"{name}_{t}", lambda t=t: part(t)) for t in tables}


def default_fit(spark, sf):
    return fitted(spark, sf, "ols", lambda: O.fit(student(spark, sf)))


_FRAMES: dict[tuple, tuple] = {}


def grid_fit(spark, sf):
    """The rows after the course filter and the grid's frames, written once."""
    key = (spark.sparkContext.applicationId, source_version(spark, sf))
    if key not in _FRAMES:
        needed = [*G.NEEDED, "course_size"]
        build = lambda: C.course_filter(C.with_course_stats(analysis(spark, sf))).select(*needed)
        s1 = stage(spark, sf, "course_filtered", build)
        _FRAMES[key] = (s1, G.grid_frames(s1))
    return _FRAMES[key]


def grid_sums(spark, sf):
    return stage(spark, sf, "grid_suffstats", lambda: G.grid_suffstats(grid_fit(spark, sf)[1]))


def grid_fitted(spark, sf):
    build = lambda: O.fit(None, keys=G.CFG, sfs=grid_sums(spark, sf))
    return fitted(spark, sf, "grid", build, ("terms", "levels"))


@query("ols_suffstats")
def q_ols_suffstats(spark, sf):
    return O.suffstats(student(spark, sf))


@query("design_levels")
def q_design_levels(spark, sf):
    return O.design_levels(O.suffstats(student(spark, sf))).drop("factor_pos")


@query("ols_coeffs")
def q_ols_coeffs(spark, sf):
    return default_fit(spark, sf)["terms"]


@query("ols_cluster_cov")
def q_ols_cluster_cov(spark, sf):
    return default_fit(spark, sf)["cov"]


@query("ols_pvalues")
def q_ols_pvalues(spark, sf):
    return default_fit(spark, sf)["terms"].select("term", F.round("p", 4).alias("p"))


@query("ols_confint")
def q_ols_confint(spark, sf):
    return default_fit(spark, sf)["terms"].select("term", "ci_low", "ci_high")


@query("ols_fit_stats")
def q_ols_fit_stats(spark, sf):
    return default_fit(spark, sf)["fit_stats"]


@query("grid_survivors")
def q_grid_survivors(spark, sf):
    s1, frames = grid_fit(spark, sf)
    return G.grid_survivors(s1, frames)


@query("grid_suffstats")
def q_grid_suffstats(spark, sf):
    return grid_sums(spark, sf)


@query("grid_coeffs")
def q_grid_coeffs(spark, sf):
    return grid_fitted(spark, sf)["terms"]


@query("grid_coeffs_wide")
def q_grid_coeffs_wide(spark, sf):
    """Wide table: one row per configuration, coefficients per term."""
    return G.wide(grid_fitted(spark, sf), "coef")


@query("grid_pvalues")
def q_grid_pvalues(spark, sf):
    """Wide table: one row per configuration, p-values (4 places) per term."""
    f = grid_fitted(spark, sf)
    return G.wide({**f, "terms": f["terms"].withColumn("p", F.round("p", 4))}, "p")


@query("grid_confint")
def q_grid_confint(spark, sf):
    """Wide table of the lower 95 % bounds (the study's stored interval)."""
    return G.wide(grid_fitted(spark, sf), "ci_low")


# ---- sources and sinks ---------------------------------------------------------------
from ..sources import csv_io  # noqa: E402


_EXPORTS: dict[tuple, str] = {}


def exported(spark, sf):
    """The submission table as CSV, written once."""
    key = (spark.sparkContext.applicationId, source_version(spark, sf))
    if key not in _EXPORTS:
        s = subs(spark, sf)
        path = scratch_path(s, "submissions_csv")
        # a part a stored file, whose rows are bounded
        csv_io.export_csv(s, path, compression="gzip")
        _EXPORTS[key] = path
    return _EXPORTS[key]


@query("csv_scan")
def q_csv_scan(spark, sf):
    """Round trip: the submission table exported as CSV, read back as the
    11-column analysis extract (text -> typed, null tokens)."""
    return csv_io.read_analysis_csv(spark, exported(spark, sf), multi_line=False)


@query("export_csv")
def q_export_csv(spark, sf):
    """Round trip of timestamps with microseconds through a CSV export."""
    W.query(wh(spark, sf), "SELECT 1")  # registers the views
    path = scratch_path(wh(spark, sf).course_dim, "query_csv")
    csv_io.query_to_csv(
        spark, "SELECT id, timestampadd(MICROSECOND, cast(id % 1000000 AS int), submitted_at) AS submitted_at FROM submission_dim", path
    )
    return csv_io.read_csv(spark, path, types={"id": "long", "submitted_at": "timestamp_ntz"})


@query("clean_from_csv")
def q_clean_from_csv(spark, sf):
    """The cleaned, ranked and scored rows of a run that starts from a CSV file."""
    return study.from_csv(spark, exported(spark, sf)).submissions


@query("students_from_csv")
def q_students_from_csv(spark, sf):
    return study.from_csv(spark, exported(spark, sf)).students


# ---- further cleaning views -----------------------------------------------------------
from ..functions.scalars import parse_timestamp  # noqa: E402


@query("course_stats_join")
def q_course_stats_join(spark, sf):
    """Submission rows with their course size and mean joined back."""
    return C.with_course_stats(analysis(spark, sf))


@query("course_invariants")
def q_course_invariants(spark, sf):
    cfg = CleanConfig()
    s2 = C.assignment_filter(C.course_filter(C.with_course_stats(analysis(spark, sf))), cfg.a_thres)
    return C.course_invariant_counts(C.student_filter(s2, cfg.s_thres), cfg.a_n, cfg.s_n)


@query("datetime_parse")
def q_datetime_parse(spark, sf):
    """Timestamps rendered as text (as in the CSV extract) and parsed back."""
    s = subs(spark, sf)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return s.select(
        "submission_id",
        parse_timestamp(F.date_format("submitted_at", fmt)).alias("submitted_at"),
        parse_timestamp(F.date_format("due_date", fmt)).alias("due_date"),
    )
