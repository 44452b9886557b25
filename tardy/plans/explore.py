"""Statistics behind the exploratory figures (the data of each plot, not the
drawing): group error bars, densities, boxes, histograms, student bands,
time series and course size checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BAND_HIGH, BAND_LOW, BAND_MID, KDE_LEVELS, MAIN_ETHNICITIES, RESPONSE, SAMPLE_SEED
from ..operators.density import auto_histogram, box_outliers, box_stats, kde_grid
from ..operators.ranking import group_quantiles, micros, value_positions
from ..sources.tables import materialize

FS_PCT = "final_score_percentile_ranks"
DIMENSIONS = ("gender", "first_gen_status", "ethnicity")


def course_grade_stats(student: DataFrame) -> DataFrame:
    """Per course: mean, median and std of the final-score percentile rank."""
    agg = student.groupBy("course_id").agg(
        F.avg(FS_PCT).alias("fs_pct_mean"), F.stddev_samp(FS_PCT).alias("fs_pct_std")
    )
    med = group_quantiles(student, ["course_id"], FS_PCT, {"fs_pct_median": 0.5})
    return agg.join(med, "course_id", "left").select("course_id", "fs_pct_mean", "fs_pct_median", "fs_pct_std")


def _stacked(df: DataFrame, value: str, dims=DIMENSIONS, extra=()) -> DataFrame:
    """(extra..., dimension, level, value) with one row per input row and dimension."""
    pairs = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in dims)
    return df.select(
        *extra, F.col(value).alias("_v"), F.expr(f"stack({len(dims)}, {pairs}) AS (dimension, level)")
    ).select(*extra, "dimension", "level", F.col("_v").alias(value))


def group_stats(df: DataFrame, value: str = RESPONSE, dims=DIMENSIONS, main_ethnicity_only: bool = False) -> DataFrame:
    """Error-bar data per (dimension, level): n (rows, nulls included),
    center (the median, shown by the study as its mean), mean, std and
    se = std / sqrt(n). Null levels are dropped. With ``main_ethnicity_only``
    the ethnicity arm keeps the four main groups only."""
    s = _stacked(df, value, dims).where(F.col("level").isNotNull())
    if main_ethnicity_only:
        s = s.where((F.col("dimension") != "ethnicity") | F.col("level").isin(*MAIN_ETHNICITIES))
    agg = s.groupBy("dimension", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    med = group_quantiles(s, ["dimension", "level"], value, {"center": 0.5})
    return agg.join(med, ["dimension", "level"], "left").select(
        "dimension", "level", "n", "center", "mean", "std", (F.col("std") / F.sqrt("n")).alias("se")
    )


def main_ethnicity_filter(df: DataFrame) -> DataFrame:
    """Rows kept by the four-group ethnicity filter and rows removed (one pass)."""
    keep = F.col("ethnicity").isin(*MAIN_ETHNICITIES)
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count(F.when(keep, 1)).alias("rows_kept"),
        F.count(F.when(~keep | F.col("ethnicity").isNull(), 1)).alias("rows_removed"),
    )


def user_mean_rank(ranked: DataFrame) -> DataFrame:
    """Mean submission percentile rank per user over all courses."""
    return ranked.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.avg("assignment_percentile_ranks").alias("mean_pct_rank")
    )


def _band(m) -> F.Column:
    return (
        F.when(m < BAND_LOW, "low")
        .when((m > BAND_MID[0]) & (m < BAND_MID[1]), "mid")
        .when(m > BAND_HIGH, "high")
    )


def seeded_place(n: int, seed: int = SAMPLE_SEED) -> int:
    """The place that numpy's seeded generator draws out of ``n`` without
    replacement, as pandas' ``sample(n=1, random_state=seed)`` does: the first of a
    permutation of 0..n-1 (eight bytes a user of a band, for a moment)."""
    return int(np.random.RandomState(seed).permutation(n)[0])


def student_bands(ranked: DataFrame, seed: int = SAMPLE_SEED) -> DataFrame:
    """Per band (low < .25, .4 < mid < .6, high > .75 of the user's mean rank):
    number of users and the user whom the study's seeded sample draws: the one
    at the drawn place in the order of user ids, found by range positions."""
    u = user_mean_rank(ranked).withColumn("band", _band(F.col("mean_pct_rank"))).where(F.col("band").isNotNull())
    users = materialize(u, "band_users")
    sizes = users.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()  # three bands
    place = F.lit(None).cast("long")
    for r in sizes:
        place = F.when(F.col("band") == r["band"], seeded_place(r["n"], seed)).otherwise(place)
    drawn = value_positions(users, ["band"], "user_id").where(F.col("_below") == place)
    return users.join(F.broadcast(drawn.select("band", "user_id", F.col("_total").alias("n_users"))), ["band", "user_id"]).select(
        "band", "n_users", "user_id", "mean_pct_rank"
    )


def student_time_series(ranked: DataFrame, seed: int = SAMPLE_SEED) -> DataFrame:
    """Submissions of the three picked students: one per due date (earliest
    submission, then lowest assignment id), ordered by due date (nulls last)
    and labelled A0, A1, ..."""
    picked = student_bands(ranked, seed).select("band", "user_id")
    rows = ranked.join(F.broadcast(picked), "user_id")  # at most three users
    first = rows.groupBy("band", "user_id", "due_date").agg(
        F.min(F.struct("submitted_at", "assignment_id", "assignment_percentile_ranks", "course_id")).alias("_f")
    )
    first = first.withColumn("_due", micros(first, "due_date"))
    pos = value_positions(first, ["band", "user_id"], "_due").select("band", "user_id", "_due", "_below")
    n_dated = first.groupBy("band", "user_id").agg(F.count("due_date").alias("_nd"))
    seq = (
        first.join(pos, ["band", "user_id", "_due"], "left")
        .join(n_dated, ["band", "user_id"])
        .withColumn("seq", F.coalesce(F.col("_below"), F.col("_nd")).cast("int"))
    )
    return seq.select(
        "band",
        "user_id",
        "seq",
        F.concat(F.lit("A"), F.col("seq").cast("string")).alias("label"),
        "due_date",
        F.col("_f.submitted_at").alias("submitted_at"),
        F.col("_f.assignment_id").alias("assignment_id"),
        F.col("_f.course_id").alias("course_id"),
        F.col("_f.assignment_percentile_ranks").alias("assignment_percentile_ranks"),
    ).orderBy("band", "seq")


def course_counts(df: DataFrame) -> DataFrame:
    """Distinct assignments and students per course."""
    return df.where(F.col("course_id").isNotNull()).groupBy("course_id").agg(
        F.countDistinct("assignment_id").alias("n_assignments"), F.countDistinct("user_id").alias("n_students")
    )


def course_sizes(df: DataFrame, by: str = "n_students") -> DataFrame:
    """All courses with their counts, the smallest ``by`` first (then by id)."""
    return course_counts(df).orderBy(by, "course_id")


def course_counts_check(df: DataFrame) -> DataFrame:
    """Number of courses, of courses with < 20 students and with < 5 assignments."""
    c = course_counts(df)
    return c.agg(
        F.count(F.lit(1)).alias("n_courses"),
        F.count(F.when(F.col("n_students") < 20, 1)).alias("n_under_20_students"),
        F.count(F.when(F.col("n_assignments") < 5, 1)).alias("n_under_5_assignments"),
    )


def kde_by(df: DataFrame, dimension: str, value: str = RESPONSE) -> DataFrame:
    """Density curves of ``value`` for the plotted levels of one dimension."""
    levels = KDE_LEVELS[dimension]
    d = df.where(F.col(dimension).isin(*levels)).select(F.col(dimension).alias("level"), value)
    return kde_grid(d, ["level"], value).select(F.lit(dimension).alias("dimension"), "*")


def course_density_matrix(df: DataFrame, value: str = RESPONSE) -> DataFrame:
    """Density curves per (course, dimension, level) for the plotted levels."""
    s = _stacked(df, value, extra=("course_id", "course_name"))
    cond = None
    for dim, levels in KDE_LEVELS.items():
        c = (F.col("dimension") == dim) & F.col("level").isin(*levels)
        cond = c if cond is None else cond | c
    return kde_grid(s.where(cond), ["course_id", "course_name", "dimension", "level"], value)


def course_grade_box(student: DataFrame) -> DataFrame:
    """Box statistics of the per-course mean, median and std of the
    final-score percentile rank."""
    return box_stats(_grade_long(student), ["stat"], "value")


def _grade_long(student: DataFrame) -> DataFrame:
    arms = "'mean', fs_pct_mean, 'median', fs_pct_median, 'std', fs_pct_std"
    return course_grade_stats(student).select("course_id", F.expr(f"stack(3, {arms}) AS (stat, value)")).where("value IS NOT NULL")


def course_grade_box_outliers(student: DataFrame) -> DataFrame:
    """The courses beyond the whiskers of each box, lowest value first."""
    return box_outliers(_grade_long(student), ["stat"], "value").orderBy("stat", "value", "course_id")


def course_grade_hist(student: DataFrame) -> DataFrame:
    """Histogram (numpy ``auto`` bins) of the per-course mean grade percentile."""
    return auto_histogram(course_grade_stats(student), "fs_pct_mean")
