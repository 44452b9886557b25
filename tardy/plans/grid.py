"""The regression grid: 108 cleaning configurations, one Spark job.

A cube over nested thresholds instead of 108 re-reads and re-cleanings:

* course stats and the course filter do not depend on the configuration;
* ``a_thres`` are nested, so an assignment has a level: how many of them its ratio
  passes. A student's assignments per level, summed from the highest level down,
  give the counts at every ``a_thres``; the ``s_thres`` are nested too, so the
  (a_thres, s_thres) pairs a student-course passes are a few compared numbers. They
  are kept as the bits of an int; a row passes the pairs of its student that are
  also pairs of its assignment's level. No row is copied;
* ranks depend on the pair but not on (a_n, s_n): the invariants remove whole
  courses and ranks are taken inside assignments of one course. Each (assignment,
  time) is counted once per pair, as columns, and one pass over the sorted times
  sums all of them;
* the pairs become rows only at (student, course), after the mean;
* (a_n, s_n) act on the course-level counts only; the regression input is
  reduced to sufficient statistics per (a_thres, s_thres, course, pattern)
  before being expanded to the 12 (a_n, s_n) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COVARIATES, GRID_A_N, GRID_A_THRES, GRID_S_N, GRID_S_THRES, RESPONSE
from ..operators import ols
from ..operators.dedupe import first_values
from ..operators.joinback import NARROW_ROWS, join_back
from ..operators.ranking import micros, running_counts
from ..sources.csv_io import export_csv
from ..sources.tables import materialize
from .clean import assignment_ratios

CFG = ["a_n", "s_n", "a_thres", "s_thres"]
TS = ["a_thres", "s_thres"]
NEEDED = ("course_id", "assignment_id", "user_id", "due_date", "submitted_at", *COVARIATES)


def _pairs(a_thres: Sequence[float], s_thres: Sequence[float]) -> list[tuple[float, float]]:
    """The threshold pairs by number, ascending: pair ``i * len(s_thres) + j``
    holds the i-th ``a_thres`` and the j-th ``s_thres``. A long holds 62 of them."""
    if len(set(a_thres)) * len(set(s_thres)) > 62:
        raise ValueError("more than 62 threshold pairs")
    return [(float(a), float(s)) for a in sorted(set(a_thres)) for s in sorted(set(s_thres))]


def _bit(k: int) -> Column:
    return F.lit(1 << k).cast("bigint")


def _has(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(_bit(k)) != 0


def _per_pair(pairs: list[tuple[float, float]], value) -> Column:
    """An array of (a_thres, s_thres, *value(k)) structs."""
    return F.array(*[F.struct(F.lit(a).alias("a_thres"), F.lit(s).alias("s_thres"), *value(k)) for k, (a, s) in enumerate(pairs)])


def grid_frames(
    s1: DataFrame,
    a_thres: Sequence[float] = GRID_A_THRES,
    s_thres: Sequence[float] = GRID_S_THRES,
    a_n: Sequence[int] = GRID_A_N,
    s_n: Sequence[int] = GRID_S_N,
) -> dict:
    """``s1``: rows after course stats and the course filter. Returns written
    tables: ``cells`` (course, user, assignment with ``n`` rows and ``_level``, of
    assignments that pass a threshold), ``rows`` (rows that pass a pair, with the
    bits ``_mask`` of all they pass), ``course_counts`` per pair, ``survivors``, the
    surviving (config, course) pairs; and ``pairs``, the numbered threshold pairs."""
    pairs = _pairs(a_thres, s_thres)
    a_levels, s_levels = sorted({a for a, _ in pairs}), sorted({s for _, s in pairs})
    wide = len(s_levels)
    # One narrow row per (course, student, assignment) decides all filters.
    all_cells = materialize(
        s1.groupBy("course_id", "user_id", "assignment_id").agg(F.count(F.lit(1)).alias("n"), F.max("course_size").alias("course_size")), "grid_all_cells"
    )
    level = sum((F.when(F.col("_ratio") > a, 1).otherwise(0) for a in a_levels), F.lit(0)).cast("int")
    # Pairs that an assignment of a level allows: those of the first ``_level`` thresholds.
    levels = materialize(assignment_ratios(all_cells, F.count("user_id")).select("assignment_id", level.alias("_level")).where("_level > 0"), "grid_levels")
    cells = materialize(join_back(all_cells.drop("course_size"), levels, "assignment_id", "inner", "grid_levels", NARROW_ROWS), "grid_cells")
    level_mask = F.element_at(F.array(*[F.lit((1 << (wide * i)) - 1).cast("bigint") for i in range(1, len(a_levels) + 1)]), F.col("_level"))

    at_level = [F.count_if(F.col("_level") == i + 1).alias(f"_l{i}") for i in range(len(a_levels))]
    from_above = lambda i: sum((F.col(f"_l{k}") for k in range(i, len(a_levels))), F.lit(0))
    of_course = cells.select("course_id", "assignment_id", "_level").distinct().groupBy("course_id").agg(*at_level)
    of_course = of_course.select("course_id", *[from_above(i).alias(f"_nc{i}") for i in range(len(a_levels))])
    of_student = cells.where(F.col("user_id").isNotNull()).groupBy("user_id", "course_id").agg(*at_level)
    of_student = of_student.select("user_id", "course_id", *[from_above(i).alias(f"_na{i}") for i in range(len(a_levels))])
    mask = F.lit(0).cast("bigint")
    for k, (a, s) in enumerate(pairs):
        i = a_levels.index(a)
        mask = mask.bitwiseOR(F.when(F.col(f"_na{i}") > F.floor(F.col(f"_nc{i}") * s), _bit(k)).otherwise(F.lit(0).cast("bigint")))
    students = join_back(of_student, of_course, "course_id", "inner", "grid_course_levels")
    students = materialize(students.select("user_id", "course_id", mask.alias("_student")).where("_student <> 0"), "grid_students")

    def passing(table: DataFrame) -> DataFrame:
        """Rows with a ``_level`` that pass a pair, with their ``_mask``."""
        both = join_back(table, students, ["user_id", "course_id"], "inner", "grid_students")
        kept = [c for c in table.columns if c != "_level"]
        return both.select(*kept, F.col("_student").bitwiseAND(level_mask).alias("_mask")).where("_mask <> 0")

    with_level = join_back(s1.select(*NEEDED), levels, "assignment_id", "inner", "grid_levels", NARROW_ROWS)
    rows = materialize(passing(with_level), "grid_rows")

    # Per pair and course: students from their bits, assignments and rows from
    # the assignments' totals (a passing student has an assignment of the level).
    count = range(len(pairs))
    bits = lambda column, n: [F.count_if(_has(F.col(column), k)).alias(f"{n}{k}") for k in count]
    of_assignment = passing(cells).groupBy("course_id", "assignment_id").agg(
        F.bit_or("_mask").alias("_mask"), *[F.sum(F.when(_has(F.col("_mask"), k), F.col("n"))).alias(f"r{k}") for k in count]
    )
    assignments = of_assignment.groupBy("course_id").agg(*bits("_mask", "a"), *[F.sum(f"r{k}").alias(f"r{k}") for k in count])
    counts = assignments.join(students.groupBy("course_id").agg(*bits("_student", "s")), "course_id")
    one = lambda k: (
        F.col(f"a{k}").alias("n_assignments_updated"), F.col(f"s{k}").alias("n_students_updated"), F.col(f"r{k}").alias("n_rows")
    )
    cc = counts.select("course_id", F.inline(_per_pair(pairs, one))).where("n_students_updated > 0")
    cc = materialize(cc, "grid_course_counts")
    limits = F.array(*[F.struct(F.lit(x).alias("a_n"), F.lit(y).alias("s_n")) for x in a_n for y in s_n])
    ok = F.filter(limits, lambda c: (F.col("n_students_updated") > c["s_n"]) & (F.col("n_assignments_updated") > c["a_n"]))
    surv = cc.select(*TS, "course_id", "n_rows", "n_students_updated", F.explode(ok).alias("c")).select(
        F.col("c.a_n").alias("a_n"), F.col("c.s_n").alias("s_n"), *TS, "course_id", "n_rows", "n_students_updated"
    )
    return {"pairs": pairs, "rows": rows, "cells": cells, "course_counts": cc, "survivors": surv}


def config_table(spark, a_n=GRID_A_N, s_n=GRID_S_N, a_thres=GRID_A_THRES, s_thres=GRID_S_THRES) -> DataFrame:
    """The 108 configurations (a fixed parameter table, 108 rows)."""
    rows = [(int(x), int(y), float(a), float(s)) for x in a_n for y in s_n for a in a_thres for s in s_thres]
    return spark.createDataFrame(rows, "a_n int, s_n int, a_thres double, s_thres double")


def grid_survivors(s1: DataFrame, frames: dict) -> DataFrame:
    """Per configuration: rows after each filter, surviving courses and
    student-course pairs (configurations that keep nothing give zeros)."""
    pairs = frames["pairs"]
    thresholds = sorted({a for a, _ in pairs})
    n_all = s1.agg(F.count(F.lit(1)).alias("rows_course_filter"))
    first = F.array(*[F.lit(a) for a in thresholds])
    n1 = n_all.select("rows_course_filter", F.explode(first).alias("a_thres"))  # a row per threshold
    above = [F.sum(F.when(F.col("_level") > i, F.col("n"))) for i in range(len(thresholds))]
    n2 = frames["cells"].agg(
        F.array(*[F.struct(F.lit(a).alias("a_thres"), n.alias("rows_assignment_filter")) for a, n in zip(thresholds, above, strict=True)]).alias("x")
    ).select(F.inline("x"))
    n3 = frames["course_counts"].groupBy(*TS).agg(F.sum("n_rows").alias("rows_student_filter"))
    n4 = frames["survivors"].groupBy(*CFG).agg(
        F.sum("n_rows").alias("rows_final"),
        F.count(F.lit(1)).alias("n_courses"),
        F.sum("n_students_updated").alias("n_student_courses"),
    )
    counted = ("rows_assignment_filter", "rows_student_filter", "rows_final", "n_courses", "n_student_courses")
    return (
        config_table(s1.sparkSession)
        .join(n1, "a_thres")
        .join(n2, "a_thres", "left")
        .join(n3, TS, "left")
        .join(n4, CFG, "left")
        .select(*CFG, "rows_course_filter", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted])
    )


def _percentiles(rows: DataFrame, n_pairs: int) -> DataFrame:
    """``assignment_id``, ``_at``, ``_pct``: the percentile ranks of a time among
    the assignment's submissions that pass a pair, by pair number."""
    names = [f"_n{k}" for k in range(n_pairs)]
    times = rows.where(F.col("assignment_id").isNotNull() & F.col("_at").isNotNull()).groupBy("assignment_id", "_at").agg(
        *[F.count_if(_has(F.col("_mask"), k)).alias(c) for k, c in enumerate(names)]
    )
    pos = running_counts(times, ["assignment_id"], "_at", names)
    pct = lambda c: F.when(F.col(c) > 0, (F.col(f"_below{c}") + (F.col(c) + 1) / 2.0) / F.col(f"_total{c}"))
    return pos.select("assignment_id", "_at", F.array(*[pct(c) for c in names]).alias("_pct"))


def student_responses(frames: dict) -> DataFrame:
    """Per pair and (student, course): the mean percentile rank and the
    covariates of the first row (by due date, submission, assignment)."""
    pairs, rows = frames["pairs"], frames["rows"]
    rows = rows.withColumn("_at", micros(rows, "submitted_at"))
    ranked = rows.join(_percentiles(rows, len(pairs)), ["assignment_id", "_at"], "left")
    per = ranked.groupBy("user_id", "course_id").agg(
        F.bit_or("_mask").alias("_mask"),
        *[F.avg(F.when(_has(F.col("_mask"), k), F.get("_pct", F.lit(k)))).alias(f"_y{k}") for k in range(len(pairs))],
    )
    long = per.select("user_id", "course_id", "_mask", F.inline(_per_pair(pairs, lambda k: (_bit(k).alias("_k"), F.col(f"_y{k}").alias(RESPONSE)))))
    long = long.where(F.col("_mask").bitwiseAND(F.col("_k")) != 0).select(*TS, "user_id", "course_id", RESPONSE)
    out = [*TS, "user_id", "course_id", RESPONSE, *COVARIATES]
    keys = ["user_id", "course_id"]
    # Mostly the covariates are the same in all rows of a (student, course).
    combos = materialize(rows.select(*keys, *COVARIATES).distinct(), "grid_covariates")
    several = materialize(combos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), "grid_several")
    if several.isEmpty():
        return long.join(combos, keys).select(*out)
    sure = long.join(join_back(combos, several, keys, "left_anti", "grid_several"), keys).select(*out)
    # For the others the first row counts. A student that passes a pair passes
    # the lowest s_thres too, so a pair's rows depend on a_thres alone.
    unsure, wide = join_back(rows, several, keys, "left_semi", "grid_several"), len({s for _, s in pairs})
    firsts = [unsure.where(_has(F.col("_mask"), i * wide)).withColumn("a_thres", F.lit(a)) for i, a in enumerate(sorted({a for a, _ in pairs}))]
    order = [F.col("due_date").isNull(), F.col("due_date"), F.col("submitted_at"), F.col("assignment_id")]
    covariates = ["ethnicity", *[c for c in COVARIATES if c != "ethnicity"]]
    first = first_values(reduce(DataFrame.unionByName, firsts), ["a_thres", *keys], covariates, order)
    return sure.unionByName(long.join(first, ["a_thres", *keys]).select(*out))


def grid_suffstats(frames: dict) -> DataFrame:
    """Regression sufficient statistics per (config, course, pattern)."""
    sfs = ols.suffstats(student_responses(frames), TS)
    surv = frames["survivors"].select(*CFG, "course_id")
    return sfs.join(surv, [*TS, "course_id"]).select(*CFG, "course_id", *COVARIATES, "n", "sy", "syy")


def grid_fit(frames: dict) -> dict[str, DataFrame]:
    return ols.fit(None, keys=CFG, sfs=materialize(grid_suffstats(frames), "grid_suffstats"))


def wide(fit: dict[str, DataFrame], value: str) -> DataFrame:
    """One row per configuration, one column per term (the study's layout).
    The terms are known from the levels: a handful of names."""
    named = fit["levels"].where(F.col("term").isNotNull()).groupBy("factor_pos", "level", "term").agg(F.lit(1).alias("_"))
    terms = [ols.INTERCEPT, *[r["term"] for r in named.orderBy("factor_pos", "level").collect()]]
    return fit["terms"].groupBy(*CFG).pivot("term", terms).agg(F.first(value))


def write_results(fit: dict[str, DataFrame], path: str) -> None:
    """The study's three result files, as CSV folders: coefficients, p-values
    (4 places) and lower 95 % bounds, thresholds first."""
    for name, value in (("coeffs", "coef"), ("pvalues", "p"), ("conf_int", "ci_low")):
        table = wide(fit, value)
        if value == "p":
            table = table.select(*CFG, *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in table.columns if c not in CFG])
        export_csv(table.orderBy(*CFG), f"{path.rstrip('/')}/{name}")
