"""What the shared steps write and shuffle, and that their rows stay the same."""

import dataclasses
import os

from pyspark.sql import functions as F

from tardy.operators.joinback import NARROW_ROWS
from tardy.plans import clean as C
from tardy.plans import registry as R
from tardy.plans import warehouse as W
from tardy.sources import fixtures, tables

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def parts(path):
    at = path.removeprefix("file:")
    return [f for _, _, files in os.walk(at) for f in files if f.startswith("part-")]


def plain_course_submissions(wh):
    """The count over rows of the whole join."""
    sd = W._valid_submissions(wh).select(F.col("id").alias("sd_id"))
    j = (
        sd.join(wh.submission_fact.alias("sf"), F.col("sf.submission_id") == F.col("sd_id"))
        .join(wh.course_dim.alias("cd"), F.col("cd.id") == F.col("sf.course_id"), "left")
        .join(W._user_demographics(wh), F.col("u_id") == F.col("sf.user_id"))
    )
    return j.groupBy(*W._course_cols()).agg(F.countDistinct("sd_id").alias("submissions"))


def odd_warehouse(spark):
    """Submission ids of several users and courses, unknown, null and repeated keys."""
    wh = R.wh(spark, SF)
    f = wh.submission_fact
    course = F.when(F.col("submission_id") % 5 == 0, F.lit(None)).when(F.col("submission_id") % 7 == 0, F.col("course_id") + 10**9).otherwise(F.col("course_id"))
    more = f.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id") + 1))
    others = f.where("submission_id % 2 = 0").withColumn("course_id", course)
    again = wh.course_dim.where("id % 2 = 0").withColumn("name", F.concat("name", F.lit("+")))
    return dataclasses.replace(
        wh, submission_fact=f.unionByName(more).unionByName(others).unionByName(others), course_dim=wh.course_dim.unionByName(again).unionByName(again)
    )


def test_course_submissions_of_odd_keys(spark):
    for wh in (R.wh(spark, SF), odd_warehouse(spark)):
        assert rows_of(W.course_submissions(wh)) == rows_of(plain_course_submissions(wh))


def test_course_submissions_shuffles_no_id_with_its_course(spark):
    plan = W.course_submissions(R.wh(spark, SF))._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "sd_id" in line and "course_name" in line]
    assert not wide


def test_submissions_of_users_with_several_demographics(spark):
    wh = R.wh(spark, SF)
    uid = F.expr("CAST(substring(unique_name, 2) AS BIGINT)")
    twice = wh.pseudonym_dim.where(uid % 4 == 0).withColumn("unique_name", F.concat(F.lit("n"), (uid + 1).cast("string")))
    got = rows_of(W.submissions(dataclasses.replace(wh, pseudonym_dim=wh.pseudonym_dim.unionByName(twice))))
    pairs = W._user_demographics(dataclasses.replace(wh, pseudonym_dim=wh.pseudonym_dim.unionByName(twice))).drop("anon_netid").distinct()
    base = W.submissions(wh).drop(*W.DEMOGRAPHICS)
    want = base.join(pairs.withColumnRenamed("u_id", "user_id"), "user_id").select(*W.SUBMISSION_COLS).distinct()
    # users that had no demographics before come with the new pseudonym
    old = {r.user_id for r in base.select("user_id").distinct().collect()}
    assert sorted(r for r in got if int(r.split("user_id=")[1].split(",")[0]) in old) == rows_of(want)


def test_ratios_on_cells_count_without_distinct(spark, monkeypatch):
    rows = R.analysis(spark, SF)
    cells = C.cells_of(rows).where("course_id IS NOT NULL")
    sized = cells.join(C.course_stats(rows).select("course_id", "course_size"), "course_id")
    assert rows_of(C.assignment_ratios(sized, F.count("user_id"))) == rows_of(C.assignment_ratios(sized))
    plans = {}
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(df, name))
    C.decide(C.cells_of(rows))
    assert plans["clean_ratios"].count("Exchange hashpartitioning") == 1


def test_kept_assignments_are_broadcast_beyond_the_wide_limit(spark, monkeypatch):
    from tardy.operators import joinback

    asked = []
    real = joinback.small_or_shuffled
    monkeypatch.setattr(joinback, "small_or_shuffled", lambda t, n=joinback.SMALL_ROWS: asked.append((t.columns, n)) or real(t, n))
    C.clean(R.analysis(spark, SF))
    assert [n for c, n in asked if c == ["assignment_id"]] == [NARROW_ROWS] * 2


def test_written_tables_are_zstd(spark, tmp_path):
    df = spark.range(1000)
    assert all(".zstd." in f for f in parts(tables.write_scratch(df, "codec")))
    fixtures.write_warehouse(R.wh(spark, SF), str(tmp_path / "wh"))
    assert all(".zstd." in f for f in parts(str(tmp_path / "wh")))


def test_users_and_enrollments_share_one_aggregate(spark, monkeypatch):
    grain = tables.materialize(fixtures.submission_grain(spark, SF), "grain")
    names = []
    real = tables.materialize
    monkeypatch.setattr(fixtures, "materialize", lambda df, name: names.append(name) or real(df, name))
    a, b = fixtures.build_warehouse(spark, SF, grain), fixtures.build_warehouse(spark, SF)
    assert names == ["fixture_user_courses"]
    for t in ("user_dim", "enrollment_dim", "course_score_fact", "stu_enrollment"):
        assert rows_of(getattr(a, t)) == rows_of(getattr(b, t))


def test_exported_parts_are_compressed(spark):
    assert parts(R.exported(spark, SF)) and all(f.endswith(".csv.gz") for f in parts(R.exported(spark, SF)))
    assert R.QUERIES["csv_scan"](spark, SF).count() == R.subs(spark, SF).count()
