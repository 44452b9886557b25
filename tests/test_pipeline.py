"""Cleaning edge cases on hand-made rows, CSV round trips, fixture counts
and a DuckDB oracle subset on the smallest driver tables."""

import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from tardy.config import CleanConfig
from tardy.plans import clean as C
from tardy.plans import scores as S
from tardy.sources import csv_io
from tardy.sources.fixtures import build_warehouse
from tardy.sources.tables import scratch_path

SF = "/root/testdata/sf0.001"
COLS = "course_id long, course_name string, assignment_id long, due_date timestamp_ntz, submitted_at timestamp_ntz, " \
       "user_id long, gender string, ethnicity string, is_a_urm string, first_gen_status string, final_score double"


def _row(course, assignment, user, day, score, due_day=1, eth="White"):
    d = dt.datetime(2021, 1, 1)
    sub = None if day is None else d + dt.timedelta(days=day)
    return (course, f"c{course}", assignment, d + dt.timedelta(days=due_day), sub, user, "F", eth, "N", "N", score)


def test_course_filter_null_mean_kept_zero_mean_dropped(spark):
    rows = [_row(1, 10, 1, 1, None), _row(1, 10, 2, 2, None), _row(2, 20, 1, 1, 0.0), _row(2, 20, 2, 1, 0.0),
            _row(3, 30, 1, 1, 5.0), _row(None, 40, 1, 1, 5.0)]
    df = spark.createDataFrame(rows, COLS)
    kept = {r.course_id for r in C.course_filter(C.with_course_stats(df)).select("course_id").distinct().collect()}
    assert kept == {1, 3}


def test_thresholds_are_strict(spark):
    # course of 4 students; assignment 10 done by 2 of 4 (ratio 0.5): dropped at a_thres=0.5
    rows = [_row(1, 11, u, u, 1.0) for u in range(4)] + [_row(1, 10, u, u, 1.0) for u in range(2)]
    df = C.with_course_stats(spark.createDataFrame(rows, COLS))
    kept = {r.assignment_id for r in C.assignment_filter(df, 0.5).select("assignment_id").distinct().collect()}
    assert kept == {11}
    # invariants: 4 students, 1 assignment -> s_n=4 drops, s_n=3 keeps (a_n=0)
    s = C.assignment_filter(df, 0.5)
    assert C.course_invariants(s, 0, 4).count() == 0
    assert C.course_invariants(s, 0, 3).count() == 4


def test_single_assignment_student_has_null_variance(spark):
    rows = [_row(1, 10, 1, 1, 1.0), _row(1, 10, 2, 2, 1.0), _row(1, 11, 2, 3, 1.0), _row(1, 11, 1, 1, 1.0),
            _row(1, 12, 3, 1, 1.0)]
    df = C.with_course_stats(spark.createDataFrame(rows, COLS))
    df = df.withColumn("n_assignments", df.course_size).withColumn("n_assignments_updated", df.course_size) \
           .withColumn("n_students_updated", df.course_size)
    sc = S.procrastination_scores(S.add_assignment_ranks(df)).toPandas().set_index("user_id")
    assert pd.isna(sc.loc[3, "procrastination_var_rank"]) and pd.isna(sc.loc[3, "procrastination_std_rank"])
    assert sc.loc[3, "procrastination_median_rank"] == 1.0
    # tie on assignment 10? no: user 1 day 1, user 2 day 2 -> ranks 1, 2 -> pct .5, 1
    assert sc.loc[1, "procrastination_mean_rank"] == pytest.approx(0.5)


def test_ties_and_null_submission_times(spark):
    rows = [_row(1, 10, 1, 5, 1.0), _row(1, 10, 2, 5, 1.0), _row(1, 10, 3, 7, 1.0), _row(1, 10, 4, None, 1.0)]
    r = S.add_assignment_ranks(spark.createDataFrame(rows, COLS)).toPandas().set_index("user_id")
    assert list(r.loc[[1, 2, 3], "assignment_ranks"]) == [1.5, 1.5, 3.0]
    assert r.loc[3, "assignment_percentile_ranks"] == 1.0  # denominator counts non-null times only
    assert pd.isna(r.loc[4, "assignment_ranks"])


def test_csv_round_trip_with_quotes_newlines_and_null_tokens(spark, tmp_path):
    p = tmp_path / "extract.csv"
    p.write_text(
        "submitted_at,due_date,course_id,course_name,user_id,assignment_id,final_score,ethnicity,gender,is_a_urm,"
        "first_gen_status,extra\n"
        '2021-01-02 10:00:00,2021-01-03 00:00:00,1,"Intro ""A""\nPart 2",7,70,NA,White,F,N,N,x\n'
        "2021-01-02 11:00:00,,1,plain,8,70,88.5,,M,Y,NULL,y\n"
    )
    df = csv_io.read_analysis_csv(spark, str(p)).toPandas()
    assert list(df.columns)[:3] == ["submitted_at", "due_date", "course_id"]  # the file's order
    assert df.course_name[0] == 'Intro "A"\nPart 2'
    assert pd.isna(df.final_score[0]) and pd.isna(df.due_date[1]) and pd.isna(df.ethnicity[1])
    assert df.first_gen_status.isna()[1] and df.final_score[1] == 88.5
    out = scratch_path(spark.range(1), "csv-test")
    csv_io.export_csv(spark.createDataFrame(df), out)
    back = csv_io.read_analysis_csv(spark, out).toPandas().sort_values("user_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(back, df.sort_values("user_id").reset_index(drop=True), check_dtype=False)


def test_malformed_timestamp_fails_unless_lenient(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("submitted_at,due_date,course_id,course_name,user_id,assignment_id,final_score,ethnicity,gender,"
                 "is_a_urm,first_gen_status\nnot a time,,1,c,1,1,1,W,F,N,N\n")
    with pytest.raises(Exception):
        csv_io.read_analysis_csv(spark, str(p)).collect()
    assert csv_io.read_analysis_csv(spark, str(p), lenient=True).first().submitted_at is None


def test_fixture_counts(spark):
    wh = build_warehouse(spark, SF)
    counts = {n: df.count() for n, df in wh.__dict__.items()}
    assert counts["course_dim"] == 10 and counts["user_dim"] == 48 and counts["pseudonym_dim"] == 51
    assert counts["stu_enrollment"] == 55 and counts["assignment_dim"] == 125
    assert counts["submission_dim"] == 2552 and counts["enrollment_dim"] == 300


def test_audit_is_monotone(spark):
    audit = E.queries()["filter_audit"](spark, SF).toPandas().sort_values("stage_no")
    assert list(audit["rows"]) == sorted(audit["rows"], reverse=True)
    assert list(audit["rows"]) == [1645, 1645, 1505, 1335, 1335]


def _duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None)
    rows = [tuple(round(v, 6) if isinstance(v, float) else (str(v) if v is not None else None) for v in r)
            for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple("" if x is None else str(x) for x in r))


@pytest.mark.parametrize("name", [
    "submissions", "course_meta", "student_course_lvl", "grid_survivors", "se_plot_data", "course_grade_hist",
    "student_time_series",
])
def test_oracle_subset(spark, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dd = _duck(SF).execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert _canon(sp) == _canon(dd)


def test_grid_point_equals_single_pipeline(spark):
    from tardy.plans import grid as G
    from tardy.plans import registry as R
    from tardy.operators import ols
    cfg = CleanConfig(5, 10, 0.25, 0.25)
    single = ols.fit(S.student_course_level(S.add_assignment_ranks(C.clean(R.analysis(spark, SF), cfg))))["terms"]
    s1, frames = R.grid_fit(spark, SF)
    g = G.grid_fit(frames)["terms"].where("a_n = 5 AND s_n = 10 AND a_thres = 0.25 AND s_thres = 0.25")
    a = single.toPandas().sort_values("term_idx")
    b = g.toPandas().sort_values("term_idx")
    assert list(a.term) == list(b.term)
    np.testing.assert_allclose(a.coef.to_numpy(), b.coef.to_numpy(), atol=1e-12)
    np.testing.assert_allclose(a.se.to_numpy(), b.se.to_numpy(), atol=1e-12)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "procrastination_mean_rank" in df.columns
