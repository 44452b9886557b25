"""Joins of rows to their own aggregates under a hot key."""

import pytest
from pyspark.sql import functions as F

from tardy.operators.density import kde_grid
from tardy.operators.joinback import join_back
from tardy.plans import clean as C

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
}


@pytest.fixture
def skewed(spark):
    """Joins by shuffle, and partitions of 200 kB count as hot."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark, n=200_000):
    """Half of the rows have key 0."""
    k = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1000)
    return spark.range(0, n, 1, 8).select(k.alias("k"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def final_plan(df):
    q = df._jdf.queryExecution()
    q.toRdd().count()  # runs this very plan
    return q.executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_hot_key_is_split(spark, skewed, how):
    rows = hot_rows(spark)
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    split = join_back(rows, stats, "k", how, max_rows=0)
    assert "skew=true" in final_plan(split)
    assert "skew=true" not in final_plan(rows.join(stats, "k", how))  # what the helper is for
    assert split.count() == rows.count()


def test_few_rows_are_broadcast(spark, skewed):
    rows = hot_rows(spark, 2000)
    joined = join_back(rows, rows.groupBy("k").agg(F.sum("v").alias("s")), "k")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert {r.s for r in joined.where("k = 0").collect()} == {sum(range(0, 2000, 2))}


def test_null_keys_and_rejected_joins(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k int, v int")
    stats = rows.where("k IS NOT NULL").groupBy("k").agg(F.sum("v").alias("s"))
    assert sorted((r.k or 0, r.v, r.s) for r in join_back(rows, stats, "k").collect()) == [(0, 1, None), (1, 2, 5), (1, 3, 5)]
    with pytest.raises(ValueError):
        join_back(rows, stats, "k", "full")


def test_hot_curve_is_split_before_it_is_expanded(spark, skewed, monkeypatch):
    from tardy.operators import density

    monkeypatch.setattr(density, "small_or_shuffled", lambda t: t)
    v = (F.col("v") % 50021) / 50021.0
    curves = kde_grid(hot_rows(spark).select("k", v.alias("x")), ["k"], "x", gridsize=3)
    assert "skew=true" in final_plan(curves)


def test_clean_of_a_hot_course_equals_the_steps(spark):
    """One course holds most rows; ``clean`` on cells equals the chain of filters."""
    i = F.col("id")
    course = F.when(i % 3 < 2, 1).otherwise(i % 7)
    rows = spark.range(6000).select(
        course.alias("course_id"), F.lit("c").alias("course_name"), (course * 100 + F.abs(F.hash(i)) % 9).alias("assignment_id"),
        F.lit(None).cast("timestamp_ntz").alias("due_date"), F.lit(None).cast("timestamp_ntz").alias("submitted_at"),
        F.when(i % 41 > 0, F.abs(F.hash(i + 7)) % 90).alias("user_id"), F.lit("F").alias("gender"), F.lit("e").alias("ethnicity"),
        F.lit("N").alias("is_a_urm"), F.lit("Y").alias("first_gen_status"), (i % 5).cast("double").alias("final_score"),
    )
    cfg = C.CleanConfig(a_n=2, s_n=10, a_thres=0.3, s_thres=0.2)
    steps = C.student_filter(C.assignment_filter(C.course_filter(C.with_course_stats(rows)), cfg.a_thres), cfg.s_thres)
    steps = C.course_invariants(steps, cfg.a_n, cfg.s_n)
    whole = C.clean(rows, cfg)
    assert sorted(whole.columns) == sorted(steps.columns)
    got, want = whole.select(*steps.columns), steps
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
