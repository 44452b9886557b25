"""Row choice without sorting, against pandas-like plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tardy.operators import dedupe as D
from tardy.plans import registry as R
from tardy.plans import scores as S
from tardy.plans import warehouse as W

SF = "/root/testdata/sf0.001"
LOW, HIGH = -(2**63), 2**63 - 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(n=600, seed=1):
    rnd = random.Random(seed)
    ids = [None, LOW, HIGH, 0, -1, 7, 8, 2**40]
    return [(rnd.choice([None, 1, 2, 3, 4]), rnd.choice("ab"), rnd.choice(ids), rnd.choice([None, "x", "y", "é"]), rnd.choice([None, "p", "q"])) for _ in range(n)]


def expected(rows, nulls_last):
    def place(v, last):
        return (v is None) if last else (v is not None), v if v is not None else 0

    best = {}
    for k, j, i, s, t in rows:
        order = (place(i, "i" in nulls_last), place(s, "s" in nulls_last)[0], s or "", place(t, False)[0], t or "")
        if (k, j) not in best or order < best[k, j][0]:
            best[k, j] = (order, (k, j, i, s, t))
    return sorted((v for _, v in best.values()), key=str)


@pytest.mark.parametrize("nulls_last", [(), ("i",), ("s",), ("i", "s")])
@pytest.mark.parametrize("max_rows", [100, 2])
def test_first_per_key(spark, nulls_last, max_rows):
    """With a dictionary, and with more combinations than it may hold."""
    rows = rows_of()
    df = spark.createDataFrame(rows, "k int, j string, i bigint, s string, t string").repartition(4)
    got = D.first_per_key(df, ["k", "j"], ["i", "s"], nulls_last, max_rows)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, nulls_last)
    assert ("SortAggregate" in plan(got)) == (max_rows == 2)


def test_first_per_key_of_strings_only(spark):
    rows = [("a", "z", None), ("a", "y", "1"), ("a", "y", None), ("b", None, "q"), (None, "x", "x")]
    df = spark.createDataFrame(rows, "k string, o string, p string")
    assert sorted((tuple(r) for r in D.first_per_key(df, ["k"], ["o", "p"]).collect()), key=str) == sorted([("a", "y", None), ("b", None, "q"), (None, "x", "x")], key=str)
    assert D.first_per_key(df.limit(0), ["k"], ["o"]).count() == 0
    assert [tuple(r) for r in D.first_per_key(df.select("k", F.lit(3).alias("n")).limit(1), ["k"], ["n"]).collect()] == [("a", 3)]


def test_first_values_orders_only_where_rows_differ(spark):
    rows = [(1, 5, "b", 1.0), (1, 4, "c", 2.0), (1, 4, "c", 2.0), (2, 9, "x", None), (2, 1, "x", None), (3, None, "m", 0.5), (3, 2, "n", 0.5)]
    df = spark.createDataFrame(rows, "k int, o int, s string, d double")
    order = [F.col("o").isNull(), F.col("o")]
    assert sorted(tuple(r) for r in D.first_values(df, ["k"], ["s", "d"], order).collect()) == [(1, "c", 2.0), (2, "x", None), (3, "n", 0.5)]
    same = D.first_values(df.where("k = 2"), ["k"], ["s", "d"], order)
    assert "SortAggregate" not in plan(same) and [tuple(r) for r in same.collect()] == [(2, "x", None)]


def test_no_sort_aggregates_in_the_study(spark):
    wh = R.wh(spark, SF)
    ranked = R.ranked(spark, SF)
    for df in (W.valid_enrollment(wh), W.stu_demographics(wh), S.first_rows(ranked), S.student_course_level(ranked)):
        assert "SortAggregate" not in plan(df)
