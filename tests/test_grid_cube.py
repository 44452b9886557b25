"""The threshold cube against one run of the plain filters per threshold pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tardy.operators.ranking import running_counts, value_positions
from tardy.plans import clean as C
from tardy.plans import grid as G
from tardy.plans import scores as S


def submissions(spark, seed=3, varied=True):
    """Two courses; resubmissions, missing times and users; students whose
    demographics differ between rows if ``varied``."""
    rnd, rows = random.Random(seed), []
    for course, students, assignments in ((1, 14, 8), (2, 9, 5), (3, 3, 2)):
        eager = {u: rnd.random() for u in range(students)}
        for a in range(assignments):
            share = rnd.random()
            due = rnd.choice([None, dt.datetime(2020, 1, 1 + a % 3)])
            for u in range(students):
                if rnd.random() < share * 0.6 + eager[u] * 0.5:
                    for _ in range(rnd.choice([1, 1, 2])):
                        at = rnd.choice([None, *[dt.datetime(2020, 1, d, 3) for d in range(1, 9)]])
                        g = rnd.choice("MF") if varied and u % 4 == 0 else "MF"[u % 2]
                        rows.append((course, "c", course * 100 + a, due, at, None if u == 8 else u, g, rnd.choice([None, "x", "y"]) if varied else "x", "N", "Y", 1.0))
    cols = "course_id long, course_name string, assignment_id long, due_date timestamp_ntz, submitted_at timestamp_ntz, user_id long, gender string, ethnicity string, is_a_urm string, first_gen_status string, final_score double"
    return spark.createDataFrame(rows, cols).repartition(3)


@pytest.mark.parametrize("varied", [True, False])
def test_cube_equals_plain_filters(spark, varied):
    s1 = C.course_filter(C.with_course_stats(submissions(spark, varied=varied)))
    A, Z = ((0.2, 0.6), (0.1, 0.8)) if varied else ((0.2, 0.45, 0.6), (0.1, 0.5))
    frames = G.grid_frames(s1, A, Z, (1, 3), (2, 5))
    got, counts = {}, {}
    for r in G.student_responses(frames).collect():
        key = (r.a_thres, r.s_thres, r.user_id, r.course_id)
        assert key not in got
        got[key] = (round(r.procrastination_mean_rank, 9) if r.procrastination_mean_rank is not None else None, r.gender, r.ethnicity, r.is_a_urm, r.first_gen_status)
    for r in frames["course_counts"].collect():
        counts[r.a_thres, r.s_thres, r.course_id] = (r.n_assignments_updated, r.n_students_updated, r.n_rows)
    want, want_counts = {}, {}
    for a in A:
        s2 = C.assignment_filter(s1, a)
        for z in Z:
            s3 = C.student_filter(s2, z)
            for r in S.first_rows(S.add_assignment_ranks(s3)).join(S.procrastination_scores(S.add_assignment_ranks(s3)), ["user_id", "course_id"]).collect():
                y = r.procrastination_mean_rank
                want[a, z, r.user_id, r.course_id] = (round(y, 9) if y is not None else None, r.gender, r.ethnicity, r.is_a_urm, r.first_gen_status)
            for r in s3.groupBy("course_id").agg(F.countDistinct("assignment_id").alias("a"), F.countDistinct("user_id").alias("u"), F.count(F.lit(1)).alias("n")).collect():
                want_counts[a, z, r.course_id] = (r.a, r.u, r.n)
    assert len(want) > 30 and len({k[:2] for k in want}) > 2
    if not varied:
        assert got == want and counts == want_counts
    else:  # the plain run's first row also breaks ties by columns the grid has not
        assert got.keys() == want.keys() and counts == want_counts
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert sum(got[k] == want[k] for k in got) > 0.9 * len(got)


def test_several_counts_in_one_pass(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), v, rnd.randrange(3), rnd.randrange(2)) for v in range(500)]
    vc = spark.createDataFrame(rows, "g int, v int, a long, b long").repartition(5)
    for p in (1, 7):
        both = {(r.g, r.v): r for r in running_counts(vc, ["g"], "v", ["a", "b"], p).collect()}
        assert len(both) == 500
        for g, v, a, b in rows:
            r = both[g, v]
            same = [x for x in rows if x[0] == g]
            assert (r._belowa, r._belowb) == (sum(x[2] for x in same if x[1] < v), sum(x[3] for x in same if x[1] < v))
            assert (r._totala, r._totalb) == (sum(x[2] for x in same), sum(x[3] for x in same))
    one = value_positions(vc, ["g"], "v")
    assert {(r.g, r.v): (r._below, r._total) for r in one.collect()} == {(g, v): (sum(x[0] == g and x[1] < v for x in rows), sum(x[0] == g for x in rows)) for g, v, _, _ in rows}


def test_too_many_pairs(spark):
    with pytest.raises(ValueError):
        G._pairs([i / 10 for i in range(8)], [i / 10 for i in range(8)])
