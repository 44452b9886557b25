"""Plan guards, on the plans before any stage is written: no Cartesian product
or nested-loop join, a known number of scans, pruned columns."""

import re

from tardy.operators import ols
from tardy.plans import clean as C
from tardy.plans import explore as X
from tardy.plans import grid as G
from tardy.plans import registry as R
from tardy.plans import scores as S
from tardy.plans import warehouse as W

SF = "/root/testdata/sf0.001"


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark):
    wh = R.wh(spark, SF)
    rows = R.analysis(spark, SF)
    ranked = R.ranked(spark, SF)
    return {
        "submissions": W.submissions(wh),
        "course_meta": W.course_meta(wh),
        "clean": C.clean(rows),
        "assignment_ranks": S.add_assignment_ranks(R.cleaned(spark, SF)),
        "first_rows": S.first_rows(ranked),
        "scores": S.with_scores(ranked),
        "density": X.course_density_matrix(S.with_scores(ranked)),
        "grid_survivors": G.grid_survivors(*R.grid_fit(spark, SF)),
        "grid_suffstats": G.grid_suffstats(R.grid_fit(spark, SF)[1]),
        "ols": ols.suffstats(R.student(spark, SF)),
    }


def test_no_pair_joins(spark):
    for name, df in frames(spark).items():
        plan = initial_plan(df)
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_submissions_scans_of_the_large_tables(spark):
    plan = initial_plan(W.submissions(R.wh(spark, SF)))
    # once for the rows and once for the counts that choose the courses
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert sum("grade_matches_current_submission#" in s for s in scans) == 2
    assert sum(s.startswith("submission_id#") or ",submission_id#" in s for s in scans) == 2


def test_few_curves_are_broadcast(spark):
    ranked = R.ranked(spark, SF)
    plan = initial_plan(X.kde_by(S.with_scores(ranked), "gender"))
    assert "SortMergeJoin [level" not in plan and "BroadcastHashJoin [level" in plan


def test_audit_works_on_its_cells(spark):
    """The rows are read when the cells are written, not again after that."""
    tagged = C.stage_reached(R.analysis(spark, SF))
    assert not any("/submissions-" in f for f in tagged.inputFiles())


def test_scan_prunes_columns(spark):
    from tardy.sources.fixtures import submission_grain

    plan = initial_plan(submission_grain(spark, SF))
    # lineitem has 11 columns; only five are read
    assert "l_extendedprice" not in plan and "l_returnflag" not in plan


def test_wide_rows_are_not_shuffled_to_be_distinct(spark):
    """The joined rows are distinct already; no aggregate stands above the joins."""
    plan = initial_plan(W.submissions(R.wh(spark, SF)))
    top = plan.split("Join", 1)[0]
    assert "HashAggregate" not in top and "Exchange" not in top
    # submission_dim and its fact are shuffled by the submission's id only
    assert not re.search(r"hashpartitioning\(submission_id#\d+L, [a-z]", plan)


def test_submissions_of_repeated_inputs_are_distinct(spark):
    """Every warehouse table twice: the same rows, once each."""
    from dataclasses import fields

    wh = R.wh(spark, SF)
    twice = type(wh)(**{f.name: getattr(wh, f.name).unionByName(getattr(wh, f.name)) for f in fields(wh)})
    once, again = W.submissions(wh), W.submissions(twice)
    assert again.count() == once.count() == again.distinct().count()
    assert once.exceptAll(again).isEmpty()
