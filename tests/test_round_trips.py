"""Sub-second CSV round trips, far timestamps in ranks, stages written once."""

import datetime as dt

import pytest

from tardy.operators.ranking import average_rank
from tardy.plans import registry
from tardy.session import ensure_checkpoint_dir
from tardy.sources import csv_io

SF = "/root/testdata/sf0.001"


def test_csv_keeps_microseconds(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 1, 1, 1, 1, 1, 250000)), (2, dt.datetime(2020, 1, 1, 1, 1, 1, 750001)), (3, None)]
    out = str(tmp_path / "x")
    csv_io.export_csv(spark.createDataFrame(rows, "user_id bigint, due_date timestamp_ntz"), out)
    back = csv_io.read_csv(spark, out, types={"user_id": "long", "due_date": "timestamp_ntz"})
    assert sorted(back.collect()) == rows


def test_far_timestamps_rank_alike(spark):
    days = [dt.datetime(9999, 12, 31), dt.datetime(1600, 1, 1), dt.datetime(2020, 5, 5, 1, 2, 3, 4), None, dt.datetime(9999, 12, 31)]
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(days)], "g int, i int, d timestamp_ntz")
    got = [{r.i: (r.r, r.p) for r in average_rank(df, ["g"], "d", "r", "p", strategy=s).collect()} for s in ("range", "window")]
    assert got[0] == got[1] and got[0][0] == (3.5, 0.875) and got[0][3] == (None, None)


def test_stages_are_written_once(spark):
    first = registry.subs(spark, SF).inputFiles()
    assert registry.subs(spark, SF).inputFiles() == first
    registry.forget_stages(spark)
    assert registry.subs(spark, SF).inputFiles() != first


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_ordered_by_count(spark):
    counts = [r.enrollments for r in registry.QUERIES["top_courses"](spark, SF).collect()]
    assert counts == sorted(counts, reverse=True)
    assert len(counts) == registry.QUERIES["course_enrollments"](spark, SF).count()


def test_no_scratch_table_is_left(spark):
    """All tables of a session are tracked, and gone once it forgets them."""
    import glob
    import os

    from tardy.session import ensure_checkpoint_dir as folder

    at = os.path.join(folder(spark).removeprefix("file:"), "tables")
    registry.QUERIES["grid_suffstats"](spark, SF).count()
    registry.QUERIES["export_csv"](spark, SF).count()
    assert glob.glob(f"{at}/*")
    registry.forget_stages(spark)
    assert not glob.glob(f"{at}/*")
    assert registry.QUERIES["grid_survivors"](spark, SF).count() == 108
