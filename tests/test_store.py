"""Named tables: replaced as a whole, stored in order, read by range."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tardy.plans import registry as R
from tardy.sources import store

SF = "/root/testdata/sf0.001"


def days(spark, n=4000):
    day = F.when(F.col("id") % 50 > 0, F.expr("date_add(DATE'2020-01-01', CAST(id * 7919 % 365 AS INT))").cast("timestamp_ntz"))
    return spark.range(n).select("id", day.alias("due"))


@pytest.fixture
def table(spark):
    yield "test_days"
    store.drop_table(spark, "test_days")


def test_stored_order(spark, table):
    store.replace_table(days(spark), table, ("due", "id"), file_rows=500)
    read = store.read_table(spark, table)
    assert read.count() == 4000 and read.rdd.getNumPartitions() >= 1
    files = sorted(read.inputFiles())
    assert len(files) >= 6
    last = None
    for f in files:  # each file is sorted and follows the one before it, nulls last
        rows = [(r.due is None, r.due or dt.datetime(1, 1, 1), r.id) for r in spark.read.parquet(f).collect()]
        assert rows == sorted(rows) and (last is None or not rows or last <= rows[0])
        last = rows[-1] if rows else last


def test_range_reads_few_files(spark, table):
    store.replace_table(days(spark), table, ("due", "id"), file_rows=500)
    whole = store.read_table(spark, table)
    low, high = dt.datetime(2020, 3, 1), dt.datetime(2020, 3, 20)
    part = store.read_range(spark, table, "due", low, high)
    assert len(part.inputFiles()) <= 2 < len(whole.inputFiles())
    want = {r.id for r in whole.where(F.col("due").between(low, high)).collect()}
    assert {r.id for r in part.collect()} == want and want
    assert store.read_range(spark, table, "due", None, high).count() == whole.where(F.col("due") <= high).count()
    assert store.read_range(spark, table, "due", low).count() == whole.where(F.col("due") >= low).count()
    assert store.read_range(spark, table, "due", dt.datetime(2031, 1, 1)).count() == 0


def test_replace_and_readers(spark, table):
    with pytest.raises(ValueError, match="no table"):
        store.read_table(spark, table)
    first = store.replace_table(days(spark, 100), table, ("due",))
    old = store.current_version(spark, table)
    store.replace_table(store.read_table(spark, table).where("id < 10"), table, ("due",))  # by a query over itself
    assert store.read_table(spark, table).count() == 10 and store.current_version(spark, table) != old
    assert first.count() == 100  # the version before stays for its readers
    store.replace_table(days(spark, 0), table, ("due",))
    assert store.read_table(spark, table).count() == 0
    assert store.read_range(spark, table, "due", dt.datetime(2020, 1, 1)).count() == 0
    with pytest.raises(ValueError, match="not a table name"):
        store.read_table(spark, "../x")


def test_submission_table_is_stored_by_due_date(spark):
    rows = [(r.due_date is None, r.due_date or dt.datetime(1, 1, 1), r.submission_id) for f in sorted(R.subs(spark, SF).inputFiles()) for r in spark.read.parquet(f).collect()]
    assert rows == sorted(rows) and len(rows) > 1000
    assert R.submission_table(spark, SF) == R.submission_table(spark, SF)
