"""CSV files with line breaks in fields, read in splits, against Spark's own
whole-file reader."""

import csv
import random

import pytest

from tardy.sources.csv_io import export_csv, read_csv
from tardy.sources.csv_split import read_split_csv
from tardy.sources.tables import scratch_path

TEXT = ["plain", "", "two\nlines", '"quoted" and\n\n"more"', "a,b", 'x""\n""y', "\n", "end\n", "é☃\r\nz", '"', "tail "]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def whole_files(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(path, seed, n, end="\n", long=0):
    rnd = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", "te\nxt", "other"])
        for i in range(n):
            text = rnd.choice(TEXT)
            if long and i % 40 == 7:
                text = "long\nrecord, " * long
            out.writerow([i, text, rnd.choice(TEXT)])


@pytest.mark.parametrize("long", [0, 300])
def test_splits_give_the_whole_records(spark, small_splits, tmp_path, long):
    """Several files; records over many splits (``long``); one split a few lines."""
    for k in range(3):
        write(tmp_path / f"part{k}.csv", k, 160, long=long)
    df = read_split_csv(spark, str(tmp_path))
    assert df.columns == ["id", "te\nxt", "other"]
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    want = []
    for k in range(3):
        with open(tmp_path / f"part{k}.csv", newline="", encoding="utf-8") as f:
            want += [tuple(v or None for v in r) for r in list(csv.reader(f))[1:]]
    assert rows(df) == sorted(want, key=str) and len(want) == 480
    fields = rows(whole_files(spark, str(tmp_path)))
    assert [r[0] for r in rows(df)] == [r[0] for r in fields]


def test_several_tasks_read_one_file(spark, small_splits, tmp_path):
    write(tmp_path / "one.csv", 5, 400)
    df = read_split_csv(spark, str(tmp_path / "one.csv"))
    assert df.rdd.getNumPartitions() > 10 and whole_files(spark, str(tmp_path / "one.csv")).rdd.getNumPartitions() == 1
    assert df.count() == 400


def test_export_is_read_back(spark, small_splits):
    data = [(i, t, None if i % 3 else i / 7) for i, t in enumerate(TEXT * 30)]
    df = spark.createDataFrame(data, "id long, text string, x double").repartition(4)
    path = scratch_path(df, "csv-split-test")
    export_csv(df, path)
    got = read_csv(spark, path, types={"id": "long", "x": "double"})
    assert sorted((r.id, r.text, r.x) for r in got.collect() if r.text is not None) == sorted(r for r in data if r[1] not in ("",) and r[1] is not None)
    assert got.count() == len(data)


def test_line_ends_blank_lines_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\r\n1,"p\r\nq"\r\n\r\n2,r\r\n', newline="")
    assert rows(read_split_csv(spark, str(tmp_path / "a.csv"))) == [("1", "p\r\nq"), ("2", "r")]
    (tmp_path / "b.csv").write_text("x,y\n")
    assert rows(read_split_csv(spark, str(tmp_path / "b.csv"))) == []
    (tmp_path / "c.csv").write_text('x,y\n1,"open')
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d" / "2.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_split_csv(spark, str(tmp_path / "d"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_split_csv(spark, str(tmp_path / "e.csv"))
