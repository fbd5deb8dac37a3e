import pytest
from pyspark.sql import functions as F

from tabulon.sources import grid as G
from tabulon.sources import sheets
from test_engine import CSV, xlsx


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "表 1.csv").write_bytes(CSV.encode("cp950"))
    (tmp_path / "two.txt").write_text('a,"b\nc"\n1,(2)\n')
    (tmp_path / "book.xlsx").write_bytes(xlsx([["x", 1], ["y", 2]], (), "s"))
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xff\xff")
    for name in ("old.xls", "~$book.xlsx", "notes.md"):
        (tmp_path / name).write_bytes(b"x")
    G.register(spark)
    return tmp_path


def rows(df):
    return sorted((tuple(x) for x in df.withColumn("warning", F.substring("warning", 1, 16)).collect()), key=str)


def test_source_equals_read_grid(spark, folder):
    found = spark.read.format("grid").load(str(folder))
    assert rows(found) == rows(sheets.read_grid(spark, f"file://{folder}")) and rows(found) == rows(spark.read.format("grid").load(f"file://{folder}"))
    assert {x.file for x in found.where("warning IS NOT NULL").collect()} == {"broken.xlsx", "bad.csv", "old.xls"}


def test_named_files_and_sheets_alone_are_opened(spark, folder):
    found = spark.read.format("grid").load(str(folder))
    one = G.load(spark, str(folder), ["two.txt"])
    assert one.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() == 6
    assert [(x.row, x.col, x.text, x.number) for x in one.orderBy("row", "col").collect()] == [(1, 1, "a", None), (1, 2, "b\nc", None), (2, 1, "1", 1.0), (2, 2, "(2)", -2.0)]
    two = G.load(spark, str(folder), ["two.txt", "book.xlsx"], ["s"])
    assert {x.file for x in two.collect()} == {"book.xlsx"}
    assert G.load(spark, str(folder), ["nowhere.csv"]).count() == 0 and G.load(spark, str(folder), []).count() == 0


def test_scans_of_one_frame_keep_their_own_filters(spark, folder):
    found = spark.read.format("grid").load(str(folder))
    n = found.count()
    parts = [found.where(F.col("file") == x) for x in ("two.txt", "book.xlsx")]
    assert [p.count() for p in parts] == [4, 4] and parts[0].union(parts[1]).count() == 8 and found.count() == n


def test_folder_without_readable_files(spark, tmp_path):
    (tmp_path / "old.xls").write_bytes(b"x")
    G.register(spark)
    with pytest.raises(Exception, match="no file of xlsx"):
        spark.read.format("grid").load(str(tmp_path)).collect()
