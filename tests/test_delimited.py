import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabulon.sources import delimited, sheets


def made(r, rows):
    """Text with fields of all kinds: quoted line breaks, quotes within, stray quotes, blank lines, each kind of line end."""
    kinds = ["7", "1,234", "", " ", "plain", "日本", '"a,b"', '"x\ny"', '"x\r\ny,""z"""', '"open""\n\nend"', 'st"ray', '"closed"more', '"closed"x"y', '""', "(5)", '"\r"']
    return "".join(",".join(r.choice(kinds) for _ in range(r.randint(1, 4))) + r.choice(["\n", "\n", "\r\n", "\r"]) if r.random() > 0.05 else r.choice(["\n", "\r\n"]) for _ in range(rows))


def cells(found, name):
    return sorted((x.row, x.col, x.text, x.number) for x in found if x.file == name and x.warning is None)


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("few", [100_000, 0])
def test_cells_equal_reading_whole(spark, tmp_path, monkeypatch, size, few):
    if few == 0 and size != 64:
        pytest.skip("one size by shuffle is enough")
    monkeypatch.setattr(delimited, "FEW", few)
    monkeypatch.setattr(delimited, "PIECE", 100)
    r, files = random.Random(size), {}
    for i in range(5):
        text = made(r, 60) + r.choice(["", "last", '"never closed\n1,2'])
        files[f"表 {i}+.csv"] = text.encode(["utf-8", "utf-8-sig", "cp950"][i % 3], "strict")
    files |= {"empty.csv": b"", "one.TXT": b"a", "lines.csv": b"\n\n\nx\n", "broken.csv": b"1,2\n" * 30 + b"\xff\xff\n", "quote.csv": b'"', "~$lock.csv": b"1", "other.dat": b"1"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found = delimited.read_delimited(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, content in files.items():
        if name not in ("broken.csv", "~$lock.csv", "other.dat"):
            assert cells(found, name) == sorted(sheets.csv_cells(content)), name
    assert {x.file for x in found if x.warning} == {"broken.csv"} and {x.file for x in found} <= {*files} - {"~$lock.csv", "other.dat"}
    assert {x.sheet for x in found if x.file.startswith("表 0")} == {"表 0+"}


def test_states_compose_as_the_reader_counts():
    r = random.Random(3)
    for _ in range(300):
        text = made(r, r.randint(1, 12)).replace("\r\n", "\n").replace("\r", "\n")
        head = '"' + text.replace('"', "") if r.random() < 0.5 else text
        (inside, n), _ = delimited.both_ways(head.encode())
        rows = list(csv.reader(io.StringIO(head, newline="")))
        assert n + inside == len(rows)
        rest = text.encode()
        closed, m = delimited.both_ways(rest)[1]
        whole = len(list(csv.reader(io.StringIO('"' + text, newline=""))))
        assert m + closed == whole


def test_a_record_longer_than_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "PIECE", 1000)
    long = "\n".join(str(i) for i in range(60_000))
    (tmp_path / "long.csv").write_text(f'a,b\n"{long}",2\nc,d\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = delimited.read_delimited(spark, f"file://{tmp_path}").orderBy("row", "col").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(x.row, x.col, x.text) for x in got] == [(1, 1, "a"), (1, 2, "b"), (2, 1, long), (2, 2, "2"), (3, 1, "c"), (3, 2, "d")]


def test_blocks_are_shared_among_tasks(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("1,2,3\n" * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = delimited.read_delimited(spark, f"file://{tmp_path}")
        assert got.count() == 600_000 and got.agg(F.max("row"), F.count_distinct("row")).first()[:] == (200_000, 200_000)
        assert delimited._lines(spark, f"file://{tmp_path}").rdd.getNumPartitions() >= 12
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
