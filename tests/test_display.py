"""Texts of values that lie between two roundings, against SQL in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import differences
from tabulon import table_queries as Q
from tabulon.functions import scalar as S

BETWEEN = [1.005, 0.125, 0.375, -87.425, 343.135, 1075.975, 2.675, -0.0, 0.0, 12500.0, 13500.0, 14500.0, -24500.0, 100500000.0, 1e15 + 0.5, 9.3e18, -5.5, None]


def test_legacy_display_between_roundings(spark, tmp_path):
    rows = [(5 * i + k, x) for i, x in enumerate(BETWEEN) for k in range(5)] + [(None, 14500.0), (-3, 2.5), (-4, 1.005)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert differences(spark, c, str(tmp_path), Q.legacy_display, Q.SQL["legacy_display"]) == ""


@pytest.mark.parametrize("places", [1, 2])
def test_fixed_rounds_as_python(spark, places):
    values = [(i * 125 + j) / 1000 for i in range(-400, 400) for j in (0, 5, 50)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", S.fixed(F.col("x"), places)).collect()
    assert [(x, t) for x, t in got if t != f"{x:.{places}f}"] == []
