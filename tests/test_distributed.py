import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon.operators import firsts, medians, running
from tabulon.tables import meet


@pytest.fixture(scope="module")
def rows(spark):
    """A hot key, ties, missing values and keys, values of all sizes and both signs."""
    r = random.Random(1)
    data = []
    for i in range(4000):
        key = r.choice(["hot", "hot", "a", "b", None, "same"])
        value = {"same": 7.0, "a": r.choice([1.0, 2.0]), "b": r.uniform(-1, 1) * 10 ** r.randint(-200, 200)}.get(key, float(r.randint(-50, 50)) if r.random() < 0.7 else r.gauss(0, 1e6))
        data.append((key, r.choice([None, float("nan"), value, value, value]) if r.random() < 0.2 else value, r.choice([None, *range(40)]), i))
    data += [("one", 3.5, 1, 4000), ("two", 1.0, 1, 4001), ("two", 2.0, 1, 4002), ("none", None, 1, 4003), ("inf", float("inf"), 1, 4004), ("inf", 1.0, 1, 4005), ("inf", float("-inf"), 1, 4006)]
    return spark.createDataFrame(data, "key string, value double, step int, id long").cache()


def told(rows, sql):
    t = rows.toPandas()  # noqa: F841
    t["step"] = t["step"].astype("Int64")
    return duckdb.sql(sql.replace("FROM t", "FROM (SELECT * REPLACE (CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM t)")).fetchall()


@pytest.mark.parametrize("leaf", [10_000, 50, 2])
def test_medians_equal_sql(spark, rows, monkeypatch, leaf):
    monkeypatch.setattr(medians, "LEAF", leaf)
    more = rows.unionByName(rows.where("key = 'hot'").limit(1)) if leaf == 50 else rows  # an odd and an even count
    got = {r.key: (r.n, r.median) for r in medians.medians(more, ["key"]).collect()}
    want = {k: (n, m) for k, n, m in told(more, "SELECT key, COUNT(value), median(value) FROM t WHERE key IS DISTINCT FROM 'inf' GROUP BY key")}
    assert got.pop("inf") == (3, 1.0)
    assert got.keys() == want.keys() and all(got[k] == want[k] or got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-15) for k in want)
    assert medians.medians(rows.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("size", [100_000, 3])
def test_running_sums_and_ranks_equal_sql(spark, rows, monkeypatch, size):
    monkeypatch.setattr(running, "RANGE", size)
    whole = rows.withColumn("value", F.floor(F.when(F.abs("value") < 1e9, F.nanvl("value", F.lit(None).cast("double")))))
    got = running.ranks(running.running_sums(whole, ["step", "key"], {"sum": F.sum("value"), "n": F.count("value")}), ["step"]).collect()
    want = told(whole, "SELECT id, SUM(value) OVER (ORDER BY step NULLS FIRST, key NULLS FIRST), COUNT(value) OVER (ORDER BY step NULLS FIRST, key NULLS FIRST), rank() OVER (ORDER BY step NULLS FIRST) FROM t")
    assert sorted((r.id, r["sum"], r.n, r["rank"]) for r in got) == sorted((i, None if s is None else int(s), n, k) for i, s, n, k in want)
    down = running.running_sums(whole, ["id"], {"sum": F.sum("value")}, descending=True).collect()
    assert sorted((r.id, r["sum"]) for r in down) == sorted((i, None if s is None else int(s)) for i, s in told(whole, "SELECT id, SUM(value) OVER (ORDER BY id DESC) FROM t"))
    assert running.running_sums(whole.limit(0), ["id"], {"sum": F.sum("value")}).count() == 0


def test_ranges_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE", 1000)
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.lit(1).alias("v"))
    bounds = running._bounds(rows.select(F.struct("k").alias("key")), 20_000)
    assert 10 <= len(bounds) <= 20 and len({b.k for b in bounds}) == len(bounds)
    out = running.running_sums(rows, ["k"], {"n": F.sum("v")})
    assert out.where("n <> (k + 1) * 4").count() == 0 and out.count() == 20_000


def test_first_values_equal_a_sort(spark, rows):
    got = {r.key: r.ids for r in firsts.first_values(rows, ["key"], ["step", "id"], F.col("id"), 5, "ids").collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.step is not None, r.step or 0, r.id)):
        want.setdefault(r.key, []).append(r.id)
    assert got == {k: v[:5] for k, v in want.items()}
    plan = firsts.first_rows(rows, ["key"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_meet_takes_nulls_as_equal(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string"), spark.createDataFrame([(None, "z"), (2, "w")], "k int, b string")
    assert {tuple(r) for r in meet(a, b, ["k"]).collect()} == {(None, "y", "z")}
    assert {tuple(r) for r in meet(a, b, ["k"], "full").collect()} == {(None, "y", "z"), (1, "x", None), (2, None, "w")}
