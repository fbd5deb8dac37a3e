import random

import pytest

from tabulon.plans import batch
from tabulon.plans.recipe import Recipe, compile_all, compile_recipe

LONG = "period int, canonical string, dimension string, value double, file string, sheet string, row int, col int, aggregation_role string"


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        name = r.choice([f"f{k}" for k in range(8)] + [None])
        rows.append((r.choice([2021, 2022, 2023, None]), name, f"d{name}", r.choice([None, float("nan"), round(r.uniform(-100, 900), 2)]), r.choice(["a", "a", "b"]), r.choice(["s", "t"]), i, r.choice([None, 1, 2, 30]), r.choice(["detail", "detail", "subtotal", "total", None])))
    return spark.createDataFrame(rows, LONG).cache()


def step(name, block, source="dataset", **params):
    return {"id": name, "block": block, "input": source, "params": params}


def recipes(n):
    r = random.Random(2)
    out = []
    for i in range(n):
        year, name = r.choice([2021, 2022, 2023, 1999]), r.choice([f"f{k}" for k in range(9)])
        now = step("now", "filter_by_period", start=year, end=year)
        one = step("one", "filter", "now", column="canonical", operator=r.choice(["==", "in"]), value=name)
        if one["params"]["operator"] == "in":
            one["params"]["value"] = [name, "f1"]
        file = step("file", "filter", "one", column="file", operator="==", value=r.choice("ab"))
        total = step("n", r.choice(["group_sum", "group_mean"]), r.choice(["one", "file"]), places=4, detail_only=r.choice([True, False]))
        steps, output, more = [now, one, file, total], "n", {}
        kind = r.randrange(4)
        if kind == 1:
            steps += [step("all", "group_sum", "now", places=4), {"id": "out", "block": "ratio", "params": {"numerator": {"$ref": "n"}, "denominator": {"$ref": "all"}, "as_percent": r.choice([True, False])}}]
            output, more = "out", {"is_share": True}
        if kind == 2:
            before = step("before", "filter_by_period", start=year - 1, end=year - 1)
            steps += [before, step("old", "filter", "before", column="canonical", operator="==", value=name), step("m", "group_sum", "old", places=4), {"id": "out", "block": "growth_rate", "params": {"current": {"$ref": "n"}, "previous": {"$ref": "m"}}}]
            output = "out"
        if kind == 3:
            steps += [{"id": "out", "block": "ratio", "params": {"numerator": {"$ref": "n"}, "denominator": r.choice([3, 0, None, 2.5])}}]
            output = "out"
        out.append({"metric_id": f"m{i}", "metric_name": f"M {i}", "unit": r.choice(["%", "元", "x"]), "period": year, "assumption_statement": "none", "steps": steps, "output": output, **more})
    return out


def told(rows):
    close = lambda v: None if v is None else round(v, 9)
    return sorted([str((*(close(x) if isinstance(x, float) else x for x in r),)) for r in rows])


def test_rows_equal_one_plan_each(spark, data):
    many = [Recipe.parse(x) for x in recipes(30)]
    assert all(batch.takes(r, data) for r in many)
    want = [r for x in many for r in compile_recipe(x, data).collect()]
    assert told(batch.compile_batch(many, data).collect()) == told(want) and {x.status for x in want} == {"passed", "na", "failed"}


def test_two_hundred_recipes_scan_once(spark, data, tmp_path):
    data.write.parquet(f"{tmp_path}/long")
    table = spark.read.parquet(f"{tmp_path}/long")
    many = [Recipe.parse(x) for x in recipes(200)]
    leaves = sorted({x for r in many for x in batch._sides(r, table).values() if isinstance(x, batch.Leaf)}, key=repr)
    assert len(leaves) > 100
    plan = batch._matched(leaves, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("BroadcastHashJoin") == 1
    out = batch.compile_batch(many, table)
    assert out.count() == 200 and f"{tmp_path}/long" not in "".join(out.inputFiles())


def test_table_of_requests_beyond_a_broadcast(spark, data, monkeypatch):
    many = [Recipe.parse(x) for x in recipes(12)]
    want = told(batch.compile_batch(many, data).collect())
    monkeypatch.setattr(batch, "FEW", 0)
    assert told(batch.compile_batch(many, data).collect()) == want


def test_what_a_batch_leaves_to_a_plan_of_its_own(spark, data):
    base = recipes(1)[0]
    other = lambda steps, output: Recipe.parse({**base, "steps": steps, "output": output})
    like = step("f", "filter", column="canonical", operator="contains", value="f")
    for r in (other([like, step("n", "group_sum", "f")], "n"), other([step("f", "filter", column="value", operator="==", value=1.5), step("n", "group_sum", "f")], "n"), other([step("t", "rank_top_n", n=1)], "t"), other([step("p", "filter_by_period", start=3, end=1), step("n", "group_sum", "p")], "n")):
        assert not batch.takes(r, data)
    few = [{**base, "metric_id": "own", "steps": [like, step("y", "filter_by_period", "f", start=2022, end=2022), step("n", "group_sum", "y", places=4)], "output": "n"}, *recipes(3), {"metric_id": "bad"}]
    made, refused = compile_all(few, data)
    assert sorted(r.metric_id for r in made.collect()) == ["m0", "m1", "m2", "own"] and [x for x, _ in refused] == ["bad"]
    two = other([step("n", "group_sum")], "n")
    assert batch.takes(two, data)
    with pytest.raises(Exception, match="more than one row"):
        batch.compile_batch([two], data).collect()
