"""Exact medians of all groups at once, with a bounded state: brackets from mergeable sketches, narrowed by exact counts.

A round asks a sketch for values close to each open group's median on both sides and counts exactly what lies below, at, between and above
them; the part that holds the median's rank goes on to the next round. Groups with LEAF values or fewer left, and those whose part is a
single value, are open no more; their last values are picked by rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.blocks import present
from tabulon.tables import cut, discard, meet

#: Values of a group that one task puts in order; accuracy of the sketches (their size), and the share of ranks on each side of a bracket.
LEAF, ACCURACY, ASIDE = 1_000_000, 1000, 0.002
PARTS = range(5)


def medians(df: DataFrame, by: list[str], value: str = "value", name: str = "median") -> DataFrame:
    """(by, n, name): how many values a group has and their median, halfway between the middle two of an even number.

    Missing values (null, NaN) don't count; a group without values has n 0 and a null median. Null keys are a group.
    """
    v = present(F.col(value).cast("double"))
    rows = df.select(*by, v.alias("_v"))
    state = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = state.withColumns({"_left": F.col("n"), "_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2)})  # ranks of the middle two among what is left
    wide = (F.col("_left") > max(LEAF, 2)) & (F.col("_low") < F.col("_high"))
    state = cut(state)
    keep = [*by, "n", "_low", "_high", "_left", "_a", "_b"]
    while not state.where(wide).isEmpty():
        found = meet(rows.where("_v IS NOT NULL"), state.where(wide), by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        sketch = found.groupBy(*by).agg(F.percentile_approx("_v", [0.5 - ASIDE, 0.5 + ASIDE], ACCURACY).alias("_mid"), F.percentile_approx("_v", [i / 32 for i in range(33)], ACCURACY).alias("_grid"), F.first("_a").alias("_rank"), F.first("_left").alias("_of"))
        at = F.col("_rank") / F.col("_of")
        lower, upper = F.greatest(F.floor((at - ASIDE) * 32).cast("int"), F.lit(0)), F.least(F.ceil((at + 2 * ASIDE) * 32).cast("int"), F.lit(32))
        middle = F.abs(at - 0.5) < ASIDE / 2
        sketch = sketch.select(*by, F.when(middle, F.col("_mid")[0]).otherwise(F.element_at("_grid", lower + 1)).alias("_p"), F.when(middle, F.col("_mid")[1]).otherwise(F.element_at("_grid", upper + 1)).alias("_q"))
        x, p, q = F.col("_v"), F.col("_p"), F.col("_q")
        part = F.when(x < p, 0).when(x == p, 1).when(x < q, 2).when(x == q, 3).otherwise(4)  # two of them are single values, so every round gets on
        seen = meet(found, sketch, by)
        cases = {k: F.when(part == k, x) for k in PARTS}
        counts = seen.groupBy(*by).agg(*(f(c).alias(f"_{t}{k}") for k, c in cases.items() for t, f in (("n", F.count), ("min", F.min), ("max", F.max))))
        out = meet(state.where(wide), counts, by)
        ends = [sum((F.col(f"_n{j}") for j in range(k)), F.lit(0)) for k in range(len(PARTS) + 1)]
        inside = lambda k, r: (F.col(r) >= ends[k]) & (F.col(r) < ends[k + 1])
        new = {"_low": None, "_high": None, "_left": None, "_a2": None, "_b2": None}
        pick = lambda f: F.coalesce(*(F.when(inside(k, "_a") & inside(k, "_b"), f(k)) for k in PARTS))
        split = lambda r, t: F.coalesce(*(F.when(inside(k, r), F.col(f"_{t}{k}")) for k in PARTS))
        new["_low"] = F.coalesce(pick(lambda k: F.col(f"_min{k}")), split("_a", "max"))  # the middle two on two sides of a cut are its neighbours
        new["_high"] = F.coalesce(pick(lambda k: F.col(f"_max{k}")), split("_b", "min"))
        new["_left"] = F.coalesce(pick(lambda k: F.col(f"_n{k}")), F.lit(2))
        new["_a2"] = F.coalesce(pick(lambda k: F.col("_a") - ends[k]), F.lit(0))
        new["_b2"] = F.coalesce(pick(lambda k: F.col("_b") - ends[k]), F.lit(1))
        out = out.select(*by, "n", *(c.alias(f"_new{i}") for i, c in enumerate(new.values()))).toDF(*keep)
        before, state = state, cut(state.where(~F.coalesce(wide, F.lit(False))).unionByName(out))
        discard(before)
    return _picked(rows, state, by, name)


def _picked(rows: DataFrame, state: DataFrame, by: list[str], name: str) -> DataFrame:
    """The medians of groups of which LEAF values are left at most, or neighbours of a cut, or one value."""
    told = (F.col("_low") == F.col("_high")) | ((F.col("_left") == 2) & (F.col("_a") == 0) & (F.col("_b") == 1)) | F.col("_low").isNull()
    leaves = meet(rows.where("_v IS NOT NULL"), state.where(~told), by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    leaves = leaves.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1)
    ends = leaves.groupBy(*by, "n").agg(F.max(F.when(F.col("_at") == F.col("_a"), F.col("_v"))).alias("_low"), F.max(F.when(F.col("_at") == F.col("_b"), F.col("_v"))).alias("_high"))
    both = state.where(told).select(*by, "n", "_low", "_high").unionByName(ends)
    return both.select(*by, "n", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias(name))


def middles(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, median, size): the medians of a column and of its absolute values, found together."""
    v = F.col(value).cast("double")
    both = df.select(*by, F.explode(F.array(F.struct(F.lit(False).alias("_size"), v.alias("v")), F.struct(F.lit(True).alias("_size"), F.abs(v).alias("v")))).alias("_x")).select(*by, "_x.*")
    found = medians(both, [*by, "_size"], "v")
    return found.groupBy(*by).agg(F.max(F.when(~F.col("_size"), F.col("median"))).alias("median"), F.max(F.when(F.col("_size"), F.col("median"))).alias("size"))
