"""Running sums and positions over a whole table, in many tasks.

Keys are cut into ranges at sampled bounds. The ranges' totals, a few numbers, give each range its start; within a range a
window does the rest, so the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range holds, about; ranges at most, and those of one step of the search for a row's range.
RANGE, MOST, STEP = 100_000, 4096, 64
#: Sampled keys for each bound, about.
SAMPLE = 16


def _bounds(rows: DataFrame, n: int, key: str = "key") -> list:
    """Keys that cut the rows into ranges of like size, from a sample by hash of about SAMPLE keys for each."""
    parts = min(MOST, -(-n // RANGE))
    if parts < 2:
        return []
    share = int((1 << 30) * min(1.0, parts * SAMPLE / n))
    found = [r[0] for r in rows.select(key).distinct().where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).orderBy(key).collect()]
    cuts = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    return [k for i, k in enumerate(cuts) if not i or k != cuts[i - 1]]


def running(rows: DataFrame, sums: list[str], descending: bool = False, key: str = "key") -> DataFrame:
    """rows (a struct called key, and others) with ``<sum>_upto`` for each column of sums: its sum over the rows up to and with this one.

    Rows are in order of key, nulls first (last with ``descending``); rows of equal keys are in any order, in one range. A sum is null until its
    first value. Up to RANGE rows are one range.
    """
    first = F.desc(key) if descending else F.asc(key)
    bounds = _bounds(rows, rows.count(), key)
    if not bounds:
        own = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({f"{s}_upto": F.sum(s).over(own) for s in sums})
    kind = rows.schema[key].dataType.simpleString()
    steps = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    table = rows.sparkSession.createDataFrame([([s[0] for s in steps], steps)], f"_heads array<{kind}>, _steps array<array<{kind}>>")
    step = F.size(F.filter("_heads", lambda h: h <= F.col(key)))
    block = F.when(step == 0, 0).otherwise((step - 1) * STEP + F.size(F.filter(F.element_at("_steps", F.greatest(step, F.lit(1))), lambda b: b <= F.col(key))))
    ranged = rows.join(F.broadcast(table)).withColumn("_block", block).drop("_heads", "_steps")  # the bounds are one row
    before = Window.orderBy(F.desc("_block") if descending else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_block").agg(*(F.sum(s).alias(s) for s in sums)).select("_block", *(F.sum(s).over(before).alias(f"_{s}_start") for s in sums))
    own = Window.partitionBy("_block").orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(starts), "_block")  # MOST rows at most

    def upto(s: str) -> Column:
        here, start = F.sum(s).over(own), F.col(f"_{s}_start")
        return F.coalesce(start + here, start, here)

    return out.withColumns({f"{s}_upto": upto(s) for s in sums}).drop("_block", *(f"_{s}_start" for s in sums))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """df with each named sum running over all rows up to the row's key, rows of equal keys among them (SQL's default frame).

    sums are aggregates, such as ``F.sum("v")`` or ``F.count("v")``. Null keys come first, with ``descending`` last. Equal keys are summed
    before they are put in order, so one that holds a third of the table is one row there.
    """
    rows = df.withColumn("_key", F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order))))
    short = {n: f"s{i}" for i, n in enumerate(sums)}
    totals = rows.groupBy(F.col("_key").alias("key")).agg(*(c.alias(short[n]) for n, c in sums.items()))
    placed = running(totals, list(short.values()), descending).select(F.col("key").alias("_at"), *(F.col(f"{s}_upto").alias(f"_{s}") for s in short.values()))
    out = rows.join(placed, F.col("_key").eqNullSafe(F.col("_at")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"_{s}").alias(n) for n, s in short.items()))


def ranks(df: DataFrame, order: list[str], name: str = "rank", descending: bool = False) -> DataFrame:
    """df with each row's competition rank (1, 1, 3) over the whole table; null keys come first, with ``descending`` last."""
    rows = df.withColumn("_key", F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order))))
    placed = running(rows.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n")), ["n"], descending)
    placed = placed.select(F.col("key").alias("_at"), (F.col("n_upto") - F.col("n") + 1).alias(name))
    return rows.join(placed, F.col("_key").eqNullSafe(F.col("_at"))).select(*(F.col(f"`{c}`") for c in df.columns), name)
