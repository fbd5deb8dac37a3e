"""Data of charts: what is drawn is computed here, for all entities at once; missing points stay null, never 0.

Tables are (entity, period, measure, value) with any names; ``month`` keys are yyyymm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.model import NA, PASSED
from tabulon.operators.blocks import growth_rate, require
from tabulon.operators.metrics import previous_month


def at_latest(df: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, latest, now, before): each entity's value in the table's latest month with data, and in the month before."""
    require(df, entity, period, "value")
    last = df.where("value IS NOT NULL").agg(F.max(period).alias("latest"))
    rows = df.join(F.broadcast(last), F.col(period).isin(F.col("latest"), previous_month(F.col("latest"))))  # one row
    pick = lambda at: F.max(F.when(F.col(period) == at, F.col("value")))
    return rows.groupBy(entity, "latest").agg(pick(F.col("latest")).alias("now"), pick(previous_month(F.col("latest"))).alias("before"))


def largest(df: DataFrame, entity: str, period: str, n: int) -> DataFrame:
    """The n entities with the largest values in the latest month, with their position."""
    top = at_latest(df, entity, period).where("now IS NOT NULL").orderBy(F.desc("now"), entity).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("now"), entity)))


def scatter(df: DataFrame, entity: str, period: str, n: int = 15, scale: float = 1.0) -> DataFrame:
    """(entity, x, y, position): size over ``scale`` and growth on the month before of the n largest; those without a base go."""
    rows = largest(df, entity, period, n).withColumn("g", growth_rate(F.col("now"), F.col("before")))
    return rows.where("g.value IS NOT NULL").select(entity, (F.col("now") / scale).alias("x"), F.col("g.value").alias("y"), "position")


def monthly_growth_bars(df: DataFrame, entity: str, period: str, n: int = 10) -> DataFrame:
    """(entity, growth, position): growth on the month before of the n largest; those without a base go."""
    return scatter(df, entity, period, n).select(entity, F.col("y").alias("growth"), "position")


def share_pairs(df: DataFrame, entity: str, period: str, measure: str, first: str, second: str, n: int = 8) -> DataFrame:
    """(entity, first_share, second_share, position): shares of two measures in the latest month, for the n largest by the first."""
    share = lambda name: at_latest(df.where(F.col(measure) == name), entity, period).withColumn("share", F.try_divide(F.col("now"), F.sum("now").over(Window.partitionBy("latest"))) * 100).select(entity, F.col("share").alias(f"{name}_share"))
    top = largest(df.where(F.col(measure) == first), entity, period, n).select(entity, "position")
    out = top.join(share(first), entity, "left").join(share(second), entity, "left")
    return out.select(entity, F.col(f"{first}_share").alias("first_share"), F.col(f"{second}_share").alias("second_share"), "position")


def amount_per_unit(df: DataFrame, entity: str, period: str, measure: str, amount: str, units: str, factor: float = 1000.0, n: int | None = None) -> DataFrame:
    """(entity, per_unit): amount times ``factor`` over units in the latest month, rounded; entities without either go."""
    pick = lambda name: F.max(F.when(F.col(measure) == name, F.col("value")))
    last = df.where("value IS NOT NULL").agg(F.max(period).alias("latest"))
    rows = df.join(F.broadcast(last), F.col(period) == F.col("latest")).groupBy(entity).agg(pick(amount).alias("a"), pick(units).alias("u"))
    out = rows.where("a IS NOT NULL AND u > 0").select(entity, F.round(F.col("a") * factor / F.col("u"), 0).alias("per_unit"), "u")
    return (out if n is None else out.orderBy(F.desc("u"), entity).limit(n)).drop("u")


def stacked(df: DataFrame, entity: str, period: str, n: int = 5, scale: float = 1.0, places: int = 1) -> DataFrame:
    """(entity, period, value): every period of the n largest entities, scaled and rounded; periods without rows are null."""
    top = largest(df, entity, period, n).select(entity)
    grid = df.select(period).distinct().withColumn("_", F.lit(1)).join(F.broadcast(top.withColumn("_", F.lit(1))), "_").drop("_")  # n rows for each period
    sums = df.groupBy(entity, period).agg(F.max("value").alias("value"))
    return grid.join(sums, [entity, period], "left").select(entity, period, F.round(F.col("value") / scale, places).alias("value"))


def summary_table(df: DataFrame, entity: str, period: str, measure: str, names: list[str], n: int = 14) -> DataFrame:
    """One row for each of the n largest entities by the first measure, a column for each measure's latest value."""
    last = df.where("value IS NOT NULL").agg(F.max(period).alias("latest"))
    rows = df.join(F.broadcast(last), F.col(period) == F.col("latest")).groupBy(entity).agg(*(F.max(F.when(F.col(measure) == x, F.col("value"))).alias(x) for x in names))
    return rows.where(F.col(names[0]).isNotNull()).orderBy(F.desc(names[0]), entity).limit(n)


def chart_points(charts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(chart_id, series, position, label, metric_id, value, status): a row for each point of charts (chart_id, categories, series).

    series: array of (name, metric_ids). A label is the category at the point's place, null beyond them; an id that metrics
    (metric_id, value, status) lacks gives a null value and status.
    """
    each = charts.select("chart_id", "categories", F.explode("series").alias("s"))
    points = each.select("chart_id", F.col("s.name").alias("series"), "categories", F.posexplode("s.metric_ids").alias("position", "metric_id"))
    points = points.withColumn("label", F.get("categories", F.col("position"))).drop("categories")
    return points.join(metrics.select("metric_id", "value", "status"), "metric_id", "left").select("chart_id", "series", F.col("position").cast("long").alias("position"), "label", "metric_id", "value", "status")


def chart_status(points: DataFrame) -> DataFrame:
    """(chart_id, status): passed if all its points are; missing if none is known, else the worst of na, review and failed."""
    worst: Column = F.max(F.when(F.col("status") == PASSED, 0).when(F.col("status") == NA, 1).when(F.col("status") == "needs_manual_review", 2).when(F.col("status") == "failed", 3))
    name = F.when(F.col("w").isNull(), "missing").when((F.col("w") == 0) & F.col("gap"), NA)
    for k, x in enumerate((PASSED, NA, "needs_manual_review", "failed")):
        name = name.when(F.col("w") == k, x)
    return points.groupBy("chart_id").agg(worst.alias("w"), F.bool_or(F.col("status").isNull()).alias("gap")).select("chart_id", name.alias("status"))
