"""Business metrics over whole long tables: one grouped or windowed plan gives every entity's figure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.blocks import exclude_aggregates, growth_rate, ratio, total
from tabulon.operators.medians import medians
from tabulon.tables import meet


def market_total(df: DataFrame, by: list[str], places: int | None = None) -> DataFrame:
    """Total of each group: the reported total row if there is one, else the sum of details."""
    role = F.coalesce("aggregation_role", F.lit("detail"))
    told = F.max(F.when(role == "total", F.col("value")))
    made = total(F.when(~role.isin("total", "subtotal"), F.col("value")), places)
    return df.groupBy(*by).agg(F.coalesce(told, made).alias("market_total"))


def market_share(df: DataFrame, by: list[str], places: int | None = None) -> DataFrame:
    """Detail rows with market_total and share (percent of it; null with a zero or missing total)."""
    whole = market_total(df, by, places)
    rows = exclude_aggregates(df).join(whole, by)
    return rows.withColumn("share", ratio(F.col("value"), F.col("market_total"))["value"])


def share_change(shares: DataFrame, entity: list[str], period: str = "period", places: int = 2) -> DataFrame:
    """Change of share in points from the period before, each share rounded first, the result to twice the places."""
    w = Window.partitionBy(*entity).orderBy(period)
    now, before = F.round("share", places), F.round(F.lag("share").over(w), places)
    near = F.lag(period).over(w) == F.col(period) - 1
    return shares.withColumn("share_change", F.when(near, F.round(now - before, 2 * places)))


def previous_month(month):
    """Key of the month before a yyyymm key."""
    return F.when(month % 100 == 1, month - 89).otherwise(month - 1)


def growth(df: DataFrame, entity: list[str], period: str, previous) -> DataFrame:
    """value, base, growth (percent), status and reason of each row against its entity's row at key ``previous``(period).

    A self-join on keys: periods without a row before are not available, with a reason; gaps don't shift the base.
    """
    base = df.select(*(F.col(c).alias(f"_{c}") for c in entity), F.col(period).alias("_at"), F.col("value").alias("base"))
    cond = previous(F.col(period)).eqNullSafe(F.col("_at"))
    for c in entity:
        cond &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = df.join(base, cond, "left").withColumn("g", growth_rate(F.col("value"), F.col("base")))
    return rows.select(*entity, period, "value", "base", F.col("g.value").alias("growth"), "g.status", "g.reason")


def unique_ranking(df: DataFrame, by: list[str], ties: list[str], top: int | None = None) -> DataFrame:
    """Rows numbered 1.. by falling value within each group, totals left out; nulls last."""
    w = Window.partitionBy(*by).orderBy(F.col("value").desc_nulls_last(), *ties)
    out = exclude_aggregates(df).withColumn("position", F.row_number().over(w).cast("long"))
    return out if top is None else out.where(F.col("position") <= top)


def quadrants(df: DataFrame, x: str, y: str, by: list[str], how: str = "median") -> DataFrame:
    """Each row's quadrant by whether x and y reach their group's median or mean."""
    if how == "median":
        rows = df
        for c, cut_name in ((x, "x_cut"), (y, "y_cut")):
            rows = meet(rows, medians(df, by, c, cut_name).drop("n"), by)
    else:
        rows = meet(df, df.groupBy(*by).agg(F.avg(x).alias("x_cut"), F.avg(y).alias("y_cut")), by)
    high_x, high_y = F.col(x) >= F.col("x_cut"), F.col(y) >= F.col("y_cut")
    name = F.when(high_x & high_y, "large_growing").when(high_x, "large_slow").when(high_y, "small_growing").otherwise("small_slow")
    return rows.withColumn("quadrant", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), name))


def minmax(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Values scaled to 0..1 within each group; 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))
    return df.withColumn("scaled", F.when(F.col(value).isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))))


def latest_top_fields(df: DataFrame, n: int, places: int | None = None) -> DataFrame:
    """For each file, its n largest detail fields by summed value in its latest period with data."""
    rows = df.where(F.coalesce("aggregation_role", F.lit("detail")) == "detail")
    last = rows.where("value IS NOT NULL").groupBy("file").agg(F.max("period").alias("period"))
    sums = rows.join(last, ["file", "period"]).groupBy("file", "period", "canonical").agg(total(F.col("value"), places).alias("value"))
    w = Window.partitionBy("file").orderBy(F.col("value").desc(), "canonical")
    return sums.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= n)


def trend(df: DataFrame, keys: list[str], periods: int) -> DataFrame:
    """The last ``periods`` periods up to each file's latest, for each key; a period without rows is null, never 0."""
    last = df.where("value IS NOT NULL").groupBy("file").agg(F.max("period").alias("last"))
    grid = df.select("file", *keys).distinct().join(last, "file").select("file", *keys, F.explode(F.sequence(F.col("last") - periods + 1, F.col("last"))).alias("period"))
    return grid.join(df.select("file", *keys, "period", "value"), ["file", *keys, "period"], "left")


def first_to_last(df: DataFrame, entity: list[str], period: str = "period") -> DataFrame:
    """Growth from each entity's first to its latest period."""
    ends = df.where("value IS NOT NULL").groupBy(*entity).agg(F.min_by("value", period).alias("first"), F.max_by("value", period).alias("last"))
    return ends.withColumn("growth", growth_rate(F.col("last"), F.col("first"))["value"])
