"""Checks that give issues as rows, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.model import FAILED, NA, PASSED
from tabulon.operators.blocks import total
from tabulon.operators.medians import middles
from tabulon.tables import meet

# Units of percentages, and units whose values can't be negative.
PERCENT = ("%", "percent", "百分比")
NON_NEGATIVE = ("人次", "元", "美元", "夜")


def sanity(value: Column, unit: Column, is_share: Column) -> Column:
    """passed, na (missing) or failed: not finite, below -100 percent, a share outside 0..100, negative where that can't be."""
    bad = (
        F.isnan(value) | (F.abs(value) == float("inf")) | (unit.isin(*PERCENT) & (value < -100)) | (is_share & ((value < 0) | (value > 100)))
        | (unit.isin(*NON_NEGATIVE) & (value < 0))
    )
    return F.when(value.isNull(), NA).when(F.coalesce(bad, F.lit(False)), FAILED).otherwise(PASSED)


def cross_file_ambiguity(df: DataFrame) -> DataFrame:
    """Fields of one name in more than one file, with the files."""
    out = df.groupBy("canonical").agg(F.countDistinct("file").alias("n_files"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    return out.where("n_files > 1")


def component_check(df: DataFrame, by: list[str], tolerance: float = 0.005, places: int | None = None) -> DataFrame:
    """Reported total against the sum of components; passed within the relative tolerance, na without a total."""
    role = F.coalesce("aggregation_role", F.lit("detail"))
    out = df.groupBy(*by).agg(F.max(F.when(role == "total", F.col("value"))).alias("reported"), total(F.when(~role.isin("total", "subtotal"), F.col("value")), places).alias("computed"))
    gap = F.try_divide(F.abs(F.col("computed") - F.col("reported")), F.abs("reported"))
    return out.withColumn("status", F.when(gap.isNull(), NA).when(gap > tolerance, FAILED).otherwise(PASSED))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, nulls equal, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def period_gaps(df: DataFrame, entity: list[str], period: str, following) -> DataFrame:
    """Neighbouring periods of an entity between which ``following``(period) is missing."""
    w = Window.partitionBy(*entity).orderBy(period)
    rows = df.select(*entity, period).where(F.col(period).isNotNull()).distinct().withColumn("next", F.lead(period).over(w))
    return rows.where(F.col("next").isNotNull() & (F.col("next") != following(F.col(period))))


def missing_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows without a value."""
    return df.where(F.col("value").isNull() | F.isnan("value")).select(*keys)


def negative_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and values of negative rows."""
    return df.where("value < 0").select(*keys, "value")


def share_sums(shares: DataFrame, by: list[str], tolerance: float = 0.5, places: int = 6) -> DataFrame:
    """Sum of shares of each group and whether it is 100 within the tolerance."""
    out = shares.groupBy(*by).agg(F.round(F.sum("share"), places).alias("share_sum"))
    return out.withColumn("status", F.when(F.abs(F.col("share_sum") - 100) <= tolerance, PASSED).otherwise(FAILED))


def numeric_profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, range, median, whether all are whole or within -100..100, magnitude and whether any is negative."""
    v = F.col("value")
    rows = df.where(v.isNotNull())
    out = rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.bool_and(v == F.floor(v)).alias("whole"), F.bool_and(F.abs(v) <= 100).alias("percent_like"), F.bool_or(v < 0).alias("negative"),
    )
    out = meet(out, middles(rows, by), by)
    magnitude = F.when(F.col("size") > 0, F.floor(F.log10("size"))).otherwise(0).cast("long")
    return out.withColumn("magnitude", magnitude).drop("size")


def range_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """The rectangle of cells of each group."""
    return df.groupBy(*by).agg(*(f(c).cast("long").alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "min"), (F.max, "max"))))


