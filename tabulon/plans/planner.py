"""Rule-based metrics of all files in one plan: each file's largest detail fields in its latest period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.model import NA, PASSED
from tabulon.operators.blocks import growth_rate, ratio, total
from tabulon.operators.metrics import latest_top_fields

PLAN = "metric_id", "kind", "file", "sheet", "canonical", "period", "value", "unit", "status", "reason"


def metric_token(file: Column, canonical: Column) -> Column:
    """The start of a metric's id: the file's table number (its name up to the second ``-``), else eight characters, and the field."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    token = F.regexp_extract(stem, r"^[^-]+-[^-]+", 0)
    return F.replace(F.concat_ws("_", F.when(token != "", token).otherwise(F.substring(stem, 1, 8)), canonical), F.lit(" "), F.lit(""))


def field_values(long: DataFrame, places: int | None = None) -> DataFrame:
    """(file, sheet, canonical, aggregation_role, period, value): sums of fields; null where all cells are."""
    filled = F.when(F.count("value") > 0, total(F.col("value"), places))
    return long.where("period IS NOT NULL").groupBy("file", "sheet", "canonical", F.coalesce("aggregation_role", F.lit("detail")).alias("aggregation_role"), "period").agg(filled.alias("value"))


def rule_plan(long: DataFrame, units: DataFrame | None = None, top: int = 5, places: int | None = None) -> DataFrame:
    """PLAN rows: value, growth on the year before (yoy) and share of the total for each file's ``top`` fields.

    The total is the field of role total in the same file *and* sheet (the first by name); fields of sheets without one have no
    share. units: (file, sheet, canonical, unit); unknown otherwise. A missing value or base is na with its reason.
    """
    values = field_values(long, places)
    chosen = latest_top_fields(long, top, places).select("file", "canonical", F.col("period").alias("last"), "position")
    detail = values.where("aggregation_role = 'detail'").join(chosen, ["file", "canonical"])
    here = ["file", "sheet", "canonical"]
    now = F.max(F.when(F.col("period") == F.col("last"), F.col("value"))).alias("now")
    before = F.max(F.when(F.col("period") == F.col("last") - 1, F.col("value"))).alias("before")
    rows = detail.groupBy(*here, "last", "position").agg(now, before, F.bool_or(F.col("period") == F.col("last")).alias("there")).where("there")
    first = Window.partitionBy("file", "sheet", "period").orderBy("canonical")
    totals = values.where("aggregation_role = 'total'").withColumn("n", F.row_number().over(first)).where("n = 1")
    rows = rows.join(totals.select("file", "sheet", F.col("period").alias("last"), F.col("value").alias("all"), F.lit(True).alias("has_total")), ["file", "sheet", "last"], "left")
    if units is not None:
        rows = rows.join(units.select(*here, "unit").dropDuplicates(here), here, "left")
    unit = F.coalesce("unit", F.lit("未知")) if units is not None else F.lit("未知")
    token, year = metric_token(F.col("file"), F.col("canonical")), F.col("last").cast("string")
    value = F.struct(F.col("now").alias("value"), F.when(F.col("now").isNull(), NA).otherwise(PASSED).alias("status"), F.when(F.col("now").isNull(), "no value").alias("reason"))
    metric = lambda kind, suffix, result, unit: F.struct(F.lit(kind).alias("kind"), F.concat_ws("_", token, *suffix, year).alias("metric_id"), result.alias("r"), unit.alias("unit"))
    made = F.array(
        metric("value", [], value, unit), metric("yoy", [F.lit("yoy")], growth_rate(F.col("now"), F.col("before")), F.lit("%")),
        metric("share", [F.lit("share")], ratio(F.col("now"), F.col("all")), F.lit("%")),
    )
    out = rows.select(*here, F.col("last").alias("period"), "has_total", F.explode(made).alias("m")).where("m.kind <> 'share' OR has_total")
    return out.select("m.metric_id", "m.kind", *here, "period", "m.r.value", "m.unit", "m.r.status", "m.r.reason").select(*PLAN)


def trend_points(long: DataFrame, periods: int = 6, places: int | None = None) -> DataFrame:
    """(chart_id, metric_id, file, canonical, period, value): the last ``periods`` periods of each file's largest field.

    A period without rows is null, never 0; files with fewer than two periods that hold a value have no trend.
    """
    largest = latest_top_fields(long, 1, places).select("file", "canonical", F.col("period").alias("last"))
    grid = largest.withColumn("period", F.explode(F.sequence(F.col("last") - periods + 1, F.col("last"))))
    sums = field_values(long, places).where("aggregation_role = 'detail'").groupBy("file", "canonical", "period").agg(F.sum("value").alias("value"))
    points = grid.join(sums, ["file", "canonical", "period"], "left")
    points = points.withColumn("held", F.count("value").over(Window.partitionBy("file", "canonical"))).where("held >= 2")
    token = metric_token(F.col("file"), F.col("canonical"))
    return points.select(F.concat(F.lit("trend_"), token).alias("chart_id"), F.concat_ws("_", token, F.col("period").cast("string")).alias("metric_id"), "file", "canonical", "period", "value")
