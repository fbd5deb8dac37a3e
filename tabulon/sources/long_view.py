"""Long tables made of relational ones: a value for each period and field, with roles and cell coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def revenue(spark: SparkSession, folder: str, monthly: bool = False) -> DataFrame:
    """(period, r_name, n_name, n_nationkey, r_regionkey, level, v): revenue of suppliers' nations, of regions and of all, in one aggregate.

    level: 0 for a nation, 1 for a region, 2 for all. Dimension tables join after the first sum.
    """
    when = F.year("l_shipdate") * 100 + F.month("l_shipdate") if monthly else F.year("l_shipdate")
    v = F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(MONEY))
    sums = table(spark, folder, "lineitem").groupBy(when.alias("period"), "l_suppkey").agg(F.sum(v).alias("v"))
    place = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = sums.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    period, region, nation = ["period"], ["r_name", "r_regionkey"], ["n_name", "n_nationkey"]
    found = rows.groupingSets([period + region + nation, period + region, period], *period, *region, *nation).agg(F.sum("v").alias("v"), F.grouping_id().alias("g"))
    return found.withColumn("level", F.when(F.col("g") == 0, 0).when(F.col("g") == 0b00011, 1).otherwise(2)).drop("g")


def _long(rows: DataFrame, canonical, dimension, sheet, col, role, file: str = "lineitem") -> DataFrame:
    return rows.select(
        F.col("period").cast("int").alias("period"), canonical.alias("canonical"), dimension.alias("dimension"), F.col("v").cast("double").alias("value"),
        F.lit(file).alias("file"), sheet.alias("sheet"), (F.col("period") % 100 + 3).cast("int").alias("row"), col.cast("int").alias("col"), role.alias("aggregation_role"),
    )


def sales(spark: SparkSession, folder: str, monthly: bool = False) -> DataFrame:
    """Revenue by period and nation, with a subtotal for each region and a total."""
    level, region = F.col("level"), F.col("r_name")
    by_level = lambda *xs: F.when(level == 0, xs[0]).when(level == 1, xs[1]).otherwise(xs[2])
    return _long(
        revenue(spark, folder, monthly), by_level(F.concat(F.lit("revenue_"), "n_name"), F.concat(F.lit("revenue_"), region, F.lit("_subtotal")), F.lit("revenue_total")),
        by_level(F.concat(region, F.lit(" > "), "n_name"), F.concat(region, F.lit(" > subtotal")), F.lit("total")), by_level(region, region, F.lit("all")),
        by_level(F.col("n_nationkey") + 2, F.col("r_regionkey") + 100, F.lit(200)), by_level(F.lit("detail"), F.lit("subtotal"), F.lit("total")),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals by year and the customer's nation, under the same field names in another file."""
    sums = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("period"), "o_custkey").agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("v"))
    rows = sums.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("period", "r_name", "n_name", "n_nationkey").agg(F.sum("v").alias("v"))
    return _long(rows, F.concat(F.lit("revenue_"), "n_name"), F.concat("r_name", F.lit(" > "), "n_name"), F.col("r_name"), F.col("n_nationkey") + 2, F.lit("detail"), "orders")


SHEETS_FILE = "表1-1-arrivals.xlsx"


def sheet_cells(spark: SparkSession, folder: str, transposed: bool = False) -> DataFrame:
    """Order totals as a workbook's cells: a sheet for each region with a title, a header row, a footnote and periods down or across.

    Upright: row 2 names the nations, years like 84年1995 go down from row ``period - 1990``. Transposed: row 2 holds the years,
    nations go down.
    """
    rows = orders(spark, folder).select("period", "sheet", "value", F.element_at(F.split("dimension", " > "), 2).alias("nation"), (F.col("col") - 1).alias("n"))
    year, low = F.col("period").cast("string"), F.col("period") - 1990

    def cells(df: DataFrame, row, col, text, number=None) -> DataFrame:
        n = F.lit(None).cast("double") if number is None else number
        return df.select(F.lit(SHEETS_FILE).alias("file"), "sheet", row.cast("int").alias("row"), col.cast("int").alias("col"), text.alias("text"), n.alias("number"))

    sheets = rows.select("sheet").distinct()
    nations, periods = rows.select("sheet", "nation", "n").distinct(), rows.select("sheet", "period").distinct()
    down, across = (F.col("n") + 2, low) if transposed else (low, F.col("n") + 1)
    value = F.col("value")
    out = cells(sheets, F.lit(1), F.lit(1), F.col("sheet")).unionByName(cells(sheets, F.lit(2), F.lit(1), F.lit("name" if transposed else "年度 year")))
    out = out.unionByName(cells(sheets, F.lit(60), F.lit(1), F.lit("source: orders"))).unionByName(cells(rows, down, across, value.cast("string"), value))
    if transposed:
        return out.unionByName(cells(nations, F.col("n") + 2, F.lit(1), F.col("nation"))).unionByName(cells(periods, F.lit(2), low, year))
    years = F.concat((F.col("period") - 1911).cast("string"), F.lit("年"), year)
    return out.unionByName(cells(nations, F.lit(2), F.col("n") + 1, F.col("nation"))).unionByName(cells(periods, low, F.lit(1), years))


def monthly_measures(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, month, measure, value): sales and quantity of suppliers' nations by month."""
    month = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey", month.alias("month")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("amount"), F.sum(F.col("l_quantity").cast(MONEY)).alias("units")
    )
    rows = sums.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.col("n_name").alias("entity"), "month").agg(F.sum("amount").alias("amount"), F.sum("units").alias("units"))
    return rows.unpivot(["entity", "month"], ["amount", "units"], "measure", "value").withColumn("value", F.col("value").cast("double"))
