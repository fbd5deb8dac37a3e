"""Bank sheets of the older layout as standard records: an entity column, period codes as headers, perhaps a share column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.tables import meet

RECORD = ("institution", "period", "metric", "value", "unit", "source_file", "source_sheet", "source_cell", "raw_value")
# What a sheet's name says of its metric and unit, in order; the total's name; words of share columns; rows searched for a header.
SHEET_METRICS = (
    ("流通卡數", "流通卡數", "張"), ("有效卡數", "有效卡數", "張"), ("簽帳金額", "當月簽帳金額", "千元"), ("循環信用", "循環信用餘額", "千元"),
    ("分期付款", "分期付款餘額", "千元"), ("逾期", "逾期放款比率", "%"), ("呆帳", "呆帳比率", "%"), ("備抵", "備抵呆帳提足率", "%"),
)
TOTAL, SHARE_WORDS, PREFERRED, PASSED_OVER, HEADER_SCAN = "總計", ("市佔率", "市占率"), "P.7", "P.5", 10


def metric_of(sheet: str) -> tuple[str, str]:
    """Metric and unit that a sheet's name tells; the name itself and unknown otherwise."""
    return next(((metric, unit) for word, metric, unit in SHEET_METRICS if word in sheet), (sheet, "未知"))


def preferred_sheets(sheets: list[str]) -> list[str]:
    """The sheets to read: a P.5 sheet goes if there is a P.7 sheet of its metric."""
    better = {metric_of(s)[0] for s in sheets if PREFERRED in s}
    return [s for s in sheets if not (PASSED_OVER in s and metric_of(s)[0] in better)]


def standardise(wide: DataFrame, file: str, sheet: str) -> DataFrame:
    """RECORD rows of a sheet read with its header; rows without an entity go.

    Columns of five or six digits are periods. A share column gives percents for the sheet's last period, but none for
    the total's row.
    """
    metric, unit = metric_of(sheet)
    entity, *rest = wide.columns
    periods = [c for c in rest if re.fullmatch(r"\d{5,6}", c.strip())]
    share = next((c for c in rest if any(w in c for w in SHARE_WORDS)), None)
    name = F.trim(F.col(f"`{entity}`").cast("string"))
    rows = wide.where(name.isNotNull() & ~name.isin("", "None", "nan"))

    def record(at: Column, what: str, value: Column, unit: str, cell: Column, raw: Column) -> list[Column]:
        made = (name, at, F.lit(what), value, F.lit(unit), F.lit(file), F.lit(sheet), F.concat(name, F.lit("@"), cell), raw)
        return [c.alias(n) for c, n in zip(made, RECORD)]

    raw = [F.struct(F.lit(c.strip()).alias("p"), F.col(f"`{c}`").cast("string").alias("raw")) for c in periods]
    each = rows.withColumn("_x", F.explode(F.array(*raw))) if raw else rows.where("false").withColumn("_x", F.struct(F.lit("").alias("p"), F.lit("").alias("raw")))
    number = lambda c: F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    out = each.select(*record(F.col("_x.p"), metric, number(F.col("_x.raw")), unit, F.col("_x.p"), F.col("_x.raw")))
    if share is None or not periods:
        return out
    text = F.col(f"`{share}`").cast("string")
    told = rows.where(number(text).isNotNull() & (name != TOTAL))
    return out.unionByName(told.select(*record(F.lit(max(p.strip() for p in periods)), f"{metric}_市佔率", number(text) * 100, "%", F.lit("市佔率"), text)))


def header_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, header): the first of HEADER_SCAN rows in which every filled cell is text, else row 1."""
    lines = cells.groupBy("file", "sheet", "row").agg((F.count("number") == 0).alias("words"))
    return lines.groupBy("file", "sheet").agg(F.coalesce(F.min(F.when(F.col("words") & (F.col("row") <= HEADER_SCAN), F.col("row"))), F.lit(1)).alias("header"))


def records(cells: DataFrame) -> DataFrame:
    """RECORD rows of all sheets of the older layout among the cells (file, sheet, row, col, text, number), in one plan.

    Headers are rows of a table here: a cell takes its column's header by a join, so sheets with any columns are read together. The first
    column names the entity; rows without one go. Every entity has a record for each of its sheet's periods, null where there is
    no cell. A P.5 sheet goes if its file has a P.7 sheet of its metric. As in ``standardise``, a share column gives percents for the
    last period.
    """
    sheet = ["file", "sheet"]
    told = [(F.col("sheet").contains(word), F.lit(metric), F.lit(unit)) for word, metric, unit in reversed(SHEET_METRICS)]
    metric, unit = F.col("sheet"), F.lit("未知")
    for hit, m, u in told:
        metric, unit = F.when(hit, m).otherwise(metric), F.when(hit, u).otherwise(unit)
    heads = header_rows(cells).withColumns({"metric": metric, "unit": unit})
    better = heads.where(F.col("sheet").contains(PREFERRED)).select("file", F.col("metric").alias("_better")).distinct()
    heads = heads.join(better.withColumnRenamed("file", "_file"), F.col("file").eqNullSafe(F.col("_file")) & (F.col("metric") == F.col("_better")), "left")
    heads = heads.where(~F.col("sheet").contains(PASSED_OVER) | F.col("_better").isNull()).drop("_file", "_better")
    body = meet(cells, heads, sheet)
    names = body.where("row = header").select(*sheet, "col", F.trim("text").alias("name"))
    rows = body.where("row > header")
    name = F.trim("text")
    entities = rows.where((F.col("col") == 1) & ~name.isin("", "None", "nan")).select(*sheet, "row", "metric", "unit", name.alias("institution"))
    periods = names.where((F.col("col") > 1) & F.col("name").rlike(r"^\d{5,6}$")).withColumnRenamed("name", "period")
    number = F.coalesce("number", F.nanvl(F.col("text").try_cast("double"), F.lit(None).cast("double")))
    values = rows.select(*sheet, "row", "col", number.alias("value"), F.col("text").alias("raw_value"))
    grid = meet(entities, periods, sheet)
    out = meet(grid, values, [*sheet, "row", "col"], "left")
    made = ("institution", "period", "metric", "value", "unit", F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"))
    plain = out.select(*made, F.concat("institution", F.lit("@"), "period").alias("source_cell"), "raw_value")
    hit = F.lit(False)
    for w in SHARE_WORDS:
        hit |= F.col("name").contains(w)
    share = names.where((F.col("col") > 1) & hit).groupBy(*sheet).agg(F.min("col").alias("col"))
    last = periods.groupBy(*sheet).agg(F.max("period").alias("period"))
    shares = meet(meet(meet(entities.where(F.col("institution") != TOTAL), share, sheet), last, sheet), values.where("value IS NOT NULL"), [*sheet, "row", "col"])
    shares = shares.withColumns({"metric": F.concat("metric", F.lit("_市佔率")), "value": F.col("value") * 100, "unit": F.lit("%")})
    return plain.unionByName(shares.select(*made, F.concat("institution", F.lit("@市佔率")).alias("source_cell"), "raw_value"))
