"""Structure of sheets from a table of cells (file, sheet, row, col, text, number), by aggregates over all sheets at once.

A sheet's rows above its data are titles or headers; a column's headers, from top to bottom, are its name. Periods
stand in a column or, in transposed sheets, in the headers. Both layouts give the same long table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators.firsts import first_values
from tabulon.tables import cut, meet

SHEET = ["file", "sheet"]
# Thresholds of the inference.
DENSE, PERIODS, TITLE_WIDTH = 0.5, 0.7, 0.8
HEADER_SCAN, TITLE_CELLS, LEAST_CODES = 20, 2, 3


class Inferred(NamedTuple):
    """What is found out about sheets, as small tables beside the cells."""

    #: cells with year (of period cells).
    cells: DataFrame
    #: (file, sheet, width, data_start, data_end, period_col, entity_col, transposed), data_start null without data.
    sheets: DataFrame
    #: (file, sheet, row, title, header) of rows above the data, fewer than HEADER_SCAN a sheet.
    heads: DataFrame
    #: (file, sheet, col, layers, name, code, filled, numeric, years, ratio_like, kind) of columns with headers or data.
    columns: DataFrame


def inferred(cells: DataFrame) -> Inferred:
    """Rows, columns and sheets are profiled by aggregates that tasks combine before a shuffle; no task holds a sheet.

    Data starts in the first of HEADER_SCAN rows that is mostly numbers and no header of period codes, and ends in the last
    row that is mostly numbers. Rows above are titles if they start in the first column and hold little or one text over
    most of the width; if no header is left, the last title is one. A column's layers are its distinct header texts from top
    to bottom. The period column is the left-most in which most cells are years. Periods stand in the headers if LEAST_CODES
    or more columns end in a code; the entity column is the first one without a code in which most cells are no numbers.
    The cells are written once, since all of this reads them.
    """
    row, col, v = F.col("row"), F.col("col"), F.col("number")
    out = cut(cells.select(*SHEET, "row", "col", "text", "number").withColumn("year", S.year_of(F.col("text"), v)))
    lines = out.groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("filled"), F.count("number").alias("numeric"), F.count(S.period_code(F.col("text"), v)).alias("codes"),
        (F.min("text") == F.max("text")).alias("alike"), F.bool_or(col == 1).alias("first"), F.max("col").alias("right"),
    )
    dense = F.col("numeric") / F.col("filled") > DENSE
    coded = (F.col("codes") >= LEAST_CODES) & (F.col("codes") / F.col("filled") >= 0.5)
    sheets = lines.groupBy(*SHEET).agg(
        F.max("right").alias("width"), F.min(F.when(dense & ~coded & (row <= HEADER_SCAN), row)).alias("data_start"), F.max(F.when(dense, row)).alias("data_end")
    )
    sheets = cut(sheets)
    above = meet(lines.where(row < HEADER_SCAN), sheets, SHEET).where(row < F.col("data_start"))
    spread = (F.col("filled") >= 2) & F.col("alike") & (F.col("filled") / F.col("width") >= TITLE_WIDTH)
    heads = above.select(*SHEET, "row", (F.col("first") & ((F.col("filled") <= TITLE_CELLS) | spread)).alias("title"))
    lone = heads.groupBy(*SHEET).agg(F.when(F.bool_and("title"), F.max("row")).alias("only"))
    heads = cut(meet(heads, lone, SHEET).select(*SHEET, "row", "title", (~F.col("title") | F.coalesce(F.col("only") == row, F.lit(False))).alias("header")))
    squashed = F.trim(F.regexp_replace("text", r"\s+", " "))
    texts = meet(out.where(row < HEADER_SCAN), heads.where("header").select(*SHEET, "row"), [*SHEET, "row"])
    stack = F.sort_array(F.collect_list(F.struct("row", squashed.alias("text"))))  # a cell for each header row
    named = texts.groupBy(*SHEET, "col").agg(F.array_distinct(F.transform(stack, lambda x: x["text"])).alias("layers"))
    data = meet(out, sheets.select(*SHEET, "data_start", "data_end"), SHEET).where(row.between(F.col("data_start"), F.col("data_end")))
    filled = data.groupBy(*SHEET, "col").agg(
        F.count(F.lit(1)).alias("filled"), F.count("number").alias("numeric"), F.count("year").alias("years"), F.bool_and(F.abs(v) <= 100).alias("small"), F.bool_or(v != F.floor(v)).alias("broken"),
    )
    cols = meet(named, filled, [*SHEET, "col"], "full")
    cols = cols.withColumns({"layers": F.coalesce("layers", F.array().cast("array<string>")), **{c: F.coalesce(c, F.lit(0)) for c in ("filled", "numeric", "years")}})
    cols = cols.withColumns({"name": F.when(F.size("layers") > 0, F.array_join("layers", " > ")), "code": S.period_code(F.try_element_at("layers", F.lit(-1)), F.lit(None).cast("double"))})
    ratio = (S.unit_of(F.coalesce("name", F.lit(""))) == "%") | (F.coalesce("small", F.lit(False)) & F.coalesce("broken", F.lit(False)))
    cols = cut(cols.withColumn("ratio_like", ratio))
    entity = F.col("code").isNull() & (F.col("filled") > 0) & (1 - F.try_divide("numeric", "filled") > DENSE)
    told = cols.groupBy(*SHEET).agg(
        F.min(F.when(F.try_divide("years", "filled") >= PERIODS, col)).alias("period_col"), F.min(F.when(entity, col)).alias("entity_col"), (F.count("code") >= LEAST_CODES).alias("transposed")
    )
    sheets = meet(sheets, told, SHEET, "left").withColumn("transposed", F.coalesce("transposed", F.lit(False)))
    kind = (
        F.when(F.col("name").isNull() | (F.col("filled") == 0), "empty").when(col == F.col("period_col"), "period")
        .when(F.try_divide("numeric", "filled") > DENSE, "measure").otherwise("label")
    )
    cols = meet(cols, told.select(*SHEET, "period_col", "transposed"), SHEET).withColumn("kind", kind)
    return Inferred(out, sheets, heads, cols.select(*SHEET, "col", "layers", "name", "code", "filled", "numeric", "years", "ratio_like", "transposed", "kind"))


def sheet_structure(cells: DataFrame) -> DataFrame:
    """(file, sheet, width, data_start, data_end, title_rows, header_rows) of each sheet with data; blank rows are neither titles nor headers."""
    found = inferred(cells)
    rows = lambda c, name: F.sort_array(F.collect_list(F.when(c, F.col("row")))).alias(name)
    heads = found.heads.groupBy(*SHEET).agg(rows(F.col("title") & ~F.col("header"), "title_rows"), rows(F.col("header"), "header_rows"))
    none = F.array().cast("array<int>")
    out = meet(found.sheets.where("data_start IS NOT NULL").select(*SHEET, "width", "data_start", "data_end"), heads, SHEET, "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("title_rows", "header_rows")})


def unparsable_sheets(cells: DataFrame) -> DataFrame:
    """(file, sheet, reason) of sheets in which no data was found."""
    return inferred(cells).sheets.where("data_start IS NULL").select(*SHEET, F.lit("no row that is mostly numbers").alias("reason"))


def columns(cells: DataFrame) -> DataFrame:
    """(file, sheet, col, name, layers, filled, numeric, years, code, kind, ratio_like, transposed) of each column with headers or data.

    kind: empty, period, measure (mostly numbers) or label.
    """
    return inferred(cells).columns


LONG_COLUMNS = ("period", "month", "canonical", "dimension", "value", "file", "sheet", "row", "col", "aggregation_role", "anomaly")


def long_table(cells: DataFrame) -> DataFrame:
    """LONG_COLUMNS: one row for each number of a measure, with its cell.

    Periods in a column: the column's name is the dimension. Periods in headers: the row's entity is, and month keeps
    the code (yyyymm), so that stocks needn't be summed over months. Periods that can't be read are null, not guessed.
    anomaly: a negative number where the measure isn't ratio-like, or any in a transposed sheet.
    """
    found = inferred(cells)
    sheets = found.sheets.where("data_start IS NOT NULL").select(*SHEET, "data_start", "data_end", "period_col", "entity_col")
    data = meet(found.cells, sheets, SHEET).where(F.col("row").between(F.col("data_start"), F.col("data_end")))
    entity = F.when(F.col("number").isNull(), F.trim(F.regexp_replace("text", r"\s+", " ")))
    marks = data.where("col = period_col OR col = entity_col").groupBy(*SHEET, "row").agg(
        F.max(F.when(F.col("col") == F.col("period_col"), F.col("year"))).alias("row_year"), F.max(F.when(F.col("col") == F.col("entity_col"), entity)).alias("entity")
    )
    across = F.col("transposed")
    rows = meet(data.where("number IS NOT NULL").select(*SHEET, "row", "col", "number"), found.columns, [*SHEET, "col"])
    rows = meet(rows.where((across & F.col("code").isNotNull()) | (~across & (F.col("kind") == "measure"))), marks, [*SHEET, "row"], "left").where(~across | F.col("entity").isNotNull())
    layers = F.when(across, F.array("entity")).otherwise(F.col("layers"))
    names = F.filter(F.transform(layers, S.chinese_part), lambda x: x != "")
    canonical = F.array_join(F.concat(F.array(S.concept(F.col("sheet"), F.col("file"))), names), "_")
    return rows.select(
        F.when(across, F.col("code.year")).otherwise(F.col("row_year")).cast("int").alias("period"), F.when(across, F.col("code.month")).cast("int").alias("month"), canonical.alias("canonical"),
        F.when(across, F.col("entity")).otherwise(F.col("name")).alias("dimension"), F.col("number").alias("value"), *SHEET, "row", "col",
        S.role_of(F.try_element_at(layers, F.lit(-1))).alias("aggregation_role"), ((F.col("number") < 0) & (across | ~F.col("ratio_like"))).alias("anomaly"),
    )


def fingerprints(cells: DataFrame) -> DataFrame:
    """(file, sheet, fingerprint): sixteen hex digits over the number of header rows and the columns' names."""
    found = inferred(cells)
    named = found.columns.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("name", F.lit("")).alias("name")))).alias("named"))
    depth = found.heads.where("header").groupBy(*SHEET).agg(F.count(F.lit(1)).alias("deep"))
    out = meet(named, depth, SHEET, "left").withColumn("depth", F.coalesce("deep", F.lit(0)).cast("string"))
    return out.select(*SHEET, S.fingerprint(F.concat(F.array("depth"), F.transform("named", lambda x: x["name"]))).alias("fingerprint"))


def reconnaissance(cells: DataFrame) -> DataFrame:
    """(file, sheet, rows, width, density, years, negatives): a first look at each sheet; ten negative cells at most, as addresses."""
    found = inferred(cells)
    sheets = found.sheets.where("data_start IS NOT NULL").select(*SHEET, "width", "data_start", "data_end", (F.col("data_end") - F.col("data_start") + 1).alias("rows"))
    data = meet(found.cells, sheets.drop("width", "rows"), SHEET).where(F.col("row").between(F.col("data_start"), F.col("data_end")))
    seen = data.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("filled"), F.slice(F.sort_array(F.collect_set("year")), 1, 3).alias("years"))  # there are some 200 years
    negative = first_values(data.where("number < 0"), SHEET, ["row", "col"], F.struct("row", "col"), 10, "cells")
    out = meet(meet(sheets, seen, SHEET), negative, SHEET, "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<row:int,col:int>>")))
    return out.select(
        *SHEET, "rows", "width", F.round(F.col("filled") / (F.col("rows") * F.col("width")), 4).alias("density"), "years",
        F.transform("cells", lambda x: S.a1(x["row"], x["col"])).alias("negatives"),
    )


def anomaly_summary(long: DataFrame) -> DataFrame:
    """(file, sheet, dimension, n, cells): negative numbers of each column and their first five addresses."""
    bad, keys = long.where("anomaly"), [*SHEET, "dimension"]
    out = meet(bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), first_values(bad, keys, ["row", "col"], F.struct("row", "col"), 5, "at"), keys)
    return out.select(*SHEET, "dimension", "n", F.array_join(F.transform("at", lambda x: S.a1(x["row"], x["col"])), ",").alias("cells"))

