"""Catalog of fields from a long table: a card for each column with unit, role, confidence, samples and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators.firsts import first_values
from tabulon.operators.medians import middles
from tabulon.tables import cut, meet

FIELD = ["file", "sheet", "canonical", "dimension"]
# Thresholds of confidence and of merging names.
AUTO, LEAST, BASE = 0.85, 0.6, 0.9
FEW_VALUES, SAMPLES, SAME_NAME, SAME_KIND = 3, 3, 92.0, 0.7


def profile_struct(value: Column) -> Column:
    """Count, range, wholeness and signs of a column's values, as one aggregate; sizes are absolute."""
    return F.struct(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.bool_and(value == F.floor(value)).alias("whole"),
        F.bool_and(F.abs(value) <= 100).alias("percent_like"), F.coalesce(F.bool_or(value < 0), F.lit(False)).alias("negative"),
    )


def inferred_unit(name: Column, context: Column, profile: Column) -> Column:
    """Struct of unit and reliability: by the column's words, by those of sheet and file, by its numbers, else unknown."""
    own, near = S.unit_of(name), S.unit_of(context)
    known = profile["n"] > 0
    unit = lambda name, sure: F.struct(name.alias("unit") if isinstance(name, Column) else F.lit(name).alias("unit"), F.lit(sure).alias("reliability"))
    return (
        F.when(own != "unknown", unit(own, 1.0)).when(near != "unknown", unit(near, 0.95)).when(known & profile["percent_like"] & ~profile["whole"], unit("%", 0.8))
        .when(known & profile["whole"] & (profile["magnitude"] >= 3), unit("整數計數", 0.7)).otherwise(unit("未知", 0.3))
    )


def confidence(reliability: Column, n: Column) -> Column:
    """BASE times the unit's reliability; 0.2 without values, 0.55 at most with fewer than FEW_VALUES."""
    sure = reliability * BASE
    return F.when(n == 0, 0.2).when(n < FEW_VALUES, F.least(sure, F.lit(0.55))).otherwise(sure)


def field_cards(long: DataFrame) -> DataFrame:
    """One row for each field of a file's sheet, with what is known about it and whether it needs review.

    Columns: FIELD, aggregation_role, unit, confidence, decision (auto, flagged or review), cell_range, n, low, high,
    samples (the first values by row), notes.
    """
    keys, v, at = [*FIELD, "aggregation_role"], F.col("value"), F.struct("row", "col")
    rows = cut(long.select(*keys, "value", "row", "col"))
    cards = rows.groupBy(*keys).agg(profile_struct(v).alias("p"), F.min(at).alias("from"), F.max(at).alias("to"))
    cards = meet(meet(cards, middles(rows, keys), keys), first_values(rows.where(v.isNotNull()), keys, ["row", "col"], F.round(v, 4), SAMPLES, "s"), keys, "left")
    magnitude = F.when(F.col("size") > 0, F.log10("size").cast("int")).otherwise(0)
    cards = cards.withColumns({"p": F.struct("p.*", "median", magnitude.alias("magnitude")), "samples": F.coalesce("s", F.array().cast("array<double>"))})
    cards = cards.withColumn("u", inferred_unit(F.col("dimension"), F.concat_ws(" ", "sheet", "file"), F.col("p")))
    sure, n = confidence(F.col("u.reliability"), F.col("p.n")), F.col("p.n")
    notes = F.filter(F.array(
        F.when(n == 0, "no values").when(n < FEW_VALUES, "too few values"), F.when(F.col("u.reliability") < 0.9, "unit not stated"),
        F.when(F.col("aggregation_role") != "detail", F.concat(F.lit("aggregate: "), F.col("aggregation_role"))), F.when(F.col("p.negative") & (F.col("u.unit") != "%"), "negative values"),
    ), lambda x: x.isNotNull())
    cell = lambda k: S.a1(F.col(f"{k}.row"), F.col(f"{k}.col"))
    return cards.select(
        *FIELD, "aggregation_role", "u.unit", sure.alias("confidence"), F.when(sure >= AUTO, "auto").when(sure >= LEAST, "flagged").otherwise("review").alias("decision"),
        F.concat(cell("from"), F.lit(":"), cell("to")).alias("cell_range"), "p.n", "p.low", "p.high", "samples", notes.alias("notes"), F.col("p").alias("profile"),
    )


def usable_fields(cards: DataFrame) -> DataFrame:
    """Cards that recipes may name."""
    return cards.where("decision <> 'review'")


def review_list(cards: DataFrame, anomalies: DataFrame, unparsable: DataFrame, unread: DataFrame) -> DataFrame:
    """(file, sheet, subject, reason): fields below the threshold, columns with negative values, sheets and files that weren't read."""
    none = F.lit(None).cast("string")
    return (
        cards.where("decision = 'review'").select("file", "sheet", F.col("canonical").alias("subject"), F.array_join("notes", "; ").alias("reason"))
        .unionByName(anomalies.select("file", "sheet", F.col("dimension").alias("subject"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("negative values, first in"), "cells").alias("reason")))
        .unionByName(unparsable.select("file", "sheet", none.alias("subject"), "reason")).unionByName(unread.select("file", none.alias("sheet"), none.alias("subject"), F.col("warning").alias("reason")))
    )


def catalog_summary(cards: DataFrame) -> DataFrame:
    """One row: files, usable fields, those taken without review, and those kept for review."""
    return cards.agg(
        F.count_distinct("file").alias("files"), F.count_if(F.col("decision") != "review").alias("fields"), F.count_if(F.col("decision") == "auto").alias("auto"),
        F.count_if(F.col("decision") == "review").alias("review"),
    )


def compact_text(cards: DataFrame, most: int = 220) -> DataFrame:
    """(position, line): a line for each of the first ``most`` usable fields, and a last one that says how many were left out."""
    line = F.concat_ws(" | ", "canonical", "unit", "aggregation_role", "file", "sheet", F.array_join(F.transform(F.slice("samples", 1, 2), lambda x: x.cast("string")), ","))
    fields = usable_fields(cards)
    top = fields.orderBy("file", "sheet", "canonical", "dimension").limit(most)
    top = top.select(F.row_number().over(Window.orderBy("file", "sheet", "canonical", "dimension")).alias("position"), line.alias("line"))
    left = fields.agg((F.count(F.lit(1)) - most).alias("left")).where("left > 0")
    return top.unionByName(left.select(F.lit(most + 1).alias("position"), F.concat(F.col("left").cast("string"), F.lit(" more fields")).alias("line")))


def data_summary(long: DataFrame) -> DataFrame:
    """(concept, leaves, periods, records): what each concept (a name's first part) is split by and when it was measured."""
    parts = F.split("canonical", "_")
    rows = long.select(F.element_at(parts, 1).alias("concept"), F.element_at(parts, -1).alias("leaf"), "period")
    return rows.groupBy("concept").agg(
        F.sort_array(F.collect_set("leaf")).alias("leaves"), F.sort_array(F.collect_set("period")).alias("periods"), F.count(F.lit(1)).alias("records")
    )


def compatibility(a: Column, b: Column) -> Column:
    """How alike two profiles are, 0 to 1: magnitude first, then range and wholeness."""
    apart = F.least(F.abs(a["magnitude"] - b["magnitude"]) * 0.25, F.lit(0.6))
    score = 1.0 - apart - F.when(a["percent_like"] != b["percent_like"], 0.25).otherwise(0.0) - F.when(a["whole"] != b["whole"], 0.1).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def fuzzy_pairs(cards: DataFrame) -> DataFrame:
    """(a_file, a_sheet, a, b_file, b_sheet, b, ratio): fields of different sheets with names of SAME_NAME or more and compatible profiles.

    Names so alike share a pair of neighbouring characters (or are one character), so they meet by those, not by a cross join.
    """
    text = F.concat(F.lit("\x02"), "canonical")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))
    rows = cards.select("file", "sheet", "canonical", "profile", F.explode(F.when(F.length("canonical") > 1, F.slice(grams, 2, F.size(grams))).otherwise(grams)).alias("gram"))
    side = lambda p: rows.select("gram", *(F.col(c).alias(f"{p}_{c}") for c in ("file", "sheet", "canonical", "profile")))
    key = lambda p: F.struct(f"{p}_file", f"{p}_sheet", f"{p}_canonical")
    apart = (F.col("a_file") != F.col("b_file")) | (F.col("a_sheet") != F.col("b_sheet"))
    size = lambda p: F.length(f"{p}_canonical")
    near = F.least(size("a"), size("b")) * 200.0 / (size("a") + size("b")) >= SAME_NAME
    met = side("a").join(side("b"), "gram").where((key("a") < key("b")) & apart & near).drop("gram").distinct()
    out = met.withColumn("ratio", S.indel_ratio(F.col("a_canonical"), F.col("b_canonical"))).where(F.col("ratio") >= SAME_NAME)
    out = out.where((compatibility(F.col("a_profile"), F.col("b_profile")) >= SAME_KIND) | (F.col("a_profile.n") == 0) | (F.col("b_profile.n") == 0))
    return out.select("a_file", "a_sheet", F.col("a_canonical").alias("a"), "b_file", "b_sheet", F.col("b_canonical").alias("b"), "ratio")


def join_keys(long: DataFrame) -> DataFrame:
    """(dimension, files): dimensions that two or more files have."""
    return long.groupBy("dimension").agg(F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"), F.count_distinct("file").alias("n")).where("n > 1").drop("n")
