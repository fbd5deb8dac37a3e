"""The first k rows of each group, without gathering a group: every task keeps k rows of a group before the shuffle, and k after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group, lowest in order (nulls first); rows that are equal in order are taken as they come."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(own)).where(F.col("_nth") <= k).drop("_nth")


def first_values(df: DataFrame, keys: list[str], order: list[str], value: Column, k: int, name: str) -> DataFrame:
    """(keys, name): an array of the value in the first k rows of each group, in order."""
    rows = first_rows(df, keys, order, k).select(*keys, F.struct(*order, value.alias("_value")).alias("_row"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("_row")), lambda x: x["_value"]).alias(name))
