"""Schemas, vocabularies and errors of the report engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: The long table that every block reads: one row for each value, with the cell it comes from.
LONG = T.StructType([
    T.StructField("period", T.IntegerType()),
    T.StructField("canonical", T.StringType()),
    T.StructField("dimension", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("file", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("aggregation_role", T.StringType()),
])

#: Roles that sums leave out, since their rows repeat what detail and residual rows hold.
AGGREGATE_ROLES = ("subtotal", "total")

PASSED, NA, FAILED, REVIEW = "passed", "na", "failed", "needs_manual_review"


class ExecutionError(Exception):
    """A recipe or block that can't be carried out."""


class BlockError(ExecutionError, ValueError):
    """Wrong input of a block: a column, operator or parameter."""
