"""The ten whitelisted blocks: DataFrame to DataFrame, or columns for the scalar ones; nothing runs here.

Missing values are null, and NaN counts as missing. ``places`` sums decimals of that scale,
which is exact whatever the order in which partial sums meet; null sums doubles.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.model import AGGREGATE_ROLES, NA, PASSED, BlockError
from tabulon.operators.running import running


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise BlockError(f"columns not in the table: {', '.join(missing)}")


def present(value: Column) -> Column:
    """The value as a double, null for NaN."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def _among(c: Column, values: object) -> Column:
    return c.isin(list(values) if isinstance(values, (list, tuple, set)) else [values])


OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "==": operator.eq, "!=": lambda c, v: F.coalesce(c != v, F.lit(True)), ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
    "in": _among, "contains": lambda c, v: c.cast("string").contains(str(v)), "matches": lambda c, v: c.cast("string").rlike(str(v)),
}


def filter_rows(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """Rows for which the comparison holds; nulls never do, but for ``!=`` on columns other than period."""
    require(df, column)
    if operator not in OPERATORS:
        raise BlockError(f"unknown operator {operator!r}")
    keep = OPERATORS[operator](F.col(column), value)
    return df.where(keep & F.col(column).isNotNull() if operator == "!=" and column == "period" else keep)


def filter_by_period(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of periods from start to end, both included; rows without a period go even when unbounded."""
    require(df, "period")
    if start is not None and end is not None and start > end:
        raise BlockError(f"start {start} is after end {end}")
    keep = F.col("period").isNotNull()
    if start is not None:
        keep &= F.col("period") >= start
    if end is not None:
        keep &= F.col("period") <= end
    return df.where(keep)


def exclude_aggregates(df: DataFrame) -> DataFrame:
    """Rows that aren't subtotals or totals; rows without a role stay, as does a table without roles."""
    if "aggregation_role" not in df.columns:
        return df
    return df.where(F.coalesce(~F.col("aggregation_role").isin(*AGGREGATE_ROLES), F.lit(True)))


def total(value: Column, places: int | None = None) -> Column:
    """Sum that skips missing values and is 0 when all are."""
    value = present(value)
    s = F.sum(value) if places is None else F.sum(value.cast(f"decimal(28,{places})")).cast("double")
    return F.coalesce(s, F.lit(0.0))


def _grouped(df: DataFrame, group_col: str, value_col: str, detail_only: bool, out: Column) -> DataFrame:
    require(df, group_col, value_col)
    rows = exclude_aggregates(df) if detail_only else df
    return rows.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(out.alias(value_col))


def group_sum(df: DataFrame, group_col: str = "period", value_col: str = "value", detail_only: bool = True, places: int | None = None) -> DataFrame:
    """Sum by key without subtotals and totals; null keys go, a group of nulls is 0."""
    return _grouped(df, group_col, value_col, detail_only, total(F.col(value_col), places))


def group_mean(df: DataFrame, group_col: str = "period", value_col: str = "value", detail_only: bool = True, places: int | None = None) -> DataFrame:
    """Mean by key over values that are there; null for a group of nulls."""
    v = present(F.col(value_col))
    mean = F.avg(v) if places is None else F.try_divide(F.sum(v.cast(f"decimal(28,{places})")).cast("double"), F.count(v).cast("double"))
    return _grouped(df, group_col, value_col, detail_only, mean)


def ratio(numerator: Column, denominator: Column, as_percent: bool = True) -> Column:
    """Struct of value, status and reason; a missing operand or a zero denominator is not available, with its reason."""
    n, d = present(numerator), present(denominator)
    reason = F.when(n.isNull(), "numerator is missing").when(d.isNull(), "denominator is missing").when(d == 0, "denominator is zero")
    value = F.when(reason.isNull(), F.try_divide(n, d) * (100.0 if as_percent else 1.0))
    return F.struct(value.alias("value"), F.when(reason.isNull(), PASSED).otherwise(NA).alias("status"), reason.alias("reason"))


def growth_rate(current: Column, previous: Column) -> Column:
    """Struct of the change in percent, status and reason; not available for missing values and bases of 0 or less."""
    c, p = present(current), present(previous)
    reason = F.when(c.isNull(), "current value is missing").when(p.isNull(), "base is missing").when(p == 0, "base is zero").when(p < 0, "base is negative")
    value = F.when(reason.isNull(), F.try_divide(c - p, p) * 100.0)
    return F.struct(value.alias("value"), F.when(reason.isNull(), PASSED).otherwise(NA).alias("status"), reason.alias("reason"))


def rank_top_n(df: DataFrame, value_col: str = "value", n: int = 5, ascending: bool = False, ties: Iterable[str] = ()) -> DataFrame:
    """The first n rows by value with their competition rank (1, 1, 3); nulls go; ``ties`` order equal values.

    Ranks are counted over the first rows only: n rows and all that tie with the last of them are ranked
    after a top-n selection, so no task orders the whole table.
    """
    require(df, value_col, *ties)
    if n <= 0:
        raise BlockError("n must be positive")
    v = F.col(value_col)
    first = v.asc() if ascending else v.desc()
    top = df.where(present(v).isNotNull()).orderBy(first, *ties).limit(n)
    return top.withColumn("rank", F.rank().over(Window.orderBy(first)).cast("long"))


def pivot(df: DataFrame, index: str = "period", columns: str = "dimension", values: str = "value", detail_only: bool = True, names: list | None = None, places: int | None = None) -> DataFrame:
    """Wide table of sums; a cell without rows is null, one of null values 0. Given ``names`` save a pass over the data."""
    require(df, index, columns, values)
    rows = exclude_aggregates(df) if detail_only else df
    return rows.groupBy(index).pivot(columns, names).agg(total(F.col(values), places))


def join(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on keys, of which nulls equal each other; columns of both sides get suffixes. Cross joins are refused."""
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "outer") or not keys:
        raise BlockError(f"join {how!r} on {keys} is not allowed")
    require(a, *keys)
    require(b, *keys)
    shared = {c for c in a.columns if c in b.columns and c not in keys}
    left = a.select(*(F.col(c).alias(c + suffixes[0] if c in shared else c) for c in a.columns))
    right = b.select(*(F.col(c).alias(f"__{c}" if c in keys else c + suffixes[1] if c in shared else c) for c in b.columns))
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = left.join(right, cond, how)
    if how == "outer":
        out = out.withColumns({k: F.coalesce(k, f"__{k}") for k in keys})
    return out.drop(*(f"__{k}" for k in keys))


def cumulative_sum(df: DataFrame, value_col: str = "value", order_by: str = "period", within: Iterable[str] = (), ties: Iterable[str] = (), places: int | None = None) -> DataFrame:
    """Running sum row by row; a null value stays null and the sum goes on; null order keys come last.

    Without ``within`` the table is summed in ranges of its order, in many tasks; rows that are equal in order and ties come in an order by
    all their columns.
    """
    require(df, value_col, order_by, *within, *ties)
    v = present(F.col(value_col))
    v = v if places is None else v.cast(f"decimal(28,{places})")
    if within:
        w = Window.partitionBy(*within).orderBy(F.col(order_by).asc_nulls_last(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total_ = F.sum(v).over(w)
    else:
        key = F.struct(F.col(order_by).isNull().alias("k0"), F.col(order_by).alias("k1"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("h"))
        df, total_ = running(df.withColumns({"_key": key, "_v": v}), ["_v"], key="_key"), F.col("_v_upto")
    out = df.withColumn("cumulative", F.when(v.isNotNull(), total_ if places is None else total_.cast("double")))
    return out.drop("_key", "_v", "_v_upto")


#: What recipes may name.
BLOCKS: dict[str, Callable] = {
    "filter": filter_rows, "filter_by_period": filter_by_period, "group_sum": group_sum, "group_mean": group_mean, "ratio": ratio,
    "growth_rate": growth_rate, "rank_top_n": rank_top_n, "pivot": pivot, "join": join, "cumulative_sum": cumulative_sum,
}
SCALAR = ("ratio", "growth_rate")
