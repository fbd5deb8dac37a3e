"""Many recipes as one plan: what each sums becomes rows of a table of requests, and the data set is joined with it once.

A recipe that filters, sums or averages, and perhaps puts two such figures into a ratio or a growth rate, asks for one or two
sums (leaves). A leaf is a set of conditions: columns that equal a value (or one of several), and a range of periods. Leaves whose conditions are
on the same columns form a pattern. Every row of the data set asks each pattern, by the values it has in the pattern's columns, for the
leaves that want it: one equi-join with one scan, however many recipes there are. Equal leaves of several recipes are summed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalar import a1
from tabulon.model import AGGREGATE_ROLES
from tabulon.operators.blocks import growth_rate, present, ratio
from tabulon.operators.firsts import first_rows
from tabulon.plans.recipe import CELLS, COORDINATES, DATASET, SCALAR, Recipe, Step, judged
from tabulon.tables import cut, meet

SUMS = ("group_sum", "group_mean")
#: Leaves up to which the table of requests is broadcast.
FEW = 100_000
_SIDES = {"ratio": ("numerator", "denominator"), "growth_rate": ("current", "previous")}


@dataclass(frozen=True)
class Leaf:
    """A sum or mean over rows with ``equal`` (column, values) and a period from start to end."""

    equal: tuple[tuple[str, tuple], ...]
    dated: bool
    start: int | None
    end: int | None
    block: str
    group_col: str
    detail_only: bool
    places: int | None

    @property
    def pattern(self) -> tuple[str, ...]:
        return tuple(sorted({c for c, _ in self.equal}))


def _leaf(step: Step, steps: dict[str, Step], dataset: DataFrame) -> Leaf | None:
    """What a sum asks for, if its inputs are filters that a pattern expresses."""
    known = {"group_col", "value_col", "detail_only", "places"}
    p = step.params
    if step.block not in SUMS or not set(p) <= known or p.get("value_col", "value") != "value" or p.get("group_col", "period") not in dataset.columns:
        return None
    equal: dict[str, set] = {}
    dated, low, high, at = False, None, None, step
    while at.inputs != (DATASET,):
        if len(at.inputs) != 1 or at.inputs[0] not in steps:
            return None
        at = steps[at.inputs[0]]
        f = at.params
        if at.block == "filter_by_period" and set(f) <= {"start", "end"}:
            bounds = f.get("start"), f.get("end")
            if any(not (b is None or isinstance(b, int)) for b in bounds) or None not in bounds and bounds[0] > bounds[1]:
                return None
            dated = True
            low = max((x for x in (low, bounds[0]) if x is not None), default=None)
            high = min((x for x in (high, bounds[1]) if x is not None), default=None)
        elif at.block == "filter" and set(f) == {"column", "operator", "value"} and f["operator"] in ("==", "in") and f["column"] in dataset.columns:
            values = f["value"] if f["operator"] == "in" and isinstance(f["value"], (list, tuple)) else [f["value"]]
            kind = dict(dataset.dtypes)[f["column"]]
            if any(not isinstance(v, str if kind == "string" else int) or isinstance(v, bool) for v in values) or kind not in ("string", "int", "bigint"):
                return None
            equal[f["column"]] = equal[f["column"]] & set(values) if f["column"] in equal else set(values)
        else:
            return None
    return Leaf(tuple(sorted((c, tuple(sorted(v))) for c, v in equal.items())), dated, low, high, step.block, p.get("group_col", "period"), bool(p.get("detail_only", True)), p.get("places"))


def _sides(recipe: Recipe, dataset: DataFrame) -> dict[str, Leaf | float | None] | None:
    """The leaves and constants of a recipe's output by role (``value`` for a sum); None if it isn't of this shape."""
    steps = {s.id: s for s in recipe.steps}
    out = steps[recipe.output]
    if out.block in SUMS:
        leaf = _leaf(out, steps, dataset)
        return None if leaf is None else {"value": leaf}
    if out.block not in SCALAR or not set(out.params) <= {*_SIDES[out.block], "as_percent"} or set(_SIDES[out.block]) - set(out.params):
        return None
    found: dict[str, Leaf | float | None] = {}
    for role in _SIDES[out.block]:
        v = out.params[role]
        if isinstance(v, dict):
            side = steps.get(v.get("$ref"))
            found[role] = _leaf(side, steps, dataset) if side is not None else None
            if found[role] is None:
                return None
        elif v is None or isinstance(v, (int, float)) and not isinstance(v, bool):
            found[role] = v
        else:
            return None
    return found if any(isinstance(x, Leaf) for x in found.values()) else None


def takes(recipe: Recipe, dataset: DataFrame) -> bool:
    """Whether the recipe can be one of a batch over the data set."""
    return {*COORDINATES, "period", "value", "aggregation_role"} <= set(dataset.columns) and _sides(recipe, dataset) is not None


def _chain(recipe: Recipe) -> list[str]:
    """The steps that the output rests on, in the order of ``compile_recipe``."""
    made: dict[str, list[str]] = {DATASET: []}
    for s in recipe.steps:
        refs = [v["$ref"] for v in s.params.values() if isinstance(v, dict) and "$ref" in v]
        above = [*(() if s.block in SCALAR else s.inputs), *refs]
        made[s.id] = [*dict.fromkeys(x for k in above for x in made[k]), f"{s.id}:{s.block}"]
    return made[recipe.output]


def _matched(leaves: list[Leaf], dataset: DataFrame) -> DataFrame:
    """(leaf, group, COORDINATES, sum0.., n, rows): the data set's cells that each leaf sums, by one scan."""
    spark = dataset.sparkSession
    patterns = sorted({x.pattern for x in leaves})
    requests = []
    for i, leaf in enumerate(leaves):
        keys = [()]
        for c in leaf.pattern:
            keys = [(*k, v) for k in keys for v in dict(leaf.equal)[c]]
        requests += [(patterns.index(leaf.pattern), "".join(f"{v}\x1f" for v in k), i, leaf.dated, leaf.start, leaf.end, leaf.detail_only, leaf.group_col) for k in keys]
    table = spark.createDataFrame(requests, "pattern int, key string, leaf int, dated boolean, start int, end int, detail_only boolean, group_col string")
    told = [F.struct(F.lit(i).alias("pattern"), F.concat(F.lit(""), *(x for c in p for x in (F.col(c).cast("string"), F.lit("\x1f")))).alias("key")) for i, p in enumerate(patterns)]
    detail = F.coalesce(~F.col("aggregation_role").isin(*AGGREGATE_ROLES), F.lit(True))
    asked = dataset.withColumns({"_detail": detail, "_ask": F.explode(F.array(*told))})
    joined = asked.join(F.broadcast(table) if len(requests) <= FEW else table, (F.col("_ask.pattern") == F.col("pattern")) & (F.col("_ask.key") == F.col("key")))
    when = F.col("period")
    dated = ~F.col("dated") | (when.isNotNull() & F.coalesce(when >= F.col("start"), F.lit(True)) & F.coalesce(when <= F.col("end"), F.lit(True)))
    group = F.lit(None).cast("string")
    for c in sorted({x.group_col for x in leaves}):
        group = F.when(F.col("group_col") == c, F.col(c).cast("string")).otherwise(group)
    value = present(F.col("value"))
    sums = {f"sum{i}": F.sum(value if p is None else value.cast(f"decimal(28,{p})")).alias(f"sum{i}") for i, p in enumerate(_places(leaves))}
    return joined.where(dated & (F.col("_detail") | ~F.col("detail_only"))).groupBy("leaf", group.alias("group"), *COORDINATES).agg(*sums.values(), F.count(value).alias("n"))


def _places(leaves: list[Leaf]) -> list[int | None]:
    return sorted({x.places for x in leaves}, key=lambda p: -1 if p is None else p)


def compile_batch(recipes: list[Recipe], dataset: DataFrame) -> DataFrame:
    """The METRIC rows that ``compile_recipe`` gives for each recipe, one after the other; all of them ``takes`` said yes to.

    The cells that the leaves sum are found by one scan and written; values, sources and cells come from what was written.
    """
    spark = dataset.sparkSession
    sides = [_sides(r, dataset) for r in recipes]
    leaves = sorted({x for s in sides for x in s.values() if isinstance(x, Leaf)}, key=repr)
    number = {x: i for i, x in enumerate(leaves)}
    places = _places(leaves)
    about = spark.createDataFrame([(i, x.block == "group_mean", places.index(x.places)) for i, x in enumerate(leaves)], "leaf int, mean boolean, sums int")
    cells = cut(_matched(leaves, dataset))
    total = F.lit(None).cast("double")
    for i in range(len(places)):
        total = F.when(F.col("sums") == i, F.sum(f"sum{i}").cast("double")).otherwise(total)
    groups = cells.where("group IS NOT NULL").join(F.broadcast(about), "leaf").groupBy("leaf", "group", "mean", "sums").agg(total.alias("total"), F.sum("n").alias("n"))  # a row for each leaf
    figure = F.when(F.col("mean"), F.try_divide("total", F.col("n").cast("double"))).otherwise(F.coalesce("total", F.lit(0.0)))
    single = F.when(F.count(F.lit(1)) <= 1, F.first(figure)).otherwise(F.raise_error(F.concat(F.lit("a sum gives more than one row: leaf "), F.col("leaf").cast("string"))).cast("double"))
    figures = groups.groupBy("leaf").agg(single.alias("figure"))
    rows = []
    for i, (r, s) in enumerate(zip(recipes, sides)):
        out = next(x for x in r.steps if x.id == r.output)
        a, b = (s.get(k) for k in (_SIDES[out.block] if out.block in SCALAR else ("value", "none")))
        given = [None if isinstance(x, Leaf) or x is None else float(x) for x in (a, b)]
        rows.append((i, r.metric_id, r.metric_name, r.unit, r.period, r.assumption_statement, r.is_share, _chain(r), out.block if out.block in SCALAR else "value", bool(out.params.get("as_percent", True)), number.get(a), number.get(b), *given))
    schema = "recipe int, metric_id string, metric_name string, unit string, period int, assumption string, is_share boolean, blocks array<string>, kind string, percent boolean, a int, b int, a_given double, b_given double"
    asked = spark.createDataFrame(rows, schema)
    for k in ("a", "b"):
        asked = asked.join(figures.select(F.col("leaf").alias(k), F.col("figure").alias(f"{k}_figure")), k, "left").withColumn(f"{k}_value", F.coalesce(f"{k}_figure", f"{k}_given"))
    asked = asked.withColumn("r", _result()).join(_lineage(asked, cells), "recipe", "left")
    none = F.array()
    kinds = {"mixed": "array<string>", "sources": "array<struct<file:string,sheet:string,range:string>>", "cells": "array<string>"}
    asked = asked.withColumns({c: F.coalesce(c, none.cast(t)) for c, t in kinds.items()})
    return judged(asked.select("*", "r.value", "r.status", "r.reason"))


def _result() -> Column:
    """value, status and reason of a recipe from its two sides."""
    a, b = F.col("a_value"), F.col("b_value")
    plain = F.struct(a.alias("value"), F.lit(None).cast("string").alias("status"), F.when(a.isNull(), "no rows").alias("reason"))
    return F.when(F.col("kind") == "value", plain).when(F.col("kind") == "growth_rate", growth_rate(a, b)).when(F.col("percent"), ratio(a, b)).otherwise(ratio(a, b, False))


def _lineage(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """(recipe, mixed, sources, cells) as ``compile_recipe`` tells them."""
    uses = asked.select("recipe", F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("leaf")).distinct()
    seen = cells.groupBy("leaf", "canonical").agg(F.sort_array(F.collect_set("file")).alias("files")).where(F.size("files") > 1)
    told = F.concat(F.lit("ambiguous source: "), F.coalesce("canonical", F.lit("")), F.lit(" in "), F.array_join("files", ", "))
    mixed = uses.join(seen, "leaf").groupBy("recipe").agg(F.sort_array(F.collect_set(told)).alias("mixed"))
    places = ["file", "sheet", "col"]
    spans = cells.where("col IS NOT NULL").groupBy("leaf", *places).agg(F.min("row").alias("top"), F.max("row").alias("end"))
    spans = uses.join(spans, "leaf").groupBy("recipe", *places).agg(F.min("top").alias("top"), F.max("end").alias("end"))
    span = F.struct("file", "sheet", F.concat(a1(F.col("top"), F.col("col")), F.lit(":"), a1(F.col("end"), F.col("col"))).alias("range"))
    spans = spans.groupBy("recipe").agg(F.sort_array(F.collect_list(span)).alias("sources"))
    spots = ["file", "sheet", "row", "col"]
    firsts = first_rows(cells.select("leaf", *spots).distinct(), ["leaf"], spots, CELLS)
    firsts = first_rows(uses.join(firsts, "leaf").select("recipe", *spots).distinct(), ["recipe"], spots, CELLS)
    firsts = firsts.groupBy("recipe").agg(F.sort_array(F.collect_list(F.struct(*spots))).alias("c"))
    firsts = firsts.select("recipe", F.transform("c", lambda x: F.concat(x["sheet"], F.lit("!"), a1(x["row"], x["col"]))).alias("cells"))
    return meet(meet(asked.select("recipe"), mixed, ["recipe"], "left"), meet(spans, firsts, ["recipe"], "full"), ["recipe"], "left")
