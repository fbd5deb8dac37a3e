"""Recipes: JSON graphs of whitelisted blocks, compiled to one lazy plan that gives one metric row."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.model import FAILED, NA, PASSED, ExecutionError
from tabulon.functions.scalar import a1
from tabulon.operators.blocks import BLOCKS, SCALAR, exclude_aggregates, present
from tabulon.operators.review import metric_issues
from tabulon.operators.validate import NON_NEGATIVE, PERCENT, sanity

DATASET = "dataset"
#: Blocks that leave subtotals and totals out by default.
DETAIL = ("group_sum", "group_mean", "pivot")
# Columns that a step of a planner that isn't trusted may filter on.
ADVERTISED = ("file", "canonical", "period", "aggregation_role")
# What a recipe has to state.
REQUIRED = ("metric_id", "metric_name", "unit", "period", "assumption_statement", "steps", "output")


@dataclass(frozen=True)
class Step:
    """A block with its inputs (ids of earlier steps or ``dataset``) and parameters; ``{"$ref": id}`` is a step's result."""

    id: str
    block: str
    inputs: tuple[str, ...] = (DATASET,)
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    metric_id: str
    metric_name: str
    unit: str
    period: int | None
    assumption_statement: str
    steps: tuple[Step, ...]
    output: str
    is_share: bool = False

    @classmethod
    def parse(cls, data: dict) -> Recipe:
        missing = [k for k in REQUIRED if k not in data]
        if missing:
            raise ExecutionError(f"recipe lacks {', '.join(missing)}")
        steps = []
        for s in data["steps"]:
            if s.get("block") not in BLOCKS:
                raise ExecutionError(f"unknown block {s.get('block')!r}")
            inputs = s.get("inputs") or [s.get("input", DATASET)]
            known = {DATASET, *(x.id for x in steps)}
            refs = [v["$ref"] for v in s.get("params", {}).values() if isinstance(v, dict) and "$ref" in v]
            unknown = [x for x in (*inputs, *refs) if x not in known]
            if unknown:
                raise ExecutionError(f"step {s.get('id')!r} refers to {unknown[0]!r}, which isn't an earlier step")
            steps.append(Step(s["id"], s["block"], tuple(inputs), dict(s.get("params", {}))))
        if data["output"] not in {s.id for s in steps}:
            raise ExecutionError(f"output {data['output']!r} is no step")
        return cls(**{k: data[k] for k in REQUIRED if k != "steps"}, steps=tuple(steps), is_share=bool(data.get("is_share")))


def check_fields(recipe: Recipe, known: set[str]) -> None:
    """Raise if a filter on canonical names a field that the catalog doesn't have."""
    for s in recipe.steps:
        if s.block == "filter" and s.params.get("column") == "canonical":
            v = s.params.get("value")
            unknown = [x for x in (v if isinstance(v, list) else [v]) if x not in known]
            if unknown:
                raise ExecutionError(f"unknown field {unknown[0]!r}")


def check_columns(recipe: Recipe, allowed: tuple[str, ...] = ADVERTISED) -> None:
    """Raise if a filter reads a column that isn't advertised."""
    for s in recipe.steps:
        if s.block == "filter" and s.params.get("column") not in allowed:
            raise ExecutionError(f"step {s.id!r} filters on {s.params.get('column')!r}, which isn't one of {', '.join(allowed)}")


def tool_schema() -> dict:
    """JSON schema of a recipe: what a planner may name."""
    step = {
        "type": "object", "required": ["id", "block"],
        "properties": {
            "id": {"type": "string"}, "block": {"enum": sorted(BLOCKS)}, "input": {"type": "string", "default": DATASET},
            "inputs": {"type": "array", "items": {"type": "string"}}, "params": {"type": "object"},
        },
    }
    text = {"type": "string"}
    types = {"period": {"type": ["integer", "null"]}, "steps": {"type": "array", "items": step}}
    return {"type": "object", "required": list(REQUIRED), "properties": {k: types.get(k, text) for k in REQUIRED} | {"is_share": {"type": "boolean"}}}


def _one_value(df: DataFrame, name: str) -> DataFrame:
    """One row with the frame's only value, null if it is empty; more rows fail when the plan runs."""
    if "value" not in df.columns:
        raise ExecutionError(f"step {name!r} has no value column")
    single = F.when(F.count(F.lit(1)) <= 1, F.first(present(F.col("value")))).otherwise(F.raise_error(F.lit(f"step {name!r} gives more than one row")).cast("double"))
    return df.agg(single.alias("value"))


COORDINATES = ("file", "sheet", "canonical", "row", "col")
#: Cells that a metric cites at most.
CELLS = 30


def _sources(leaves: list[DataFrame]) -> DataFrame:
    """One row about the cells that a metric rests on: fields taken from several files, ranges and first cells.

    Leaves are the last frames with coordinates on each way to the output; a field in several files counts within one leaf
    only, since two leaves may well stand for two files.
    """
    rows = reduce(DataFrame.unionByName, (x.select(*COORDINATES, F.lit(i).alias("leaf")) for i, x in enumerate(leaves)))
    mixed = rows.groupBy("leaf", "canonical").agg(F.sort_array(F.collect_set("file")).alias("files")).where(F.size("files") > 1)
    mixed = mixed.agg(F.sort_array(F.collect_set(F.concat(F.lit("ambiguous source: "), F.coalesce("canonical", F.lit("")), F.lit(" in "), F.array_join("files", ", ")))).alias("mixed"))
    spans = rows.groupBy("file", "sheet", "col").agg(F.min("row").alias("top"), F.max("row").alias("end")).where("col IS NOT NULL")
    span = F.struct("file", "sheet", F.concat(a1(F.col("top"), F.col("col")), F.lit(":"), a1(F.col("end"), F.col("col"))).alias("range"))
    spans = spans.agg(F.sort_array(F.collect_list(span)).alias("sources"))
    cells = rows.select("file", "sheet", "row", "col").distinct().orderBy("file", "sheet", "row", "col").limit(CELLS)
    cells = cells.agg(F.sort_array(F.collect_list(F.struct("file", "sheet", "row", "col"))).alias("c"))
    cells = cells.select(F.transform("c", lambda x: F.concat(x["sheet"], F.lit("!"), a1(x["row"], x["col"]))).alias("cells"))
    return mixed.join(F.broadcast(spans)).join(F.broadcast(cells))  # one row each


def compile_recipe(recipe: Recipe, dataset: DataFrame) -> DataFrame:
    """A row METRIC; nothing runs before the caller's action.

    A field that the output sums over several files makes the metric fail, whatever its value. issues lists all that is
    wrong; sources and cells say where the numbers come from, over all ways to the output.
    """
    frames: dict[str, DataFrame] = {DATASET: dataset}
    leaves: dict[str, list[DataFrame]] = {DATASET: [dataset] if set(COORDINATES) <= set(dataset.columns) else []}
    chain: dict[str, list[str]] = {DATASET: []}
    for s in recipe.steps:
        params, refs = {}, {}
        for k, v in s.params.items():
            (refs if isinstance(v, dict) and "$ref" in v else params)[k] = v["$ref"] if isinstance(v, dict) and "$ref" in v else v
        try:
            if s.block in SCALAR:
                sides = [_one_value(frames[r], r).withColumnRenamed("value", k) for k, r in refs.items()]
                row = reduce(lambda a, b: a.join(F.broadcast(b)), sides)  # one row each
                given = {k: F.lit(params.pop(k)) for k in list(params) if k in ("numerator", "denominator", "current", "previous")}
                frames[s.id] = row.select(BLOCKS[s.block](**{k: F.col(k) for k in refs}, **given, **params).alias("r")).select("r.*")
            else:
                frames[s.id] = BLOCKS[s.block](*(frames[x] for x in s.inputs), **params, **{k: frames[r] for k, r in refs.items()})
        except TypeError as e:
            raise ExecutionError(f"step {s.id!r}: {e}") from e
        above = [*(() if s.block in SCALAR else s.inputs), *refs.values()]
        out = frames[s.id]
        if set(COORDINATES) <= set(out.columns):
            leaves[s.id] = [out]
        else:
            kept = [detail(x) if s.block in DETAIL and params.get("detail_only", True) else x for k in above for x in leaves[k]]
            leaves[s.id] = list({id(x): x for x in kept}.values())
        chain[s.id] = [*dict.fromkeys(x for k in above for x in chain[k]), f"{s.id}:{s.block}"]
    out = frames[recipe.output]
    if "status" not in out.columns:
        out = _one_value(out, recipe.output).select("value", F.lit(None).cast("string").alias("status"), F.when(F.col("value").isNull(), "no rows").alias("reason"))
    if leaves[recipe.output]:
        out = out.join(F.broadcast(_sources(leaves[recipe.output])))  # one row each
    else:
        none = F.array().cast("array<string>")
        out = out.withColumns({"mixed": none, "sources": F.array().cast("array<struct<file:string,sheet:string,range:string>>"), "cells": none})
    about = {"metric_name": recipe.metric_name, "unit": recipe.unit, "period": recipe.period, "assumption": recipe.assumption_statement, "is_share": recipe.is_share}
    out = out.withColumns({k: F.lit(v).cast({"period": "int", "is_share": "boolean"}.get(k, "string")) for k, v in about.items()})
    return judged(out.withColumns({"metric_id": F.lit(recipe.metric_id), "blocks": F.array(*(F.lit(x) for x in chain[recipe.output]))}))


def judged(out: DataFrame) -> DataFrame:
    """METRIC rows of values with status, reason, mixed and what is known of the recipe: issues listed, status settled."""
    value, unit, share = F.col("value"), F.col("unit"), F.col("is_share")
    issues = F.concat("mixed", metric_issues(value, unit, share, PERCENT, NON_NEGATIVE))
    status = F.when(F.size("mixed") > 0, FAILED).when(value.isNull() | (F.col("status") == NA), NA).when(sanity(value, unit, share) == FAILED, FAILED).otherwise(PASSED)
    return out.select(
        "metric_id", "metric_name", "value", "unit", "period", status.alias("status"), "reason", issues.alias("issues"), "assumption", "blocks", "sources", "cells",
    )


def detail(df: DataFrame) -> DataFrame:
    """What a guarded sum reads of a leaf."""
    return exclude_aggregates(df)


def compile_all(recipes: list[dict], dataset: DataFrame, fields: set[str] | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Metrics of all valid recipes, and (metric_id, reason) of those refused. Recipes that ``batch`` takes share one scan, others have a plan each."""
    from tabulon.plans import batch

    rows, refused, many = [], [], []
    for data in recipes:
        try:
            r = Recipe.parse(data)
            if fields is not None:
                check_fields(r, fields)
            if batch.takes(r, dataset):
                many.append(r)
            else:
                rows.append(compile_recipe(r, dataset))
        except ExecutionError as e:
            refused.append((str(data.get("metric_id")), str(e)))
    if many:
        rows.append(batch.compile_batch(many, dataset))
    return (reduce(DataFrame.unionByName, rows) if rows else None), refused
