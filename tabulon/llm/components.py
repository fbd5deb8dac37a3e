"""Distributed connected components: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Component of every node of ``edges`` (u, v): rows (node, comp), comp the component's smallest node.

    Each round takes the least label among a node's neighbours and then that label's own label, so long
    chains halve. Labels, neighbours' minima and edges are separate tables: a hub's rows meet a table of
    unique keys in a join whose large partitions adaptive execution can split; minima combine before the
    shuffle. Null ends and loops are dropped. No edges give no rows.
    """
    e = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))  # one pass over what edges come from
    e = scratch.write(e.select(both.alias("e")).select("e.*").distinct(), "edges")
    labels = scratch.write(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    moved = not labels.isEmpty()
    while moved:
        near = (
            e.join(labels.select(F.col("node").alias("v"), "comp"), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("m"))
        )
        hooked = scratch.write(labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("low")), "hooked")
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        lowest, seen = F.least("low", "lower"), Observation()
        new = hooked.join(jump, "low").observe(seen, F.count_if(lowest != F.col("comp")).alias("moved"))
        new = scratch.write(new.select("node", lowest.alias("comp")), "labels")
        moved = seen.get["moved"] > 0
        scratch.drop(labels, hooked)
        labels = new
    scratch.drop(e)
    return labels
