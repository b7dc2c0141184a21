"""Connected components by minimum labels, pointer jumping and contraction of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import Scratch, is_empty


def _flatten(scratch: Scratch, parents: DataFrame, name: str) -> DataFrame:
    """Pointer jumping: parent := parent of parent, until all point at a root."""
    step, before = 0, None
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        jumped = parents.select("node", "parent").join(up, "parent").select(
            "node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")
        )
        parents = scratch.save(jumped, f"{name}-{step}")
        if before:
            scratch.drop(before)
        before, step = f"{name}-{step}", step + 1
        if is_empty(parents.where("moved")):
            return parents.select("node", "parent")


def component_labels(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reached.

    A node takes the smallest label among itself and its neighbours; the label trees are
    flattened, and the edges rewritten between labels. A node keeps its own label only where
    it is smaller than all neighbours, so each round leaves fewer nodes with edges; rounds
    end when no edge is left. Every round is written. The lookups join many rows to one row
    a node, so a hub's rows can be split over tasks with that row copied.
    """
    edges, steps, round_no = scratch.save(edges, "edges-0"), [], 0
    while not is_empty(edges):
        both = edges.union(edges.select("v", "u"))
        hooked = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select(
            "node", F.least("node", "least").alias("parent")
        )
        hooked = scratch.save(hooked, f"hooked-{round_no}")
        parents = _flatten(scratch, hooked, f"parents-{round_no}")
        scratch.drop(f"hooked-{round_no}")
        steps.append(parents)
        at_u = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        at_v = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = edges.join(at_u, "u").join(at_v, "v").where("pu <> pv")
        moved = moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        edges = scratch.save(moved, f"edges-{round_no + 1}")
        scratch.drop(f"edges-{round_no}")
        round_no += 1
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = steps[-1]
    for parents in reversed(steps[:-1]):
        later = labels.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        labels = parents.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
    return labels.select("node", F.col("parent").alias("root"))
