"""Problem 1: pairwise matches become groups.

Method: minimum labels travel across the edges, pointer jumping flattens the label
trees, and every round is written to the shared folder until no label changes. After
each round the edges are rewritten between labels (operators/components.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import component_labels
from corvane.runtime import Scratch


def linked(pairs: DataFrame, scope: str, a: str, b: str, score: str, threshold: float) -> DataFrame:
    """Distinct accepted edges (scope, a, b) with a < b.

    A pair counts if any of its rows, in either order, reaches the threshold. Rows with
    a null scope, id or score, a NaN score or twice the same item are no edge.
    """
    ok = (F.col(score) >= threshold) & ~F.isnan(score) & (F.col(a) != F.col(b)) & F.col(scope).isNotNull()
    return (
        pairs.where(ok)
        .select(F.col(scope).alias("scope"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


def group_items(
    pairs: DataFrame,
    scope: str = "experiment_id",
    a: str = "item_id_a",
    b: str = "item_id_b",
    score: str = "score",
    threshold: float = 0.62,
) -> DataFrame:
    """One row (scope, item_id, group_id) for each item with a link.

    group_id is the smallest item id reached directly or indirectly within the scope,
    itself included. Items without an accepted link don't appear; an empty input gives
    an empty result. Other columns of the input, whatever their names, are ignored.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    named = scratch.save(linked(pairs, scope, a, b, score, threshold), "named")
    ends = named.select("scope", F.col("a").alias("item")).union(named.select("scope", "b")).distinct()
    # Numbers instead of strings: exact, eight bytes to shuffle, and in no order an adversary chose.
    nodes = scratch.save(ends.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = named.join(nodes.select("scope", F.col("item").alias("a"), F.col("node").alias("x")), ["scope", "a"])
    edges = edges.join(nodes.select("scope", F.col("item").alias("b"), F.col("node").alias("y")), ["scope", "b"])
    edges = edges.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    labelled = scratch.save(nodes.join(component_labels(scratch, edges), "node"), "labelled")
    least = labelled.groupBy("root").agg(F.min("item").alias("group_id"))
    return labelled.join(least, "root").select(
        F.col("scope").alias(scope), F.col("item").alias("item_id"), "group_id"
    )
