"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def components(edges: DataFrame, mixed: bool = False) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b); the component is its smallest node.

    In each round every node is replaced by the smallest among itself and its neighbours, until no edge is left
    between different nodes. Edges shrink at each round, each is written to the shared folder, and minima have partial
    aggregates, so a node with very many neighbours costs a row for each task. A path whose nodes ascend loses only one node in a
    round; ``mixed`` has another order in each round, by hashes, so that such paths are halved, and looks for the smallest nodes at
    the end.
    """
    edges = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("hash"), F.col(c).alias("node"))  # noqa: B023, E731
        if mixed:
            step = both.groupBy("a").agg(F.min(rank("b")).alias("to")).select("a", F.least(rank("a"), "to")["node"].alias("to"))
        else:
            step = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to"))
        step = saved(step, "cc-step")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            moved = step.select(F.col("a").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = saved(labels, "cc-labels")
        first = edges.join(step.withColumnRenamed("to", "c"), "a").select("b", "c")
        second = first.join(step.select(F.col("a").alias("b"), "to"), "b").select(F.least("c", "to").alias("a"), F.greatest("c", "to").alias("b"))
        edges = saved(second.filter("a <> b").distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if mixed:
        smallest = labels.groupBy("component").agg(F.min("node").alias("smallest"))
        labels = labels.join(smallest, "component").select("node", F.col("smallest").alias("component"))
    return labels
