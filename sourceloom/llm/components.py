"""Connected components by contraction, without collecting anything: every round maps a node to its least neighbour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: label is the least node of its component.

    Edges with a null end and loops are ignored. A round replaces each edge by the edge between its ends' least
    neighbours; only nodes that are least among their neighbours remain, so the graph shrinks fast, and a round's map is a
    partial aggregation: a hub of any degree is one row a task before the shuffle. Edges of hubs that would outweigh a task are
    relabelled where they lie (see join_by_key).
    """
    graph = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    graph = staged(graph, "edges")
    maps: list[DataFrame] = []
    while not graph.isEmpty():
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"), "n")
        least = staged(least, "least")
        maps.append(least.drop("n"))
        left = least.select(F.col("node").alias("a"), F.col("to").alias("ta"), "n")
        right = least.select(F.col("node").alias("b"), F.col("to").alias("tb"), "n")
        graph = join_by_key(join_by_key(graph, left, "a"), right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        graph = staged(graph.where("a <> b").distinct(), "edges")
    if not maps:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def follow(labels: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("node").alias("label"), "to")
        return labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))

    return reduce(follow, maps[1:], maps[0].select("node", F.col("to").alias("label")))
