"""Connected components of an edge table by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import stage


def _local_forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one partition replaced by (node, least node of its local group): never more rows than nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 50_000):
        yield pd.DataFrame(pairs[i : i + 50_000], columns=["a", "b"])


#: Edges that one task may join on its own (a few tens of MB); a smaller graph needs no rounds.
EDGES_A_TASK = 100_000


def _labels_at_once(edges: DataFrame) -> DataFrame:
    """(id, component) of a graph of at most ``EDGES_A_TASK`` edges, in one task."""
    roots = edges.coalesce(1).mapInPandas(_local_forest, "a bigint, b bigint").select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def components(edges: DataFrame, rounds: int = 60, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(id, component) for each end of an edge (a, b); component is the least id of the connected component.

    Each round every node points at the neighbour (or itself) whose hash is least, and the graph is
    contracted along the pointers. Nodes of the contracted graph fall by a constant share a round, and
    edges inside what is joined already disappear, so large groups cost no more than small ones. Once no
    more than ``edges_a_task`` edges are left, one task joins the rest.
    """
    left = stage(edges.select("a", "b"), "cc-edges")
    if left.count() <= edges_a_task:
        return stage(_labels_at_once(left), "cc-labels", done=(left,))
    left = stage(left.mapInPandas(_local_forest, "a bigint, b bigint"), "cc-edges", done=(left,))
    labels = stage(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("label", F.col("id")), "cc-labels")
    for _ in range(rounds):
        both = left.select("a", "b").union(left.select("b", "a"))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("x"))).alias("best")
        me = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("x"))
        points = stage(both.groupBy("a").agg(best).select(F.col("a").alias("old"), F.least("best", me)["x"].alias("new")), "cc-points")
        moved = labels.join(points.hint("merge"), labels.label == points.old, "left")
        labels = stage(moved.select("id", F.coalesce("new", "label").alias("label")), "cc-labels", done=(labels,))
        to_a, to_b = points.select(F.col("old").alias("a"), F.col("new").alias("x")), points.select(F.col("old").alias("b"), F.col("new").alias("y"))
        moved = left.join(to_a.hint("merge"), "a").join(to_b.hint("merge"), "b").filter("x <> y")
        left = stage(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().mapInPandas(_local_forest, "a bigint, b bigint"), "cc-edges", done=(left, points))
        if left.count() <= edges_a_task:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    rest = _labels_at_once(left)
    joined = labels.join(rest.select(F.col("id").alias("label"), "component").hint("merge"), "label", "left").select("id", F.coalesce("component", "label").alias("label"))
    joined = stage(joined, "cc-labels")
    least = stage(joined.groupBy("label").agg(F.min("id").alias("component")), "cc-least")
    return joined.join(least.hint("merge"), "label").select("id", "component")
