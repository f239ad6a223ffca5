"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))


def _to_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that has an edge, with the least node it is connected to.

    Large-star and small-star steps in turn: neighbours move to the least of their neighbourhood until
    nothing changes. A step is an aggregate and a join; a node with very many neighbours is a hot key of
    that join only, never one task's group. Edges to itself and repeated edges do no harm; no edges, no rows.
    """
    edges = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    state = _state(edges)
    while state[0]:
        large = _to_least(_both_ways(edges)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(large.where("a > b").distinct())
        small = _to_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        moved = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        edges = cut_lineage(moved.where("a > b").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
