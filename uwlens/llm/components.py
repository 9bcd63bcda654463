"""Connected components of a link table, as Spark joins (large-star / small-star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hook every neighbour of a node to the smallest node around it.

    Large star moves the neighbours above the node, small star the ones below it and the node itself.
    Edges go from the smaller node ``a`` to the larger ``b``; neighbourhoods are never collected."""
    near = edges.select(F.col("b").alias("a"), F.col("a").alias("b")) if small else _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hooked = near.join(least, "a")
    if small:
        out = hooked.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    else:
        out = hooked.where("b > a").select(F.col("m").alias("a"), "b")
    return (out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Both stars repeat until nothing moves (about log of the component's diameter rounds); each round
    is written to the shared folder, so lineage stays short and a lost executor repeats one round."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    step, seen = 0, None
    edges = scratch.save(edges, f"{name}0")
    mark = _mark(edges)
    while mark != seen:
        seen, step = mark, step + 1
        edges = scratch.save(_stars(_stars(edges, small=False), small=True), f"{name}{step}")
        mark = _mark(edges)
        scratch.drop(f"{name}{step - 1}")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
