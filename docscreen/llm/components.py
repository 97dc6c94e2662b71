"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscreen.session import cut_lineage


def _spread_minimum(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest of u and its neighbours.

    The minimum is a table of its own, so that both sides of the join are plain exchanges and a
    node with very many edges is split by the skew join.
    """
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("low"))
                        .select("u", F.least("u", "low").alias("low")))
    return edges.join(least, "u")


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    Nodes are longs; pairs may repeat and come in either order. Every round writes the edges to
    the shared folder and stops when they no longer change; their number never grows.
    """
    edges = (pairs.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
             .filter("u <> v").distinct())
    edges, before = cut_lineage(edges), None
    while True:
        print_of = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before or not print_of[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = print_of
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_spread_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .distinct())
        small = _spread_minimum(cut_lineage(large))
        edges = cut_lineage(
            small.select(F.explode(F.array(
                F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.*").filter("u <> v").distinct())
