"""Degree distributions and ego networks over distinct edges; an undirected graph counts both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph


def out_degrees(graph: Graph) -> DataFrame:
    """(id, degree) of vertices with an edge going out: number of distinct heads, a self-loop included."""
    return graph.adjacency().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def in_degrees(graph: Graph) -> DataFrame:
    """(id, degree) of vertices with an edge coming in."""
    return graph.adjacency().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


def ego_net(graph: Graph, egos: DataFrame | None = None) -> DataFrame:
    """(ego, src, dst): the edges from each vertex to its neighbours, and the edges among those neighbours.
    egos: (id) of the vertices wanted, all by default. The result of all vertices is as large as the number of
    wedges that close; ask for those needed."""
    n = graph.adjacency().where(F.col("src") != F.col("dst"))
    star = n.select(F.col("src").alias("ego"), F.col("dst").alias("w"))
    if egos is not None:
        star = star.join(egos.select(F.col("id").alias("ego")).distinct(), "ego", "left_semi")
    spokes = star.select("ego", F.col("ego").alias("src"), F.col("w").alias("dst"))
    second = star.join(n.select(F.col("src").alias("w"), F.col("dst").alias("x")), "w")
    rim = second.join(star.select("ego", F.col("w").alias("x")), ["ego", "x"], "left_semi").select("ego", F.col("w").alias("src"), F.col("x").alias("dst"))
    return spokes.unionByName(rim)
