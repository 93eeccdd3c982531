"""Triangles of the undirected simple graph beneath a graph: parallel edges count once, self-loops never."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..runtime import materialize


def oriented(pairs: DataFrame) -> DataFrame:
    """(lo, hi) of distinct undirected pairs (a, b), pointing from the end of smaller (degree, id) to the other. No
    vertex has more than about sqrt(2 E) out-edges then, so a hub's neighbours are never paired with each other."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))
    degree = ends.groupBy("v").agg(F.count("*").alias("d"))
    x = pairs.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    return x.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))


def _met(graph: Graph) -> DataFrame:
    """(lo, hi, third): every oriented edge with the heads that both its ends point to. Only edges are shuffled, each
    with its ends' lists of heads, which hold about sqrt(2 E) entries at most; no wedge is ever a row. The oriented pairs
    are written out once, since the edges and the lists both come from them."""
    e = materialize(oriented(materialize(graph.undirected_pairs(), "pairs")), "oriented")
    heads = e.groupBy("lo").agg(F.collect_list("hi").alias("heads"))
    both = e.join(heads, "lo").join(heads.select(F.col("lo").alias("hi"), F.col("heads").alias("far")), "hi")
    return both.select("lo", "hi", F.array_intersect("heads", "far").alias("third"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c), a < b < c, of every triangle, once."""
    x = _met(graph).select("lo", "hi", F.explode("third").alias("n"))
    s = F.array_sort(F.array("lo", "hi", "n"))
    return x.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def triangle_count(graph: Graph) -> DataFrame:
    """One row: the number of triangles, 0 for an empty graph."""
    return _met(graph).agg(F.coalesce(F.sum(F.size("third").cast("bigint")), F.lit(0)).alias("triangles"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    """(id, triangles) of vertices in at least one triangle."""
    each = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id"))
    return each.groupBy("id").agg(F.count("*").alias("triangles"))
