"""PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..runtime import dropped, materialize


def pagerank(graph: Graph, alpha: float = 0.85, iterations: int = 10) -> DataFrame:
    """(id, rank) after `iterations` rounds of r = (1 - alpha)/N + alpha (sum of r(u)/outdegree(u) over distinct edges
    u -> v, plus the rank of vertices without out-edges spread evenly); ranks sum to 1.

    The edges with their weights are written once; a round is one join and one aggregation with map-side combine, so a
    vertex with a third of all edges costs one partial sum per task. Every round's ranks are written to the shared
    folder and those before the last are removed: each plan reads one round and is as large as the first, and a lost
    executor costs no earlier round. An empty graph gives no rows.
    """
    if not 0 <= alpha < 1:
        raise ValueError("alpha is at least 0 and below 1")
    if not 0 < iterations < 1000:
        raise ValueError("iterations are between 1 and 999")
    adjacency = graph.adjacency()
    degree = adjacency.groupBy("src").agg(F.count("*").alias("out"))
    edges = materialize(adjacency.join(degree, "src").select("src", "dst", (1.0 / F.col("out")).alias("w")), "edges")
    vertices = materialize(graph.vertices.select("id").join(degree.select(F.col("src").alias("id"), F.lit(True).alias("goes")), "id", "left").select("id", F.col("goes").isNull().alias("dangling")), "vertices")
    n = vertices.count()
    ranks = vertices.withColumn("rank", F.lit(1.0 / max(n, 1)))
    before: list[DataFrame] = []
    for i in range(1, iterations + 1):
        ranks = one_round(ranks, edges, vertices, n, alpha)
        if i < iterations:
            ranks = materialize(ranks, "ranks")
            before.append(ranks)
            if len(before) > 1:
                dropped(before.pop(0))
    return ranks.select("id", "rank")


def one_round(ranks: DataFrame, edges: DataFrame, vertices: DataFrame, n: int, alpha: float) -> DataFrame:
    """The ranks (id, dangling, rank) after one more round."""
    given = ranks.select(F.col("id").alias("src"), "rank").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
    loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
    rank = F.lit((1 - alpha) / max(n, 1)) + F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + loose / F.lit(float(max(n, 1))))
    return vertices.join(given, "id", "left").select("id", "dangling", rank.alias("rank"))
