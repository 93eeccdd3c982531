"""CALL procedures: the algorithms by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..algorithms import degrees, pagerank, partitioning, triangles
from ..graph import Graph


@dataclass(frozen=True)
class Procedure:
    columns: tuple[str, ...]
    run: Callable[..., DataFrame]


def _ego(graph: Graph, *ids: int) -> DataFrame:
    wanted = graph.vertices.select("id").where(F.col("id").isin(*ids)) if ids else None
    return degrees.ego_net(graph, wanted)


#: lower-case name -> procedure; run() of the query engine takes more of them.
PROCEDURES: dict[str, Procedure] = {
    "algo.trianglecount": Procedure(("triangles",), triangles.triangle_count),
    "algo.triangles": Procedure(("a", "b", "c"), triangles.triangles),
    "algo.pagerank": Procedure(("id", "rank"), pagerank.pagerank),
    "algo.indegree": Procedure(("id", "degree"), degrees.in_degrees),
    "algo.outdegree": Procedure(("id", "degree"), degrees.out_degrees),
    "algo.egonet": Procedure(("ego", "src", "dst"), _ego),
    "algo.partitionstats": Procedure(("part", "vertices", "local_edges", "cut_edges", "cut_ratio"), partitioning.partition_stats),
    "db.vertexcount": Procedure(("vertices",), lambda g: g.vertex_count()),
    "db.edgecount": Procedure(("edges",), lambda g: g.edge_count()),
    "db.labels": Procedure(("label",), lambda g: g.vertices.select("label").where("label is not null").distinct()),
    "db.relationshiptypes": Procedure(("type",), lambda g: g.edges.select("type").distinct()),
}
