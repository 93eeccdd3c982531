"""The property graph: a vertex and an edge DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .runtime import materialize

VERTEX_SYSTEM = ("id", "label", "labels", "props")
EDGE_SYSTEM = ("eid", "src", "dst", "type", "props")


@dataclass(frozen=True)
class Graph:
    """vertices(id bigint, label string and/or labels array<string>, typed property columns and/or props
    map<string,string>); edges(src, dst, type, property columns and/or props, eid bigint where an edge needs an
    identity: keyed() adds it). Edges join existing vertices (valid() checks it); parallel edges and self-loops are
    allowed. In an undirected graph an edge is stored once and matches both ways."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def of_edges(edges: DataFrame, directed: bool = True, partitions: int | None = None) -> Graph:
        """A graph of (src, dst) rows: vertices are the distinct endpoints, type is DEFAULT when there is none. Rows
        with a null end are left out."""
        e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        e = e.withColumns({"src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint")})
        if "type" not in e.columns:
            e = e.withColumn("type", F.lit("DEFAULT"))
        v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.lit(None).cast("string"))
        first = [c for c in EDGE_SYSTEM[:4] if c in e.columns]
        return Graph(v, e.select(*first, *[c for c in e.columns if c not in first]), directed)

    def keyed(self) -> Graph:
        """The graph with edge numbers: a row's eid is its partition and its place there, so no two rows share one
        however many there are. The edges are written out with them, so that every reading sees the same numbers; a
        graph that has them is returned as it is."""
        if "eid" in self.edges.columns:
            return self
        return Graph(self.vertices, materialize(self.edges.select(F.monotonically_increasing_id().alias("eid"), "*"), "edges"), self.directed)

    @staticmethod
    def of_labels(vertices: dict[str, DataFrame], edges: dict[str, DataFrame], directed: bool = True) -> Graph:
        """A graph of one typed DataFrame per label (with id) and per edge type (with eid, src, dst)."""
        v = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("label", F.lit(name)) for name, df in vertices.items()])
        e = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("type", F.lit(name)) for name, df in edges.items()])
        return Graph(v, e, directed)

    def vertex_count(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("vertices"))

    def edge_count(self) -> DataFrame:
        """All stored edges; repeated ones count."""
        return self.edges.agg(F.count("*").alias("edges"))

    def valid(self) -> DataFrame:
        """Edges with an end that is no vertex; empty if the graph is sound."""
        ends = [self.vertices.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}")) for c in ("src", "dst")]
        x = self.edges.join(ends[0], "src", "left").join(ends[1], "dst", "left")
        return x.where(F.col("__src").isNull() | F.col("__dst").isNull()).select(*self.edges.columns)

    def adjacency(self) -> DataFrame:
        """Distinct (src, dst); both ways for an undirected graph."""
        e = self.edges.select("src", "dst")
        if not self.directed:
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return e.distinct()

    def undirected_pairs(self) -> DataFrame:
        """Distinct (a, b) with a < b of adjacent vertices, self-loops left out."""
        return self.edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
