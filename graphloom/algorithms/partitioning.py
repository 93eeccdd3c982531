"""Vertex partitioning: hash, and the two greedy stream partitioners; quality of a partitioning."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph

# Numbers of the partitioning algorithms.
ALGORITHMS = {1: "HASH", 2: "FENNEL", 3: "LDG", 4: "METIS"}


def automatic_count(edges: int) -> int:
    """Partitions for a graph of so many edges: a sixth of the fifth root, two at least."""
    return max(2, round(edges**0.2 / 6))


def hash_partition(id_: Column, n: int) -> Column:
    return F.pmod(id_, F.lit(n))


def partition_stats(graph: Graph, n: int) -> DataFrame:
    """Per hash partition: vertices, edges inside it, cut edges that leave from it, and the share of cut edges."""
    return stats(graph, graph.vertices.select("id", hash_partition(F.col("id"), n).cast("int").alias("part")), True, n)


def stats(graph: Graph, placed: DataFrame, by_hash: bool = False, n: int = 0) -> DataFrame:
    """As partition_stats(), for any placement (id, part)."""
    if by_hash:
        e = graph.edges.select(hash_partition(F.col("src"), n).cast("int").alias("p"), hash_partition(F.col("dst"), n).cast("int").alias("q"))
    else:
        s = placed.select(F.col("id").alias("src"), F.col("part").alias("p"))
        t = placed.select(F.col("id").alias("dst"), F.col("part").alias("q"))
        e = graph.edges.select("src", "dst").join(s, "src").join(t, "dst")
    inside = F.col("p") == F.col("q")
    per_edge = e.groupBy(F.col("p").alias("part")).agg(F.sum(inside.cast("bigint")).alias("local_edges"), F.sum((~inside).cast("bigint")).alias("cut_edges"))
    per_vertex = placed.groupBy("part").agg(F.count("*").alias("vertices"))
    out = per_vertex.join(per_edge, "part", "left")
    local, cut = (F.coalesce(c, F.lit(0)) for c in ("local_edges", "cut_edges"))
    return out.select("part", "vertices", local.alias("local_edges"), cut.alias("cut_edges"), F.coalesce(F.try_divide(cut.cast("double"), local + cut), F.lit(0.0)).alias("cut_ratio"))


def _choose(scores: list[float]) -> int:
    return max(range(len(scores)), key=lambda i: (scores[i], -i))


def stream_place(edges: Iterable[tuple[int, int]], n: int, method: str, vertices: int, total_edges: int, gamma: float = 1.5, owned: Callable[[int], bool] = lambda _: True) -> dict[int, int]:
    """Placement of a stream of edges in its order, each new vertex by its neighbours placed so far: LDG weighs them
    by what room a partition has left and goes where there is room, FENNEL subtracts the marginal cost of the
    partition's size. Ties: the lower number. Only vertices that are `owned` are placed."""
    if method not in ("LDG", "FENNEL"):
        raise ValueError(f"no stream partitioner {method}")
    place: dict[int, int] = {}
    seen: dict[int, list[int]] = defaultdict(lambda: [0] * n)
    size = [0] * n
    room = max(1.0, vertices / n)
    a = total_edges * n ** (gamma - 1) / max(1, vertices) ** gamma
    for u, v in edges:
        for x, y in ((u, v), (v, u)):
            if not owned(x):
                continue
            near = seen[x]
            if y in place:
                near[place[y]] += 1
            if x in place:
                continue
            if method == "LDG":
                scores = [max(1, near[i]) * (1 - size[i] / room) for i in range(n)]
            else:
                scores = [near[i] - a * ((size[i] + 1) ** gamma - size[i] ** gamma) for i in range(n)]
            place[x] = _choose(scores)
            size[place[x]] += 1
    return place


def stream_partition(graph: Graph, n: int, method: str = "LDG", streams: int = 1) -> DataFrame:
    """(id, part) by a greedy stream partitioner. The methods look at edges one after the other; `streams` splits the
    vertices by hash into so many streams that run side by side - the loader's threads, so to say. A vertex belongs to
    one stream, which sees all its edges in the order of their numbers and alone places it; neighbours count where the
    same stream has placed them. Each stream keeps its own share of the capacity, so all of them together keep the
    whole: LDG leaves no partition with more than vertices / n and one per stream. One stream is the exact sequential
    method and one task: use it for graphs that one task can hold. Vertices without edges go by hash."""
    graph = graph.keyed()
    e = graph.edges.select("eid", "src", "dst")
    owner = lambda c: F.pmod(F.xxhash64(c), F.lit(streams)).cast("int")
    both = e.withColumns({"a": owner("src"), "b": owner("dst")})
    each = both.select("eid", "src", "dst", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("stream"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("eid")
        mine = int(pdf["stream"].iloc[0])
        own = set(pdf.loc[pdf["a"] == mine, "src"]) | set(pdf.loc[pdf["b"] == mine, "dst"])
        place = stream_place(zip(pdf["src"].tolist(), pdf["dst"].tolist()), n, method, len(own), len(pdf), owned=own.__contains__)
        return pd.DataFrame({"id": list(place), "part": list(place.values())})

    placed = each.groupBy("stream").applyInPandas(run, "id long, part int")
    return graph.vertices.select("id").join(placed, "id", "left").select("id", F.coalesce("part", F.pmod(F.col("id"), F.lit(n)).cast("int")).alias("part"))
