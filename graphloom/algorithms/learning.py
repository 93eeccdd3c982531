"""Federated averaging, training frames and link scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph


def fed_avg(updates: DataFrame, round_: str, weights: str, size: str) -> DataFrame:
    """(round, position, weight): the clients' weight vectors averaged by their sample sizes. Null weights, and sizes
    that are null or not above zero, are left out."""
    each = updates.where(F.col(size) > 0).select(F.col(round_).alias("round"), F.col(size).alias("__n"), F.posexplode(weights).alias("position", "__w")).where(F.col("__w").isNotNull())
    return each.groupBy("round", "position").agg((F.sum(F.col("__n") * F.col("__w")) / F.sum("__n")).alias("weight"))


def training_frame(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of attribute frames; of several rows of one key the one of the earliest frame is kept."""
    frames = [p.withColumn("__order", F.lit(i)) for i, p in enumerate(parts)]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "__order")]
    first = both.groupBy(key).agg(F.min_by(F.struct(*rest), "__order").alias("__row"))
    return first.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def training_memory_gb(graph_gb: float) -> float:
    """Memory that training on a graph of this size needs, by a linear fit."""
    return 3.6 * graph_gb + 2


def pack(sizes: dict[int, float], hosts: dict[str, float]) -> dict[str, list[int]]:
    """Best fit: each partition, largest first, to the host with the least room that still holds it; partitions that
    fit nowhere are left out."""
    room, out = dict(hosts), {h: [] for h in hosts}
    for part, need in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fits = [h for h in room if room[h] >= need]
        if fits:
            best = min(fits, key=lambda h: (room[h] - need, h))
            room[best] -= need
            out[best].append(part)
    return out


def link_scores(graph: Graph, features: str = "features", candidates: DataFrame | None = None) -> DataFrame:
    """(src, dst, score): cosine similarity of the ends' feature vectors, for candidate pairs (src, dst) or the
    graph's edges. Pairs with a missing or zero vector have a null score."""
    pairs = (candidates if candidates is not None else graph.edges).select("src", "dst").distinct()
    v = graph.vertices.select("id", F.transform(features, lambda x: x.cast("double")).alias("f"))
    x = pairs.join(v.select(F.col("id").alias("src"), F.col("f").alias("a")), "src", "left").join(v.select(F.col("id").alias("dst"), F.col("f").alias("b")), "dst", "left")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)
    return x.select("src", "dst", F.try_divide(dot(F.col("a"), F.col("b")), F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))).alias("score"))
