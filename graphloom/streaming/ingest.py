"""Continuous ingest of edges and continuous triangle counts.

Batches are idempotent: whatever a batch adds goes to a folder of its batch number, a batch that is run again after a
failure writes the same rows over it, and the state of a batch is that of all earlier numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import dropped, materialize
from ..sources.edges import edges_of_json, parse_edge_json

PAIRS = "a bigint, b bigint"
#: Pairs that a task of triangle_delta() holds, about, and the neighbours that it looks up at a time.
PART, LOOKUPS = 2_000_000, 4_000_000


def read_stream(spark: SparkSession, path: str, kind: str = "text", options: dict[str, str] | None = None) -> DataFrame:
    """Lines of new files of a folder, or of a Kafka topic (kind 'kafka' with its usual options; the connector must
    be on the class path)."""
    if kind == "kafka":
        x = spark.readStream.format("kafka").options(**({"subscribe": path, "startingOffsets": "earliest"} | (options or {}))).load()
        return x.select(F.col("value").cast("string").alias("value"))
    return spark.readStream.options(**(options or {})).text(path)


def stream_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, type, props) of edge messages; end marks and lines that are no edge are left out."""
    return edges_of_json(parse_edge_json(lines.where(F.trim("value") != "-1")))


def _swept(batch: DataFrame) -> SparkSession:
    """The session of a stream's batch, set to remove a query's shuffle files when the query ends; else those of all
    batches lie there until the driver collects its garbage."""
    batch.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return batch.sparkSession


def pairs_of(edges: DataFrame) -> DataFrame:
    """Distinct undirected pairs a < b."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _closed(a: np.ndarray, b: np.ndarray, tag: np.ndarray, want: int) -> int:
    """Triangles of distinct pairs whose sides' tags have all bits of `want` between them. Pairs point to the end of
    larger degree; the shorter of both ends' lists is looked up in the other's, some lists at a time."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(ids), len(a)
    place = np.empty(n, np.int64)
    place[np.argsort(np.bincount(ends, minlength=n), kind="stable")] = np.arange(n)
    u, v = place[ends[:m]], place[ends[m:]]
    key = np.minimum(u, v) * n + np.maximum(u, v)
    order = np.argsort(key)
    key, tag = key[order], tag[order]
    lo, hi = np.divmod(key, n)
    first = np.searchsorted(lo, np.arange(n + 1))
    bits = np.zeros(n, tag.dtype)
    np.bitwise_or.at(bits, lo, tag)
    own, far = first[lo + 1] - np.arange(m) - 1, first[hi + 1] - first[hi]  # heads beyond hi: of lo, of hi
    base = np.flatnonzero((np.minimum(own, far) > 0) & (((tag | bits[lo] | bits[hi]) & want) == want))
    short = own[base] <= far[base]
    size, start, other = np.where(short, own[base], far[base]), np.where(short, base + 1, first[hi[base]]), np.where(short, hi[base], lo[base])
    upto, count = np.cumsum(size), 0
    for some in np.split(np.arange(len(base)), np.flatnonzero(np.diff(upto // LOOKUPS)) + 1):
        k = np.repeat(some, size[some])
        at = start[k] + np.arange(len(k)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        asked = other[k] * n + hi[at]
        found = np.minimum(np.searchsorted(key, asked), m - 1)
        hit = key[found] == asked
        count += int(np.count_nonzero(((tag[base[k[hit]]] | tag[at[hit]] | tag[found[hit]]) & want) == want))
    return count


def triangle_delta(old: DataFrame, new: DataFrame, part: int = PART) -> DataFrame:
    """One row `triangles`: how many `new` pairs (none of them in old) add to those of `old`. Vertices have one of p
    colours, and a pair goes to every set of three colours, repeats allowed, that its ends' colours belong to. A set
    counts the triangles of just its three colours, so each is met once; no wedge is ever a row. p is such that a set has
    about `part` pairs, each pair being sent p times. Nothing runs before the row is read."""
    tagged = old.select("a", "b", F.lit(0).alias("fresh")).unionByName(new.select("a", "b", F.lit(1).alias("fresh")))
    colours = tagged.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(6 * F.count("*") / F.lit(part)))).alias("p"))  # one row
    of = lambda c: F.pmod(F.xxhash64(c), "p").alias(f"c{c}")
    sent = tagged.crossJoin(F.broadcast(colours)).select("*", of("a"), of("b")).withColumn("cc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1)))
    least, most = F.least("ca", "cb", "cc"), F.greatest("ca", "cb", "cc")
    trio = (least * F.col("p") + F.col("ca") + F.col("cb") + F.col("cc") - least - most) * F.col("p") + most
    tag = F.col("fresh") + 2 * (F.col("ca") != F.col("cb")).cast("int") + 4 * (least != most).cast("int")

    def count(t: pa.Table) -> pa.Table:
        a, b, tags = (t.column(c).to_numpy() for c in ("a", "b", "tag"))
        return pa.table({"n": [_closed(a, b, tags & 3, 3 if tags[0] & 4 else 1)]})

    each = sent.select("a", "b", tag.cast("tinyint").alias("tag"), trio.alias("trio")).groupBy("trio").applyInArrow(count, "n bigint")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))


class TriangleCounter:
    """Running triangle count of a stream of edges, with its state beneath a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _before(self, name: str, schema: str, batch: int) -> DataFrame:
        """The rows of all batches with a lower number."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        x = self.spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        return x.where(F.col("batch") < batch).drop("batch")

    def add(self, edges: DataFrame, batch: int) -> int:
        """Takes a batch's edges in and gives the count after it."""
        old = self._before("pairs", PAIRS, batch)
        new = pairs_of(edges).join(old, ["a", "b"], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.folder}/pairs/batch={batch}")
        new = self.spark.read.schema(PAIRS).parquet(f"{self.folder}/pairs/batch={batch}")
        delta = triangle_delta(old, new).first()[0]
        self.spark.createDataFrame([(delta,)], "delta bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        return self.total(batch + 1)

    def total(self, before: int = 2**62) -> int:
        return self._before("deltas", "delta bigint", before).agg(F.coalesce(F.sum("delta"), F.lit(0))).first()[0]

    def totals(self) -> DataFrame:
        """One row `triangles`: the count after all batches so far."""
        return self._before("deltas", "delta bigint", 2**62).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("triangles"))

    def start(self, edges: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs the counter on a streaming DataFrame with src and dst; trigger as writeStream.trigger takes it."""
        write = edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: TriangleCounter(_swept(df), self.folder).add(df, i) and None)
        return (write.trigger(**trigger) if trigger else write).start()


EDGES = "src bigint, dst bigint, type string"


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """All edges that append_edges() has put beneath a folder."""
    return spark.read.schema(f"{EDGES}, run string, batch bigint").option("basePath", folder).parquet(folder)


def append_edges(edges: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends edges of a stream that are not there yet to <folder>/run=<r>/batch=<n>, r standing for the checkpoint: a
    batch that is run again writes over itself, and another stream into the same folder writes beside it. Files are ranges
    of src and dst, in order: they take few bytes an edge, and a batch reads only those that its sources may be in."""
    spark = edges.sparkSession
    run = f"{zlib.crc32(checkpoint.encode()):08x}x"

    def add(df: DataFrame, i: int) -> None:
        _swept(df)
        new = materialize(df.select("src", "dst", "type").distinct(), "batch")
        fresh, (least, most) = new, new.agg(F.min("src"), F.max("src")).first()
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if least is not None and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            there = appended(spark, folder).where(((F.col("run") != run) | (F.col("batch") < i)) & F.col("src").between(least, most))
            fresh = new.join(there.hint("merge"), ["src", "dst", "type"], "left_anti")  # the files' size says little of their rows
        ranged = fresh.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst", "type")
        ranged.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/run={run}/batch={i}")
        dropped(new)

    write = edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (write.trigger(**trigger) if trigger else write).start()


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows per window and key in event time; rows later than the watermark are dropped, on streams and batches alike
    through withWatermark (which a batch ignores)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
