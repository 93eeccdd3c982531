"""Catalog of graphs and models: one row each in Parquet tables, listed, added, extended and removed by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..graph import Graph
from ..runtime import _remove
from .edges import read_graph, write_graph

# States of a graph.
LOADING, STREAMING, OPERATIONAL, DELETING, NONOPERATIONAL = 1, 2, 3, 4, 5
SCHEMA = "idgraph bigint, name string, path string, graph_status int, vertexcount bigint, edgecount bigint, is_directed boolean"
MODELS = "idmodel bigint, name string, path string, bytes bigint"


@dataclass(frozen=True)
class Catalog:
    """Graphs and models beneath a folder: catalog rows in <root>/catalog/<id> and <root>/model_catalog/<id>, tables in
    <root>/graphs/<id>, files in <root>/models/<id>."""

    spark: SparkSession
    root: str

    def _rows(self, folder: str, schema: str, key: str) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        there = fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        x = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}") if there else self.spark.createDataFrame([], schema)
        return x.orderBy(key)

    def rows(self) -> DataFrame:
        return self._rows("catalog", SCHEMA, "idgraph")

    def _put(self, row: tuple, mode: str = "errorifexists") -> None:
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode(mode).parquet(f"{self.root}/catalog/{row[0]}")

    def add(self, name: str, graph: Graph) -> int:
        top = self.rows().agg(F.max("idgraph")).first()[0]
        i = (top or 0) + 1
        write_graph(graph, f"{self.root}/graphs/{i}")
        g = read_graph(self.spark, f"{self.root}/graphs/{i}")
        self._put((i, name, f"{self.root}/graphs/{i}", OPERATIONAL, g.vertices.count(), g.edges.count(), graph.directed))
        return i

    def get(self, i: int) -> Graph:
        row = self.rows().where(F.col("idgraph") == i).first()
        if row is None:
            raise KeyError(f"there is no graph {i}")
        return read_graph(self.spark, row["path"], row["is_directed"])

    def append(self, i: int, graph: Graph) -> None:
        """More edges, and the vertices that are not there yet, to a graph; its row's counts go up by what was added.
        Edge numbers go on after the highest."""
        held = self.get(i)
        row = self.rows().where(F.col("idgraph") == i).first()
        top = held.edges.agg(F.coalesce(F.max("eid"), F.lit(-1))).first()[0]
        new = graph.vertices.join(held.vertices.select("id"), "id", "left_anti").dropDuplicates(["id"])
        vertices = _as(new, held.vertices)
        edges = _as(graph.keyed().edges.withColumn("eid", F.col("eid") + F.lit(top + 1)), held.edges)
        added = vertices.count(), edges.count()
        vertices.write.mode("append").parquet(f"{row['path']}/vertices")
        edges.sortWithinPartitions("src").write.mode("append").parquet(f"{row['path']}/edges")
        self._put((i, row["name"], row["path"], OPERATIONAL, row["vertexcount"] + added[0], row["edgecount"] + added[1], row["is_directed"]), "overwrite")

    def remove(self, i: int) -> None:
        self.get(i)
        for part in ("catalog", "graphs"):
            _remove(self.spark, f"{self.root}/{part}/{i}")

    def listing(self) -> DataFrame:
        """One text line per graph: |id|name|path|state|."""
        state = F.element_at(F.create_map(*[F.lit(x) for p in ((1, "loading"), (2, "streaming"), (3, "op"), (4, "deleting"), (5, "nop")) for x in p]), F.col("graph_status"))
        return self.rows().select(_line(F.col("idgraph").cast("string"), "name", "path", state).alias("line"))

    # --- models

    def models(self) -> DataFrame:
        return self._rows("model_catalog", MODELS, "idmodel")

    def add_model(self, name: str, path: str) -> int:
        """Copies a trained model's file from any Hadoop path into the catalog."""
        i = (self.models().agg(F.max("idmodel")).first()[0] or 0) + 1
        to = f"{self.root}/models/{i}/{path.rstrip('/').rpartition('/')[2]}"
        size = copied(self.spark, path, to)
        self.spark.createDataFrame([(i, name, to, size)], MODELS).coalesce(1).write.parquet(f"{self.root}/model_catalog/{i}")
        return i


def copied(spark: SparkSession, path: str, to: str) -> int:
    """Copies one file between Hadoop paths; its length."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = b.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, fs, b, False, conf)
    return fs.getFileStatus(b).getLen()


def _as(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of `like`, missing ones null. Columns that `like` lacks cannot be stored and are an error."""
    extra = [c for c in df.columns if c not in like.columns]
    if extra:
        raise ValueError(f"the stored graph has no columns {extra}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def _line(*parts: Column | str) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", *parts), F.lit("|"))


def calibrated_sla(measured: DataFrame, keys: list[str], value: str, attempt: str, most: int = 3) -> DataFrame:
    """Mean of the first `most` attempts per key."""
    return measured.where(F.col(attempt) <= most).groupBy(*keys).agg(F.avg(value).alias("sla_value"))


def sla_report(sla: DataFrame, categories: DataFrame, command: str) -> DataFrame:
    """(graph_id, partition_count, sla_value, line) of one command: what its calls took per graph and number of
    partitions; line is |graph|partitions|ms|. sla: id_sla_category, graph_id, partition_count, sla_value; categories:
    id, command. The categories are a list of commands; an unknown one gives no rows."""
    wanted = categories.where(F.col("command") == command).select(F.col("id").alias("id_sla_category")).distinct()
    x = sla.join(wanted, "id_sla_category", "left_semi").select("graph_id", "partition_count", "sla_value")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in x.columns]
    return x.withColumn("line", _line(*text))
