"""Loaders of edges and graphs: edge lists, edge JSON, RDF/XML, triples, citation JSON, attribute files; and the sink.

Loaders are lazy DataFrames over splittable text, so any Hadoop path works (file:, hdfs:, s3a:). Lines that cannot be
read are left out; bad_lines() gives them.
"""

from __future__ import annotations

import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..graph import Graph
from ..runtime import materialize

#: Edge message: two vertices and the edge's properties; every value is text.
VERTEX = "struct<id:string,pid:string,properties:map<string,string>>"
EDGE_JSON = f"struct<source:{VERTEX},destination:{VERTEX},properties:map<string,string>,isNode:boolean,id:string,pid:string>"


def _pair(line: Column) -> Column:
    return F.split(F.trim(line), r"[ \t]*,[ \t]*|[ \t]+")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines of two whole numbers set off by spaces, tabs or a comma."""
    x = spark.read.text(path).select(_pair(F.col("value")).alias("p"))
    x = x.where(F.size("p") == 2).select(F.col("p")[0].try_cast("bigint").alias("src"), F.col("p")[1].try_cast("bigint").alias("dst"))
    return x.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines that read_edge_list() leaves out."""
    p = _pair(F.col("value"))
    ok = (F.size(p) == 2) & F.get(p, F.lit(0)).try_cast("bigint").isNotNull() & F.get(p, F.lit(1)).try_cast("bigint").isNotNull()
    return spark.read.text(path).where((F.trim("value") != "") & ~ok)


def edge_list_graph(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return Graph.of_edges(read_edge_list(spark, path), directed)


def fetch(spark: SparkSession, url: str, to: str, chunk: int = 1 << 20) -> str:
    """Loads a URL (http, https, ftp, file) into a file of any Hadoop path, a chunk at a time; returns that path, which
    the loaders read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        with urllib.request.urlopen(url) as source:
            while data := source.read(chunk):
                out.write(bytearray(data))
    finally:
        out.close()
    return to


def renumber(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with contiguous ids from 0, (id, number)): vertices numbered in id order. Numbers come from a range
    partitioned sort and per-partition offsets, so no task sees all vertices."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    numbers = numbered(ids, "id", "number")
    out = edges
    for end in ("src", "dst"):
        out = out.join(numbers.select(F.col("id").alias(end), F.col("number").alias(f"__{end}")), end).drop(end).withColumnRenamed(f"__{end}", end)
    return out, numbers


def numbered(distinct: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct values of a column with their numbers from 0 in order, by range partitions and their offsets."""
    ranged = materialize(distinct.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return ranged.withColumn("__rank", rank).join(offsets, "__part").select(key, (F.col("__before") + F.col("__rank") - 1).alias(name))


def parse_edge_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Edge messages of a text column, as a struct `m`; lines that are no JSON object have null."""
    return lines.select(F.from_json(column, EDGE_JSON, {"mode": "PERMISSIVE"}).alias("m"))


def edges_of_json(messages: DataFrame) -> DataFrame:
    """(src, dst, type, props) of parsed messages; the property `type` is the type, DEFAULT if there is none."""
    x = messages.where("m.source.id is not null and m.destination.id is not null")
    x = x.select(F.col("m.source.id").try_cast("bigint").alias("src"), F.col("m.destination.id").try_cast("bigint").alias("dst"), F.coalesce(F.try_element_at("m.properties", F.lit("type")), F.lit("DEFAULT")).alias("type"), F.col("m.properties").alias("props"))
    return x.where("src is not null and dst is not null")


def vertices_of_json(messages: DataFrame) -> DataFrame:
    """(id, label, props), one row per vertex that a message mentions, stand-alone node messages included. Of several
    the one with most properties is kept, then the greatest as text."""
    own = F.struct(F.col("m.id").alias("id"), F.col("m.pid").alias("pid"), F.col("m.properties").alias("properties"))
    ends = F.array("m.source", "m.destination", F.when(F.col("m.isNode"), own))
    x = messages.where("m is not null").select(F.explode(ends).alias("v")).where("v.id is not null")
    x = x.select(F.col("v.id").try_cast("bigint").alias("id"), F.col("v.properties").alias("props")).where("id is not null")
    size = F.struct(F.coalesce(F.size("props"), F.lit(0)).alias("n"), F.to_json("props").alias("j"))
    best = x.groupBy("id").agg(F.max_by(F.struct("props"), size).alias("b"))
    return best.select("id", F.try_element_at("b.props", F.lit("label")).alias("label"), F.col("b.props").alias("props"))


def edge_json_graph(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    m = parse_edge_json(spark.read.text(path))
    e = edges_of_json(m)
    return Graph(vertices_of_json(m), e, directed)


# Bibliography elements and the fields taken from them.
RDF_RECORDS = ("Article-Reference", "Book-Reference", "Thesis-Reference", "Book-Section-Reference", "Conference-Proceedings-Reference")
RDF_FIELDS = {"title": "akt:has-title", "journal": "akt:article-of-journal", "volume": "akt:has-volume", "year": "akts:year-of", "month": "akts:month-of", "url": "akt:has-web-address"}


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """(record, kind, title, journal, volume, year, month, url, authors): bibliography records of RDF/XML."""
    out = None
    for kind in RDF_RECORDS:
        x = spark.read.format("xml").option("rowTag", f"akt:{kind}").option("attributePrefix", "_").option("mode", "DROPMALFORMED").load(path)
        if not (columns := [c for c in x.columns if c != "_corrupt_record"]):
            continue
        x = x.withColumn("__json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))
        scalar = lambda tag: F.coalesce(F.when(F.col("__json").rlike(rf'"{tag}":"'), F.regexp_extract("__json", rf'"{tag}":"((?:[^"\\]|\\.)*)"', 1)), F.nullif(F.regexp_extract("__json", rf'"{tag}":(-?[\d.]+)', 1), F.lit("")))
        authors = F.array_distinct(F.regexp_extract_all("__json", F.lit(r'"akt:full-name":"((?:[^"\\]|\\.)*)"'), F.lit(1)))
        x = x.select(F.xxhash64("__json").alias("record"), F.lit(kind).alias("kind"), *[scalar(tag).alias(n) for n, tag in RDF_FIELDS.items()], authors.alias("authors"))
        out = x if out is None else out.unionByName(x)
    if out is None:
        fields = ", ".join(f"{n} string" for n in RDF_FIELDS)
        return spark.createDataFrame([], f"record bigint, kind string, {fields}, authors array<string>")
    return out.dropDuplicates(["record"])


def coauthor_graph(records: DataFrame) -> Graph:
    """Authors joined where they share a record; an author's id is a hash of the name. The authors of one record are
    paired, so a record adds as many edges as it has pairs."""
    ids = records.select("record", "title", "year", F.explode("authors").alias("name")).withColumn("id", F.shiftrightunsigned(F.xxhash64("name"), 1))
    v = ids.select("id", F.lit("Author").alias("label"), "name").distinct()
    a = ids.select("record", "title", "year", F.col("id").alias("src"))
    b = ids.select("record", F.col("id").alias("dst"))
    e = a.join(b, "record").where(F.col("src") < F.col("dst")).withColumn("type", F.lit("COAUTHOR"))
    return Graph(v, Graph.of_edges(e, False).edges, False)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of `subject<TAB>predicate object` lines."""
    m = r"^([^\t]+)\t(\S+)\s+(.*\S)\s*$"
    x = spark.read.text(path).where(F.col("value").rlike(m))
    return x.select(*[F.regexp_extract("value", m, i).alias(n) for i, n in enumerate(("subject", "predicate", "object"), 1)])


def triples_graph(triples: DataFrame) -> Graph:
    """Subjects and objects as vertices (id: hash of the name), predicates as edge types."""
    key = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    names = triples.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    v = names.select(key("name").alias("id"), F.lit(None).cast("string").alias("label"), "name")
    return Graph(v, Graph.of_edges(triples.select(key("subject").alias("src"), key("object").alias("dst"), F.col("predicate").alias("type"))).edges)


CITATION = "id string, references array<string>, fos array<struct<name:string,w:double>>"


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CITATION).json(path).where("id is not null")


def citation_edges(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("id").alias("src"), F.explode("references").alias("dst")).where("dst is not null").distinct()


def field_frequencies(papers: DataFrame, weight: float = 0.5) -> DataFrame:
    """(name, n): papers per field of study with a weight above `weight`."""
    each = papers.select("id", F.explode("fos").alias("f")).where(F.col("f.w") > weight).select("id", F.col("f.name").alias("name")).distinct()
    return each.groupBy("name").agg(F.count("*").alias("n"))


def one_hot(papers: DataFrame, weight: float = 0.5, above: int = 821) -> DataFrame:
    """(id, features array<tinyint>): one place per field of study that more than `above` papers have with a weight
    above `weight`, in name order. The fields are numbered and joined to the papers that have them, so neither the plan
    nor the driver holds the list, however long it is. id is unique."""
    kept = field_frequencies(papers, weight).where((F.col("n") > above) & F.col("name").isNotNull())
    places = numbered(kept.select("name"), "name", "place")
    total = places.agg(F.count("*").cast("int").alias("__total"))  # one row
    each = papers.select("id", F.explode("fos").alias("f")).where(F.col("f.w") > weight).select("id", F.col("f.name").alias("name")).distinct()
    held = each.join(places, "name").groupBy("id").agg(F.collect_set(F.col("place").cast("int")).alias("held"))
    all_ = F.when(F.col("__total") > 0, F.sequence(F.lit(0), F.col("__total") - 1)).otherwise(F.array().cast("array<int>"))
    out = papers.select("id").join(held, "id", "left").crossJoin(F.broadcast(total))
    return out.select("id", F.transform(all_, lambda p: F.coalesce(F.array_contains("held", p), F.lit(False)).cast("tinyint")).alias("features"))


# Element types of attribute files.
DTYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "float": "float"}


def infer_dtype(values: list[str]) -> str:
    """The narrowest type that holds a first line's values."""
    if any("." in v or "e" in v.lower() for v in values):
        return "float"
    top = max((abs(int(v)) for v in values), default=0)
    return "int8" if top <= 127 else "int16" if top <= 32767 else "int32"


def read_attributes(spark: SparkSession, path: str, dtype: str | None = None) -> DataFrame:
    """(id, features): lines of a vertex id and its values set off by spaces, tabs or commas. A value that does not
    fit the type is null. Without dtype the first line decides."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"[ \t]*,[ \t]*|[ \t]+").alias("p")).where(F.size("p") > 1)
    if dtype is None:
        first = lines.first()
        dtype = infer_dtype(list(first["p"][1:])) if first else "float"
    kind = DTYPES[dtype]
    return lines.select(F.col("p")[0].try_cast("bigint").alias("id"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda v: v.try_cast(kind)).alias("features")).where("id is not null")


def with_attributes(graph: Graph, attributes: DataFrame) -> Graph:
    """The graph with the attribute columns on its vertices."""
    return Graph(graph.vertices.join(attributes.dropDuplicates(["id"]), "id", "left"), graph.edges, graph.directed)


def write_graph(graph: Graph, path: str, mode: str = "errorifexists", buckets: int = 0) -> None:
    """Parquet tables vertices and edges; edges sorted by source within files, so that seeks by source prune."""
    graph = graph.keyed()
    graph.vertices.write.mode(mode).parquet(f"{path}/vertices")
    e = graph.edges.repartition(buckets, "src") if buckets else graph.edges
    e.sortWithinPartitions("src").write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), directed)


def write_pairs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text, one line per row: degrees, ranks, ego networks."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])).write.mode(mode).text(path)
