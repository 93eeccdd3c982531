"""Queries of the loaders, sinks, catalog and streams: tables are written as the files and messages that a loader reads,
loaded again, and compared with the tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..algorithms import partitioning, triangles
from ..graph import Graph
from ..operators import sets
from ..runtime import _remove, fresh_path, table, written_lines
from ..sources import edges as sources
from ..sources.catalog import Catalog, sla_report
from ..streaming import ingest


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _lines(df: DataFrame, line: Column, label: str, more: tuple[str, ...] = (), path: str = "") -> str:
    """The lines of a table, and further ones that a loader must leave out."""
    x = df.select(line.alias("value"))
    if more:
        x = x.unionByName(df.sparkSession.createDataFrame([(m,) for m in more], "value string"))
    return written_lines(x, label, path)


def _order_lines(spark: SparkSession, d: str) -> str:
    """customer -> order edges as an edge list, its separators changing by line, with lines that are none."""
    o = table(spark, d, "orders")
    gap = F.element_at(F.array(*[F.lit(x) for x in (" ", "\t", ",", "   ", " , ")]), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return _lines(o, F.concat(_text("o_custkey"), gap, _text("o_orderkey")), "edges", ("", "x 1", "1", "1 2 3", "5;6"))


def src_edge_list(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_edge_list(spark, _order_lines(spark, d))


def src_edge_list_bad(spark: SparkSession, d: str) -> DataFrame:
    return sources.bad_lines(spark, _order_lines(spark, d)).select(F.col("value").alias("line"))


def src_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a gapped key numbered from 0: (id, number)."""
    o = table(spark, d, "orders").select((F.col("o_custkey") * 7 + 3).alias("src"), (F.col("o_orderkey") * 11 + 100_000).alias("dst"))
    return sources.renumber(o)[1]


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """nation -> region edges as wire messages, and nations as stand-alone node messages."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))

    def vertex(i: Column, label: str, name: str) -> Column:
        return F.struct(i.alias("id"), F.struct(i.alias("id"), F.lit(label).alias("label"), F.col(name).alias("name")).alias("properties"))

    nation, region = _text(F.col("n_nationkey") + 100), _text("r_regionkey")
    edge = F.to_json(F.struct(vertex(nation, "Nation", "n_name").alias("source"), vertex(region, "Region", "r_name").alias("destination"), F.struct(F.lit("IN_REGION").alias("type"), _text("n_regionkey").alias("since")).alias("properties")))
    lone = F.to_json(F.struct(F.lit(True).alias("isNode"), _text(F.col("n_nationkey") + 1000).alias("id"), F.struct(F.lit("Lone").alias("label"), F.col("n_name").alias("name")).alias("properties")))
    return x.select(F.explode(F.array(edge, lone)).alias("value"))


def _message_graph(spark: SparkSession, d: str) -> Graph:
    return sources.edge_json_graph(spark, _lines(_messages(spark, d), F.col("value"), "messages", ("-1", "{broken", "", "[]", '{"source":{"id":"1"}}')))


def src_edge_json(spark: SparkSession, d: str) -> DataFrame:
    return _message_graph(spark, d).edges.select("src", "dst", "type", F.col("props.since").alias("since"))


def src_edge_json_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the edge messages and the node messages."""
    return _message_graph(spark, d).vertices.where(F.col("label").isNotNull()).select("id", "label", F.col("props.name").alias("name"))


def src_vertex_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attribute lines of an id and numbers, set off in three ways."""
    p = table(spark, d, "part")
    gap = F.element_at(F.array(*[F.lit(x) for x in (" ", "\t", ",")]), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    line = F.concat(_text("p_partkey"), gap, _text("p_size"), gap, _text(F.col("p_size") * 100))
    a = sources.read_attributes(spark, _lines(p, line, "attributes"), "int16")
    g = sources.with_attributes(Graph.of_edges(p.select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"))), a)
    return g.vertices.select("id", F.col("features")[0].cast("int").alias("size"), F.col("features")[1].cast("int").alias("hundred"))


_ESCAPED = "replace(replace(p_name, '&', '&amp;'), '<', '&lt;')"


def _rdf(spark: SparkSession, d: str) -> DataFrame:
    """Parts as bibliography records: the brand and the type are the authors, the size is the year."""
    p = table(spark, d, "part")
    person = lambda c: f"'<akt:has-author><akt:Person><akt:full-name>', {c}, '</akt:full-name></akt:Person></akt:has-author>'"
    line = F.expr(f"concat('<akt:Article-Reference>', {person('p_brand')}, {person('p_type')}, '<akt:has-title>', {_ESCAPED}, ' no ', p_partkey, '</akt:has-title><akts:year-of>y', p_size, '</akts:year-of></akt:Article-Reference>')")
    ends = [spark.createDataFrame([(x,)], "value string") for x in ('<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:akt="a" xmlns:akts="s">', "</rdf:RDF>")]
    whole = ends[0].coalesce(1).unionByName(p.select(line.alias("value"))).unionByName(ends[1].coalesce(1)).coalesce(1)  # an XML document is one file
    return sources.read_rdf(spark, written_lines(whole, "records"))


def src_rdf(spark: SparkSession, d: str) -> DataFrame:
    return _rdf(spark, d).select("kind", "title", "year", F.array_join(F.array_sort("authors"), ",").alias("authors"))


def src_rdf_coauthors(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of authors and how many records they share."""
    g = sources.coauthor_graph(_rdf(spark, d))
    name = {c: g.vertices.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst")}
    x = g.edges.join(name["src"], "src").join(name["dst"], "dst")
    return x.groupBy(F.least("src_name", "dst_name").alias("a"), F.greatest("src_name", "dst_name").alias("b")).agg(F.count("*").alias("n"))


def src_triples(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = _lines(x, F.concat("n_name", F.lit("\t"), F.lit("lies_in "), "r_name"), "triples", ("", "no tab", "a\tb"))
    return sources.read_triples(spark, path)


def src_citations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers that cite the parts in them: distinct citations."""
    l = table(spark, d, "lineitem")
    line = F.to_json(F.struct(_text("l_orderkey").alias("id"), F.array(_text("l_partkey"), _text("l_suppkey")).alias("references")))
    return sources.citation_edges(sources.read_citations(spark, _lines(l, line, "papers", ('{"references":["9"]}',))))


def src_fetched_edge_list(spark: SparkSession, d: str) -> DataFrame:
    """An edge list fetched by URL, then counted: vertices, edges, triangles."""
    n = table(spark, d, "nation")
    line = F.concat(_text("n_nationkey"), F.lit(" "), _text((F.col("n_nationkey") + 1) % 25), F.lit("\n"), _text("n_nationkey"), F.lit(" "), _text((F.col("n_nationkey") + 2) % 25))
    folder = written_lines(n.select(line.alias("value")).coalesce(1), "served")
    served = spark.read.text(folder).inputFiles()[0]
    path = sources.fetch(spark, served, fresh_path(spark, "fetched") + "/edges.dl") if served.startswith("file:") else folder
    g = sources.edge_list_graph(spark, path)
    return g.vertex_count().crossJoin(g.edge_count()).crossJoin(triangles.triangle_count(g))  # three single rows


def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """A graph stored and read again: edges per type, each with a number of its own."""
    path = fresh_path(spark, "store")
    sources.write_graph(_message_graph(spark, d), path)
    return sources.read_graph(spark, path).edges.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("eid").alias("numbers"))


def _catalog(spark: SparkSession, d: str) -> Catalog:
    c = Catalog(spark, fresh_path(spark, "catalog"))
    o = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 100).cast("bigint").alias("dst"))
    i = c.add("regions", Graph.of_edges(o))
    c.append(i, Graph.of_edges(o.withColumn("dst", F.col("dst") + 3)))
    c.remove(c.add("gone", Graph.of_edges(o)))
    c.add("loops", Graph.of_edges(o.select("src", F.col("src").alias("dst")), False))
    return c


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    """Graphs added, extended and removed, with the counts that their rows keep."""
    return _catalog(spark, d).rows().select("idgraph", "name", "graph_status", "vertexcount", "edgecount", "is_directed")


def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    return c.listing().select(F.replace("line", F.lit(c.root), F.lit("")).alias("line"))


def result_sink(spark: SparkSession, d: str) -> DataFrame:
    """Degrees written as tab-separated lines and read back."""
    path = fresh_path(spark, "sink")
    sources.write_pairs(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return sets.intersection(c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key")), s.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")))


def sla_command_report(spark: SparkSession, d: str) -> DataFrame:
    """What the calls of one category of commands took."""
    categories = spark.createDataFrame([(1, "trian"), (2, "pgrnk"), (3, "idd")], "id int, command string")
    return sla_report(table(spark, d, "graph_sla").dropDuplicates(), categories, "trian")


def auto_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Hash partitions in the number that suits the edges."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    g = Graph.of_edges(e)
    return partitioning.partition_stats(g, partitioning.automatic_count(g.edges.count())).select("part", "vertices", "local_edges", "cut_edges")


# --- streams


#: Messages that lie in a stream's folder at a time, about: some 650 MB.
MESSAGES = 8_000_000


def _stream_files(spark: SparkSession, d: str, messages: int) -> Iterator[str]:
    """Customer -> supplier edges within a nation as wire messages in a folder (the path is a pattern). They come in parts
    of about so many messages, by ranges of customers: a part's files are there until the next part is asked for, so
    all readers take a part in before. All parts together hold every message."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    x = c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).where("c_custkey <> s_suppkey")
    end = lambda i: F.struct(_text(i).alias("id"))
    edge = F.to_json(F.struct(end("c_custkey").alias("source"), end("s_suppkey").alias("destination"), F.struct(F.lit("KNOWS").alias("type")).alias("properties")))
    n = c.groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").alias("c")).join(s.groupBy(F.col("s_nationkey").alias("n")).agg(F.count("*").alias("s")), "n")
    parts = max(1, -(-(n.agg(F.sum(F.col("c") * F.col("s"))).first()[0] or 0) // messages))
    least, most = c.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    bound = lambda i: least + (most - least + 1) * i // parts
    folder = fresh_path(spark, "stream")
    for i in range(parts):
        some = x if parts == 1 else x.where((F.col("c_custkey") >= bound(i)) & (F.col("c_custkey") < bound(i + 1)))
        path = _lines(some, edge, "stream", ("-1", "junk"), f"{folder}/{i}")
        yield f"{folder}/*"
        _remove(spark, path)


def _stream(spark: SparkSession, files: str) -> DataFrame:
    return ingest.stream_edges(ingest.read_stream(spark, files, options={"maxFilesPerTrigger": "4"}))


def stream_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of a stream of messages, counted batch by batch."""
    counter, progress = ingest.TriangleCounter(spark, fresh_path(spark, "triangles")), fresh_path(spark, "progress")
    for files in _stream_files(spark, d, MESSAGES):
        counter.start(_stream(spark, files), progress, availableNow=True).awaitTermination()
    return counter.totals()


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a stream appended without repeats, the stream being read twice."""
    folder, readers = fresh_path(spark, "edges"), [fresh_path(spark, "progress") for _ in range(2)]
    for files in _stream_files(spark, d, MESSAGES):
        for progress in readers:
            ingest.append_edges(_stream(spark, files), folder, progress, availableNow=True).awaitTermination()
    return ingest.appended(spark, folder).select("src", "dst", "type")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows of a stream of files, each written once the watermark has passed it; a last event far ahead
    closes all others."""
    e = table(spark, d, "events").select("ts", "event_type")
    last = e.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", F.lit("end").alias("event_type"))
    files, out = fresh_path(spark, "events"), fresh_path(spark, "windows")
    e.write.parquet(f"{files}/part=1")
    read = lambda: spark.readStream.schema("ts timestamp, event_type string").parquet(f"{files}/part=*")
    progress = fresh_path(spark, "progress")
    for step in (None, last):
        if step is not None:
            step.write.parquet(f"{files}/part=2")
        counts = ingest.windowed_counts(read(), "ts", "event_type", "1 day")
        counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, event_type string, n bigint").parquet(out)


_ALL = (src_edge_list, src_edge_list_bad, src_renumbered, src_edge_json, src_edge_json_vertices, src_vertex_attributes, src_rdf, src_rdf_coauthors, src_triples, src_citations, src_fetched_edge_list, graph_store, catalog_rows, catalog_listing, result_sink, set_intersection, sla_command_report, auto_partitions, stream_triangles, stream_append, stream_windows)
QUERIES = {f.__name__: f for f in _ALL}

_PAIRS = "P AS (SELECT DISTINCT least(c_custkey, s_suppkey) AS a, greatest(c_custkey, s_suppkey) AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey <> s_suppkey)"
SQL = {
    "src_edge_list": "SELECT o_custkey AS src, o_orderkey AS dst FROM orders",
    "src_edge_list_bad": "SELECT unnest(['x 1', '1', '1 2 3', '5;6']) AS line",
    "src_renumbered": "WITH i AS (SELECT o_custkey * 7 + 3 AS id FROM orders UNION SELECT o_orderkey * 11 + 100000 FROM orders) SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM i",
    "src_edge_json": "SELECT CAST(100 + n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, 'IN_REGION' AS type, CAST(n_regionkey AS VARCHAR) AS since FROM nation",
    "src_edge_json_vertices": "SELECT CAST(100 + n_nationkey AS BIGINT) AS id, 'Nation' AS label, n_name AS name FROM nation UNION ALL SELECT 1000 + n_nationkey, 'Lone', n_name FROM nation UNION ALL SELECT DISTINCT CAST(r_regionkey AS BIGINT), 'Region', r_name FROM region JOIN nation ON n_regionkey = r_regionkey",
    "src_vertex_attributes": "SELECT p_partkey AS id, CAST(p_size AS INT) AS size, CAST(p_size * 100 AS INT) AS hundred FROM part",
    "src_rdf": "SELECT 'Article-Reference' AS kind, p_name || ' no ' || p_partkey AS title, 'y' || p_size AS year, CASE WHEN p_brand < p_type THEN p_brand || ',' || p_type WHEN p_brand = p_type THEN p_brand ELSE p_type || ',' || p_brand END AS authors FROM part",
    "src_rdf_coauthors": "SELECT least(p_brand, p_type) AS a, greatest(p_brand, p_type) AS b, count(*) AS n FROM part WHERE p_brand <> p_type GROUP BY ALL",
    "src_triples": "SELECT n_name AS subject, 'lies_in' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey",
    "src_citations": "SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem UNION SELECT CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem",
    "src_fetched_edge_list": "WITH e AS (SELECT n_nationkey AS s, (n_nationkey + k) % 25 AS t FROM nation, (SELECT unnest([1, 2]) AS k)), P AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM e) SELECT (SELECT count(*) FROM (SELECT a FROM P UNION SELECT b FROM P)) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM P x JOIN P y ON x.b = y.a JOIN P z ON z.a = x.a AND z.b = y.b) AS triangles",
    "graph_store": "SELECT 'IN_REGION' AS type, count(*) AS n, count(*) AS numbers FROM nation",
    "catalog_rows": "WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), v AS (SELECT k AS i FROM n UNION SELECT r + 100 FROM n UNION SELECT r + 103 FROM n) SELECT CAST(1 AS BIGINT) AS idgraph, 'regions' AS name, 3 AS graph_status, (SELECT count(*) FROM v) AS vertexcount, CAST((SELECT 2 * count(*) FROM n) AS BIGINT) AS edgecount, true AS is_directed UNION ALL SELECT 2, 'loops', 3, (SELECT count(*) FROM n), (SELECT count(*) FROM n), false",
    "catalog_listing": "SELECT unnest(['|1|regions|/graphs/1|op|', '|2|loops|/graphs/2|op|']) AS line",
    "result_sink": "SELECT o_custkey || chr(9) || count(*) AS line FROM orders GROUP BY o_custkey",
    "set_intersection": "SELECT c_nationkey AS nation, c_custkey AS key FROM customer INTERSECT SELECT s_nationkey, s_suppkey FROM supplier",
    "sla_command_report": "SELECT graph_id, partition_count, sla_value, '|' || coalesce(graph_id, '') || '|' || coalesce(CAST(partition_count AS VARCHAR), '') || '|' || coalesce(CAST(sla_value AS VARCHAR), '') || '|' AS line FROM (SELECT DISTINCT * FROM graph_sla) WHERE id_sla_category = 1",
    "auto_partitions": "WITH c AS (SELECT greatest(2, CAST(round(power(count(*), 0.2) / 6) AS BIGINT)) AS n FROM lineitem), v AS (SELECT l_partkey AS i FROM lineitem UNION SELECT l_suppkey FROM lineitem), x AS (SELECT i % n AS part, count(*) AS vertices FROM v, c GROUP BY ALL), y AS (SELECT l_partkey % n AS part, count(*) FILTER (l_partkey % n = l_suppkey % n) AS l, count(*) FILTER (l_partkey % n <> l_suppkey % n) AS t FROM lineitem, c GROUP BY ALL) SELECT CAST(part AS INT) AS part, vertices, coalesce(l, 0) AS local_edges, coalesce(t, 0) AS cut_edges FROM x LEFT JOIN y USING (part)",
    "stream_triangles": f"WITH {_PAIRS} SELECT CAST(count(*) AS BIGINT) AS triangles FROM P x JOIN P y ON x.b = y.a JOIN P z ON z.a = x.a AND z.b = y.b",
    "stream_append": "SELECT DISTINCT c_custkey AS src, s_suppkey AS dst, 'KNOWS' AS type FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey <> s_suppkey",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL",
}
