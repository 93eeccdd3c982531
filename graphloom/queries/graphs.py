"""Queries of the graph engine over the star-schema tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..algorithms import degrees, learning, pagerank, partitioning, triangles
from ..cypher.compiler import cypher, run, to_json
from ..graph import Graph
from ..runtime import followed, materialize, table
from ..sources import edges as sources
from ..streaming import ingest

# Where the ids of each label begin.
BASE = {"Region": 0, "Nation": 100, "Supplier": 10**12, "Part": 2 * 10**12, "Customer": 3 * 10**12, "Order": 4 * 10**12}


def _eid(number: int, key: Column) -> Column:
    """Edge ids of one type: the type's number above 60 bits of the key."""
    return F.lit(number << 60) + key.cast("bigint")


def _row_number(rows: DataFrame) -> Column:
    """A number of each row of a Parquet table by its file (20 bits) and its place in it (40), whatever is filtered or
    pruned: keys may repeat, and no shuffle is needed to count them. Files are numbered in order of their names."""
    files = sorted(rows.inputFiles())
    if len(files) == 1:
        return F.col("_metadata.row_index")
    plain = r"^(\w+):/+"  # a path's scheme is written with one slash or three
    place = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (re.sub(plain, r"\1:/", f), i)])[F.regexp_replace("_metadata.file_path", plain, "$1:/")]
    return F.shiftleft(place.cast("bigint"), 40) + F.col("_metadata.row_index")


def star_graph(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, suppliers, parts, customers and orders as one property graph."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "supplier", "part", "customer", "orders", "lineitem")}

    def at(label: str, c: str) -> Column:
        return F.col(c).cast("bigint") + F.lit(BASE[label])

    vertices = {
        "Region": t["region"].select(at("Region", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Nation": t["nation"].select(at("Nation", "n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Supplier": t["supplier"].select(at("Supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        "Part": t["part"].select(at("Part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")),
        "Customer": t["customer"].select(at("Customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
        "Order": t["orders"].select(at("Order", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")),
    }
    l = t["lineitem"]
    line = _row_number(l)
    edges = {
        "IN_REGION": t["nation"].select(_eid(1, F.col("n_nationkey")).alias("eid"), at("Nation", "n_nationkey").alias("src"), at("Region", "n_regionkey").alias("dst")),
        "IN_NATION": t["customer"].select(_eid(2, F.col("c_custkey")).alias("eid"), at("Customer", "c_custkey").alias("src"), at("Nation", "c_nationkey").alias("dst")).unionByName(t["supplier"].select(_eid(3, F.col("s_suppkey")).alias("eid"), at("Supplier", "s_suppkey").alias("src"), at("Nation", "s_nationkey").alias("dst"))),
        "PLACED": t["orders"].select(_eid(4, F.col("o_orderkey")).alias("eid"), at("Customer", "o_custkey").alias("src"), at("Order", "o_orderkey").alias("dst"), F.col("o_orderdate").alias("orderdate")),
        "CONTAINS": l.select(_eid(5, line).alias("eid"), at("Order", "l_orderkey").alias("src"), at("Part", "l_partkey").alias("dst"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount")),
        "SUPPLIED_BY": l.select("l_partkey", "l_suppkey").distinct().select(_eid(6, F.shiftleft(F.col("l_partkey").cast("bigint"), 28) + F.col("l_suppkey")).alias("eid"), at("Part", "l_partkey").alias("src"), at("Supplier", "l_suppkey").alias("dst")),
    }
    return Graph.of_labels(vertices, edges)


def co_bought(spark: SparkSession, d: str) -> Graph:
    """Parts bought in one order, undirected; an order's lines are its own small group."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    e = l.select("l_orderkey", F.col("l_partkey").alias("src")).join(l.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("src < dst")
    return Graph.of_edges(e.select("src", "dst").distinct(), directed=False)


def follows(spark: SparkSession, d: str) -> Graph:
    """Users whose events follow each other within an event type, undirected."""
    e = followed(table(spark, d, "events").select("event_id", "ts", "event_type", "user_id"), "event_type", ["ts", "event_id"], "user_id", "next")
    return Graph.of_edges(e.where("next is not null and user_id <> next").select(F.col("user_id").alias("src"), F.col("next").alias("dst")), directed=False)


def purchases(spark: SparkSession, d: str) -> Graph:
    """Customers pointing to the suppliers of what they bought; parallel edges are kept."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + F.lit(BASE["Customer"])).alias("src"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") + F.lit(BASE["Supplier"])).alias("dst"))
    return Graph.of_edges(o.join(l, "k").select("src", "dst"))


_V = """V AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'Region' AS label, r_name AS name, NULL::DOUBLE AS acctbal, NULL AS brand, NULL AS ptype, NULL::INT AS size, NULL::DOUBLE AS price, NULL AS segment, NULL AS status, NULL AS priority FROM region
  UNION ALL SELECT 100 + n_nationkey, 'Nation', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 1000000000000 + s_suppkey, 'Supplier', s_name, s_acctbal, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 2000000000000 + p_partkey, 'Part', p_name, NULL, p_brand, p_type, p_size, p_retailprice, NULL, NULL, NULL FROM part
  UNION ALL SELECT 3000000000000 + c_custkey, 'Customer', c_name, c_acctbal, NULL, NULL, NULL, NULL, c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT 4000000000000 + o_orderkey, 'Order', NULL, NULL, NULL, NULL, NULL, o_totalprice, NULL, o_orderstatus, o_orderpriority FROM orders)"""
_E = """E AS (
  SELECT 100 + n_nationkey AS src, CAST(n_regionkey AS BIGINT) AS dst, 'IN_REGION' AS type, NULL::DOUBLE AS quantity, NULL::DOUBLE AS extendedprice, NULL::DOUBLE AS discount FROM nation
  UNION ALL SELECT 3000000000000 + c_custkey, 100 + c_nationkey, 'IN_NATION', NULL, NULL, NULL FROM customer
  UNION ALL SELECT 1000000000000 + s_suppkey, 100 + s_nationkey, 'IN_NATION', NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 3000000000000 + o_custkey, 4000000000000 + o_orderkey, 'PLACED', NULL, NULL, NULL FROM orders
  UNION ALL SELECT 4000000000000 + l_orderkey, 2000000000000 + l_partkey, 'CONTAINS', l_quantity, l_extendedprice, l_discount FROM lineitem
  UNION ALL SELECT DISTINCT 2000000000000 + l_partkey, 1000000000000 + l_suppkey, 'SUPPLIED_BY', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM lineitem)"""
_W = f"WITH {_V}, {_E} "
_CO = "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), P AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey) "
_FO = "WITH f AS (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nx FROM events), P AS (SELECT DISTINCT least(user_id, nx) AS a, greatest(user_id, nx) AS b FROM f WHERE nx IS NOT NULL AND nx <> user_id), N AS (SELECT a AS u, b AS v FROM P UNION ALL SELECT b, a FROM P) "
_PU = "WITH B AS (SELECT 3000000000000 + o_custkey AS src, 1000000000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), A AS (SELECT DISTINCT src, dst FROM B) "
_TRI = "SELECT CAST(count(*) AS BIGINT) AS triangles FROM P x JOIN P y ON x.b = y.a JOIN P z ON z.a = x.a AND z.b = y.b"

#: name -> (query text, SQL over V and E)
CYPHER: dict[str, tuple[str, str]] = {
    "node_scan_filter_avg": ("MATCH (n) WHERE n.id < 10 RETURN avg(n.id) AS avg_id", "SELECT avg(id) AS avg_id FROM V WHERE id < 10"),
    "node_scan_all": ("MATCH (n) RETURN n.id AS id, n.label AS label", "SELECT id, label FROM V"),
    "node_scan_label": ("MATCH (c:Customer) RETURN c.id AS id, c.name AS name, c.acctbal AS acctbal", "SELECT id, name, acctbal FROM V WHERE label = 'Customer'"),
    "node_by_id_seek": ("MATCH (n) WHERE id(n) = 2000000000007 RETURN n.id AS id, n.name AS name, n.brand AS brand", "SELECT id, name, brand FROM V WHERE id = 2000000000007"),
    "rel_type_scan_directed": ("MATCH (a)-[r:IN_REGION]->(b) RETURN a.name AS a, b.name AS b", "SELECT x.name AS a, y.name AS b FROM E JOIN V x ON x.id = src JOIN V y ON y.id = dst WHERE type = 'IN_REGION'"),
    "rel_scan_directed_all": ("MATCH (a)-[r]->(b) RETURN type(r) AS t, a.label AS a, b.label AS b, count(*) AS n", "SELECT type AS t, x.label AS a, y.label AS b, count(*) AS n FROM E JOIN V x ON x.id = src JOIN V y ON y.id = dst GROUP BY ALL"),
    "rel_scan_undirected": ("MATCH (a:Nation)-[r:IN_REGION]-(b) RETURN a.id AS a, b.id AS b", "SELECT src AS a, dst AS b FROM E WHERE type = 'IN_REGION'"),
    "rel_scan_undirected_all": ("MATCH (a)-[r]-(b) RETURN a.label AS a, count(*) AS n", "SELECT label AS a, count(*) AS n FROM (SELECT src AS i FROM E UNION ALL SELECT dst FROM E) JOIN V ON i = id GROUP BY ALL"),
    "expand_left_arrow": ("MATCH (r:Region)<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer) RETURN r.name AS region, count(*) AS n", "SELECT r.name AS region, count(*) AS n FROM E e JOIN V r ON r.id = e.dst JOIN E f ON f.dst = e.src JOIN V c ON c.id = f.src WHERE e.type = 'IN_REGION' AND f.type = 'IN_NATION' AND c.label = 'Customer' GROUP BY ALL"),
    "quantifiers": ("MATCH (p:Part) WITH p, range(1, p.size % 5) AS l RETURN p.id AS id, all(x IN l WHERE x < 4) AS a, any(x IN l WHERE x = 2) AS b, none(x IN l WHERE x > 3) AS c, single(x IN l WHERE x > 1) AS d", "SELECT id, size % 5 < 4 AS a, size % 5 >= 2 AS b, size % 5 < 4 AS c, size % 5 = 2 AS d FROM V WHERE label = 'Part'"),
    "case_simple": ("MATCH (n) RETURN CASE n.label WHEN 'Part' THEN 1 WHEN 'Order' THEN 2 ELSE 0 END AS k, count(*) AS n", "SELECT CAST(CASE label WHEN 'Part' THEN 1 WHEN 'Order' THEN 2 ELSE 0 END AS BIGINT) AS k, count(*) AS n FROM V GROUP BY ALL"),
    "map_value": ("MATCH (p:Part) WITH p, {b: p.brand, s: p.size} AS m RETURN p.id AS id, m.b AS brand, m.s + 1 AS next", "SELECT id, brand, CAST(size + 1 AS BIGINT) AS next FROM V WHERE label = 'Part'"),
    "return_star": ("MATCH (r:Region) WITH r.name AS region, id(r) AS i RETURN *", "SELECT name AS region, id AS i FROM V WHERE label = 'Region'"),
    "type_compatibility": ("MATCH (n:Nation) WHERE n.name = 5 OR n.name > 'NATION_5' OR n.id = '103' RETURN n.id AS id", "SELECT id FROM V WHERE label = 'Nation' AND (name > 'NATION_5' OR id = 103)"),
    "expand_two_hop": ("MATCH (c:Customer)-[:PLACED]->(o)-[l:CONTAINS]->(p:Part) WHERE p.size = 10 RETURN c.id AS c, p.id AS p, l.quantity AS q", "SELECT x.src AS c, y.dst AS p, y.quantity AS q FROM E x JOIN E y ON x.dst = y.src JOIN V p ON p.id = y.dst WHERE x.type = 'PLACED' AND y.type = 'CONTAINS' AND p.size = 10"),
    "expand_multi_type": ("MATCH (a)-[r:PLACED|IN_NATION]->(b) RETURN type(r) AS t, count(*) AS n", "SELECT type AS t, count(*) AS n FROM E WHERE type IN ('PLACED', 'IN_NATION') GROUP BY ALL"),
    "rel_uniqueness": ("MATCH (o:Order)-[r1:CONTAINS]->(p)<-[r2:CONTAINS]-(q) RETURN p.id AS p, count(*) AS n", "SELECT p, n FROM (WITH L AS (SELECT l_partkey AS k, row_number() OVER () AS i FROM lineitem) SELECT 2000000000000 + x.k AS p, count(*) AS n FROM L x JOIN L y ON x.k = y.k AND x.i <> y.i GROUP BY ALL)"),
    "shared_variable_parts": ("MATCH (s:Supplier)-[:IN_NATION]->(n), (p)-[:SUPPLIED_BY]->(s) WHERE p.size < 3 RETURN n.name AS nation, count(*) AS n", "SELECT n.name AS nation, count(*) AS n FROM E x JOIN V n ON n.id = x.dst JOIN E y ON y.dst = x.src JOIN V p ON p.id = y.src WHERE x.type = 'IN_NATION' AND y.type = 'SUPPLIED_BY' AND p.size < 3 GROUP BY ALL"),
    "second_match": ("MATCH (c:Customer)-[:IN_NATION]->(n) WHERE c.acctbal > 9000 MATCH (n)-[:IN_REGION]->(r) RETURN r.name AS region, count(c) AS n", "SELECT r.name AS region, count(*) AS n FROM V c JOIN E x ON x.src = c.id AND x.type = 'IN_NATION' JOIN E y ON y.src = x.dst AND y.type = 'IN_REGION' JOIN V r ON r.id = y.dst WHERE c.label = 'Customer' AND c.acctbal > 9000 GROUP BY ALL"),
    "filter_compare_ops": ("MATCH (p:Part) WHERE p.size >= 10 AND p.size <= 20 AND p.size <> 15 AND p.price > 950 RETURN p.id AS id", "SELECT id FROM V WHERE label = 'Part' AND size >= 10 AND size <= 20 AND size <> 15 AND price > 950"),
    "filter_chained": ("MATCH (p:Part) WHERE 10 < p.size <= 12 RETURN p.id AS id", "SELECT id FROM V WHERE label = 'Part' AND size > 10 AND size <= 12"),
    "filter_bool_logic": ("MATCH (p:Part) WHERE NOT (p.size = 1 OR p.size = 2) XOR p.price > 1500 RETURN count(*) AS n", "SELECT count(*) AS n FROM V WHERE label = 'Part' AND (NOT (size = 1 OR size = 2)) <> (price > 1500)"),
    "filter_null": ("MATCH (n) WHERE n.acctbal IS NULL AND n.name IS NOT NULL RETURN n.label AS label, count(*) AS n", "SELECT label, count(*) AS n FROM V WHERE acctbal IS NULL AND name IS NOT NULL GROUP BY ALL"),
    "filter_string_predicates": ("MATCH (n) WHERE n.name STARTS WITH 'Customer' AND n.name ENDS WITH '7' OR n.name CONTAINS '00012' RETURN n.id AS id", "SELECT id FROM V WHERE starts_with(name, 'Customer') AND name LIKE '%7' OR name LIKE '%00012%'"),
    "filter_in_list": ("MATCH (c:Customer) WHERE c.segment IN ['BUILDING', 'MACHINERY'] RETURN c.segment AS s, count(*) AS n", "SELECT segment AS s, count(*) AS n FROM V WHERE label = 'Customer' AND segment IN ('BUILDING', 'MACHINERY') GROUP BY ALL"),
    "filter_property_to_property": ("MATCH (a:Nation)-[:IN_REGION]->(r) WHERE a.name > r.name RETURN a.name AS a", "SELECT a.name AS a FROM E JOIN V a ON a.id = src JOIN V r ON r.id = dst WHERE type = 'IN_REGION' AND a.name > r.name"),
    "inline_property_map": ("MATCH (p:Part {size: 7}) RETURN p.id AS id, p.brand AS brand", "SELECT id, brand FROM V WHERE label = 'Part' AND size = 7"),
    "pattern_predicate": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {priority: '1-URGENT'}) RETURN c.id AS id", "SELECT id FROM V WHERE label = 'Customer' AND id NOT IN (SELECT src FROM E JOIN V o ON o.id = dst WHERE type = 'PLACED' AND o.priority = '1-URGENT')"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o) WHERE o.price > 400000 } RETURN c.id AS id", "SELECT DISTINCT src AS id FROM E JOIN V o ON o.id = dst WHERE type = 'PLACED' AND o.price > 400000"),
    "cartesian_product": ("MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "SELECT a.name AS a, b.name AS b FROM V a, V b WHERE a.label = 'Region' AND b.label = 'Nation'"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.status = 'F' RETURN c.id AS id, count(o) AS n", "SELECT c.id, CAST(count(o.id) AS BIGINT) AS n FROM V c LEFT JOIN (SELECT src, v.id FROM E JOIN V v ON v.id = dst WHERE type = 'PLACED' AND v.status = 'F') o ON o.src = c.id WHERE c.label = 'Customer' GROUP BY ALL"),
    "avg_global": ("MATCH (p:Part) RETURN round(avg(p.price), 6) AS a", "SELECT round(avg(price), 6) AS a FROM V WHERE label = 'Part'"),
    "agg_grouped": ("MATCH (p:Part) RETURN p.brand AS brand, count(*) AS n, min(p.size) AS lo, max(p.size) AS hi, sum(p.size) AS total, round(stDev(p.price), 4) AS sd", "SELECT brand, count(*) AS n, min(size) AS lo, max(size) AS hi, CAST(sum(size) AS BIGINT) AS total, round(stddev_samp(price), 4) AS sd FROM V WHERE label = 'Part' GROUP BY ALL"),
    "agg_percentile": ("MATCH (p:Part) RETURN p.brand AS brand, percentileCont(p.size, 0.5) AS c, percentileDisc(p.size, 0.9) AS d", "SELECT brand, quantile_cont(size, 0.5) AS c, quantile_disc(size, 0.9) AS d FROM V WHERE label = 'Part' GROUP BY ALL"),
    "agg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, collect(n.name) AS names UNWIND names AS name RETURN r.name AS region, size(names) AS n, name", "SELECT r.name AS region, CAST(count(*) OVER (PARTITION BY dst) AS INT) AS n, x.name FROM E JOIN V r ON r.id = dst JOIN V x ON x.id = src WHERE type = 'IN_REGION'"),
    "count_distinct": ("MATCH (o:Order)-[:CONTAINS]->(p) RETURN count(DISTINCT p) AS parts, count(DISTINCT o) AS orders, count(*) AS n", "SELECT count(DISTINCT dst) AS parts, count(DISTINCT src) AS orders, count(*) AS n FROM E WHERE type = 'CONTAINS'"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT brand, size FROM V WHERE label = 'Part'"),
    "order_by_limit": ("MATCH (o:Order) RETURN o.id AS id, o.price AS price ORDER BY o.price DESC, o.id LIMIT 20", "SELECT id, price FROM V WHERE label = 'Order' ORDER BY price DESC, id LIMIT 20"),
    "skip_limit": ("MATCH (p:Part) RETURN p.id AS id ORDER BY p.id SKIP 10 LIMIT 15", "SELECT id FROM V WHERE label = 'Part' ORDER BY id LIMIT 15 OFFSET 10"),
    "union": ("MATCH (p:Part) RETURN p.size AS x UNION MATCH (q:Part) WHERE q.size > 25 RETURN q.size AS x", "SELECT DISTINCT size AS x FROM V WHERE label = 'Part'"),
    "union_all": ("MATCH (s:Supplier) RETURN s.name AS name UNION ALL MATCH (n:Nation) RETURN n.name AS name", "SELECT name FROM V WHERE label IN ('Supplier', 'Nation')"),
    "unwind": ("UNWIND [1, 2, 3, 2] AS x MATCH (p:Part) WHERE p.size = x RETURN x, count(*) AS n", "SELECT CAST(x AS BIGINT) AS x, count(*) AS n FROM (SELECT unnest([1, 2, 3, 2]) AS x) JOIN V ON size = x WHERE label = 'Part' GROUP BY ALL"),
    "case_expr": ("MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'middle' ELSE 'large' END AS k, count(*) AS n", "SELECT CASE WHEN size < 10 THEN 'small' WHEN size < 30 THEN 'middle' ELSE 'large' END AS k, count(*) AS n FROM V WHERE label = 'Part' GROUP BY ALL"),
    "arithmetic": ("MATCH (p:Part) RETURN p.id AS id, p.size / 4 AS a, p.size % 4 AS b, round(p.price * 2 - 1, 4) AS c, p.size ^ 2 AS d, -p.size AS e", "SELECT id, CAST(size // 4 AS BIGINT) AS a, CAST(size % 4 AS BIGINT) AS b, round(price * 2 - 1, 4) AS c, CAST(size AS DOUBLE) ** 2 AS d, -size AS e FROM V WHERE label = 'Part'"),
    "string_functions": ("MATCH (n:Nation) RETURN n.id AS id, toLower(n.name) AS a, substring(n.name, 1, 3) AS b, size(n.name) AS c, left(n.name, 2) + '-' + right(n.name, 2) AS d, replace(n.name, 'N', '_') AS e", "SELECT id, lower(name) AS a, substr(name, 2, 3) AS b, CAST(length(name) AS INT) AS c, left(name, 2) || '-' || right(name, 2) AS d, replace(name, 'N', '_') AS e FROM V WHERE label = 'Nation'"),
    "list_functions": ("MATCH (p:Part) WITH p, range(1, p.size) AS l RETURN p.id AS id, size([x IN l WHERE x % 3 = 0 | x * 2]) AS a, reduce(s = 0, x IN l | s + x) AS b, any(x IN l WHERE x > 40) AS c, head(l) AS d, last(l) AS e", "SELECT id, CAST(size // 3 AS INT) AS a, CAST(size * (size + 1) // 2 AS BIGINT) AS b, size > 40 AS c, CAST(1 AS BIGINT) AS d, CAST(size AS BIGINT) AS e FROM V WHERE label = 'Part'"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n, sum(o.price) AS total WHERE n > 12 RETURN c.id AS id, n, round(total, 2) AS total", "SELECT src AS id, count(*) AS n, round(sum(v.price), 2) AS total FROM E JOIN V v ON v.id = dst WHERE type = 'PLACED' GROUP BY src HAVING count(*) > 12"),
    "pattern_comprehension": ("MATCH (r:Region) WITH r, [(r)<-[:IN_REGION]-(n) WHERE n.id < 118 | n.name] AS names UNWIND names AS name RETURN r.name AS region, size(names) AS n, name", "SELECT r.name AS region, CAST(count(*) OVER (PARTITION BY dst) AS INT) AS n, x.name FROM E JOIN V r ON r.id = dst JOIN V x ON x.id = src WHERE type = 'IN_REGION' AND x.id < 118"),
    "var_length_path": ("MATCH (c:Customer)-[*1..3]->(r:Region) RETURN r.name AS region, count(*) AS n", "SELECT r.name AS region, count(*) AS n FROM E x JOIN E y ON x.dst = y.src JOIN V r ON r.id = y.dst WHERE x.type = 'IN_NATION' AND y.type = 'IN_REGION' AND x.src >= 3000000000000 GROUP BY ALL"),
    "named_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r {name: 'ASIA'}) RETURN c.id AS id, length(p) AS n, [x IN nodes(p) | x.id][1] AS nation", "SELECT x.src AS id, 2 AS n, x.dst AS nation FROM E x JOIN E y ON x.dst = y.src JOIN V r ON r.id = y.dst WHERE x.type = 'IN_NATION' AND y.type = 'IN_REGION' AND r.name = 'ASIA' AND x.src >= 3000000000000"),
    "label_test": ("MATCH (n)-[:IN_NATION]->(m) RETURN n:Customer AS is_customer, count(*) AS n", "SELECT src >= 3000000000000 AS is_customer, count(*) AS n FROM E WHERE type = 'IN_NATION' GROUP BY ALL"),
    "call_procedure": ("CALL db.labels() YIELD label RETURN label", "SELECT DISTINCT label FROM V"),
    "vertex_count": ("CALL db.vertexCount() YIELD vertices RETURN vertices", "SELECT count(*) AS vertices FROM V"),
    "edge_count": ("CALL db.edgeCount() YIELD edges RETURN edges", "SELECT count(*) AS edges FROM E"),
}

UPDATES: dict[str, tuple[str, str, str]] = {
    "create_then_match": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) CREATE (n)-[:ALLY {since: 2020}]->(m:Union {name: n.name + '!'})", "MATCH (a)-[r:ALLY]->(u:Union) RETURN a.name AS a, r.since AS since, u.name AS u", "SELECT n.name AS a, CAST(2020 AS BIGINT) AS since, n.name || '!' AS u FROM E JOIN V n ON n.id = src JOIN V r ON r.id = dst WHERE type = 'IN_REGION' AND r.name = 'ASIA'"),
    "merge_edges": ("MATCH (n:Nation), (r:Region) MERGE (n)-[:IN_REGION]->(r)", "MATCH (n)-[:IN_REGION]->(r) RETURN n.id AS n, count(*) AS k", "SELECT id AS n, (SELECT count(*) FROM region) AS k FROM V WHERE label = 'Nation'"),
    "set_property": ("MATCH (p:Part) WHERE p.size > 40 SET p.size = p.size * 100", "MATCH (p:Part) RETURN p.id AS id, p.size AS size", "SELECT id, CASE WHEN size > 40 THEN size * 100 ELSE size END AS size FROM V WHERE label = 'Part'"),
    "remove_property": ("MATCH (p:Part {size: 5}) REMOVE p.brand", "MATCH (p:Part) WHERE p.brand IS NULL RETURN p.id AS id", "SELECT id FROM V WHERE label = 'Part' AND size = 5"),
    "detach_delete": ("MATCH (r:Region {name: 'ASIA'}) DETACH DELETE r", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS region, count(*) AS n", "SELECT r.name AS region, count(*) AS n FROM E JOIN V r ON r.id = dst WHERE type = 'IN_REGION' AND r.name <> 'ASIA' GROUP BY ALL"),
}


def _cypher_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: cypher(star_graph(spark, d), text)


def _update_query(update: str, read: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: cypher(run(star_graph(spark, d), update).graph, read)


def triangle_count(spark: SparkSession, d: str) -> DataFrame:
    return triangles.triangle_count(co_bought(spark, d))


def triangle_count_follows(spark: SparkSession, d: str) -> DataFrame:
    return triangles.triangle_count(follows(spark, d))


def triangles_per_vertex(spark: SparkSession, d: str) -> DataFrame:
    return triangles.triangles_per_vertex(follows(spark, d))


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return degrees.in_degrees(purchases(spark, d))


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return degrees.out_degrees(purchases(spark, d))


def degree_json(spark: SparkSession, d: str) -> DataFrame:
    return to_json(degrees.in_degrees(purchases(spark, d)).select(F.col("id").alias("node"), F.col("degree").alias("value")))


def ego_net(spark: SparkSession, d: str) -> DataFrame:
    """Ego networks of all users."""
    return degrees.ego_net(follows(spark, d))


def pagerank_purchases(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(purchases(spark, d), 0.85, 10).select("id", F.round("rank", 9).alias("rank"))


def hash_partition_stats(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.partition_stats(co_bought(spark, d), 4).withColumn("cut_ratio", F.round("cut_ratio", 9))


def ldg_partition(spark: SparkSession, d: str) -> DataFrame:
    g = follows(spark, d)
    return partitioning.stats(g, partitioning.stream_partition(g, 4, "LDG", streams=4))


def fennel_partition(spark: SparkSession, d: str) -> DataFrame:
    g = follows(spark, d)
    return partitioning.stats(g, partitioning.stream_partition(g, 4, "FENNEL", streams=4))


def ldg_balance(spark: SparkSession, d: str) -> DataFrame:
    """What any LDG placement keeps: every partition used, no vertex or edge lost, capacity kept but for one vertex a
    stream."""
    s = ldg_partition(spark, d)
    room = F.sum("vertices") / 4 + 4
    return s.agg(F.count("*").alias("parts"), F.sum("vertices").alias("vertices"), F.sum(F.col("local_edges") + F.col("cut_edges")).alias("edges"), (F.max("vertices") <= room).alias("kept"))


def incremental_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Triangles after each of four batches of the follow graph: what each batch adds to the ones before, summed up.
    The pairs are written once; the four additions are one lazy plan."""
    pairs = materialize(follows(spark, d).undirected_pairs().withColumn("batch", F.pmod(F.col("a") + F.col("b"), F.lit(4)).cast("int")), "pairs")
    part = lambda c: pairs.where(c).select("a", "b")
    deltas = [ingest.triangle_delta(part(F.col("batch") < i), part(F.col("batch") == i)).select(F.lit(i).alias("batch"), "triangles") for i in range(4)]
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # over one row a batch
    return reduce(DataFrame.unionByName, deltas).select("batch", F.sum("triangles").over(upto).alias("triangles"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")


def fed_avg(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings averaged per label, weighted by the vector's number."""
    e = table(spark, d, "embeddings").withColumn("size", F.col("vec_id") % 7 + 1)
    return learning.fed_avg(e, "label", "embedding", "size").select(F.col("round").alias("label"), "position", F.round("weight", 5).alias("weight"))


def training_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customer and supplier frames with overlapping keys: the first frame wins."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return learning.training_frame([s, c], "k")


def field_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Fields above a frequency as places of a vector, from parts as papers with brand and type as fields."""
    p = table(spark, d, "part")
    fos = F.array(F.struct(F.col("p_brand").alias("name"), F.lit(0.9).cast("double").alias("w")), F.struct(F.col("p_type").alias("name"), F.when(F.col("p_size") > 25, 0.7).otherwise(0.2).cast("double").alias("w")))
    papers = p.select(F.col("p_partkey").cast("string").alias("id"), fos.alias("fos"))
    x = sources.one_hot(papers, above=10)
    return x.select("id", F.size("features").alias("places"), F.aggregate("features", F.lit(0), lambda a, v: a + v.cast("int")).alias("ones"))


def graph_listing(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows joined with their states; repeated deliveries count once."""
    g, s = table(spark, d, "graph").dropDuplicates(), table(spark, d, "graph_status")
    return g.join(s, F.col("graph_status_idgraph_status") == F.col("idgraph_status"), "left").select("idgraph", "name", "upload_path", "description")


def sla_calibration(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.catalog import calibrated_sla

    x = table(spark, d, "graph_sla").dropDuplicates()
    return calibrated_sla(x, ["id_sla_category", "partition_count"], "sla_value", "attempt").withColumn("sla_value", F.round("sla_value", 6))


def labelled(spark: SparkSession, d: str) -> Graph:
    """Customers with two labels each, their segment being the second, and what they placed."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    people = c.select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer"), "c_mktsegment").alias("labels"), F.col("c_name").alias("name"))
    orders = o.select((F.col("o_orderkey") + BASE["Order"]).alias("id"), F.array(F.lit("Order"), F.concat(F.lit("S"), "o_orderstatus")).alias("labels"))
    placed = o.select(_eid(4, F.col("o_orderkey")).alias("eid"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") + BASE["Order"]).alias("dst"), F.lit("PLACED").alias("type"))
    return Graph(people.unionByName(orders, allowMissingColumns=True), placed)


def multi_label_scan(spark: SparkSession, d: str) -> DataFrame:
    return cypher(labelled(spark, d), "MATCH (n:Customer:BUILDING) RETURN n.id AS id, n.name AS name")


def multi_label_expand(spark: SparkSession, d: str) -> DataFrame:
    return cypher(labelled(spark, d), "MATCH (c:Customer:MACHINERY)-[:PLACED]->(o:Order:SF) RETURN c.id AS id, count(o) AS n")


def return_node(spark: SparkSession, d: str) -> DataFrame:
    """Whole nodes and relationships as results."""
    x = cypher(star_graph(spark, d), "MATCH (n:Nation)-[r:IN_REGION]->(m) RETURN n, r, m")
    return x.select(F.col("n.id").alias("id"), F.col("n.label").alias("label"), F.col("r.type").alias("type"), F.col("m.name").alias("region"))


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Relationships of each part by size() of a pattern."""
    return cypher(star_graph(spark, d), "MATCH (p:Part) RETURN p.id AS id, size((p)-[:SUPPLIED_BY]->()) AS n")


def link_scores(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of neighbouring vectors, and of every vector with itself."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    pairs = e.select(F.col("vec_id").alias("src"), F.explode(F.array("vec_id", F.col("vec_id") + 1)).alias("dst"))
    x = learning.link_scores(Graph(v, pairs.withColumn("type", F.lit("NEAR"))))
    return x.where("score is not null").select("src", "dst", F.round("score", 4).alias("score"))


def training_memory(spark: SparkSession, d: str) -> DataFrame:
    """Memory (GB) that training on each graph needs, at 100 bytes an edge."""
    g = table(spark, d, "graph").dropDuplicates().where("edgecount is not null")
    return g.select("idgraph", F.round(learning.training_memory_gb(F.col("edgecount") * 100 / 1e9), 6).alias("gb"))


def graph_algorithms(spark: SparkSession, d: str) -> DataFrame:
    """Graphs by the algorithm that partitioned them."""
    names = F.create_map(*[F.lit(x) for pair in partitioning.ALGORITHMS.items() for x in pair])
    g = table(spark, d, "graph").dropDuplicates()
    return g.groupBy(names[F.col("id_algorithm")].alias("algorithm")).agg(F.count("*").alias("n"))


_PLAIN = (multi_label_scan, multi_label_expand, return_node, node_degrees, link_scores, training_memory, graph_algorithms, triangle_count, triangle_count_follows, triangles_per_vertex, in_degree, out_degree, degree_json, ego_net, pagerank_purchases, hash_partition_stats, ldg_partition, fennel_partition, ldg_balance, incremental_triangles, windowed_events, fed_avg, training_merge, field_one_hot, graph_listing, sla_calibration)

QUERIES = {n: _cypher_query(q) for n, (q, _) in CYPHER.items()} | {n: _update_query(u, r) for n, (u, r, _) in UPDATES.items()} | {f.__name__: f for f in _PLAIN}


def _pagerank_sql(rounds: int) -> str:
    ctes = [_PU.rstrip()[5:], "I AS (SELECT src AS id FROM A UNION SELECT dst FROM A)", "C AS (SELECT count(*) AS n FROM I)", "D AS (SELECT src, count(*) AS o FROM A GROUP BY src)", "R0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM I, C)"]
    for i in range(1, rounds + 1):
        p = f"R{i - 1}"
        ctes.append(f"L{i} AS (SELECT coalesce(sum(r), 0) AS loose FROM {p} WHERE id NOT IN (SELECT src FROM D))")
        ctes.append(f"G{i} AS (SELECT A.dst AS id, sum({p}.r / D.o) AS got FROM A JOIN {p} ON {p}.id = A.src JOIN D ON D.src = A.src GROUP BY A.dst)")
        ctes.append(f"R{i} AS (SELECT I.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n) AS r FROM I CROSS JOIN C CROSS JOIN L{i} LEFT JOIN G{i} ON G{i}.id = I.id)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, round(r, 9) AS rank FROM R{rounds}"


SQL = {n: _W + s for n, (_, s) in CYPHER.items()} | {n: _W + s for n, (_, _, s) in UPDATES.items()} | {
    "multi_label_scan": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "multi_label_expand": "SELECT c_custkey AS id, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F' GROUP BY ALL",
    "return_node": "SELECT CAST(100 + n_nationkey AS BIGINT) AS id, 'Nation' AS label, 'IN_REGION' AS type, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey",
    "node_degrees": "SELECT 2000000000000 + p_partkey AS id, CAST((SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS INT) AS n FROM part",
    "link_scores": "SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id, a.vec_id + 1)",
    "training_memory": "SELECT idgraph, round(3.6 * (edgecount * 100 / 1e9) + 2, 6) AS gb FROM (SELECT DISTINCT * FROM graph) WHERE edgecount IS NOT NULL",
    "graph_algorithms": "SELECT CASE id_algorithm WHEN 1 THEN 'HASH' WHEN 2 THEN 'FENNEL' WHEN 3 THEN 'LDG' WHEN 4 THEN 'METIS' END AS algorithm, count(*) AS n FROM (SELECT DISTINCT * FROM graph) GROUP BY ALL",
    "triangle_count": _CO + _TRI,
    "triangle_count_follows": _FO + _TRI,
    "triangles_per_vertex": _FO + ", T AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM P x JOIN P y ON x.b = y.a JOIN P z ON z.a = x.a AND z.b = y.b) SELECT id, CAST(count(*) AS BIGINT) AS triangles FROM (SELECT p AS id FROM T UNION ALL SELECT q FROM T UNION ALL SELECT r FROM T) GROUP BY id",
    "in_degree": _PU + "SELECT dst AS id, count(*) AS degree FROM A GROUP BY dst",
    "out_degree": _PU + "SELECT src AS id, count(*) AS degree FROM A GROUP BY src",
    "degree_json": _PU + "SELECT '{\"node\":' || dst || ',\"value\":' || count(*) || '}' AS json FROM A GROUP BY dst",
    "ego_net": _FO + "SELECT u AS ego, u AS src, v AS dst FROM N UNION ALL SELECT x.u AS ego, x.v AS src, y.v AS dst FROM N x JOIN N y ON y.u = x.v JOIN N z ON z.u = x.u AND z.v = y.v",
    "pagerank_purchases": _pagerank_sql(10),
    "hash_partition_stats": _CO + ", I AS (SELECT a AS id FROM P UNION SELECT b FROM P), X AS (SELECT id % 4 AS part, count(*) AS vertices FROM I GROUP BY ALL), Y AS (SELECT a % 4 AS part, count(*) FILTER (a % 4 = b % 4) AS l, count(*) FILTER (a % 4 <> b % 4) AS c FROM P GROUP BY ALL) SELECT CAST(part AS INT) AS part, vertices, coalesce(l, 0) AS local_edges, coalesce(c, 0) AS cut_edges, round(coalesce(c / (l + c), 0), 9) AS cut_ratio FROM X LEFT JOIN Y USING (part)",
    "incremental_triangles": _FO + ", Q AS (SELECT a, b, (a + b) % 4 AS k FROM P), T AS (SELECT greatest(x.k, y.k, z.k) AS k FROM Q x JOIN Q y ON x.b = y.a JOIN Q z ON z.a = x.a AND z.b = y.b) SELECT CAST(i AS INT) AS batch, CAST((SELECT count(*) FROM T WHERE k <= i) AS BIGINT) AS triangles FROM range(4) r(i)",
    "ldg_balance": _FO + ", X AS (SELECT user_id AS a, nx AS b FROM f WHERE nx IS NOT NULL AND nx <> user_id) SELECT CAST(4 AS BIGINT) AS parts, (SELECT count(*) FROM (SELECT a FROM X UNION SELECT b FROM X)) AS vertices, CAST((SELECT count(*) FROM X) AS BIGINT) AS edges, true AS kept",
    "windowed_events": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL",
    "fed_avg": "WITH x AS (SELECT label, vec_id % 7 + 1 AS s, unnest(embedding) AS w, unnest(range(len(embedding))) AS position FROM embeddings) SELECT label, CAST(position AS INT) AS position, round(sum(s * w::DOUBLE) / sum(s), 5) AS weight FROM x GROUP BY ALL",
    "training_merge": "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "field_one_hot": "WITH f AS (SELECT p_partkey, p_brand AS name FROM part UNION SELECT p_partkey, p_type FROM part WHERE p_size > 25), k AS (SELECT name FROM f GROUP BY name HAVING count(*) > 10) SELECT CAST(p_partkey AS VARCHAR) AS id, CAST((SELECT count(*) FROM k) AS INT) AS places, CAST((p_brand IN (SELECT name FROM k))::INT + (p_size > 25 AND p_type IN (SELECT name FROM k))::INT AS INT) AS ones FROM part",
    "graph_listing": "SELECT idgraph, name, upload_path, description FROM (SELECT DISTINCT * FROM graph) LEFT JOIN graph_status ON graph_status_idgraph_status = idgraph_status",
    "sla_calibration": "SELECT id_sla_category, partition_count, round(avg(sla_value), 6) AS sla_value FROM (SELECT DISTINCT * FROM graph_sla) WHERE attempt <= 3 GROUP BY ALL",
}
