"""Queries of the general data problems (p1, p3, p4, p5, p6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import references, shred, skew, spikes, widen
from ..runtime import materialize, row_hash, table

METRICS = ("memory_usage", "load_average", "elapsed_time")
#: No machine has 64 TB of memory in use (MB), a load of 100,000, or a run of over a year (s); nothing is below zero.
RULES = spikes.Rules(limits={"memory_usage": (0.0, 67_108_864.0), "load_average": (0.0, 100_000.0), "elapsed_time": (0.0, 31_622_400.0)})


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return spikes.score_readings(table(spark, d, "graph_place_sla_performance"), "place_id", "graph_sla_id", METRICS, RULES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = _scored(spark, d).where(F.col("impossible") | F.col("stuck") | F.col("isolated"))
    return flagged.select("id", "metric").distinct()


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with its score and flags."""
    return _scored(spark, d).withColumnRenamed("source", "place_id")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """What the rules alone say of every reading: its run of equal values, whether it is stuck or impossible."""
    return p1_scores(spark, d).select("id", "metric", "value", "run_length", "stuck", "impossible")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.elements(table(spark, d, "edge"), "edge_id", shred.EDGE_ARRAYS)


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Every element with the element that encloses it."""
    return shred.elements(table(spark, d, "edge"), "edge_id", shred.EDGE_ARRAYS, links=True)


#: Flat tables of the endpoints and array elements: document, array path (None: the endpoint itself), scalar fields.
_CONTACT, _AFFILIATION, _SITE, _ROLE = ("kind", "value", "since"), ("org.id", "org.name"), ("city", "floor"), ("title", "from", "to")
ENTITIES: dict[str, tuple[str, str | None, tuple[str, ...]]] = {"p3_roles": ("source", "properties.affiliations.roles", _ROLE)}
for _side in ("source", "destination"):
    ENTITIES |= {
        f"p3_{_side}": (_side, None, ("id", "pid", "properties.id", "properties.label", "properties.name")),
        f"p3_{_side}_contacts": (_side, "properties.contacts", _CONTACT),
        f"p3_{_side}_affiliations": (_side, "properties.affiliations", _AFFILIATION),
        f"p3_{_side}_sites": (_side, "properties.affiliations.org.sites", _SITE),
        f"p3_{_side}_roles": (_side, "properties.affiliations.roles", _ROLE),
    }
ENTITIES |= {
    "p3_evidence": ("properties", "evidence", ("doc", "weight")),
    "p3_spans": ("properties", "evidence.spans", ("from", "to")),
    "p3_changes": ("properties", "history.changes", ("at", "by.id")),
    "p3_tags": ("properties", "history.changes.by.tags", ("k", "v")),
    "p3_measures": ("properties", "history.changes.measures", ("m", "v")),
}


def _entities(spark: SparkSession, d: str, doc: str, arr_path: str | None, fields: tuple[str, ...]) -> DataFrame:
    return shred.entities(table(spark, d, "edge"), "edge_id", shred.EDGE_ARRAYS[doc], doc, arr_path, fields)


def _entity_query(doc: str, arr_path: str | None, fields: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    """Entity table with the link `owner`: the node of the enclosing element, or the endpoint or edge (node 0)."""
    return lambda spark, d: _entities(spark, d, doc, arr_path, fields)


def p3_edges(spark: SparkSession, d: str) -> DataFrame:
    """Flat edges: every edge with its edgetype in one spelling (Local, Central), type and since of the properties
    document, and the two endpoints' ids."""
    kind = F.initcap(F.trim("edgetype"))
    edges = table(spark, d, "edge").select("edge_id", F.when(kind != "", kind).alias("edgetype")).distinct()
    ends, own = ("id", "pid"), ("type", "since")
    edges = edges.join(_entities(spark, d, "properties", None, own).select("edge_id", *own), "edge_id", "left")
    for side in ("source", "destination"):
        found = _entities(spark, d, side, None, ends).select("edge_id", *[F.col(c).alias(f"{side}_{c}") for c in ends])
        edges = edges.join(found, "edge_id", "left")
    return edges


#: The wide tables' columns, as the clean table property_type lists them.
KINDS = ("source", "edge")
CELL_ENTITY = ("entity_kind", "entity_id")


def _wide_columns(spark: SparkSession, d: str, kind: str) -> list[tuple[str, str]]:
    """property_type is a fixed dictionary of some 30 rows: the schema of the result."""
    rows = table(spark, d, "property_type").where(F.col("entity_kind") == kind).select("attr", "val_type").distinct().orderBy("attr").collect()
    return [(r["attr"], r["val_type"]) for r in rows]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Readable cells of both kinds, read once and written out: what the register stage starts from again if an
    executor is lost."""
    cells = widen.typed_cells(table(spark, d, "property_link"), table(spark, d, "property_type"), CELL_ENTITY, "attr", "val", "loaded_at", "link_id", "entity_kind")
    return materialize(cells, "cells")


def _wide(spark: SparkSession, d: str, *kinds: str) -> tuple[dict[str, DataFrame], dict[str, list[tuple[str, str]]]]:
    columns = {k: _wide_columns(spark, d, k) for k in kinds}
    return widen.widen_kinds(_cells(spark, d).where(F.col("entity_kind").isin(*kinds)), CELL_ENTITY, "entity_kind", columns), columns


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wide, columns = _wide(spark, d, *KINDS)
    return reduce(DataFrame.unionByName, [widen.cells_of(wide[k], CELL_ENTITY, columns[k]) for k in KINDS])


def p4_source_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "source")[0]["source"]


def p4_edge_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "edge")[0]["edge"]


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, side, vertex_id) once per edge and side with a readable id. Each document is parsed where it is
    read; repeats are dropped on (edge_id, hash of all columns), so no document text is shuffled."""
    raw = table(spark, d, "edge")
    slim = raw.select("edge_id", row_hash(raw).alias("__h"), "source", "destination")

    def ids(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for c in (2, 3):
                column = b.column(c)
                side = []
                for i in range(b.num_rows):
                    top = shred.parse(column[i].as_py())
                    v = top.get("id") if isinstance(top, dict) else None
                    if isinstance(v, float) and v.is_integer():
                        v = int(v)
                    text = str(v).strip() if isinstance(v, (str, int)) and not isinstance(v, bool) else ""
                    side.append(text or None)
                found.append(pa.array(side, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], ["edge_id", "__h", "source", "destination"])

    parsed = slim.mapInArrow(ids, "edge_id long, __h long, source string, destination string").dropDuplicates()
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("vertex_id")) for s in ("source", "destination")])
    return parsed.select("edge_id", F.explode(sides).alias("__s")).select("edge_id", "__s.side", "__s.vertex_id").where(F.col("vertex_id").isNotNull())


def _side_totals(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("\u0001", "side", "vertex_id").alias("__k")
    totals = skew.accumulate(_endpoints(spark, d).select(key, "edge_id"), "__k", mins=["edge_id"], maxs=["edge_id"])
    cut = F.split("__k", "\u0001", 2)
    return totals.select(cut[0].alias("side"), cut[1].alias("vertex_id"), "n", F.col("min_edge_id").alias("first_edge"), F.col("max_edge_id").alias("last_edge"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    totals = _side_totals(spark, d)
    heavy = [skew.heavy_keys(totals.where(F.col("side") == s), "vertex_id", 0.02) for s in ("source", "destination")]
    return heavy[0].unionByName(heavy[1]).select("side", "vertex_id")


def p5_vertex_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges, first and last edge of every vertex and side."""
    return _side_totals(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ym = F.date_format("loaded_at", "yyyy-MM").alias("period_ym")

    def child(name: str, *cols: str) -> DataFrame:
        # repeated deliveries give equal cases, which the last step drops: their rows need not be shuffled for it
        return table(spark, d, name).select(*cols, "loaded_at")

    def found(bad: DataFrame, name: str, key) -> DataFrame:
        return bad.select(F.lit(name).alias("child_table"), key.cast("string").alias("row_key"), ym, F.col("__reason").alias("reason"))

    graph, sla, status = (table(spark, d, t) for t in ("graph", "graph_sla", "graph_status"))
    perf = references.checked(child("graph_place_sla_performance", "id", "graph_sla_id"), sla, ("graph_sla_id", "id"), "id")
    graphs = references.orphans(child("graph", "idgraph", "graph_status_idgraph_status"), status, [("graph_status_idgraph_status", "idgraph_status")], "idgraph")
    parts = references.checked(child("streaming_partition", "graph_id", "partition_id"), graph, ("graph_id", "idgraph"), "partition_id", deleted=F.coalesce(F.col("graph_status_idgraph_status") == 3, F.lit(False)))
    out = found(perf, "graph_place_sla_performance", F.col("id"))
    out = out.unionByName(found(graphs, "graph", F.col("idgraph")))
    return out.unionByName(found(parts, "streaming_partition", F.concat_ws(":", "graph_id", "partition_id"))).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Bad references per table, month and reason."""
    return p6_found(spark, d).groupBy("child_table", "period_ym", "reason").agg(F.count("*").alias("n"))


def p6_composite(spark: SparkSession, d: str) -> DataFrame:
    """Requests for a graph in so many partitions, by the composite reference (graph_id, partition_count) of graph_sla to
    graph, which may be null in part: what is no orphan under one match may be one under another."""
    sla, graph = table(spark, d, "graph_sla").distinct(), table(spark, d, "graph")
    number = F.regexp_extract("graph_id", r"^\s*(\d{1,18})\s*$", 1)
    child = sla.select("id", F.when(number != "", number.cast("bigint")).alias("graph"), F.col("partition_count").alias("parts"))
    keys = [("graph", "idgraph"), ("parts", "centralpartitioncount")]
    each = [references.orphans(child, graph, keys, "id", m).select("id", F.lit(m).alias("match"), F.col("__reason").alias("reason")) for m in references.MATCHES]
    return reduce(DataFrame.unionByName, each)


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p1_runs, p3_found, p3_links, p3_edges, p4_found, p4_source_wide, p4_edge_wide, p5_found, p5_vertex_counts, p6_found, p6_report, p6_composite)} | {n: _entity_query(*e) for n, e in ENTITIES.items()}

_P6 = """
WITH perf AS (SELECT DISTINCT * FROM graph_place_sla_performance), g AS (SELECT DISTINCT * FROM graph),
sp AS (SELECT DISTINCT * FROM streaming_partition), sla AS (SELECT DISTINCT * FROM graph_sla),
x AS (
  SELECT 'graph_place_sla_performance' AS child_table, CAST(p.id AS VARCHAR) AS row_key, strftime(p.loaded_at, '%Y-%m') AS period_ym,
    CASE WHEN s.id IS NULL THEN 'missing' WHEN s.loaded_at > p.loaded_at THEN 'late' END AS reason
  FROM perf p LEFT JOIN sla s ON p.graph_sla_id = s.id WHERE p.graph_sla_id IS NOT NULL
  UNION ALL
  SELECT 'graph', CAST(c.idgraph AS VARCHAR), strftime(c.loaded_at, '%Y-%m'), CASE WHEN s.idgraph_status IS NULL THEN 'missing' END
  FROM g c LEFT JOIN graph_status s ON c.graph_status_idgraph_status = s.idgraph_status WHERE c.graph_status_idgraph_status IS NOT NULL
  UNION ALL
  SELECT 'streaming_partition', CAST(c.graph_id AS VARCHAR) || ':' || CAST(c.partition_id AS VARCHAR), strftime(c.loaded_at, '%Y-%m'),
    CASE WHEN p.idgraph IS NULL THEN 'missing' WHEN p.graph_status_idgraph_status = 3 THEN 'deleted' WHEN p.loaded_at > c.loaded_at THEN 'late' END
  FROM sp c LEFT JOIN g p ON c.graph_id = p.idgraph WHERE c.graph_id IS NOT NULL)
"""

_P5 = """
WITH e AS (SELECT DISTINCT * FROM edge),
d AS (SELECT edge_id, 'source' AS side, source AS t FROM e UNION ALL SELECT edge_id, 'destination', destination FROM e),
o AS (SELECT edge_id, side, CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END AS t FROM d WHERE json_valid(t)),
i AS (SELECT edge_id, side, trim(json_extract_string(t, '$.id')) AS vertex_id FROM o WHERE json_valid(t)),
c AS (SELECT side, vertex_id, count(*) AS n, min(edge_id) AS first_edge, max(edge_id) AS last_edge FROM i WHERE vertex_id <> '' GROUP BY ALL)
"""

_P4 = r"""
WITH k AS (SELECT entity_kind, attr, val_type, lower(regexp_replace(attr, '[^\p{L}\p{N}]', '', 'g')) AS name FROM property_type),
t AS (SELECT l.entity_kind, l.entity_id, l.link_id, l.loaded_at, k.attr, k.val_type, regexp_replace(l.val, '^[\s\x{00a0}\x{200b}]+|[\s\x{00a0}\x{200b}]+$', '', 'g') AS v
  FROM (SELECT DISTINCT * FROM property_link) l JOIN k ON k.entity_kind = l.entity_kind AND k.name = lower(regexp_replace(l.attr, '[^\p{L}\p{N}]', '', 'g')) WHERE l.entity_id IS NOT NULL),
q AS (SELECT *, trim(CASE WHEN length(v) > 1 AND v[1] = v[-1] AND v[1] IN (chr(34), chr(39)) THEN v[2:-2] ELSE v END) AS u FROM t),
n AS (SELECT *, CASE WHEN regexp_full_match(u, '[+-]?(\d+|\d{1,3}(,\d{3})+)?(\.\d+)?([eE][+-]?\d{1,3})?') AND regexp_matches(u, '^[+-]?\.?\d') THEN TRY_CAST(replace(u, ',', '') AS DECIMAL(38, 12)) END AS x FROM q),
r AS (SELECT *, CASE val_type
  WHEN 'string' THEN nullif(v, '')
  WHEN 'long' THEN CASE WHEN x = floor(x) THEN CAST(TRY_CAST(x AS BIGINT) AS VARCHAR) END
  WHEN 'decimal' THEN CAST(TRY_CAST(round(x, 2) AS DECIMAL(20, 2)) AS VARCHAR)
  WHEN 'boolean' THEN CASE WHEN lower(u) IN ('true', 't', 'yes', 'y', 'on', '1') THEN 'true' WHEN lower(u) IN ('false', 'f', 'no', 'n', 'off', '0') THEN 'false' END
  WHEN 'date' THEN strftime(coalesce(try_strptime(regexp_replace(u, '[T ]\d{1,2}:.*$', ''), ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%Y%m%d']), try_strptime(replace(u, '.', ''), ['%d %B %Y', '%d %b %Y', '%B %d, %Y', '%b %d, %Y', '%B %d %Y', '%b %d %Y'])), '%Y-%m-%d') END AS val_text FROM n),
c AS (SELECT entity_kind, entity_id, attr, arg_max(val_text, (loaded_at, link_id, val_text)) AS val_text, any_value(val_type) AS val_type FROM r WHERE val_text IS NOT NULL GROUP BY entity_kind, entity_id, attr)
"""
def _opened_sql(x: str) -> str:
    """A JSON value as it counts: text that holds an object or an array is that."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_type(TRY_CAST({x}->>'$' AS JSON)) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN TRY_CAST({x}->>'$' AS JSON) ELSE {x} END"


def _p3_sql() -> tuple[str, dict[str, str]]:
    """CTEs that walk every declared path by its labels and arrays; the last CTE of each document's path."""
    ctes, last = ["e AS (SELECT DISTINCT * FROM edge)"], {}
    for doc, paths in shred.EDGE_ARRAYS.items():
        top = f"{doc}_top"
        once = f"SELECT edge_id, CAST([] AS INT[]) AS pos, {_opened_sql('TRY_CAST(' + doc + ' AS JSON)')} AS y FROM e WHERE json_valid({doc})"
        ctes.append(f"{top} AS (SELECT edge_id, pos, {_opened_sql('y')} AS x FROM ({once}) WHERE y IS NOT NULL)")
        last[doc] = top
        for path in paths:
            at, done = top, []
            for label in path.split("."):
                done.append(label)
                here, held = ".".join(done), f"{doc}_{'_'.join(done)}"
                if (doc + ":" + here) not in last:
                    x = f"""json_extract(x, '$."{label}"')"""
                    one = f"SELECT edge_id, pos, {_opened_sql(x)} AS y FROM {at} WHERE json_type(x) = 'OBJECT' AND {x} IS NOT NULL"
                    step = f"SELECT edge_id, pos, {_opened_sql('y')} AS x FROM ({one})"
                    if here in paths:
                        each = f"SELECT edge_id, pos, CASE json_type(x) WHEN 'OBJECT' THEN [x] WHEN 'ARRAY' THEN json_extract(x, '$[*]') ELSE [] END AS l FROM ({step})"
                        item = f"SELECT edge_id, list_append(pos, i) AS pos, {_opened_sql('v')} AS x FROM (SELECT edge_id, pos, unnest(l) AS v, unnest(range(len(l))) AS i FROM ({each}))"
                        step = f"SELECT * FROM ({item}) WHERE json_type(x) = 'OBJECT'"
                    ctes.append(f"{held} AS ({step})")
                    last[doc + ":" + here] = held
                at = last[doc + ":" + here]
    return "WITH " + ", ".join(ctes), last


_P3, _AT = _p3_sql()
_P3_FOUND = " UNION ALL ".join(f"SELECT edge_id, '{doc}' AS side, '{path}' AS arr_path, array_to_string(pos, '.') AS arr_pos FROM {_AT[doc + ':' + path]}" for doc, paths in shred.EDGE_ARRAYS.items() for path in paths)


def _link_sql(doc: str, path: str) -> str:
    above = [p for p in shred.EDGE_ARRAYS[doc] if path.startswith(p + ".")]
    parent = f"'{max(above, key=len)}'" if above else "NULL"
    return f"SELECT edge_id, '{doc}' AS side, '{path}' AS arr_path, array_to_string(pos, '.') AS arr_pos, {parent} AS parent_path, nullif(array_to_string(pos[:-2], '.'), '') AS parent_pos FROM {_AT[doc + ':' + path]}"


_P3_LINKS = " UNION ALL ".join(_link_sql(doc, path) for doc, paths in shred.EDGE_ARRAYS.items() for path in paths)


def _scalar_sql(doc: str, label: str, name: str) -> str:
    v = f"""json_extract(x, '$."{label}"')"""
    return f"(SELECT any_value(CASE WHEN json_type({v}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {v}->>'$' END) FROM {_AT[doc]} t WHERE t.edge_id = e.edge_id AND json_type(x) = 'OBJECT') AS {name}"


_P3_EDGES = "SELECT edge_id, any_value(CASE WHEN trim(edgetype) <> '' THEN upper(trim(edgetype)[1]) || lower(trim(edgetype)[2:]) END) AS edgetype, " + ", ".join(f"any_value({n}) AS {n}" for n in ("type", "since", "source_id", "source_pid", "destination_id", "destination_pid")) + " FROM (SELECT edge_id, edgetype, " + ", ".join([_scalar_sql("properties", c, c) for c in ("type", "since")] + [_scalar_sql(s, c, f"{s}_{c}") for s in ("source", "destination") for c in ("id", "pid")]) + " FROM e) GROUP BY edge_id"

# The attributes of each kind, as property_type lists them.
_WIDE = {
    "source": "active boolean, birth_year long, budget decimal, degree_hint long, floor_area decimal, founded_on date, home_city string, joined_on date, label string, last_seen date, motto string, name string, population long, rank long, retired boolean, trust_score decimal, verified boolean",
    "edge": "channel string, confirmed boolean, expires_on date, hops long, mirrored boolean, remark string, seen_on date, since long, toll decimal, type string, weight decimal",
}
_SQL_TYPES = {"boolean": "BOOLEAN", "long": "BIGINT", "decimal": "DECIMAL(20, 2)", "date": "DATE", "string": "VARCHAR"}


def _p4_wide_sql(kind: str) -> str:
    columns = [x.split() for x in _WIDE[kind].split(", ")]
    cells = ", ".join(f"CAST(max(CASE WHEN attr = '{n}' THEN val_text END) AS {_SQL_TYPES[t]}) AS \"{n}\"" for n, t in columns)
    return _P4 + f"SELECT entity_kind, entity_id, {cells} FROM c WHERE entity_kind = '{kind}' GROUP BY entity_kind, entity_id"


_P6C = """
WITH c AS (SELECT DISTINCT id, CAST(nullif(regexp_extract(graph_id, '^\\s*(\\d{1,18})\\s*$', 1), '') AS BIGINT) AS g, partition_count AS p FROM (SELECT DISTINCT * FROM graph_sla)),
x AS (SELECT id, g, p, EXISTS (SELECT 1 FROM graph WHERE idgraph = g AND centralpartitioncount = p) AS both_met, EXISTS (SELECT 1 FROM graph WHERE idgraph = g) AS g_met, EXISTS (SELECT 1 FROM graph WHERE centralpartitioncount = p) AS p_met FROM c)
SELECT id, 'simple' AS match, 'missing' AS reason FROM x WHERE g IS NOT NULL AND p IS NOT NULL AND NOT both_met
UNION ALL SELECT id, 'partial', 'missing' FROM x WHERE (g IS NOT NULL AND p IS NOT NULL AND NOT both_met) OR (p IS NULL AND g IS NOT NULL AND NOT g_met) OR (g IS NULL AND p IS NOT NULL AND NOT p_met)
UNION ALL SELECT id, 'full', CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN 'missing' ELSE 'mixed_null' END FROM x WHERE (g IS NULL) <> (p IS NULL) OR (g IS NOT NULL AND p IS NOT NULL AND NOT both_met)
"""

_P1 = """
WITH r AS (SELECT DISTINCT * FROM graph_place_sla_performance WHERE place_id IS NOT NULL AND id IS NOT NULL),
m AS (SELECT id, place_id, 'memory_usage' AS metric, memory_usage AS value, 67108864.0 AS most FROM r UNION ALL SELECT id, place_id, 'load_average', load_average, 100000.0 FROM r
  UNION ALL SELECT id, place_id, 'elapsed_time', CAST(elapsed_time AS DOUBLE), 31622400.0 FROM r),
t AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS turn FROM m WHERE value IS NOT NULL AND NOT isnan(value) WINDOW w AS (PARTITION BY place_id, metric ORDER BY id)),
c AS (SELECT *, sum(turn) OVER (PARTITION BY place_id, metric ORDER BY id) AS chain FROM t)
SELECT id, metric, value, CAST(count(*) OVER (PARTITION BY place_id, metric, chain) AS BIGINT) AS run_length,
  count(*) OVER (PARTITION BY place_id, metric, chain) >= 5 AS stuck, value < 0 OR value > most AS impossible FROM c
"""

SQL = {
    "p1_runs": _P1,
    "p3_found": f"{_P3} {_P3_FOUND}",
    "p3_links": f"{_P3} {_P3_LINKS}",
    "p3_edges": f"{_P3} {_P3_EDGES}",
    "p4_found": _P4 + "SELECT entity_kind, entity_id, attr, val_text FROM c",
    "p4_source_wide": _p4_wide_sql("source"),
    "p4_edge_wide": _p4_wide_sql("edge"),
    "p6_composite": _P6C,
    "p5_found": _P5 + "SELECT side, vertex_id FROM (SELECT *, sum(n) OVER (PARTITION BY side) AS whole FROM c) WHERE n >= 0.02 * whole",
    "p5_vertex_counts": _P5 + "SELECT side, vertex_id, n, first_edge, last_edge FROM c",
    "p6_found": _P6 + "SELECT DISTINCT child_table, row_key, period_ym, reason FROM x WHERE reason IS NOT NULL",
    "p6_report": _P6 + ", y AS (SELECT DISTINCT child_table, row_key, period_ym, reason FROM x WHERE reason IS NOT NULL) SELECT child_table, period_ym, reason, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY ALL",
}
