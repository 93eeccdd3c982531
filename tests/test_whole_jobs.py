"""Nothing is left out: nested fields, every array path, every vertex, every reading, every item."""

import json
import os
import random

import pytest

from graphloom.operators import shred, spikes
from graphloom.queries import graphs, problems

D = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def edge_table(spark, tmp_path):
    source = {"id": 7, "pid": 1, "properties": {"label": "Person", "name": "Ann", "x.name": "no", "affiliations": [None, {"org": '{"id": 5, "sites": {"city": "Oslo"}}', "roles": [{"title": "t"}]}]}}
    properties = {"type": "T", "history": {"changes": [{"at": "1", "by": {"id": 9, "tags": [{"k": "a", "v": "b"}]}, "measures": [{"m": "x", "v": 1.5}]}]}, "evidence": {"doc": "d", "spans": [{"from": 1}, {"to": 2}]}}
    table = [
        (1, json.dumps(source), json.dumps({"id": "8", "properties": {"contacts": {"kind": "k"}}}), json.dumps(properties), " local"),
        (2, "{", None, '{"type": "U"}', "CENTRAL"),
        (3, None, "{", "", None),
    ]
    spark.createDataFrame([*table, table[0]], "edge_id bigint, source string, destination string, properties string, edgetype string").write.parquet(str(tmp_path / "edge.parquet"))
    return str(tmp_path)


def test_edges_endpoints_and_every_array_path_are_tables(spark, edge_table):
    got = {n: problems.QUERIES[n](spark, edge_table) for n in ("p3_edges", *problems.ENTITIES)}
    assert rows(got["p3_edges"].fillna("-"), "edge_id", "edgetype", "type", "source_id", "destination_id") == [(1, "Local", "T", "7", "8"), (2, "Central", "U", "-", "-"), (3, "-", "-", "-", "-")]
    assert rows(got["p3_source"], "edge_id", "id", "pid", "properties_label", "properties_name") == [(1, "7", "1", "Person", "Ann")]
    assert rows(got["p3_destination_contacts"], "edge_id", "arr_pos", "kind") == [(1, "0", "k")]
    assert rows(got["p3_source_affiliations"], "arr_pos", "org_id") == [("1", "5")]
    assert rows(got["p3_changes"], "at", "by_id") == [("1", "9")]
    assert rows(got["p3_evidence"], "f_doc") == [("d",)]
    assert {n: got[n].count() for n in ("p3_source_sites", "p3_source_roles", "p3_roles", "p3_spans", "p3_tags", "p3_measures")} == {"p3_source_sites": 1, "p3_source_roles": 1, "p3_roles": 1, "p3_spans": 2, "p3_tags": 1, "p3_measures": 1}
    for child, parent in (("p3_source_sites", "p3_source_affiliations"), ("p3_source_roles", "p3_source_affiliations"), ("p3_source_affiliations", "p3_source"), ("p3_spans", "p3_evidence"), ("p3_tags", "p3_changes"), ("p3_measures", "p3_changes")):
        nodes = set(rows(got[parent], "edge_id", "node"))
        assert set(rows(got[child], "edge_id", "owner")) <= nodes, child


def test_every_declared_array_has_its_table():
    declared = {(doc, path) for doc, paths in shred.EDGE_ARRAYS.items() for path in paths}
    assert {(doc, path) for doc, path, _ in problems.ENTITIES.values() if path} == declared


@needs_tables
def test_array_tables_hold_all_objects_of_p3_found(spark):
    found = {}
    for r in problems.p3_found(spark, D).collect():
        found.setdefault((r["side"], r["arr_path"]), set()).add((r["edge_id"], r["arr_pos"]))
    for name in ("p3_destination_roles", "p3_measures", "p3_evidence"):
        doc, path, _ = problems.ENTITIES[name]
        assert set(rows(problems.QUERIES[name](spark, D), "edge_id", "arr_pos")) == found[doc, path]


def test_every_user_has_an_ego_network(spark, tmp_path):
    users = [u for k in range(40) for u in (k, (k + 1) % 40, (k + 2) % 40)]
    events = [(i, i, u, "view") for i, u in enumerate(users)]
    spark.createDataFrame(events, "event_id bigint, ts bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    pairs = {(a, b) for x, y in zip(users, users[1:]) if x != y for a, b in ((x, y), (y, x))}
    n = {a: {y for x, y in pairs if x == a} for a, _ in pairs}
    want = {(a, a, w) for a in n for w in n[a]} | {(a, w, x) for a in n for w in n[a] for x in n[w] & n[a]}
    assert rows(graphs.QUERIES["ego_net"](spark, str(tmp_path)), "ego", "src", "dst") == sorted(want)
    assert len({e for e, _, _ in want}) == 40


@needs_tables
def test_all_parts_and_nations_are_matched(spark):
    import collections

    import pyarrow.parquet as pq

    lines = collections.Counter(pq.read_table(f"{D}/lineitem.parquet")["l_partkey"].to_pylist())
    assert rows(graphs.QUERIES["rel_uniqueness"](spark, D), "p", "n") == sorted((2 * 10**12 + p, n * (n - 1)) for p, n in lines.items() if n > 1)
    assert rows(graphs.QUERIES["merge_edges"](spark, D), "n", "k") == [(100 + i, 5) for i in range(25)]


def test_a_rarely_filled_metric_of_a_hot_place_gets_its_forest(spark):
    rng = random.Random(5)
    full = 20_000
    readings = [(i, i // 20, 1, rng.gauss(10, 1), rng.gauss(100, 2) if i % 100 == 0 else None) for i in range(1, full + 1)]
    readings[9_999] = (10_000, 500, 1, 10.0, 400.0)
    df = spark.createDataFrame(readings, "id bigint, run bigint, place int, m double, rare double")
    rules = spikes.Rules(limits={}, block=4096, sample=256, trees=16, psi=64)
    got = spikes.score_readings(df, "place", "run", ["m", "rare"], rules).where("metric = 'rare'").collect()
    assert len(got) == full // 100 and all(r["score"] > 0 for r in got)
    assert {r["id"] for r in got if r["isolated"]} == {10_000}


def test_seasonal_medians_are_of_all_readings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(spikes, "materialize", lambda df, label="step": seen.append((label, df)) or df)
    df = spark.createDataFrame([(i, i // 20, 1, float(i % 20 * 1000 + i // 20)) for i in range(2_000)], "id bigint, run bigint, place int, m double")
    spikes.score_readings(df, "place", "run", ["m"], spikes.Rules(limits={}, sample=64))
    (stats,) = [d.collect() for label, d in seen if label == "stats"]
    assert {u["s"]: u["m0"] for u in stats[0]["season"]} == {s: s * 1000 + 49.0 for s in range(20)}


@needs_tables
def test_pagerank_makes_the_ten_default_rounds(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = dict(con.execute(graphs._pagerank_sql(10)).fetchall())
    got = dict(rows(graphs.QUERIES["pagerank_purchases"](spark, D), "id", "rank"))
    assert got == pytest.approx(want, abs=2e-9) and want != pytest.approx(dict(con.execute(graphs._pagerank_sql(5)).fetchall()), abs=2e-9)


@needs_tables
def test_line_items_of_several_files_keep_their_numbers(spark, tmp_path):
    import pyarrow.parquet as pq

    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        spark.createDataFrame(pq.read_table(f"{D}/{t}.parquet").slice(0, 50).to_pandas()).write.parquet(str(tmp_path / f"{t}.parquet"))
    lines = pq.read_table(f"{D}/lineitem.parquet").slice(0, 900).to_pandas()
    spark.createDataFrame(lines).repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    g = graphs.star_graph(spark, str(tmp_path))
    all_ = g.edges.where("type = 'CONTAINS'").select("eid", "dst", "quantity")
    assert all_.select("eid").distinct().count() == 900
    some = g.edges.where("type = 'CONTAINS' and quantity > 20").select("eid", "dst", "quantity")
    assert some.join(all_, ["eid", "dst", "quantity"]).count() == some.count() > 0
