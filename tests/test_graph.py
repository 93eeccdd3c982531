"""Algorithms, sources, streaming and the catalog against brute force and known graphs."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.algorithms import degrees, learning, pagerank, partitioning, triangles
from graphloom.graph import Graph
from graphloom.sources import edges as sources
from graphloom.sources.catalog import Catalog, calibrated_sla
from graphloom.streaming import ingest

#: folder with the public sample graphs powergrid.dl and cora.cites
DATA = os.environ.get("GRAPHLOOM_SAMPLES", "")


def graph(spark, pairs, directed=False, more=()):
    g = Graph.of_edges(spark.createDataFrame(pairs, "src bigint, dst bigint"), directed)
    if more:
        g = Graph(g.vertices.unionByName(spark.createDataFrame([(i, None) for i in more], "id bigint, label string")), g.edges, directed)
    return g


def brute_triangles(pairs):
    n = {}
    for a, b in pairs:
        if a != b:
            n.setdefault(a, set()).add(b)
            n.setdefault(b, set()).add(a)
    return {tuple(sorted((a, b, c))) for a in n for b, c in itertools.combinations(n[a], 2) if c in n[b]}


def random_pairs(seed, n=25, m=90):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n) if rng.random() < 0.7 else 0) for _ in range(m)]


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (1, 2), (2, 1)], list(itertools.combinations(range(4), 2)), [(0, i) for i in range(1, 30)], random_pairs(1), random_pairs(2)])
def test_triangles(spark, pairs):
    g = graph(spark, pairs)
    want = brute_triangles(pairs)
    assert {tuple(r) for r in triangles.triangles(g).collect()} == want
    assert triangles.triangle_count(g).first()[0] == len(want)
    per = {r["id"]: r["triangles"] for r in triangles.triangles_per_vertex(g).collect()}
    assert per == {v: sum(v in t for t in want) for v in {x for t in want for x in t}}


def test_degrees_and_ego_nets(spark):
    pairs = random_pairs(3)
    g = graph(spark, pairs, True)
    e = set(pairs)
    assert {tuple(r) for r in degrees.out_degrees(g).collect()} == {(a, len({y for x, y in e if x == a})) for a, _ in e}
    assert {tuple(r) for r in degrees.in_degrees(g).collect()} == {(b, len({x for x, y in e if y == b})) for _, b in e}
    n = {a: {y for x, y in e if x == a and y != a} for a, _ in e}
    want = {(a, a, w) for a in n for w in n[a]} | {(a, w, x) for a in n for w in n[a] for x in n.get(w, ()) if x in n[a]}
    assert {tuple(r) for r in degrees.ego_net(g).collect()} == want
    one = degrees.ego_net(g, spark.createDataFrame([(0,)], "id bigint"))
    assert {tuple(r) for r in one.collect()} == {t for t in want if t[0] == 0}


def test_pagerank(spark):
    pairs = random_pairs(4)
    g = graph(spark, pairs, True, more=(100,))
    e = set(pairs)
    ids = {x for p in pairs for x in p} | {100}
    out = {i: [b for a, b in e if a == i] for i in ids}
    r = {i: 1 / len(ids) for i in ids}
    for _ in range(6):
        loose = sum(r[i] for i in ids if not out[i])
        r = {i: 0.15 / len(ids) + 0.85 * (sum(r[j] / len(out[j]) for j in ids if i in out[j]) + loose / len(ids)) for i in ids}
    got = {x["id"]: x["rank"] for x in pagerank.pagerank(g, 0.85, 6).collect()}
    assert got == pytest.approx(r) and sum(got.values()) == pytest.approx(1)
    assert pagerank.pagerank(graph(spark, [], True)).count() == 0
    for bad in ({"alpha": 1.0}, {"iterations": 0}):
        with pytest.raises(ValueError):
            pagerank.pagerank(g, **bad)


def test_partition_quality(spark):
    pairs = [(0, 2), (0, 1), (1, 3), (2, 4), (5, 6)]
    got = {r["part"]: (r["vertices"], r["local_edges"], r["cut_edges"], r["cut_ratio"]) for r in partitioning.partition_stats(graph(spark, pairs), 2).collect()}
    assert got == {0: (4, 2, 1, pytest.approx(1 / 3)), 1: (3, 1, 1, 0.5)}
    assert [partitioning.automatic_count(x) for x in (0, 6594, 10**8)] == [2, 2, 7]


@pytest.mark.parametrize("method,want", [("LDG", {0: 0, 1: 1, 2: 0, 3: 1}), ("FENNEL", {0: 0, 1: 0, 2: 0, 3: 0})])
def test_stream_partitioners(spark, method, want):
    assert partitioning.stream_place([(0, 1), (0, 2), (1, 3)], 2, method, 4, 3) == want
    stream = [(10 * k + a, 10 * k + b) for k in range(4) for a, b in itertools.combinations(range(6), 2)]
    g = graph(spark, stream)
    placed = partitioning.stream_partition(g, 2, method)
    assert placed.count() == 24 and placed.where("part not in (0, 1)").count() == 0
    assert sum(r["vertices"] for r in partitioning.stats(g, placed).collect()) == 24
    with pytest.raises(ValueError):
        partitioning.stream_place(stream, 2, "METIS", 24, 60)


def test_learning_helpers(spark):
    u = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [4.0, None], 2), (2, [1.0], 0)], "r int, w array<double>, n int")
    assert sorted(map(tuple, learning.fed_avg(u, "r", "w", "n").collect())) == [(1, 0, 3.0), (1, 1, 2.0)]
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, learning.training_frame([a, b], "k").collect())) == [(1, "a"), (2, "c")]
    assert learning.training_memory_gb(1) == pytest.approx(5.6)
    assert learning.pack({1: 3, 2: 2, 3: 9}, {"x": 3, "y": 4}) == {"x": [1], "y": [2]}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id bigint, features array<double>")
    g = Graph(v, spark.createDataFrame([(1, 1, 2, "T"), (2, 1, 3, "T")], "eid bigint, src bigint, dst bigint, type string"))
    assert sorted(map(tuple, learning.link_scores(g).collect())) == [(1, 2, 1.0), (1, 3, None)]


# --- sources


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_edge_lists(spark, tmp_path):
    p = put(tmp_path, "e.dl", "1 2\n3,4\n5\t6\n\nbad\n7 x\n1 2 3\n  8   9 \n")
    assert sorted(map(tuple, sources.read_edge_list(spark, p).collect())) == [(1, 2), (3, 4), (5, 6), (8, 9)]
    assert sorted(r[0] for r in sources.bad_lines(spark, p).collect()) == ["1 2 3", "7 x", "bad"]
    e, numbers = sources.renumber(spark.createDataFrame([(35, 1155073), (1155073, 40)], "src bigint, dst bigint"))
    assert {tuple(r) for r in numbers.collect()} == {(35, 0), (40, 1), (1155073, 2)}
    assert {(r["src"], r["dst"]) for r in e.collect()} == {(0, 2), (2, 1)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample graphs are not there")
@pytest.mark.parametrize("file,vertices,edges,pairs,count", [("powergrid.dl", 4941, 6594, 6594, 651), ("cora.cites", 2708, 5429, 5278, 1630)])
def test_known_graphs(spark, file, vertices, edges, pairs, count):
    g = sources.edge_list_graph(spark, f"{DATA}/{file}")
    assert (g.vertex_count().first()[0], g.edge_count().first()[0], g.undirected_pairs().count()) == (vertices, edges, pairs)
    assert triangles.triangle_count(g).first()[0] == count
    assert g.keyed().edges.select("eid").distinct().count() == edges


def messages():
    v = lambda i, **p: {"id": str(i), "properties": {"id": str(i)} | p}
    return [{"source": v(1, label="Person", name="Bob"), "destination": v(2, label="City"), "properties": {"type": "LIVES_IN", "since": "2019"}}, {"source": v(1), "destination": v(3), "properties": {}}]


def test_edge_json(spark, tmp_path):
    lines = [json.dumps(m) for m in messages()] + ["{broken", "-1", '{"source": {}}']
    g = sources.edge_json_graph(spark, put(tmp_path, "g.json", "\n".join(lines)))
    assert sorted((r["src"], r["dst"], r["type"]) for r in g.edges.collect()) == [(1, 2, "LIVES_IN"), (1, 3, "DEFAULT")]
    got = {r["id"]: (r["label"], (r["props"] or {}).get("name")) for r in g.vertices.collect()}
    assert got == {1: ("Person", "Bob"), 2: ("City", None), 3: (None, None)}


RDF = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:akt="a" xmlns:akts="s">
<akt:Article-Reference><akt:has-author><akt:Person><akt:full-name>Ann A</akt:full-name></akt:Person></akt:has-author>
<akt:has-author><akt:Person><akt:full-name>Bob B</akt:full-name></akt:Person></akt:has-author>
<akt:has-title>On X</akt:has-title><akts:year-of>2001</akts:year-of></akt:Article-Reference>
<akt:Article-Reference><akt:has-author><akt:Person><akt:full-name>Ann A</akt:full-name></akt:Person></akt:has-author>
<akt:has-title>On Y</akt:has-title></akt:Article-Reference>
</rdf:RDF>"""


def test_rdf_and_triples(spark, tmp_path):
    r = sources.read_rdf(spark, put(tmp_path, "b.rdf", RDF))
    assert sorted((x["title"], x["year"], sorted(x["authors"])) for x in r.collect()) == [("On X", "2001", ["Ann A", "Bob B"]), ("On Y", None, ["Ann A"])]
    g = sources.coauthor_graph(r)
    assert sorted(x["name"] for x in g.vertices.collect()) == ["Ann A", "Bob B"] and g.edges.count() == 1
    t = sources.read_triples(spark, put(tmp_path, "t.tsv", "a\tknows b\nb\tknows c \nbad\n"))
    assert sorted(map(tuple, t.collect())) == [("a", "knows", "b"), ("b", "knows", "c")]
    assert sources.triples_graph(t).vertices.count() == 3


def test_citations_and_attributes(spark, tmp_path):
    rows = [{"id": "a", "references": ["b", "b"], "fos": [{"name": "x", "w": 0.7}, {"name": "y", "w": 0.2}]}, {"id": "b", "fos": [{"name": "x", "w": 0.9}, {"name": "z", "w": 0.8}]}, {"fos": []}]
    p = sources.read_citations(spark, put(tmp_path, "c.json", "\n".join(map(json.dumps, rows))))
    assert [tuple(r) for r in sources.citation_edges(p).collect()] == [("a", "b")]
    assert {r["id"]: list(r["features"]) for r in sources.one_hot(p, above=0).collect()} == {"a": [1, 0], "b": [1, 1]}
    assert {r["id"]: list(r["features"]) for r in sources.one_hot(p, above=1).collect()} == {"a": [1], "b": [1]}
    a = sources.read_attributes(spark, put(tmp_path, "a.txt", "1 5 300\n2\t7,x\n"))
    assert a.schema["features"].dataType.simpleString() == "array<smallint>"
    assert {r["id"]: list(r["features"]) for r in a.collect()} == {1: [5, 300], 2: [7, None]}
    assert [sources.infer_dtype(v) for v in (["1"], ["40000"], ["1.5"])] == ["int8", "int32", "float"]
    g = sources.with_attributes(graph(spark, [(1, 2)]), a)
    assert g.vertices.where("features is not null").count() == 2


def test_catalog_and_sinks(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    assert c.rows().count() == 0
    i = c.add("g", graph(spark, [(1, 2), (2, 3)]))
    assert c.get(i).edges.count() == 2 and c.listing().first()[0].startswith(f"|{i}|g|")
    c.remove(i)
    assert c.rows().count() == 0
    with pytest.raises(KeyError):
        c.get(i)
    sources.write_pairs(spark.createDataFrame([(1, 2)], "a int, b int"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first()[0] == "1\t2"
    m = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (1, 99.0, 4)], "k int, v double, attempt int")
    assert calibrated_sla(m, ["k"], "v", "attempt").first()["sla_value"] == 15


# --- streaming


@pytest.mark.parametrize("seed", [5, 6])
def test_incremental_triangles_equal_a_recount(spark, tmp_path, seed):
    pairs = random_pairs(seed, 12, 40)
    rng = random.Random(seed)
    batches = [[] for _ in range(3)]
    for p in pairs:
        batches[rng.randrange(3)].append(p)
    counter = ingest.TriangleCounter(spark, f"file://{tmp_path}/state")
    seen = []
    for i, b in enumerate(batches):
        seen += b
        df = spark.createDataFrame(b, "src bigint, dst bigint")
        assert counter.add(df, i) == len(brute_triangles(seen))
        assert counter.add(df, i) == len(brute_triangles(seen))  # a batch that is run again changes nothing
    assert counter.total() == len(brute_triangles(pairs))


@pytest.mark.parametrize("part", [2_000_000, 40, 6])
def test_triangle_delta_of_many_colours(spark, part):
    pairs = sorted({(min(p), max(p)) for p in random_pairs(7, 30, 250) if p[0] != p[1]})
    old, new = pairs[::2], pairs[1::2]
    got = ingest.triangle_delta(*(spark.createDataFrame(x, ingest.PAIRS) for x in (old, new)), part)
    assert got.first()[0] == len(brute_triangles(pairs)) - len(brute_triangles(old)) > 0


def test_triangle_delta_shuffles_no_wedges(spark):
    """100 hubs share 400 leaves: 4 million wedges of new pairs, of which 300 close."""
    new = spark.range(400).crossJoin(spark.range(10_000, 10_100).withColumnRenamed("id", "b")).select(F.col("id").alias("a"), "b")
    old = spark.createDataFrame([(0, 1), (2, 3), (4, 5)], ingest.PAIRS)
    sc = spark.sparkContext
    sc.setJobGroup("delta", "delta")
    assert ingest.triangle_delta(old, new).first()[0] == 300
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("delta") for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    assert 40_000 <= sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 1_000_000


def test_stream_of_messages(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda a, b: json.dumps({"source": {"id": str(a)}, "destination": {"id": str(b)}, "properties": {}})
    counter = ingest.TriangleCounter(spark, f"file://{tmp_path}/state")
    for n, part in enumerate([[(1, 2), (2, 3)], [(3, 1), (1, 2)]]):
        (folder / f"{n}.txt").write_text("\n".join([line(*p) for p in part] + ["-1", "junk"]))
        q = counter.start(ingest.stream_edges(ingest.read_stream(spark, str(folder))), f"file://{tmp_path}/check", availableNow=True)
        q.awaitTermination()
        assert counter.total() == n
    q = ingest.append_edges(ingest.stream_edges(ingest.read_stream(spark, str(folder))), f"file://{tmp_path}/edges", f"file://{tmp_path}/check2", availableNow=True)
    q.awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/edges").count() == 3


def test_appended_files_are_in_order_and_hold_no_repeats(spark, tmp_path):
    import pyarrow.parquet as pq

    (tmp_path / "in").mkdir()
    want = [(a, b) for a in range(60) for b in range(100, 120)]
    for n in range(4):
        part = want[n * 200 : n * 200 + 600]  # what a file says again was in the one before
        random.Random(n).shuffle(part)
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(json.dumps({"source": {"id": str(a)}, "destination": {"id": str(b)}}) for a, b in part))
    for run in range(2):
        lines = ingest.read_stream(spark, str(tmp_path / "in"), options={"maxFilesPerTrigger": "1"})
        ingest.append_edges(ingest.stream_edges(lines), f"file://{tmp_path}/edges", f"file://{tmp_path}/check{run}", availableNow=True).awaitTermination()
    files = [list(zip(t["src"].to_pylist(), t["dst"].to_pylist())) for f in (tmp_path / "edges").rglob("*.parquet") if (t := pq.ParquetFile(f).read()).num_rows]
    assert sorted(x for f in files for x in f) == want and all(f == sorted(f) for f in files)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stream_messages_come_in_parts(spark, monkeypatch):
    from graphloom.queries import sources as queries

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "MESSAGES", 20)
    lines = [[r["value"] for r in spark.read.text(files).where("value like '{%'").collect()] for files in queries._stream_files(spark, d, 20)]
    assert len(lines) > 2 and max(map(len, lines)) <= 40
    each = sorted((int(m["source"]["id"]), int(m["destination"]["id"])) for part in lines for m in map(json.loads, part))
    got = sorted((r["src"], r["dst"]) for r in queries.stream_append(spark, d).collect())
    assert got == sorted(set(each)) and queries.stream_triangles(spark, d).first()[0] == len(brute_triangles(each))


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a"), (None, "a")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r["n"] for r in ingest.windowed_counts(e, "t", "k").collect()) == [1, 2]


def test_validity(spark):
    g = graph(spark, [(1, 2)])
    assert g.valid().count() == 0
    assert Graph(g.vertices.where("id = 1"), g.edges).valid().count() == 1


# --- the rest


def test_a_graph_with_the_counts_of_the_power_grid(spark, tmp_path):
    """4,941 vertices, 6,594 edges, 651 triangles: a path, 651 chords over two of its edges, far chords for the rest."""
    n, m, t = 4941, 6594, 651
    pairs = [(i, i + 1) for i in range(n - 1)] + [(4 * i, 4 * i + 2) for i in range(t)]
    pairs += [(i, i + 2000) for i in range(m - len(pairs))]
    g = sources.edge_list_graph(spark, put(tmp_path, "grid.dl", "\n".join(f"{a} {b}" for a, b in pairs)))
    assert (g.vertex_count().first()[0], g.edge_count().first()[0], triangles.triangle_count(g).first()[0]) == (n, m, t)
    from graphloom.cypher.compiler import cypher

    assert cypher(g, "MATCH (n) WHERE n.id < 10 RETURN avg(n.id) AS a").first()[0] == 4.5
    keyed = g.keyed()
    assert keyed.keyed() is keyed and keyed.edges.select("eid").distinct().count() == m


def test_equal_edges_have_numbers_of_their_own(spark):
    g = graph(spark, [(1, 2)] * 5000 + [(2, 1)] * 3).keyed()
    assert g.edges.select("eid").distinct().count() == 5003
    a, b = g.edges, g.edges.select("src", "dst", "eid").repartition(7)
    assert a.join(b, ["src", "dst", "eid"]).count() == 5003  # every reading sees the same numbers


@pytest.mark.parametrize("method", ["LDG", "FENNEL"])
@pytest.mark.parametrize("streams", [1, 3, 8])
def test_streams_keep_the_balance(spark, method, streams):
    pairs = [p for p in random_pairs(8, 160, 900) if p[0] != p[1]]
    g = graph(spark, pairs)
    placed = {r["id"]: r["part"] for r in partitioning.stream_partition(g, 4, method, streams).collect()}
    sizes = [list(placed.values()).count(i) for i in range(4)]
    assert set(placed) == {x for p in pairs for x in p} and min(sizes) > 0
    if method == "LDG":
        assert max(sizes) <= len(placed) / 4 + streams


def test_followers_over_partition_borders(spark):
    from graphloom.runtime import followed

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i // 3, i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, t int, i int, v int").repartition(5)
    got = {r["i"]: r["nx"] for r in followed(df, "g", ["t", "i"], "v", "nx").collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((t, i, v) for k, t, i, v in rows if k == g)
        want |= {a[1]: b[2] if b else None for a, b in itertools.zip_longest(own, own[1:])}
    assert got == want
    assert followed(df.limit(0), "g", ["t", "i"], "v", "nx").count() == 0


def test_pagerank_reads_one_round_at_a_time(spark):
    g = graph(spark, random_pairs(4), True)
    size = [len(pagerank.pagerank(g, 0.85, n)._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 9)]
    assert size[1] < 1.2 * size[0]


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    from types import SimpleNamespace

    from graphloom import runtime

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None))

    for master in ("yarn", "spark://h:7077", "k8s://x", "localhost"):
        with pytest.raises(ValueError):
            runtime.shared_dir(session(master))
        assert runtime.shared_dir(session(master, "s3a://b/x")) == "s3a://b/x"
    assert runtime.shared_dir(session("local[3]")).startswith("file:")
    with runtime.scratch():
        path = runtime.materialize(spark.range(3)).inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://"))


def test_catalog_append_and_models(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    i = c.add("g", graph(spark, [(1, 2), (2, 3)]))
    c.append(i, graph(spark, [(3, 4), (1, 2)]))
    row = c.rows().first()
    assert (row["vertexcount"], row["edgecount"]) == (4, 4) == (c.get(i).vertices.count(), c.get(i).edges.select("eid").distinct().count())
    with pytest.raises(ValueError):
        c.append(i, Graph.of_edges(spark.createDataFrame([(1, 2, 5)], "src bigint, dst bigint, weight int")))
    m = c.add_model("net", f"file://{put(tmp_path, 'net.bin', 'abc')}")
    assert [tuple(r)[:2] + (r["bytes"],) for r in c.models().collect()] == [(m, "net", 3)]
    assert (tmp_path / "cat" / "models" / str(m) / "net.bin").read_text() == "abc"


def test_jobs_start_by_priority(spark):
    from graphloom.jobs import JobQueue

    q, seen = JobQueue(spark, workers=1), []
    waiting = [q.submit(lambda s, p=p: (seen.append(p), s.sparkContext.getLocalProperty("spark.scheduler.pool"), s.range(3).count())[1:], p) for p in (1, 9, 2, 1)]
    failed = q.submit(lambda s: 1 / 0)
    q.start()
    assert [f.result(60) for f in waiting] == [("low", 3), ("high", 3), ("high", 3), ("low", 3)]
    assert seen == [9, 2, 1, 1] and isinstance(failed.exception(60), ZeroDivisionError)
    q.stop()
    for bad in (0, True, "high"):
        with pytest.raises(ValueError):
            q.submit(len, bad)


def test_stream_metrics(spark, tmp_path):
    from graphloom.streaming.metrics import Metrics, exposition

    assert exposition({"rows": 3.0}, {"query": 'a"b'}).endswith('stream_rows{query="a\\"b"} 3\n')
    texts = []
    listener = Metrics(texts.append)
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "0.txt").write_text("a\nb\n")
        q = spark.readStream.text(str(tmp_path / "in")).writeStream.format("noop").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if texts:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert any('stream_rows{query="lines"} 2' in t for t in texts)


def test_node_messages_keep_their_properties(spark, tmp_path):
    lone = {"isNode": True, "id": "7", "pid": 1, "properties": {"id": "7", "label": "Person", "name": "Ann"}}
    g = sources.edge_json_graph(spark, put(tmp_path, "n.json", json.dumps(lone) + "\n" + json.dumps(messages()[1])))
    assert {r["id"]: r["label"] for r in g.vertices.collect()} == {7: "Person", 1: None, 3: None}


def test_intersection(spark):
    from graphloom.operators.sets import intersection

    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([("x", 1), ("x", 1), ("x", 1), ("y", None)], "v string, k int")
    assert sorted(map(tuple, intersection(a, b).collect()), key=repr) == [(1, "x"), (None, "y")]
    assert intersection(a, b, True).count() == 3 and intersection(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        intersection(a, b.withColumnRenamed("k", "n"))
