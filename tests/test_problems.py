"""Operators of the general data problems against hand-made cases and brute force."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import readable
from graphloom.operators import references, shred, skew, spikes, widen
from graphloom.runtime import salted_join

RULES = spikes.Rules(limits={"m": (0.0, 1e6)}, block=64, sample=512, trees=16, psi=64)


def readings(spark, rows):
    return spark.createDataFrame(rows, "id bigint, run bigint, place int, m double, score string")


def flagged(spark, rows, rules=RULES):
    out = spikes.score_readings(readings(spark, rows), "place", "run", ["m"], rules)
    return {r["id"]: (r["impossible"], r["stuck"], r["isolated"]) for r in out.collect()}


def two_places(n=600):
    rng = random.Random(3)
    rows = []
    for i in range(1, n + 1):
        place = 1 if i % 3 else 2
        level = rng.gauss(100, 2) if place == 1 else rng.choice([10.0, 50.0]) + rng.gauss(0, 1)
        rows.append([i, i // 20, place, level, "x"])
    return rows


def test_spikes_limits_and_levels(spark):
    rows = two_places()
    rows[100][3], rows[200][3], rows[300][3], rows[400][3] = 150.0, -5.0, 2e6, None
    rows[10][3] = float("nan")
    got = flagged(spark, rows)
    assert got[101][2] and got[201][0] and got[301][0] and 401 not in got and 11 not in got
    assert {i for i, f in got.items() if any(f)} == {101, 201, 301}


def test_stuck_runs_also_across_blocks_and_not_shorter(spark):
    rows = two_places()
    ones = [r for r in rows if r[2] == 1]
    # ids of place 1 around the block border at 64 and 128; four equal values elsewhere
    run = [r for r in ones if 57 <= r[0] <= 70][:6]
    for r in run:
        r[3] = 101.0
    for r in [r for r in ones if r[0] > 300][:4]:
        r[3] = 99.0
    long = [r for r in ones if 100 <= r[0] <= 280]
    for r in long:
        r[3] = 98.0
    got = flagged(spark, rows)
    assert {i for i, f in got.items() if f[1]} == {r[0] for r in run + long}


def test_repeats_count_once_and_small_or_empty_sources(spark):
    rows = [[1, 1, 1, 5.0, "x"]] * 6 + [[2, 1, 1, 5.0, "x"], [3, 1, None, 5.0, "x"], [None, 1, 1, 5.0, "x"]]
    assert flagged(spark, rows) == {1: (False, False, False), 2: (False, False, False)}
    assert flagged(spark, []) == {}


def test_a_source_with_a_third_of_rows_and_ties(spark):
    rows = [[i, 1, 1, 7.0 + (i % 2), "x"] for i in range(1, 400)] + [[1000, 1, 1, 90.0, "x"]]
    assert {i for i, f in flagged(spark, rows).items() if any(f)} == {1000}


def test_isolation_forest_scores_far_points_higher():
    import numpy as np

    rng = np.random.default_rng(0)
    p = rng.normal(0, 1, (500, 4)).astype(np.float32)
    f = spikes.grow(p, 64, 128, 1)
    far = spikes.anomaly_score(f, np.array([[7, 7, 7, 7]], np.float32))[0]
    assert far > 0.7 > np.median(spikes.anomaly_score(f, p))


def seasonal(n=3000):
    """A place whose first reading of each run of 12 is usually twenty spreads high, with two such elsewhere."""
    rng = random.Random(9)
    rows = [[i, i // 12, 1, rng.uniform(96, 104) + (80 if i % 12 == 0 else 0), "x"] for i in range(24, n)]
    rows[505][3] = rows[1711][3] = 181.0
    return rows, {rows[505][0], rows[1711][0]}


def test_the_forest_decides_and_not_the_distance(spark, monkeypatch):
    import numpy as np

    rows, odd = seasonal()
    got = spikes.score_readings(readings(spark, rows), "place", "run", ["m"], RULES).collect()
    assert {r["id"] for r in got if r["isolated"]} == odd
    assert len([r for r in got if abs(r["distance"]) >= RULES.far]) > 200  # the season's, which distance alone would flag
    model = spikes.fitted(np.array([r[3] for r in rows]), np.full(len(rows), np.nan), np.zeros(len(rows), np.int64), np.ones(len(rows)), np.linspace(95, 105, 99), np.full(32, np.nan), RULES, 1)
    args = (np.array([100.0, 113.0, 125.0]), np.full(3, np.nan), np.zeros(3, np.int64), np.ones(3), RULES)
    assert spikes.judged(model, *args)[2].tolist() == [False, False, True]
    flat = model | {"threshold": np.zeros_like(model["threshold"])}  # as if the forest had no say
    assert spikes.judged(flat, *args)[2].tolist() != spikes.judged(model, *args)[2].tolist()


@pytest.mark.parametrize("block,broadcast", [(64, 0), (64, 1 << 20), (500, 1 << 20)])
def test_results_do_not_depend_on_partitions_or_plan(spark, block, broadcast):
    rng = random.Random(12)
    rows = two_places() + [[i, i // 20, rng.choice([1, 3, None]), rng.choice([5.0, 5.0, None, float("nan"), rng.gauss(0, 1)]), "x"] for i in range(700, 1500)]
    for i in range(900, 1100):
        rows[i][2:4] = [3, 7.0]
    rules = {"limits": {}, "sample": 512, "trees": 16, "psi": 64}
    a = spikes.score_readings(readings(spark, rows), "place", "run", ["m"], spikes.Rules(**rules)).collect()
    b = spikes.score_readings(readings(spark, rows + rows[::3]), "place", "run", ["m"], spikes.Rules(block=block, broadcast=broadcast, **rules)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == len({r[0] for r in rows if r[2] is not None and r[3] is not None and r[3] == r[3]})
    assert max(r["run_length"] for r in a) >= 200


# --- nested records

DOC = {"id": 7, "properties": {"name": "n", "contacts": [{"kind": "a"}, None, {"kind": "b"}], "affiliations": {"org": {"sites": "[{\"city\": \"x\"}]"}, "roles": [{"title": "t"}, "{\"title\": \"u\"}", 5]}}}


def edges(spark, docs):
    return spark.createDataFrame([(i, d, None, "{}", "E") for i, d in enumerate(docs)], "edge_id bigint, source string, destination string, properties string, node string")


def objects(spark, *docs):
    for only in (True, False):
        nodes = shred.shred(edges(spark, docs), "edge_id", shred.EDGE_ARRAYS, only)
        got = sorted((r["edge_id"], r["arr_path"], r["arr_pos"]) for r in shred.array_objects(nodes, "edge_id").collect())
        if only:
            first = got
    assert first == got
    return got


A = "properties.affiliations"


def test_shred_forms(spark):
    want = [(0, A, "0"), (0, A + ".org.sites", "0.0"), (0, A + ".roles", "0.0"), (0, A + ".roles", "0.1"), (0, "properties.contacts", "0"), (0, "properties.contacts", "2")]
    assert objects(spark, json.dumps(DOC)) == want
    assert objects(spark, json.dumps(json.dumps(DOC))) == want
    assert objects(spark, json.dumps({"properties": json.dumps(DOC["properties"])})) == want


def test_shred_damage_and_nulls(spark):
    good = json.dumps(DOC)
    assert objects(spark, good[:-3], None, "", "null", "[]", "5", '"x"', good + "}", '{"properties": {"contacts": NaN}}', '{"properties": null}') == []
    assert objects(spark, '{"properties": {"contacts": "[{]"}}', '{"properties": {"contacts": [[{"kind": 1}]]}}') == []
    deep = '{"properties":{"contacts":[' + ",".join(['{"kind":"k"}'] * 5000) + "]}}"
    assert len(objects(spark, deep)) == 5000


def test_entity_tables_keep_links(spark):
    nodes = shred.shred(edges(spark, [json.dumps(DOC), '{"id": "x"}']), "edge_id", shred.EDGE_ARRAYS)
    roles = shred.entity_table(nodes, "edge_id", "source", A + ".roles", ["title", "node"]).collect()
    assert sorted((r["edge_id"], r["parent_pos"], r["arr_pos"], r["title"]) for r in roles) == [(0, "0", "0.0", "t"), (0, "0", "0.1", "u")]
    assert "f_node" in roles[0].asDict()
    tops = shred.entity_table(nodes, "edge_id", "source", None, ["id"]).collect()
    assert sorted((r["edge_id"], r["id"]) for r in tops) == [(0, "7"), (1, "x")]
    parents = {(r["edge_id"], r["doc"], r["node"]) for r in nodes.collect()}
    assert all((r["edge_id"], r["doc"], r["parent"]) in parents for r in nodes.where("parent is not null").collect())
    assert shred.shred(edges(spark, []), "edge_id", shred.EDGE_ARRAYS).count() == 0


# --- attribute rows

VALUES = {
    "long": {"1,063": "1063", " 7 ": "7", "+95": "95", "1614.0": "1614", '"12"': "12", "12x": None, "1O4": None, "3-4": None, "": None, "null": None, "1,06": None, "1.5": None, "9" * 30: None, "-1,900": "-1900", "1e3": "1000"},
    "decimal": {"0.010": "0.01", "'-9.5'": "-9.50", "1,204.50": "1204.50", "1064492E-2": "10644.92", "29e-2": "0.29", "0.5.1": None, "12,3,4x": None, "high": None, "NaN?": None, ".5": "0.50", "3": "3.00"},
    "boolean": {"Y": "true", "off": "false", " true": "true", "1": "true", "0": "false", "2": None, "maybe": None, "tru e?": None, "?": None, "F": "false"},
    "date": {"2001-02-03": "2001-02-03", "1970/01/13": "1970-01-13", "20240229": "2024-02-29", "2023-02-29": None, "1982-4-1": "1982-04-01", "1970-05-12T07:15:00Z": "1970-05-12", "2024-10-25 00:00:00": "2024-10-25", "9 Mar 1974": "1974-03-09", "May 4, 1998": "1998-05-04", "31 Foo 2011": None, "0000-00-00": None, "2023-13-45": None, "03/04/2001": None, "soon": None, "september 9, 2001": "2001-09-09"},
    "string": {"\t LIVES_IN  ": "LIVES_IN", "   ": None, "": None, "a b": "a b", " x​": "x"},
}


@pytest.mark.parametrize("kind", VALUES)
def test_readable_values(spark, kind):
    rows = [(v,) for v in [*VALUES[kind], None]]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "v string").select("v", readable.canonical_text(F.col("v"), kind)).collect()}
    assert got == VALUES[kind] | {None: None}


def test_numbers_are_not_rounded_on_the_way(spark):
    rows = {"0.0049999996": ("0.00", None), "0.005": ("0.01", None), "-0.005": ("-0.01", None), "3.0000001": ("3.00", None), "3.0000000": ("3.00", "3"), "123456789012345678.994999": ("123456789012345678.99", None), "-1,234.5e1": ("-12345.00", "-12345"), "12e-3": ("0.01", None), "1200e-2": ("12.00", "12"), "5E0": ("5.00", "5"), "1e999": (None, None), "1e-999": ("0.00", None), "9223372036854775807": (None, "9223372036854775807"), "9223372036854775808": (None, None), "-.5e1": ("-5.00", "-5"), ".": (None, None), "-": (None, None), "e5": (None, None), "1,2": (None, None), "0e5": ("0.00", "0"), "'7'": ("7.00", "7"), "''": (None, None), "'": (None, None)}
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = {r[0]: (r[1], r[2]) for r in df.select("v", readable.canonical_text(F.col("v"), "decimal"), readable.canonical_text(F.col("v"), "long")).collect()}
    assert got == rows


def cells(spark, rows):
    x = spark.createDataFrame(rows, "link_id bigint, entity_kind string, entity_id string, attr string, val string, loaded_at timestamp, __attr2 string")
    types = spark.createDataFrame([("e", "entity_id", "string"), ("e", "birth_year", "long"), ("e", "seen_on", "date")], "entity_kind string, attr string, val_type string")
    return widen.typed_cells(x, types, ["entity_kind", "entity_id"], "attr", "val", "loaded_at", "link_id", "entity_kind")


def test_widen_latest_readable_value(spark):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 9)]
    rows = [
        (1, "e", "1", "Birth-Year", "1950", t[0], ""), (2, "e", "1", "birthYear", "1951", t[2], ""), (3, "e", "1", "BIRTH YEAR", "many", t[5], ""), (2, "e", "1", "birthYear", "1951", t[2], ""),
        (4, "e", "1", "unknown", "5", t[5], ""), (5, "e", "2", "seen.on", "May 4, 1998", t[1], ""), (6, "e", "2", "seen_on", "1999-01-01", t[1], ""),
        (7, "f", "2", "seen_on", "1999-01-01", t[1], ""), (8, "e", None, "seen_on", "1999-01-01", t[1], ""), (9, "e", "3", None, "x", t[1], ""), (10, "e", "4", "entity id", "x", None, ""),
    ]
    columns = [("birth_year", "long"), ("seen_on", "date"), ("entity_id", "string")]
    wide = widen.widen(cells(spark, rows), ["entity_kind", "entity_id"], columns)
    got = {r["entity_id"]: (r["birth_year"], r["seen_on"], r["a_entity_id"]) for r in wide.collect()}
    assert got == {"1": (1951, None, None), "2": (None, datetime.date(1999, 1, 1), None), "4": (None, None, "x")}
    assert sorted(tuple(r) for r in widen.cells_of(wide, ["entity_kind", "entity_id"], columns).collect()) == [("e", "1", "birth_year", "1951"), ("e", "2", "seen_on", "1999-01-01"), ("e", "4", "entity_id", "x")]
    assert widen.widen(cells(spark, []), ["entity_kind", "entity_id"], columns).count() == 0


def test_widen_of_several_kinds_is_one_pass(spark):
    t = datetime.datetime(2024, 1, 1)
    x = cells(spark, [(1, "e", "1", "birth_year", "5", t, ""), (2, "e", "1", "seen_on", "1999-01-01", t, ""), (3, "e", "2", "birth_year", "6", None, "")])
    x = x.unionByName(x.withColumn("entity_kind", F.lit("f")))
    both = widen.widen_kinds(x, ["entity_kind", "entity_id"], "entity_kind", {"e": [("birth_year", "long")], "f": [("seen_on", "date"), ("birth_year", "long")], "g": [("seen_on", "date")]})
    assert sorted(map(tuple, both["e"].collect())) == [("e", "1", 5), ("e", "2", 6)]
    assert sorted(map(tuple, both["f"].collect()), key=repr) == [("f", "1", datetime.date(1999, 1, 1), 5), ("f", "2", None, 6)]
    assert both["g"].count() == 0


def test_widen_registers_merge_in_any_order():
    a, b = {0: (1, 1, "x"), 1: (5, 1, "p")}, {0: (2, 0, "y"), 2: (0, 0, "q")}
    want = {0: (2, 0, "y"), 1: (5, 1, "p"), 2: (0, 0, "q")}
    assert widen._merge(dict(a), dict(b)) == want == widen._merge(dict(b), dict(a))


# --- hot keys


def test_accumulate_equals_group_by(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", "", None]) if rng.random() < 0.3 else f"k{rng.randrange(50)}", rng.choice([None, float("nan"), rng.random()]), "clash") for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, x double, n string").repartition(7)
    got = {r["key"]: (r["n"], r["sum_x"], r["min_x"], r["max_x"]) for r in skew.accumulate(df, "key", ["x"], ["x"], ["x"]).collect()}
    want = {}
    for k, x, _ in rows:
        n, xs = want.setdefault(k, (0, []))
        want[k] = (n + 1, xs + [x] if x is not None and x == x else xs)
    assert set(got) == set(want)
    for k, (n, xs) in want.items():
        assert got[k][0] == n
        assert got[k][1:] == ((pytest.approx(sum(xs)), min(xs), max(xs)) if xs else (None, None, None))
    heavy = skew.heavy_keys(skew.accumulate(df, "key"), "key", 0.5).collect()
    assert [r["key"] for r in heavy] == ["hot"]
    assert skew.accumulate(df.limit(0), "key").count() == 0


@pytest.mark.parametrize("piece", [7, 1000, skew.PIECE])
def test_accumulate_keeps_whole_numbers_and_small_pieces(spark, piece):
    big = 2**53
    rows = [(f"k{i % 97}" if i % 5 else "hot", big + i, i % 3 or None) for i in range(4000)] + [(None, -big - 1, None)]
    df = spark.createDataFrame(rows, "key string, id bigint, few int").repartition(3)
    got = {r["key"]: tuple(r)[1:] for r in skew.accumulate(df, "key", ["few"], ["id"], ["id"], piece).collect()}
    want = {}
    for k, i, f in rows:
        n, fs, ids = want.setdefault(k, (0, [], []))
        want[k] = (n + 1, fs + [f] if f is not None else fs, ids + [i])
    assert got == {k: (n, sum(fs) if fs else None, min(ids), max(ids)) for k, (n, fs, ids) in want.items()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    left = spark.createDataFrame([(i, None if i % 11 == 0 else 1 if i % 2 else i % 7) for i in range(400)], "id int, k int")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (9, "w"), (None, "n")], "k int, v string")
    got = sorted(map(tuple, salted_join(left, right, "k", how, F.col("id"), share=0.1, salts=4).collect()), key=repr)
    assert got == sorted(map(tuple, left.join(right, "k", how).select(*salted_join(left, right, "k", how, F.col("id")).columns).collect()), key=repr)


# --- references


@pytest.mark.parametrize("match", references.MATCHES)
def test_null_masks(spark, match):
    child = spark.createDataFrame([(1, 1, 1, "r"), (2, 1, 9, "r"), (3, 1, None, "r"), (4, 8, None, "r"), (5, None, None, "r"), (6, None, 9, "r"), (2, 1, 9, "r")], "id int, a int, b int, __reason2 string")
    parent = spark.createDataFrame([(1, 1), (2, None), (None, 2)], "a int, b int")
    got = sorted((r["id"], r["__reason"]) for r in references.orphans(child, parent, [("a", "a"), ("b", "b")], "id", match).collect())
    want = {"simple": [(2, "missing")] * 2, "partial": [(2, "missing")] * 2 + [(4, "missing"), (6, "missing")], "full": [(2, "missing")] * 2 + [(3, "mixed_null"), (4, "mixed_null"), (6, "mixed_null")]}
    assert got == want[match]
    assert references.orphans(child.limit(0), parent, [("a", "a")], "id", match).count() == 0
    assert references.orphans(child, parent.limit(0), [("a", "a")], "id").count() == 5


def test_checked_reasons(spark):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 5)]
    child = spark.createDataFrame([(1, 1, t[1]), (2, 2, t[1]), (3, 3, t[1]), (4, 9, t[1]), (5, None, t[1]), (6, 1, None), (7, 4, t[1])], "id int, ref int, loaded_at timestamp")
    parent = spark.createDataFrame([(1, t[0], 1), (2, t[2], 1), (3, t[0], 3), (4, t[1], None)], "key int, loaded_at timestamp, status int")
    bad = references.checked(child, parent, ("ref", "key"), "id", deleted=F.coalesce(F.col("status") == 3, F.lit(False)))
    assert sorted((r["id"], r["__reason"]) for r in bad.collect()) == [(2, "late"), (3, "deleted"), (4, "missing")]


def test_shred_has_no_limit_of_wrapping_or_depth(spark):
    want = objects(spark, json.dumps(DOC))
    wrapped = json.dumps(DOC)
    for _ in range(17):  # each wrapping doubles the escapes
        wrapped = json.dumps(wrapped)
    assert objects(spark, wrapped) == want
    plain = '{"id": 7}'
    for _ in range(18):
        plain = json.dumps(plain)
    assert shred.parse(plain) == {"id": 7}
    deep = '{"x":' * 100_000 + '{"y":1}' + "}" * 100_000
    doc = '{"id": 5, "far": ' + deep + ', "properties": {"contacts": [{"kind": ' + deep + "}]}}"
    assert objects(spark, doc) == [(0, "properties.contacts", "0")]
    assert [r["id"] for r in shred.entities(edges(spark, [doc]), "edge_id", shred.EDGE_ARRAYS["source"], "source", None, ["id"]).collect()] == ["5"]
    assert objects(spark, doc[:-1], doc + "]") == []


def test_deep_reader_reads_as_the_plain_one():
    for text in ('{"a": [1, -2.5e3, "x\\u00e9\\n", {}, [], null, true, false, {"b": [[1], {"c": ""}]}], "a": 2, "": " "}', " [ ] ", "3", '"x"', "null", "-0", "1E5"):
        assert shred._load_deep(text) == json.loads(text) and str(shred._load_deep(text)) == str(json.loads(text))
    for bad in ("", "{", '{"a"}', '{"a":1,}', "[1,]", "[1 2]", "{} x", "01", "NaN", '"a', "{1:2}", "[1}", "tru", '"\n"', "+1", "-"):
        with pytest.raises(ValueError):
            shred._load_deep(bad)


@pytest.mark.parametrize("path,fields", [(None, ["id", "properties.name"]), ("properties.affiliations.roles", ["title", "node"]), ("properties.affiliations", ["org.sites"])])
def test_one_pass_entities_equal_joined_ones(spark, path, fields):
    df = edges(spark, [json.dumps(DOC), '{"id": "x"}', None, "{", json.dumps(DOC)])
    arrays = shred.EDGE_ARRAYS["source"]
    two = shred.entity_table(shred.shred(df, "edge_id", shred.EDGE_ARRAYS), "edge_id", "source", path, fields)
    one = shred.entities(df, "edge_id", arrays, "source", path, fields)
    assert one.columns == two.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) != []
    assert shred.entities(df.limit(0), "edge_id", arrays, "source", path, fields).count() == 0
