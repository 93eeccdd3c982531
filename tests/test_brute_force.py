"""Problem queries on whole small tables against independent plain-Python versions."""

import datetime
import decimal
import json
import os
import re

import numpy as np
import pytest

from graphloom.queries import problems

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def table(name):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{D}/{name}.parquet").to_pylist()
    return list({tuple(r.values()): r for r in rows}.values())


def result(spark, name):
    rows = [tuple(r) for r in problems.QUERIES[name](spark, D).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_p1(spark):
    want = set()
    rows = sorted(table("graph_place_sla_performance"), key=lambda r: r["id"])
    for m in problems.METRICS:
        for place in {r["place_id"] for r in rows}:
            own = [r for r in rows if r["place_id"] == place and r[m] is not None]
            x = np.array([r[m] for r in own], float)
            middle = np.median(x)
            spread = 1.4826 * np.median(abs(x - middle))
            turn = np.r_[True, x[1:] != x[:-1]].cumsum()
            stuck = np.bincount(turn)[turn] >= 5
            bad = (x < 0) | (abs(x - middle) > 6.5 * spread) | stuck
            want |= {(r["id"], m) for r, b in zip(own, bad) if b}
    assert result(spark, "p1_found") == want


def opened(v):
    while isinstance(v, str):
        try:
            inner = json.loads(v)
        except ValueError:
            return v
        if not isinstance(inner, (str, dict, list)):
            return v
        v = inner
    return v


def walk(found, edge, side, v, path, pos):
    v = opened(v)
    if path in problems.shred.EDGE_ARRAYS[side]:
        for i, x in enumerate([v] if isinstance(v, dict) else v if isinstance(v, list) else []):
            x = opened(x)
            if isinstance(x, dict):
                found.add((edge, side, path, ".".join(map(str, (*pos, i)))))
                for k, y in x.items():
                    walk(found, edge, side, y, f"{path}.{k}", (*pos, i))
    elif isinstance(v, dict):
        for k, y in v.items():
            walk(found, edge, side, y, f"{path}.{k}" if path else k, pos)


def test_p3(spark):
    want = set()
    for r in table("edge"):
        for side in problems.shred.EDGE_ARRAYS:
            top = opened(r[side])
            if isinstance(top, dict):
                walk(want, r["edge_id"], side, top, "", ())
    assert result(spark, "p3_found") == want


def read(v, kind):
    v = (v or "").strip()
    if kind == "string":
        return v or None
    if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
        v = v[1:-1].strip()
    if kind in ("long", "decimal"):
        if not re.fullmatch(r"[+-]?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?([eE][+-]?\d+)?", v):
            return None
        n = decimal.Decimal(v.replace(",", ""))
        return f"{n:.2f}" if kind == "decimal" else str(int(n)) if n == int(n) else None
    if kind == "boolean":
        return "true" if v.lower() in ("true", "t", "yes", "y", "on", "1") else "false" if v.lower() in ("false", "f", "no", "n", "off", "0") else None
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%d %b %Y", "%B %d, %Y", "%b %d, %Y"):
        try:
            return datetime.datetime.strptime(re.split(r"[T ](?=\d\d:)", v)[0], form).date().isoformat()
        except ValueError:
            pass
    return None


def test_p4(spark):
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    kinds = {(r["entity_kind"], key(r["attr"])): (r["attr"], r["val_type"]) for r in table("property_type")}
    best = {}
    for r in table("property_link"):
        known = kinds.get((r["entity_kind"], key(r["attr"])))
        value = read(r["val"], known[1]) if known else None
        if value is not None:
            cell = (r["entity_kind"], r["entity_id"], known[0])
            best[cell] = max(best.get(cell, (datetime.datetime.min, 0, "")), (r["loaded_at"], r["link_id"], value))
    assert result(spark, "p4_found") == {(*cell, b[2]) for cell, b in best.items()}


def test_p5(spark):
    want = set()
    for side in ("source", "destination"):
        ids = [str(top["id"]).strip() for r in table("edge") if isinstance(top := opened(r[side]), dict) and top.get("id") is not None]
        want |= {(side, i) for i in set(ids) if ids.count(i) >= 0.02 * len(ids)}
    assert result(spark, "p5_found") == want
