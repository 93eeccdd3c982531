"""Text queries on whole small tables against independent plain-Python versions."""

import os
import re
import unicodedata

import pyarrow.parquet as pq
import pytest

from graphloom.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")

# the look-alikes of the test tables, beside the Latin letters
LATIN = str.maketrans("аеорсухѕіјһԁАВЕЅІЈКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤοµ‐‑", "aeopcyxsijhdABESIJKMHOPCTXABEZHIKMNOPToμ--")
INVISIBLE = re.compile("[­​-‏⁠﻿]")


def look(text):
    text = INVISIBLE.sub("", text)
    text = "".join(unicodedata.normalize("NFKC", c) if 0xFF00 < ord(c) < 0xFF9E or 0xFB00 <= ord(c) <= 0xFB06 else c for c in text)
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(LATIN))
    return re.sub("[  -   　]", " ", text)


def documents():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{D}/documents.parquet").to_pylist()]


def test_p9(spark):
    by_look = {}
    for i, t in documents():
        if t:
            by_look.setdefault(look(t), []).append((i, t))
    want = {(min(a, b), max(a, b)) for same in by_look.values() for a, x in same for b, y in same if a != b and x != y}
    assert {tuple(r) for r in queries.p9_found(spark, D).collect()} == want


def stretch(item, doc):
    """Whether an alignment of the whole texts holds 12 item words with one edit in 8 at most."""
    best = [[0.0, 0, 0] for _ in range(len(doc) + 1)]
    for w in item:
        row = [[0.0, 0, 0]]
        for j, v in enumerate(doc, 1):
            up, left, corner = best[j], row[j - 1], best[j - 1]
            same = w == v
            options = [[0.0, 0, 0], [corner[0] + (1 if same else -1.5), corner[1] + 1, corner[2] + (not same)], [up[0] - 1.5, up[1] + 1, up[2] + 1], [left[0] - 1.5, left[1], left[2] + 1]]
            cell = max(options)
            if cell[1] >= 12 and 8 * cell[2] <= cell[1]:
                return True
            row.append(cell)
        best = row
    return False


def test_p8(spark):
    words = lambda t: re.findall(r"[^\W_]+", look(t).lower())
    items = {r["item_id"]: words(r["text"]) for r in pq.read_table(f"{D}/eval_item.parquet").to_pylist()}
    want = set()
    for i, t in documents():
        doc = words(t or "")
        have = set(doc)
        want |= {(i, k) for k, item in items.items() if sum(w in have for w in item) >= 10 and stretch(item, doc)}
    assert {tuple(r) for r in queries.p8_found(spark, D).collect()} == want
