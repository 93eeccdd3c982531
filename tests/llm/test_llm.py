"""Text and percentile operators against brute force, exact round trips and hand-made cases."""

import base64
import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.llm import leakage, lookalike, quantiles, tokenizing

HAVE = os.path.exists(tokenizing.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not HAVE, reason="no vocabulary file")


# --- percentiles


def exact(values, p):
    v = sorted(values)
    return v[max(1, int(np.ceil(p * len(v)))) - 1]


def test_percentiles_within_the_error(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        g = rng.choice(["a", "a", "a", "b", None])
        rows.append((g, rng.choice([1, None]), rng.choice([rng.lognormvariate(3, 4), -rng.random(), 0.0, 5.0, 5.0, None, float("nan")]), "clash"))
    rows.append(("lone", 1, 1e300, "x"))
    df = spark.createDataFrame(rows, "g string, w int, v double, n string").repartition(5)
    targets = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = quantiles.percentiles(quantiles.frequencies(df, ["g", "w"], "v", 0.01), ["g", "w"], targets, 0.01, partitions=7).collect()
    groups = {}
    for g, w, v, _ in rows:
        if v is not None and v == v:
            groups.setdefault((g, w), []).append(v)
    assert len(got) == len(groups) * len(targets)
    for r in got:
        values = groups[r["g"], r["w"]]
        assert r["n"] == len(values)
        assert r["value"] == pytest.approx(exact(values, r["p"]), rel=0.01 + 1e-9)


def test_percentiles_of_parts_combine(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("v"), (F.col("id") % 7).alias("day"))
    whole = quantiles.frequencies(df, ["g"], "v")
    parts = [quantiles.frequencies(df.where(F.col("day") == d), ["g"], "v") for d in range(7)]
    rows = lambda x: sorted(map(tuple, x.select("g", "bin", "n").collect()))
    assert rows(quantiles.combine(parts, ["g"])) == rows(whole)
    assert quantiles.percentiles(whole.limit(0), ["g"], [0.5]).count() == 0


def test_an_error_of_nothing_is_exact(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), rng.choice([0.0, -0.0, 1.5, rng.random(), None, float("nan"), float("inf")])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r["g"], r["p"]): r["value"] for r in quantiles.percentiles(quantiles.frequencies(df, ["g"], "v", 0), ["g"], [0.1, 0.5, 0.99], 0, partitions=5).collect()}
    own = {g: [v for k, v in rows if k == g and v is not None and v == v] for g in ("a", None)}
    assert got == {(g, p): exact(own[g], p) for g in own for p in (0.1, 0.5, 0.99)}


def test_infinities_have_places(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "v double")
    got = [r["value"] for r in quantiles.percentiles(quantiles.frequencies(df, [], "v"), [], [0.1, 0.5, 1.0]).orderBy("p").collect()]
    assert got[0] == float("-inf") and got[1] == pytest.approx(1, rel=0.0011) and got[2] == float("inf")


# --- tokenizing

TEXTS = ["", None, "Hello world's  end\n\n \tx", "naïve café — 東京は 12,345 ½ ₃", "a b　c", "<|endoftext|> x", "퟿￿ 😀👩‍👩‍👧", "x" * 200_000, "it'S don't I'M   ", " ", "é é", "same", "same", "१२३ ٣٤", "\x1c\x85  "]


@needs_vocabulary
def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.VOCABULARY)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokenizing.encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    back = {r["doc_id"]: r["text"] for r in tokenizing.decode(spark.createDataFrame(list(got.items()), "doc_id bigint, ids array<int>"), "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    assert tokenizing.encode(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_ids_equal_the_rank_file(spark):
    import tiktoken

    path = tokenizing.VOCABULARY.replace(".json", ".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab'sт9 \n東é.,-") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in tokenizing.encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode_ordinary(x) for i, x in enumerate(texts)}


# --- look-alikes


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_fold_settles(text):
    once = lookalike.fold(text)
    assert lookalike.fold(once) == once
    assert lookalike.fold(unicodedata.normalize("NFD", text)) == once


@pytest.mark.parametrize("a,b,same", [("ﬂехіblе", "flexible", True), ("é", "é", True), ("Ａ１，", "A1,", True), ("a​b­", "ab", True), ("a b c", "a b c", True), ("ｶﾞ", "ガ", True), ("µm", "μm", True), ("Å Ω K", "Å Ω K", True), ("x‑y", "x-y", True), ("m²", "m2", False), ("é", "e", False), ("A", "a", False), ("x₃", "x3", False), ("a–b", "a-b", False), ("1", "l", False), ("a\nb", "a b", False)])
def test_what_looks_the_same(a, b, same):
    assert (lookalike.fold(a) == lookalike.fold(b)) == same


def test_trie_automaton():
    t = lookalike.Trie()
    for w, n in (("valve", 5), ("value", 9), ("рука", 4), ("pyka", 1), ("naïve", 2)):
        t.add(w, n)
    assert t.canonical("vаlvе") == (0.0, "valve")
    assert t.canonical("pyкa") == (0.0, "рука") and t.canonical("pуka") == (0.0, "pyka")
    assert t.canonical("pyk") is None and t.canonical("рyка") == (0.0, "рука")
    assert t.canonical("naïve​") == (0.0, "naïve") and t.canonical("naive") is None
    assert t.canonical("vale", budget=1.0) == (1.0, "value") and t.canonical("valuue", budget=1.0) == (1.0, "value") and t.canonical("vaxue", budget=1.0) == (1.0, "value")


@given(st.dictionaries(st.text(alphabet="aoеосxхёëйµμɡgУҮYρpр​\u0308\u0306éß9²aａ‐-бაﬁfi", min_size=1, max_size=5), st.integers(1, 9), max_size=25))
@settings(max_examples=500, deadline=None)
def test_spelling_is_one_per_look(counts):
    found = lookalike.spell(counts)
    looks = {}
    for w in counts:
        looks.setdefault(lookalike.expand(w), set()).add(found.get(w, w))
    assert all(len(s) == 1 for s in looks.values())
    assert len({next(iter(s)) for s in looks.values()}) == len(looks)


@given(st.text(alphabet="ab", min_size=1, max_size=7), st.text(alphabet="ab", min_size=1, max_size=7), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_looks_within_the_edits_share_a_shard(a, b, edits):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    if d[-1] <= edits:
        assert set(lookalike.parts(a, edits)) & lookalike.reachable(b, edits)


@pytest.mark.parametrize("shard", [1, 3, 100])
def test_paid_edits_reach_their_target_across_shards(spark, shard):
    words = {"valve": 9, "value": 5, "vаlvee": 1, "рука": 4, "pукa": 1, "zеbrа": 1, "sleeve": 3, "sleеvs": 1, "x": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {b: {r["word"]: r["result"] for r in lookalike.spellings(df, b, shard).collect()} for b in (0.0, 1.0)}
    free = {"vаlvee": "valvee", "pукa": "рука", "zеbrа": "zebra", "sleеvs": "sleevs"}
    assert got[0.0] == free == lookalike.spell(words)
    assert got[1.0] == free | {"vаlvee": "valve", "sleеvs": "sleeve"} == lookalike.spell(words, 1.0)


def test_copies_of_a_string_are_not_paired(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "the vаlve").when(F.col("id") == 8, "thе valve").otherwise("the valve").alias("text"))
    got = lookalike.look_alike_pairs(df, "doc_id", "text")
    assert got.count() == 2 * 2998 + 1 == got.distinct().count() and got.where("doc_id_a >= doc_id_b").count() == 0


def pairs_of(spark, texts):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id bigint, text string, look string").repartition(3)
    return {tuple(r) for r in lookalike.look_alike_pairs(df, "doc_id", "text").collect()}


def test_look_alike_pairs_equal_brute_force(spark):
    base = ["The valve is naïve", "Это рука и нога", "ガラス製の弁", "m² and m2", ""]
    rng = random.Random(2)
    swap = {"a": "а", "e": "е", "о": "o", "р": "p", "і": "i", " ": " ", "ï": "ï", "ガ": "ガ", "T": "Ｔ"}
    texts = [None, "", *base]
    for _ in range(60):
        t = rng.choice(base)
        texts.append("".join(swap.get(c, c) if rng.random() < 0.3 else c + ("​" if rng.random() < 0.05 else "") for c in t))
    texts += ["m2 and m2", "The Valve is naïve", "The valve is naive"]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i] != texts[j] and lookalike.fold(texts[i]) == lookalike.fold(texts[j])}
    assert pairs_of(spark, texts) == want and len(want) > 100
    assert pairs_of(spark, []) == set()


@pytest.mark.parametrize("run", ["ა", "‐", "é", "東", "​", " "])
def test_long_runs_do_not_overflow(spark, run):
    assert pairs_of(spark, ["x" + run * 100_000, "х" + run * 100_000, run * 100_000, "x"]) >= {(0, 1)}


def test_normalized_spelling_follows_the_vocabulary(spark):
    texts = ["the valve of the valve", "the vаlvе", "рука рука", "pука", "x ​ y ", None, "zеbrа"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lookalike.normalized(df, "doc_id", "text").collect()}
    assert got == {0: "the valve of the valve", 1: "the valve", 2: "рука рука", 3: "рука", 4: "x y", 5: "", 6: "zebra"}


# --- leakage

ITEMS = [
    (1, "Which primary cannula keeps 70 Topai hopper from leaking when the Zilnun terminal compresses 373 titanium plates?"),
    (2, "Which concave antenna keeps 916 Dorvai socket from vibrating when the Korbor manifold clamps 291 brass plates?"),
    (3, "Which tapered trough keeps 12 Galil carriage from drifting when the Raisu antenna rotates 290 mica plates?"),
    (4, "How far may Muta bearing travel before 52 primary catheter units stop jamming, given that silicone shields Faine?"),
    (5, "How far may Kapo antenna travel before 53 concave antenna units stop drifting, given that polyamide guides Kopu?"),
    (6, "How far may Lago modulator travel before 67 tapered hopper units stop leaking, given that ceramic deflects Baba?"),
    (7, None),
    (8, ""),
]
FILL = "The known sleeve tends to sliding under load, which the outer mast (12) of the invention prevents. "


def leaked(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id bigint, text string, item bigint")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return {tuple(r) for r in leakage.find(d, "doc_id", "text", items, "item_id", "text").collect()}


def test_leaks_and_decoys(spark):
    q1, q4 = ITEMS[0][1], ITEMS[3][1]
    w = q1.split()
    changed = w[:]
    changed[5] = "hoppers"
    docs = [
        FILL + q1 + FILL,
        FILL + q1.upper().replace(" ", "\n", 3),
        FILL + q1.replace("a", "а").replace("e", "е​") + FILL,
        FILL + " ".join(changed),
        FILL + " ".join(w[:8] + w[9:]),
        FILL + " ".join(w[:8] + ["surely"] + w[8:]),
        FILL + " ".join(w[3:15]),
        FILL + " ".join(w[:7]) + " " + FILL,
        FILL + q1.replace("70", "71").replace("Topai", "Minor").replace("Zilnun", "Bexo").replace("373", "12").replace("titanium", "steel"),
        FILL + q1 + " " + q4,
        None,
        "",
        FILL * 3000 + q4,
        q1,
        q1,
    ]
    want = {(i, 1) for i in (0, 1, 2, 3, 4, 5, 6, 9, 13, 14)} | {(9, 4), (12, 4)}
    assert leaked(spark, docs) == want
    assert leaked(spark, []) == set()


ODD = [
    (20, "Wie weit darf das kleine Lager fahren, ehe zwei alte Räder im schmalen Tal stehen bleiben?"),
    (21, "alpha7 beta9 gamma3 delta1 epsilon5 zeta2 eta8 theta4 iota6 kappa0 lambda7 my9 ny3 xi1"),
    (22, "x = y + 1 ; z = x * 2 ; w = z - y ; return w if w else z"),
    (23, "東京 は 今日 も 晴れ で 明日 は 雨 が 降る と 言わ れ て いる"),
]


@pytest.mark.parametrize("items", [ODD[:1], ITEMS[:1], ITEMS[:2], ITEMS[1:6], [*ITEMS[:6], *ODD], ODD])
def test_every_item_is_found_in_sets_of_any_size(spark, items):
    docs = [FILL + t + " " + FILL for _, t in items]
    assert leaked(spark, docs, items) == {(i, k) for i, (k, _) in enumerate(items)}


def test_items_in_several_parts(spark, monkeypatch):
    docs = [FILL + t for _, t in ITEMS[:6]]
    whole = leaked(spark, docs)
    monkeypatch.setattr(leakage, "PART", 300)
    assert leaked(spark, docs) == whole == {(i, i + 1) for i in range(6)}


def test_changed_names_keep_their_windows(spark):
    # each window of five words holds a change, so words alone give no seed; the template with its other slots does
    q = ITEMS[3][1].replace("Muta", "Kora").replace("52", "61").replace("jamming", "drifting").replace("silicone", "rubber")
    alike = q.replace("bearing", "winch").replace("primary", "sealed").replace("catheter", "nozzle").replace("shields", "holds")
    docs = spark.createDataFrame([(1, FILL + q + FILL), (2, FILL + alike)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = lambda rules: {tuple(r) for r in leakage.find(docs, "doc_id", "text", items, "item_id", "text", rules).collect()}
    assert found(leakage.Rules(per_edit=4)) == {(1, 4)} and found(leakage.Rules()) == set()


WINDOW_WORDS = st.lists(st.sampled_from(["how", "far", "may", "ab", "cd", "7", "8", "mm", "kg"]), min_size=5, max_size=5)


@given(WINDOW_WORDS, WINDOW_WORDS)
@settings(max_examples=300, deadline=None)
def test_windows_meet_if_all_slots_but_one_agree(a, b):
    def keys(window):
        codes = coder.codes(window)
        return set(leakage.slot_keys(codes, *leakage.template_windows(codes, rules), rules)[1].tolist())

    rules, coder = leakage.Rules(), leakage.Coder(frozenset(["how", "far", "may"]))
    kind = lambda w: w if w in coder.lexicon else w.isdigit() or w in leakage.UNITS and "unit" or "name"
    template = sum(w in coder.lexicon for w in a) >= rules.literals
    differ = sum(v != w for v, w in zip(a, b))
    assert bool(keys(a) & keys(b)) == (list(map(kind, a)) == list(map(kind, b)) and differ <= template)


def test_slots_are_consistent_over_a_passage():
    hits = lambda slips: [(0, p, p + 9, next((s for s in slips if p <= s < p + 5), -1)) for p in range(8)]
    assert leakage.candidates(hits([]), leakage.Rules()) == leakage.candidates(hits([5]), leakage.Rules()) == {0: [9]}
    apart = [(0, p, p + 9, p + 2) for p in (0, 4, 8)]
    assert leakage.candidates(apart, leakage.Rules()) == {} and leakage.candidates(apart, leakage.Rules(per_edit=4)) == {0: [9]}


@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=12), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=14), st.integers(-4, 6))
@settings(max_examples=300, deadline=None)
def test_no_alignment_is_passed_over(item, doc, shift):
    rules = leakage.Rules(least=4, per_edit=4, band=2)
    if leakage.holds_passage(leakage.aligned(item, doc, shift, rules.band), rules):
        assert leakage.shares_passage(item, doc, [shift], rules)


def test_template_words_are_a_share_of_the_items():
    items = [[f"name{i}", f"name{i + 1}", "which", "item"] for i in range(1000)] + [["rare"]] * 5
    assert leakage.lexicon_of(items, leakage.Rules()) == {"which", "item"}


def test_passage_rule():
    r = leakage.Rules()
    m, x = (True, True), (False, True)
    assert leakage.holds_passage([m] * 12, r) and not leakage.holds_passage([m] * 11, r)
    assert leakage.holds_passage([m] * 6 + [x] + [m] * 5, r) and not leakage.holds_passage([m, m, x] * 8, r)
    assert leakage.holds_passage([x] * 5 + [m] * 12 + [x] * 5, r)


@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_alignment_scores_as_the_full_table(item, doc):
    path = leakage.aligned(item, doc, 0, 30)
    h = np.zeros((len(item) + 1, len(doc) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if item[i - 1] == doc[j - 1] else -0.9), h[i - 1, j] - 0.9, h[i, j - 1] - 0.9)
    assert sum(1 if same else -0.9 for same, _ in path) == pytest.approx(h.max())


# --- blocks


@needs_vocabulary
def test_long_texts_are_cut_where_words_end(spark, monkeypatch):
    from tokenizers import Tokenizer

    from graphloom.llm import blocks

    t = Tokenizer.from_file(tokenizing.VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(11)
    letters = ["a", "b", "'s", "don't", "9", "é", "東", "   ", "  \n", "\t", " ", "　", "͸", ".", ",-", "\U0003134f", "  ", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(120)] + [None, "", "x" * 500, " " * 500, "͸" * 300]
    for piece, limit in ((1, 1), (7, 200), (4096, 1 << 22)):
        monkeypatch.setattr(blocks, "PIECE", piece)
        monkeypatch.setattr(blocks, "LIMIT", limit)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
        got = {r["doc_id"]: r["ids"] for r in tokenizing.encode(df, "doc_id", "text").collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
        whole = lookalike.normalized(df, "doc_id", "text").collect()
        assert {r["doc_id"]: r["text"].replace(" ", "") for r in whole} == {i: lookalike.fold(x or "").replace(" ", "") for i, x in enumerate(texts)}


def test_blocks_are_bounded_by_bytes(spark):
    from graphloom.llm import blocks

    text = F.concat(F.repeat(F.lit("word and "), 22_000), F.col("id").cast("string"))  # 200 KB
    docs = spark.range(0, 300, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"))
    made = blocks.build(docs, "doc_id", "text", tokenizing.SPACE, tokenizing.split_words, "tokens")
    sizes = made.select(F.size("docs").alias("docs"), F.length("codes").alias("bytes"), F.size("words").alias("words")).collect()
    assert sum(r["docs"] for r in sizes) == 300
    assert len(sizes) >= 10 and max(r["docs"] for r in sizes) <= 22
    assert max(r["bytes"] for r in sizes) < 4 * 22 * 44_002
