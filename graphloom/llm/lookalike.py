"""Texts that look the same but differ in their characters, brought to one spelling.

What looks the same is said by tables: a unit stands for all its look-alikes (compatibility widths, ligatures, composed
and combining accents, letters of other alphabets), and invisible characters have none. Raised and lowered figures,
accents, case and digits stay different; so do letters in a style that one can see, such as bold mathematical ones.

The corpus' own vocabulary decides the spelling: its distinct clean tokens (one alphabet, nothing invisible, composed)
stand in tries. A token as it is written runs through a trie by a weighted edit automaton: an edge is passed at no cost
by every character that looks like the edge's, an ignorable stays where it is, a ligature passes several edges, an
accent is an edge of its own whether it was composed or not; other edits cost what their weights say and are taken
within a budget, which is zero where texts must look the same. Of the spellings reached at the least cost the most
frequent is canonical (ties: the smaller string). A token that reaches none is written by the table. So tokens that look
the same get the same spelling, and a Russian word stays Cyrillic while a Latin word with Cyrillic letters turns Latin.

Tries are sharded by what must survive the edits: a spelling is cut into one part more than the budget has edits, so one
part at least is met unchanged. Without a budget that part is the whole look.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize, salted_join
from . import blocks

# Letters of other alphabets that look like Latin letters, each row beside the Latin ones.
LOOKALIKES = (
    ("Cyrillic", "аеорсухѕіјһԁԛԝԚԜАВЕЅІЈКМНОРСТУХҮѵѴӏӀ", "aeopcyxsijhdqwQWABESIJKMHOPCTYXYvVlI"),
    ("Greek", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"),
    ("Greek lunate", "ϲϹϳ", "cCj"),
    ("Armenian", "օսհոցՍՏԼՕ", "ouhngUSLO"),
    ("Cherokee", "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),
    ("Latin", "ɡ", "g"),
)
# Other characters that look like the usual one.
SIGNS = (("‐", "-"), ("‑", "-"), ("µ", "μ"))
# Invisible characters.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe0e\ufe0f\ufeff"
# Kinds of space that are not a line end.
SPACES = "\t\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _width_table() -> dict[int, str]:
    """Half-width, full-width and ligature forms, Roman numerals and signs of degrees, by the rule of their compatibility
    decomposition."""
    table = {}
    for first, last in ((0x2103, 0x2103), (0x2109, 0x2109), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFF01, 0xFF9F), (0xFFA0, 0xFFDC), (0xFFE0, 0xFFEE)):
        for o in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(o))
            if plain != chr(o):
                # a half-width voiced mark joins its letter
                table[o] = {" ゙": "゙", " ゚": "゚"}.get(plain, plain)
    return table


WIDTHS = _width_table()
DROP = {ord(c): None for c in IGNORABLE}
FIRST = WIDTHS | DROP
LETTERS = {ord(a): b for _, other, latin in LOOKALIKES for a, b in zip(other, latin, strict=True)} | {ord(a): b for a, b in SIGNS}
#: Units that letters of more than one alphabet share.
SHARED = frozenset(LETTERS.values())


def settle(text: str) -> str:
    """Usual widths, nothing invisible, composed accents."""
    return unicodedata.normalize("NFC", text.translate(FIRST))


def expand(text: str) -> str:
    """The text in units: equal for texts that look the same, spaces aside."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(FIRST)).translate(LETTERS))


def fold(text: str) -> str:
    """expand() with every kind of space as U+0020, runs of them as one, none at line ends."""
    plain = expand(text)
    plain = re.sub(f"[{re.escape(SPACES)}]+", " ", plain)
    return re.sub(r" ?\n ?", "\n", plain).strip(" \n")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


def _never_first() -> frozenset[str]:
    """Characters that a clean token does not hold: signs with a plainer look-alike, and letters for whose look another
    letter of their alphabet stands."""
    taken = {("LATIN", u) for u in LETTERS.values()}
    out = {o for o, _ in SIGNS}
    for o, u in LETTERS.items():
        key = (_script(chr(o)), u)
        if key in taken:
            out.add(chr(o))
        taken.add(key)
    return frozenset(out)


NEVER_FIRST = _never_first()


def clean(token: str) -> bool:
    """One alphabet at most, nothing that settle() changes, no character with a plainer one of the same look."""
    if token.isascii():
        return True
    if settle(token) != token:
        return False
    parts = unicodedata.normalize("NFD", token)
    return NEVER_FIRST.isdisjoint(parts) and len({_script(c) for c in parts} - {""}) <= 1


def ambiguous(token: str) -> bool:
    """Whether a clean token may have a clean look-alike in another alphabet: all its letters are shared ones."""
    return all(not u.isalpha() or u in SHARED for u in unicodedata.normalize("NFD", expand(token)))


def hits(counts: dict[str, int], budget: float = 0.0) -> dict[str, tuple[float, int, str]]:
    """(cost, -occurrences, spelling) of each token that is not sure to be its own spelling; of those without a free
    one in the trie, only what is within the budget. counts must hold what a token may reach."""
    trie, ask = Trie(), []
    for w, n in counts.items():
        if w == "" or w.isspace():
            continue
        if clean(w):
            trie.add(w, n)
            if not ambiguous(w):
                continue
        ask.append(w)
    found = ((w, trie.hit(w, budget)) for w in ask)
    return {w: hit for w, hit in found if hit}


def tabled(token: str) -> str:
    """The spelling of a token that reaches none in the tries."""
    return token if token == "" or token.isspace() or clean(token) else expand(token)


def spell(counts: dict[str, int], budget: float = 0.0) -> dict[str, str]:
    """Canonical spelling of each token that is not spelled so itself; counts must hold all look-alikes of a token."""
    found = hits(counts, budget)
    out = {w: found[w][2] if w in found else tabled(w) for w in counts}
    return {w: to for w, to in out.items() if to != w}


_UNITS: dict[str, str] = {}


def units(c: str) -> str:
    """What one character looks like, decomposed: nothing for an ignorable, several units for a ligature."""
    u = _UNITS.get(c)
    if u is None:
        u = _UNITS[c] = unicodedata.normalize("NFD", expand(c))
    return u


def decomposed(token: str) -> str:
    """A token with accents of their own, in their canonical order, which an ignorable between accents would hide."""
    out = unicodedata.normalize("NFD", token)
    if not out.isascii() and any(ord(c) in DROP for c in out) and any(unicodedata.combining(c) for c in out):
        out = unicodedata.normalize("NFD", out.translate(DROP))
    return out


class Trie:
    """Clean spellings with their counts. Edges hold decomposed characters, by what they look like."""

    def __init__(self) -> None:
        self.edges: list[dict[str, dict[str, int]]] = [{}]
        self.word: list[tuple[int, str] | None] = [None]

    def add(self, word: str, count: int) -> None:
        at = 0
        for c in decomposed(word):
            alike = self.edges[at].setdefault(units(c), {})
            to = alike.get(c)
            if to is None:
                to = alike[c] = len(self.edges)
                self.edges.append({})
                self.word.append(None)
            at = to
        self.word[at] = (count, word)

    def canonical(self, token: str, budget: float = 0.0) -> tuple[float, str] | None:
        """(cost, spelling) of hit()."""
        found = self.hit(token, budget)
        return found and (found[0], found[2])

    def hit(self, token: str, budget: float = 0.0, substitute: float = 1.0, insert: float = 1.0, delete: float = 1.0) -> tuple[float, int, str] | None:
        """(cost, -occurrences, spelling): the cheapest spelling within budget, then the most frequent, then the
        smallest; None if there is none. A step of the automaton takes one character of the token as it is written:
        edges that look like it are free, an ignorable leaves the states as they are, other edits cost their weights."""
        states = {0: 0.0}
        for c in decomposed(token):
            for u in units(c):
                states = self._step(states, u, budget, substitute, insert, delete)
                if not states:
                    return None
        ends = [(cost, -self.word[at][0], self.word[at][1]) for at, cost in states.items() if self.word[at]]
        return min(ends) if ends else None

    def _step(self, states: dict[int, float], u: str, budget: float, substitute: float, insert: float, delete: float) -> dict[int, float]:
        after: dict[int, float] = {}
        for at, cost in states.items():
            for to in self.edges[at].get(u, {}).values():
                after[to] = min(after.get(to, cost), cost)
            if cost + delete <= budget:
                after[at] = min(after.get(at, cost + delete), cost + delete)
            if cost + substitute <= budget:
                for alike in self.edges[at].values():
                    for to in alike.values():
                        after[to] = min(after.get(to, cost + substitute), cost + substitute)
        todo = list(after) if insert <= budget else []
        while todo:
            at = todo.pop()
            if after[at] + insert <= budget:
                for alike in self.edges[at].values():
                    for to in alike.values():
                        if after[at] + insert < after.get(to, budget + 1):
                            after[to] = after[at] + insert
                            todo.append(to)
        return after


def parts(look: str, edits: int) -> list[tuple[int, int, str]]:
    """A spelling's look as edits + 1 parts of about equal length: (length of the look, number, part)."""
    n, k = len(look), edits + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(n, i, look[ends[i] : ends[i + 1]]) for i in range(k)]


def reachable(look: str, edits: int) -> set[tuple[int, int, str]]:
    """The parts of all looks within `edits` edits of this one that it may hold unchanged."""
    out = set()
    for n in range(max(0, len(look) - edits), len(look) + edits + 1):
        k = edits + 1
        ends = [n * i // k for i in range(k + 1)]
        for i in range(k):
            for at in range(max(0, ends[i] - edits), ends[i] + edits + 1):
                part = look[at : at + ends[i + 1] - ends[i]]
                if len(part) == ends[i + 1] - ends[i]:
                    out.add((n, i, part))
    return out


BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + r"\n"


def tokens(text: Column) -> Column:
    """Line ends, runs of space, single characters of scripts without spaces with the marks on them, and the runs
    between them. Their concatenation is the text. The first branches take the letters of most alphabets, the space
    or line end behind them and plain wide characters by a few comparisons and without backtracking; the long classes
    see only what is left. No group repeats, so no text is too long."""
    space = "".join(f"\\x{{{ord(c):x}}}" for c in SPACES)
    invisible = "".join(f"\\x{{{ord(c):x}}}" for c in IGNORABLE)
    # Kana and Han, half-width kana included.
    wide = r"\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff65-\uff9d\x{20000}-\x{3ffff}"
    mark = rf"\p{{M}}\uff9e\uff9f{invisible}"
    plain = r"[!-~\u00a1-\u0fff]"
    other = rf"[^{space}\n{wide}]"
    quick = rf"{plain}++(?:(?![ \n]){other}++)?| (?={plain})|\n|[{wide}](?![{mark}])"
    return F.regexp_extract_all(text, F.lit(rf"{quick}|{other}++|[{space}]++|[{wide}][{mark}]*+"), F.lit(0))


#: Distinct tokens of one shard, about.
SHARD = 50_000


def spellings(words: DataFrame, budget: float = 0.0, shard: int = SHARD) -> DataFrame:
    """(word, result): canonical spelling of those words of (word, n) that are not spelled so themselves. budget: what
    the edits of a token that looks like no clean one may cost; at 0 only look-alikes share a spelling.

    words holds each distinct token once and is written out, so that the shards come from its counted rows: about
    `shard` tokens each, however large the vocabulary and however frequent its tokens. Only tokens that may be spelled
    otherwise go to more shards than one, and only with a budget.
    """
    edits = int(budget)  # no edit costs less than 1
    words = materialize(words.select("word", "n"), "words")
    shards = max(1, -(-words.count() // shard))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to = [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                look = unicodedata.normalize("NFD", expand(w))
                keys = set(parts(look, edits))
                if edits and not clean(w):
                    keys |= reachable(look, edits)
                mine = {zlib.crc32(f"{n} {i} {p}".encode("utf-8", "surrogatepass")) % shards for n, i, p in keys}
                at += [i] * len(mine)
                to += mine
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(to, pa.int32())], ["word", "n", "shard"])

    def settle_shard(t: pa.Table) -> pa.Table:
        found = hits(dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist())), budget)
        best = list(found.values())
        return pa.table({"word": pa.array(list(found), pa.string()), "cost": pa.array([h[0] for h in best], pa.float64()), "less": pa.array([h[1] for h in best], pa.int64()), "result": pa.array([h[2] for h in best], pa.string())})

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to = hit or tabled(w)
                if to != w:
                    out.append((w, to))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["word", "result"])

    sharded = words.mapInArrow(key, "word string, n bigint, shard int")
    reached = sharded.groupBy("shard").applyInArrow(settle_shard, "word string, cost double, less bigint, result string")
    if edits:  # a token's shards may each have found a spelling
        reached = reached.groupBy("word").agg(F.min(F.struct("cost", "less", "result")).alias("best")).select("word", "best.result")
    # ASCII tokens are their own spelling, unless a look-alike of another alphabet is the canonical one
    asked = words.select("word").join(reached.select("word", "result"), "word", "left").where(F.col("result").isNotNull() | F.col("word").rlike(r"[^\x00-\x7f]"))
    return asked.mapInArrow(written, "word string, result string")


def _texts(made: DataFrame, doc_id: str, columns: str, out, budget: float = 0.0) -> DataFrame:
    """Rows of out(doc ids, canonical texts) for every block, after the spellings are back at their positions."""
    attached = blocks.attach(made, materialize(spellings(blocks.distinct_words(made), budget), "spellings"), keep_words=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = re.compile(" +")
        edges = re.compile(r" ?\n ?")
        for b in batches:
            for i in range(b.num_rows):
                words = np.array([" " if w[:1] in SPACES and not w.strip(SPACES) else w for w in b.column("words")[i].values.to_pylist()], dtype=object)
                found = b.column("found")[i]
                if found.is_valid:
                    for slot, result in zip(found.values.field("slot").to_pylist(), found.values.field("result").to_pylist()):
                        words[slot] = result
                codes = np.frombuffer(b.column("codes")[i].as_buffer(), np.int32)
                spelled = words[codes] if len(words) else words
                ids = b.column("docs")[i].values
                at, texts = 0, []
                for size in b.column("sizes")[i].values.to_pylist():
                    text = spaces.sub(" ", "".join(spelled[at : at + size]))
                    texts.append(edges.sub("\n", text).strip(" \n"))
                    at += size
                yield from out(ids, texts)

    return attached.select("words", "docs", "sizes", "codes", "found").mapInArrow(run, columns.replace("DOC", f"`{doc_id}`"))


def normalized(docs: DataFrame, doc_id: str, text: str, budget: float = 0.0) -> DataFrame:
    """(doc_id, text): every text in its canonical spelling. budget: see spellings(); above 0, tokens with characters
    of several alphabets or invisible ones that look like no clean token also take the spelling of the nearest one, so
    texts that look slightly different may become equal. A null text gives an empty one; repeated rows repeat;
    other columns are ignored; an empty table gives no rows."""
    made = blocks.build(docs, doc_id, text, BLANK, tokens, "tokens")

    def out(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(texts), 2000):
            yield pa.RecordBatch.from_arrays([ids.slice(at, 2000), pa.array(texts[at : at + 2000], pa.string())], [doc_id, "text"])

    return _texts(made, doc_id, "DOC long, text string", out, budget)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def look_alike_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: rows whose non-empty texts look the same but are not equal as strings.

    Texts meet by the 128-bit digest of their canonical spelling. Strings are paired before rows are: a look with a
    single string is dropped, the pairs of different strings of a look come from its distinct strings, and only these
    are expanded to the rows that hold them. So copies meet nothing, a group of a million copies and one variant costs
    a million rows, and a string that many rows hold is salted. Null and empty texts are in no pair; doc_id is unique.
    """
    some = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc_id, text)
    made = blocks.build(some, doc_id, text, BLANK, tokens, "tokens")

    def out(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([ids, pa.array([_digest(t) for t in texts], pa.binary())], [doc_id, "look"])

    looks = _texts(made, doc_id, "DOC long, look binary", out)
    exact = some.select(doc_id, F.unhex(F.md5(text)).alias("exact"))
    both = materialize(looks.join(exact, doc_id).withColumnRenamed(doc_id, "doc"), "looks")
    strings = both.groupBy("look", "exact").agg(F.count("*").alias("n"))
    mixed = strings.groupBy("look").agg(F.count("*").alias("strings")).where(F.col("strings") > 1).select("look")
    held = materialize(both.join(mixed, "look", "left_semi"), "mixed")
    each = held.select("look", "exact").distinct()
    pairs = each.join(each.select("look", F.col("exact").alias("other")), "look").where(F.col("exact") < F.col("other")).select("exact", "other")
    rows = held.select("exact", "doc")
    first = salted_join(rows, pairs, "exact", "inner", F.col("doc")).select(F.col("doc").alias("a"), F.col("other").alias("exact"))
    found = salted_join(rows, first, "exact", "inner", F.col("doc"))
    return found.select(F.least("a", "doc").alias("doc_id_a"), F.greatest("a", "doc").alias("doc_id_b"))
