"""Evaluation texts in training texts, found by template windows.

Texts are folded (lookalike.expand, then lower case and words alone). A word becomes a typed placeholder unless it is a
template word, i.e. common among the items: numbers `#`, units `%`, all other words `@` (names, answers). Windows of `k`
placeholders and template words are hashed; the documents' windows meet the items' in a hash join. Template windows also
match questions that were merely re-parameterised, so a window's slots - its words under the placeholders - are checked
too: all but one must agree, the one left may hold another word of its type (a changed name, number or unit). A window
with fewer than `literals` template words says nothing as a template; it is hashed by its own words instead, so every
item has all of its windows, be it the only one or written unlike all others. Documents with `seeds` consistent windows
of an item are then checked word by word: an alignment must hold a stretch of `least` or more words of the item with at
most one edit in `per_edit`.

The items are the small side: their windows are a hash table that every task holds, so the join, the check of the slots
and the alignment are done where a document is read. No text and no window is shuffled, and a window that stands in a
third of all documents costs its own task nothing more than the others'.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lookalike import IGNORABLE, expand

# Units that stand behind numbers.
UNITS = frozenset("mm cm cm² cm2 m m² m³ m3 h µm μm nm km ms s min hz khz mhz w kw mw v kv a ma kpa mpa pa bar n nm kn kg g mg l ml mol °c c k kω ω mω å % ppm rpm j kj".split())
#: Letters and digits of any script with the marks on them.
WORD = re.compile("[\\w\u0300-\u036f\u3099\u309a]+")
INVISIBLE = re.compile("[" + IGNORABLE + "]+")
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Characters of items whose windows are in one hash table; more are searched in several passes.
PART = 3_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    k: int = 5
    literals: int = 2
    common: int = 3
    common_share: float = 0.01
    seeds: int = 2
    least: int = 12
    per_edit: int = 8
    band: int = 8
    filter_bits: int = 1 << 23


def raw_words(text: str | None) -> list[str]:
    """The words of a text as written; punctuation, spaces, line breaks and invisible characters do not matter."""
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return WORD.findall(text.replace("_", " "))


def plain(word: str) -> str:
    """A word in the units that it looks like, in lower case."""
    return expand(word).lower()


def words(text: str | None) -> list[str]:
    return [plain(w) for w in raw_words(text)]


class Coder(dict):
    """Word as written -> code: 62 bits of the plain word's hash above its kind. Distinct words are looked at once; a
    full cache starts anew. 0 stands for a text's end."""

    def __init__(self, lexicon: frozenset[str], size: int = 1 << 19) -> None:
        super().__init__()
        self.lexicon, self.size = lexicon, size

    def __missing__(self, word: str) -> int:
        w = plain(word)
        kind = LITERAL if w in self.lexicon else NUMBER if w.isdigit() else UNIT if w in UNITS else NAME
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2
        if len(self) >= self.size:
            self.clear()
        code = self[word] = h << 2 | kind or 4
        return code

    def codes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def lexicon_of(items: list[list[str]], rules: Rules) -> frozenset[str]:
    """Template words: those that stand in `common` items and in `common_share` of them or more, numbers and units
    apart."""
    seen = Counter(w for t in items for w in set(t))
    least = max(rules.common, rules.common_share * len(items))
    return frozenset(w for w, n in seen.items() if n >= least and not w.isdigit() and w not in UNITS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def template_windows(codes: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of all windows that hold no 0 (a text's end): of the template where it has `literals`
    words of its own or more, else of the words as they are. Third, which of them are templates."""
    n = len(codes) - rules.k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    kind = codes & np.uint64(3)
    literal = np.concatenate([[0], np.cumsum((kind == LITERAL) & (codes != 0))])
    ends = np.concatenate([[0], np.cumsum(codes == 0)])
    at = np.flatnonzero(ends[rules.k :] == ends[:n])
    template = (literal[rules.k :] - literal[:n] >= rules.literals)[at]
    typed = np.where(kind == LITERAL, codes, kind)
    h = np.where(template, np.uint64(0), np.uint64(1))
    for i in range(rules.k):
        h = _mixed((h ^ np.where(template, typed[at + i], codes[at + i])) * _MIX + np.uint64(i + 1))
    return at, h, template


def slot_keys(codes: np.ndarray, at: np.ndarray, h: np.ndarray, template: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' join keys: which window, the key, the place in the window of the slot that it leaves open. A
    template with slots has a key for each of them, of the template and the words in its other slots: two windows share
    a key if their slots agree but for one at most. Other windows have their hash and leave nothing open (-1)."""
    words = [codes[at + i] for i in range(rules.k)]
    slot = [template & (w & np.uint64(3) != LITERAL) for w in words]
    whole = np.flatnonzero(~np.logical_or.reduce(slot))
    owners, keys, places = [whole], [h[whole]], [np.full(len(whole), -1, np.int8)]
    for left in range(rules.k):
        own = np.flatnonzero(slot[left])
        key = h[own]
        for i in range(rules.k):
            if i != left:
                key = _mixed((key ^ words[i][own]) * _MIX + np.uint64(i + 1))
        owners.append(own), keys.append(key), places.append(np.full(len(own), left, np.int8))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(places)


def _laid(texts: list[str | None], coder: Coder) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all texts in a row with an end after each, where the texts start, and the words' codes."""
    tokens: list[str] = []
    starts = []
    for t in texts:
        starts.append(len(tokens))
        tokens += raw_words(t)
        tokens.append("")
    first = np.array(starts, np.int64)
    codes = coder.codes(tokens)
    codes[np.append(first[1:], len(tokens))[: len(first)] - 1] = 0
    return tokens, first, codes


def _within(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of `x` stand in a sorted table."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)


def aligned(item: list[str], doc: list[str], shift: int, band: int) -> list[tuple[bool, bool]]:
    """The best local alignment near the diagonal doc = item + shift, as steps (is a match, takes an item word).
    Banded dynamic programming: a match gives 1, a changed, missing or added word takes 0.9."""
    m, width, loss = len(doc), 2 * band + 1, 0.9
    above = [0.0] * (width + 2)
    steps = []
    best, end = 0.0, None
    for i, w in enumerate(item):
        row, step = [0.0] * (width + 2), [0] * (width + 2)
        first = i + shift - band - 1  # the word of band column b is doc[first + b]
        for b in range(max(1, -first), min(width, m - 1 - first) + 1):
            s, k = above[b] + (1.0 if w == doc[first + b] else -loss), 1
            if above[b + 1] - loss > s:
                s, k = above[b + 1] - loss, 2
            if row[b - 1] - loss > s:
                s, k = row[b - 1] - loss, 3
            if s > 0:
                row[b], step[b] = s, k
                if s > best:
                    best, end = s, (i, b)
        steps.append(step)
        above = row
    path: list[tuple[bool, bool]] = []
    if end is None:
        return path
    i, b = end
    while i >= 0 and 0 < b <= width and steps[i][b]:
        k = steps[i][b]
        if k == 1:
            path.append((item[i] == doc[i + shift - band - 1 + b], True))
            i -= 1
        elif k == 2:
            path.append((False, True))
            i, b = i - 1, b + 1
        else:
            path.append((False, False))
            b -= 1
    return path[::-1]


def shares_passage(item: list[str], doc: list[str], shifts: list[int], rules: Rules) -> bool:
    """Whether the document holds a passage of the item near one of the diagonals. Where the words of one diagonal
    will do, no alignment is made; where too few of the item's words stand within its band, none can be found."""
    for s in sorted(shifts):
        lo, hi = max(0, -s), min(len(item), len(doc) - s)
        if holds_passage([(item[i] == doc[i + s], True) for i in range(lo, hi)], rules):
            return True
        if not holds_passage([(w in doc[max(0, i + s - rules.band) : max(0, i + s + rules.band + 1)], True) for i, w in enumerate(item)], rules):
            continue
        if holds_passage(aligned(item, doc, s, rules.band), rules):
            return True
    return False


def holds_passage(path: list[tuple[bool, bool]], rules: Rules, least: int | None = None) -> bool:
    """Whether some stretch of the alignment takes `least` item words with one edit in `per_edit` of them at most."""
    least = rules.least if least is None else least
    # stretch (a, b]: per_edit * edits - taken at b is not above that at a, and b has taken least more than a
    taken = cost = 0
    passed = [(0, 0)]
    at, best = 0, None
    for same, takes in path:
        taken += takes
        cost += (0 if same else rules.per_edit) - takes
        passed.append((taken, cost))
        while passed[at][0] <= taken - least:
            best = passed[at][1] if best is None else max(best, passed[at][1])
            at += 1
        if best is not None and cost <= best:
            return True
    return False


def consistent(windows: set[tuple[int, int]], rules: Rules) -> bool:
    """Whether some stretch of the item words under (item position, item position of a slot that differs or -1) windows
    is as wide as `seeds` windows and has one word in `per_edit` at most that differs in all of its windows."""
    agreed = {p for ipos, slip in windows for p in range(ipos, ipos + rules.k) if p != slip}
    under = sorted(agreed.union(slip for _, slip in windows if slip >= 0))
    return holds_passage([(p in agreed, True) for p in under], rules, rules.k + rules.seeds - 1)


def candidates(hits: list[tuple[int, int, int, int]], rules: Rules) -> dict[int, list[int]]:
    """Item -> diagonals, from one document's (item, item position, document position, item position of a slot that
    differs or -1) of windows: items with `seeds` or more of them whose slots all agree, near common diagonals, or whose
    slots are consistent over the windows taken together."""
    near: dict[tuple[int, int], tuple[set[int], int]] = {}
    windows: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for item, ipos, pos, slip in sorted(hits, key=itemgetter(3)):  # diagonals are those of agreeing windows, where there are any
        windows[item].add((ipos, slip))
        key = (item, (pos - ipos) // rules.band)
        seen, shift = near.get(key, (set(), pos - ipos))
        if slip < 0:
            seen.add(ipos)
            shift = min(shift, pos - ipos)
        near[key] = (seen, shift)
    counts: Counter[int] = Counter()
    shifts: dict[int, list[int]] = defaultdict(list)
    for (item, _), (seen, shift) in near.items():
        counts[item] += len(seen)
        shifts[item].append(shift)
    return {i: shifts[i] for i, n in counts.items() if n >= rules.seeds or consistent(windows[i], rules)}


def find(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage of an item, without repeats.

    Every document is read whole. The items are an evaluation set: PART characters of them at a time are made into a hash table
    of windows on the driver and sent to the executors (some 30 MB); a larger set is searched in several passes over the documents,
    with the same result. A bit map of fixed size (1 MB) lets most of a document's windows go at once; what passes it
    meets the items' windows in the hash table. Null or empty texts are no cases; ids are unique in their tables;
    copies of a document are cases of their own.
    """
    held = items.where(F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    size = held.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART))
    some = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc_id, text)
    key_type = docs.schema[doc_id].dataType.simpleString()
    id_type = items.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {key_type}, `{item_id}` {id_type}"
    found = []
    for part in range(parts):
        rows = held.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == part).collect()
        found.append(some.mapInArrow(_scan(docs, rows, doc_id, item_id, items.schema[item_id].dataType, rules), schema))
    return reduce(DataFrame.unionByName, found).distinct()


def _scan(docs: DataFrame, rows: list, doc_id: str, item_id: str, id_type, rules: Rules):
    """The search of one part of the items, as a function over batches of documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids = [r[0] for r in rows]
    item_words = [words(r[1]) for r in rows]
    lexicon = lexicon_of(item_words, rules)
    _, begins, item_codes = _laid([r[1] for r in rows], Coder(lexicon))
    at, h, template = template_windows(item_codes, rules)
    bits = np.zeros(rules.filter_bits // 8, np.uint8)
    mask = np.uint64(rules.filter_bits - 1)
    where = (h & mask).astype(np.int64)
    np.bitwise_or.at(bits, where >> 3, (1 << (where & 7)).astype(np.uint8))
    own, key, left = slot_keys(item_codes, at, h, template, rules)
    order = np.argsort(key, kind="stable")
    table = (key[order], at[own][order].astype(np.int32), left[order])
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, bits, np.unique(h), table, item_codes, begins, item_words, ids))
    arrow_id = to_arrow_type(id_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, bits, templates, (keys, item_at, item_left), item_codes, begins, item_words, ids = shared.value
        coder, chunk = Coder(lexicon), 1000
        for b in batches:
            at_doc, at_item = [], []
            for begin in range(0, b.num_rows, chunk):
                tokens, starts, codes = _laid(b.column(1).slice(begin, chunk).to_pylist(), coder)
                upto = np.append(starts[1:], len(tokens)) - 1
                at, h, template = template_windows(codes, rules)
                where = (h & mask).astype(np.int64)
                maybe = np.flatnonzero((bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1)
                met = maybe[_within(templates, h[maybe])]
                own, key, _ = slot_keys(codes, at[met], h[met], template[met], rules)
                agree = _within(keys, key)
                own, key = at[met][own[agree]], key[agree]
                doc = np.searchsorted(starts, own, "right") - 1
                order = np.argsort(doc, kind="stable")
                for met in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
                    d = int(doc[met[0]])
                    lo = np.searchsorted(keys, key[met])
                    n = np.searchsorted(keys, key[met], "right") - lo
                    one = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # the entries lo, lo + 1, ... of each key
                    met = np.repeat(met, n)
                    at, slot = item_at[one], item_left[one]
                    item = np.searchsorted(begins, at, "right") - 1
                    place = at - begins[item]
                    open_slot = np.maximum(slot, 0)
                    slip = np.where((slot < 0) | (codes[own[met] + open_slot] == item_codes[at + open_slot]), -1, place + slot)
                    several = np.bincount(item[np.unique(at, return_index=True)[1]], minlength=len(ids))[item] >= rules.seeds
                    asked = candidates([*zip(*(x[several].tolist() for x in (item, place, own[met] - starts[d], slip)))], rules)
                    plain_words = [plain(w) for w in tokens[starts[d] : upto[d]]] if asked else []
                    for item, shifts in asked.items():
                        if shares_passage(item_words[item], plain_words, shifts, rules):
                            at_doc.append(begin + d), at_item.append(ids[item])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at_doc, pa.int32())), pa.array(at_item, arrow_id)], [doc_id, item_id])

    return scan
