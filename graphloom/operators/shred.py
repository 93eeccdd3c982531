"""Adjacency-table shredding of deeply nested JSON documents.

A document becomes rows of an *adjacency table*: node, parent, label, ordinal, kind, scalar. A document's nodes never
leave the Arrow batch that it came in, so the joins that the table is made for - a node with its parent, an object with
its scalars - are joins within a batch, by node number, and need no shuffle. They give every node its place among the
declared arrays (arr_path, arr_pos), its entity (owner: the top object or the element of a declared array that encloses
it) and its field (the dotted labels from there). Entity tables join object nodes with their scalars and pivot the
fields into columns; owners stay as the links between the tables.

kind: object, element (an object standing in a declared array), array, scalar or null.

Reading rules, for whole documents and every part of them:
- text that holds a complete JSON object or array counts as that object or array, however often it is wrapped;
- a lone object where an array of objects is declared is an array of one;
- a null element is no object but keeps its position;
- a document that is not complete JSON (damaged, empty, trailing characters, NaN) or null gives no nodes;
- a key that is repeated in one object keeps its last value; extra fields are shredded like any other.
Nesting has no limit but memory: what is too deep for the recursive reader is read again by an iterative one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NODE_TYPE = "doc string, node int, parent int, label string, ordinal int, kind string, arr_path string, arr_pos string, value string, owner int, field string"

#: `[]` fields of the wire message, by document: dotted path from the top of that document.
EDGE_ARRAYS = {
    "source": ("properties.contacts", "properties.affiliations", "properties.affiliations.org.sites", "properties.affiliations.roles"),
    "destination": ("properties.contacts", "properties.affiliations", "properties.affiliations.org.sites", "properties.affiliations.roles"),
    "properties": ("evidence", "evidence.spans", "history.changes", "history.changes.by.tags", "history.changes.measures"),
}

OBJECT, ARRAY, SCALAR, NULL = range(4)
ELEMENT = 4
KINDS = pa.array(["object", "array", "scalar", "null", "element"])
#: A field is named by its labels up to so many plain objects below its entity; deeper scalars have parent links alone.
FIELD_DEPTH = 64
#: Nodes that a task holds at once, a document's own number aside.
CHUNK = 200_000


# --- reading


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _load_deep(text: str):
    """json.loads without recursion, for nesting beyond the interpreter's stack."""
    end = len(text)
    skip = lambda i: _SPACE.match(text, i).end()
    open_: list = []  # the containers around the place of reading
    labels: list[str | None] = []  # the label that each open object's next value gets

    def label_at(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("a label is missing")
        labels[-1], i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return skip(i + 1)

    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                open_.append(value)
                labels.append(None)
                if c == "{":
                    at = label_at(at)
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value = float(m[0]) if m[1] or m[2] else int(m[0])
            at = m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("no value")
            value, at = _WORDS[word], at + len(word)
        while True:  # the value is complete; so may be what it closes
            at = skip(at)
            if not open_:
                if at != end:
                    raise ValueError("trailing characters")
                return value
            holder = open_[-1]
            if isinstance(holder, dict):
                holder[labels[-1]] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(holder, dict):
                    at = label_at(at)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("a container is not closed")
            value, at = open_.pop(), at + 1
            labels.pop()


def _load(text: str):
    """json.loads, but NaN and Infinity are no JSON; the check is only made where they may stand."""
    try:
        return json.loads(text, parse_constant=_refuse) if "NaN" in text or "Infinity" in text else json.loads(text)
    except RecursionError:
        return _load_deep(text)


def parse(text: str | None):
    """The object or array that the text holds, unwrapping text in text; None if it holds none. Each wrapping takes
    two characters at least, so this ends."""
    while isinstance(text, str):
        try:
            text = _load(text)
        except ValueError:
            return None
    return text if isinstance(text, (dict, list)) else None


def _opened(value: str):
    """A part as it counts: text that holds an object or an array is that object or array."""
    if value.lstrip()[:1] in ("{", "[", '"') and value.rstrip()[-1:] in ("}", "]", '"'):
        inner = parse(value)
        return value if inner is None else inner
    return value


def scalar_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return value
    return json.dumps(value)


# --- the adjacency table of a batch


class Places:
    """The declared arrays of a document and the labels that lead to them, as numbered places: 0 is the top."""

    def __init__(self, arrays: Iterable[str]) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.paths, self.declared = [""], [False]
        for path in arrays:
            at = 0
            for label in path.split("."):
                to = self.steps.setdefault((at, label), len(self.paths))
                if to == len(self.paths):
                    self.paths.append(f"{self.paths[at]}.{label}" if at else label)
                    self.declared.append(False)
                at = to
            self.declared[at] = True


class Adjacency:
    """Nodes of one document column of some rows: parallel columns, numbered through; a parent comes before its
    children, and a top object's parent is -1."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.label: list[str | None] = []
        self.ordinal: list[int] = []
        self.kind: list[int] = []
        self.value: list = []
        self.tops: list[int] = []
        self.rows: list[int] = []

    def add(self, row: int, text: str | None) -> None:
        """The nodes of one document. An explicit stack: depth is bounded by memory alone."""
        top = parse(text)
        if not isinstance(top, dict):
            return
        parent, label, ordinal, kind, value = self.parent.append, self.label.append, self.ordinal.append, self.kind.append, self.value.append
        n = len(self.kind)
        self.tops.append(n)
        self.rows.append(row)
        parent(-1), label(None), ordinal(0), kind(OBJECT), value(None)
        stack: list = [(top, n, None)]
        n += 1
        while stack:
            holder, at, own = stack.pop()
            items = holder.items() if own is None else holder
            for i, item in enumerate(items):
                name, v = item if own is None else (own, item)
                if type(v) is str:
                    v = _opened(v)
                parent(at), label(name), ordinal(i)
                if type(v) is dict:
                    kind(OBJECT), value(None)
                    stack.append((v, n, None))
                elif type(v) is list:
                    kind(ARRAY), value(None)
                    stack.append((v, n, name))
                else:
                    kind(NULL if v is None else SCALAR), value(v)
                n += 1


class Resolved:
    """An adjacency table joined with itself: every node with its parent, level by level as far as declared places
    reach, and with the entity that encloses it."""

    def __init__(self, a: Adjacency, places: Places) -> None:
        self.a = a
        n = len(a.kind)
        self.parent = parent = np.array(a.parent, np.int64)
        self.ordinal = ordinal = np.array(a.ordinal, np.int32)
        kind = np.array(a.kind, np.int8)
        self.tops = tops = np.array(a.tops, np.int64)
        names = {label: i for i, label in enumerate(dict.fromkeys(label for _, label in places.steps), 1)}
        label = np.fromiter((names.get(x, 0) for x in a.label), np.int32, n)
        step = np.full((len(places.paths), len(names) + 1), -1, np.int32)
        for (at, x), to in places.steps.items():
            step[at, names[x]] = to
        declared = np.array(places.declared)
        self.place = place = np.full(n, -1, np.int32)
        self.element = element = np.zeros(n, bool)
        entity = np.zeros(n, bool)
        place[tops] = 0
        entity[tops] = True
        holder = np.arange(n)  # of the placed nodes: the entity that they belong to, their own if they are one
        live = entity.copy()
        self.levels: list[np.ndarray] = []
        child = parent >= 0
        while True:
            at = np.flatnonzero(child & live[parent])
            if not len(at):
                break
            up = parent[at]
            inside = kind[up] == ARRAY
            to = np.where(inside, np.where(kind[at] == OBJECT, place[up], -1), step[place[up], label[at]])
            on = (to >= 0) & (kind[at] <= ARRAY)
            at, up, to, inside = at[on], up[on], to[on], inside[on]
            live = np.zeros(n, bool)
            live[at] = True
            place[at] = to
            found = (kind[at] == OBJECT) & declared[to]
            # a lone object where an array is declared is an array of one
            ordinal[at[found & ~inside]] = 0
            element[at[found]] = entity[at[found]] = True
            holder[at] = np.where(found, at, holder[up])
            self.levels.append(at[found])
        kind[element] = ELEMENT
        self.kind, self.entity = kind, entity
        # the entity around every node, by doubling the way up
        up = np.where(entity, np.arange(n), parent)
        while True:
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        self.owner = np.where(child, up[parent], -1)
        self.document = np.searchsorted(tops, np.arange(n), "right") - 1
        self.paths = places.paths
        self._positions: list[str | None] | None = None

    def positions(self) -> list[str | None]:
        """Of every element: the positions in the declared arrays passed."""
        if self._positions is None:
            out: list[str | None] = [None] * len(self.kind)
            for at in self.levels:
                for i, o, k in zip(at.tolist(), self.owner[at].tolist(), self.ordinal[at].tolist()):
                    before = out[o]
                    out[i] = str(k) if before is None else f"{before}.{k}"
            self._positions = out
        return self._positions

    def field(self, i: int) -> str | None:
        """The dotted labels from a node's entity to it; None through arrays, odd labels and more than FIELD_DEPTH."""
        a, owner, labels = self.a, int(self.owner[i]), []
        while i != owner:
            label = a.label[i]
            up = a.parent[i]
            if a.kind[up] == ARRAY or label is None or "." in label or len(labels) >= FIELD_DEPTH:
                return None
            labels.append(label)
            i = up
        return ".".join(reversed(labels))

    def rows(self, at: np.ndarray, fields: list[str | None]) -> list[pa.Array]:
        """Columns of NODE_TYPE but doc for the nodes `at`, whose fields are given."""
        a, position = self.a, self.positions()
        first = self.tops[self.document[at]]
        relative = lambda x: pa.array((x - first).astype(np.int32), mask=x < 0)
        own = np.where(self.element[at], at, self.owner[at])
        own = np.where(own < 0, first, own)
        labels = [a.label[i] for i in at.tolist()]
        within = self.element[own]
        paths = pa.array(self.paths).take(pa.array(self.place[own], mask=~within))
        return [
            pa.array((at - first).astype(np.int32)), relative(self.parent[at]), pa.array(labels, pa.string()), pa.array(self.ordinal[at], pa.int32()), KINDS.take(pa.array(self.kind[at])),
            paths, pa.array([position[i] for i in own.tolist()], pa.string()), pa.array([scalar_text(a.value[i]) for i in at.tolist()], pa.string()), relative(self.owner[at]), pa.array(fields, pa.string()),
        ]


# --- operators


def _tables(df: DataFrame, key: str, documents: Mapping[str, Iterable[str]], emit, schema: str) -> DataFrame:
    """Rows of emit(document, resolved adjacency, keys of its rows) for every chunk of every document column. A narrow
    map over the scan: no shuffle, no group can be hot."""
    columns = {c: Places(a) for c, a in documents.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, (doc, places) in enumerate(columns.items()):
                a = Adjacency()
                texts = batch.column(i + 1)
                for row in range(batch.num_rows):
                    a.add(row, texts[row].as_py())
                    if len(a.kind) >= CHUNK:
                        yield from emit(doc, Resolved(a, places), keys)
                        a = Adjacency()
                if a.tops:
                    yield from emit(doc, Resolved(a, places), keys)

    return df.select(key, *columns).mapInArrow(run, schema)


def shred(df: DataFrame, key: str, documents: Mapping[str, Iterable[str]], objects_only: bool = False) -> DataFrame:
    """Adjacency table of the JSON text columns `documents` (column -> its declared array paths); `key` names the row.

    The whole table is made and joined in either case; objects_only sends on the elements alone. Repeated input rows
    give repeated nodes: remove them before (distinct_rows) or after. Nulls, empty tables: no nodes; extra columns of
    df are ignored. A null key is kept as null.
    """
    key_type = df.schema[key].dataType.simpleString()

    def emit(doc: str, r: Resolved, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        if objects_only:
            at = np.flatnonzero(r.element)
            fields: list[str | None] = [None] * len(at)
        else:
            at = np.arange(len(r.kind))
            fields = [r.field(i) if k in (SCALAR, NULL) else None for i, k in enumerate(r.a.kind)]
        of = np.array(r.a.rows, np.int32)[r.document[at]]
        columns = [keys.take(pa.array(of)), pa.array([doc]).take(pa.array(np.zeros(len(at), np.int8))), *r.rows(at, fields)]
        yield pa.RecordBatch.from_arrays(columns, [key, "doc", "node", "parent", "label", "ordinal", "kind", "arr_path", "arr_pos", "value", "owner", "field"])

    return _tables(df, key, documents, emit, f"`{key}` {key_type}, {NODE_TYPE}")


def elements(df: DataFrame, key: str, documents: Mapping[str, Iterable[str]], links: bool = False) -> DataFrame:
    """(key, side, arr_path, arr_pos) of every object that stands in a declared array, without repeats: the element
    nodes of the adjacency table joined with the arrays that hold them. links adds parent_path and parent_pos, those of
    the element that encloses it (null where that is the top object)."""
    key_type = df.schema[key].dataType.simpleString()
    names = [key, "side", "arr_path", "arr_pos", *(["parent_path", "parent_pos"] if links else [])]

    def emit(doc: str, r: Resolved, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        at = np.concatenate(r.levels) if r.levels else np.zeros(0, np.int64)
        position, paths = r.positions(), pa.array(r.paths)
        placed = lambda i: [paths.take(pa.array(r.place[i], mask=~r.element[i])), pa.array([position[k] for k in i.tolist()], pa.string())]
        of = np.array(r.a.rows, np.int32)[r.document[at]]
        columns = [keys.take(pa.array(of)), pa.array([doc]).take(pa.array(np.zeros(len(at), np.int8))), *placed(at)]
        yield pa.RecordBatch.from_arrays([*columns, *(placed(r.owner[at]) if links else [])], names)

    return _tables(df, key, documents, emit, f"`{key}` {key_type}" + "".join(f", {n} string" for n in names[1:])).distinct()


def entities(df: DataFrame, key: str, arrays: Iterable[str], doc: str, arr_path: str | None, fields: Iterable[str]) -> DataFrame:
    """entity_table() of one document column in one pass: object nodes joined with their scalars and pivoted within the
    batch, so that only finished rows are shuffled, to drop those of repeated input rows. A scalar of a repeated field
    cannot be: a key keeps its last value."""
    fields = list(fields)
    if any(f.count(".") >= FIELD_DEPTH for f in fields):
        raise ValueError(f"a field has at most {FIELD_DEPTH} labels")
    key_type = df.schema[key].dataType.simpleString()
    names = [key, "doc", "node", "parent", "owner", "arr_path", "arr_pos", "parent_pos", *_field_names(key, fields)]
    slot = {f: i for i, f in enumerate(fields)}

    def emit(_: str, r: Resolved, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        at = r.tops if arr_path is None else np.flatnonzero(r.element & (r.place == r.paths.index(arr_path)))
        place = np.full(len(r.kind), -1, np.int64)
        place[at] = np.arange(len(at))
        cells: list[list] = [[None] * len(at) for _ in fields]
        scalars = np.flatnonzero((r.kind == SCALAR) & (place[r.owner] >= 0) & (r.owner >= 0))
        for i, p in zip(scalars.tolist(), place[r.owner[scalars]].tolist()):
            k = slot.get(r.field(i))
            if k is not None:
                cells[k][p] = scalar_text(r.a.value[i])
        position = r.positions()
        first = r.tops[r.document[at]]
        relative = lambda x: pa.array((x - first).astype(np.int32), mask=x < 0)
        own = [position[i] for i in at.tolist()]
        constant = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(at), np.int8)))
        columns = [keys.take(pa.array(np.array(r.a.rows, np.int32)[r.document[at]])), constant(doc), relative(at), relative(r.parent[at]), relative(r.owner[at]), constant(arr_path), pa.array(own, pa.string()), pa.array([p.rpartition(".")[0] or None if p else None for p in own], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.string()) for c in cells]], names)

    schema = f"`{key}` {key_type}, doc string, node int, parent int, owner int, arr_path string, arr_pos string, parent_pos string" + "".join(f", `{n}` string" for n in names[8:])
    return _tables(df, key, {doc: arrays}, emit, schema).distinct()


def _field_names(key: str, fields: Iterable[str]) -> list[str]:
    taken = {key.lower(), "doc", "node", "parent", "owner", "arr_path", "arr_pos", "parent_pos"}
    plain = [f.replace(".", "_") for f in fields]
    return [f"f_{f}" if f.lower() in taken else f for f in plain]


def entity_table(nodes: DataFrame, key: str, doc: str, arr_path: str | None, fields: Iterable[str]) -> DataFrame:
    """One row per object at arr_path (None: the top object of the document), with a column for each scalar in
    `fields` - labels, or dotted labels through plain objects (`org.name` gives the column org_name) - and the parent
    link: object nodes of an adjacency table joined with their scalars, pivoted.

    Scalars are joined on (row key, document, owner); each key's group is one document, so it is bounded by a
    document's size. owner is the node of the enclosing array element or top object (null for the top object itself),
    parent_pos the array position of the enclosing element (null at the first level). A missing or null field is
    null. Fields named like link columns get the prefix `f_`.
    """
    fields = list(fields)
    mine = (F.col("kind") == "element") & (F.col("arr_path") == arr_path) if arr_path is not None else F.col("parent").isNull()
    objects = nodes.where((F.col("doc") == doc) & mine)
    scalars = nodes.where((F.col("doc") == doc) & (F.col("kind") == "scalar") & F.col("field").isin(fields))
    cells = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(n) for f, n in zip(fields, _field_names(key, fields))]
    pivoted = scalars.groupBy(key, "doc", F.col("owner").alias("node")).agg(*cells)
    up = F.when(F.col("arr_pos").contains("."), F.regexp_replace("arr_pos", r"\.[^.]*$", ""))
    objects = objects.select(key, "doc", "node", "parent", "owner", "arr_path", "arr_pos", up.alias("parent_pos"))
    return objects.join(pivoted, [key, "doc", "node"], "left")


def array_objects(nodes: DataFrame, key: str) -> DataFrame:
    """(key, side, arr_path, arr_pos) of the element nodes of an adjacency table, without repeats."""
    return nodes.where(F.col("kind") == "element").select(key, F.col("doc").alias("side"), "arr_path", "arr_pos").distinct()
