"""Updating clauses as pure functions: each gives a new graph. The rows are written out first, since what they were
matched from changes; ids of new elements follow the largest one there is."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..graph import Graph
from ..runtime import materialize
from . import ast as A
from .expressions import Binding, Expressions, col
from .lexer import CypherError
from .patterns import bind, fresh

if TYPE_CHECKING:
    from .compiler import Compiler

SYSTEM = {"node": ("id", "label", "labels"), "relationship": ("eid", "src", "dst", "type")}


class Updates:
    def __init__(self, compiler: Compiler) -> None:
        self.c = compiler

    def apply(self, clause: A.Node) -> None:
        if isinstance(clause, A.Create):
            self.settle()
            for part in clause.parts:
                self.create(part)
        elif isinstance(clause, A.Merge):
            self.merge(clause)
        elif isinstance(clause, A.SetClause):
            self.settle()
            for item in clause.items:
                self.set(item)
        elif isinstance(clause, A.Remove):
            self.settle()
            for item in clause.items:
                self.remove(item)
        elif isinstance(clause, A.Delete):
            self.settle()
            self.delete(clause)

    def settle(self) -> None:
        self.c.rows = materialize(self.c.here(), "rows")

    # --- tables

    def table(self, kind: str) -> DataFrame:
        return self.c.graph.vertices if kind == "node" else self.c.graph.edges

    def put(self, kind: str, df: DataFrame) -> None:
        g = self.c.graph
        self.c.graph = Graph(df, g.edges, g.directed) if kind == "node" else Graph(g.vertices, df, g.directed)

    def numbered(self, kind: str, name: str) -> None:
        """Adds a new id to every row: the largest one, plus the row's number within its partition and an offset by
        partition, so no single task sees all rows."""
        key = "id" if kind == "node" else "eid"
        top = self.table(kind).agg(F.coalesce(F.max(key), F.lit(-1))).scalar()
        rows = self.c.rows.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
        rows = materialize(rows, "numbered")
        sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).select("__part", "__before")
        rank = F.col("__n") - F.shiftleft(F.col("__part").cast("bigint"), 33)
        rows = rows.join(sizes, "__part").withColumn(name, top + 1 + F.col("__before") + rank)
        self.c.rows = materialize(rows.drop("__part", "__n", "__before"), "rows")

    def properties(self, props: A.MapOf | A.Param | None) -> dict[str, Column]:
        if isinstance(props, A.Param):
            props = A.MapOf(tuple((k, A.Literal(v)) for k, v in self.c.params[props.name].items()))
        x = self.c.expressions()
        return {k: x(v) for k, v in (props.items if props else ())}

    def add(self, kind: str, rows: DataFrame, columns: dict[str, Column]) -> None:
        """New elements. A property that the table lacks becomes a new column, or an entry where there is a props map."""
        old = self.table(kind)
        own = {k: c for k, c in columns.items() if k in old.columns or k in SYSTEM[kind] or "props" not in old.columns}
        extra = {k: c for k, c in columns.items() if k not in own}
        if extra:
            pairs = [p for k, c in extra.items() for p in (F.lit(k), c.cast("string"))]
            own["props"] = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
        typed = [c.cast(old.schema[k].dataType).alias(k) if k in old.columns else c.alias(k) for k, c in own.items()]
        self.put(kind, old.unionByName(rows.select(*typed), allowMissingColumns=True))

    # --- CREATE and MERGE

    def create(self, part: A.Part) -> None:
        c = self.c
        made = []
        for n in part.nodes:
            b = c.env.get(n.var) if n.var else None
            if b is None:
                props = self.properties(n.props)
                name = fresh("n")
                if "id" in props:
                    c.rows = materialize(c.rows.withColumn(name, props.pop("id").cast("bigint")), "rows")
                else:
                    self.numbered("node", name)
                props = {k: v for k, v in self.properties(n.props).items() if k != "id"}
                columns: dict[str, Column] = {"id": col(name)}
                old = c.graph.vertices.columns
                if "labels" in old:
                    columns["labels"] = F.array(*[F.lit(x) for x in n.labels]).cast("array<string>")
                if "label" in old:
                    columns["label"] = F.lit(n.labels[0] if n.labels else None).cast("string")
                self.add("node", c.rows, columns | props)
                b = self.rebound("node", name)
                if n.var:
                    c.env = c.env | {n.var: b}
            made.append(b)
        for i, r in enumerate(part.rels):
            name = fresh("r")
            self.numbered("relationship", name)
            ends = (made[i], made[i + 1]) if r.direction != "in" else (made[i + 1], made[i])
            columns = {"eid": col(name), "src": col(ends[0].key), "dst": col(ends[1].key), "type": F.lit(r.types[0])}
            self.add("relationship", c.rows, columns | self.properties(r.props))
            if r.var:
                c.env = c.env | {r.var: self.rebound("relationship", name)}

    def rebound(self, kind: str, key: str) -> Binding:
        """The binding of the elements whose ids stand in a column of the rows, with their fields joined in."""
        df, b = bind(self.table(kind), kind, "v" if kind == "node" else "e")
        self.c.rows = self.c.rows.join(df, col(key) == col(b.key), "left").drop(key)
        return b

    def refresh(self) -> None:
        """Rejoins all bound elements with the tables as they are now; deleted ones become null."""
        c = self.c
        done: dict[str, Binding] = {}
        for n, b in list(c.env.items()):
            if b.kind not in ("node", "relationship"):
                continue
            if b.key not in done:
                others = {x for m, o in c.env.items() if o.key != b.key for x in o.fields.values()}
                key = fresh("k")
                c.rows = c.rows.withColumn(key, col(b.key)).drop(*[x for x in b.fields.values() if x not in others])
                done[b.key] = self.rebound(b.kind, key)
            c.env = c.env | {n: done[b.key]}

    def merge(self, m: A.Merge) -> None:
        """Rows that match keep their matches; for the others the pattern is created, once for rows that agree in all
        that the pattern mentions."""
        c = self.c
        c.rows = materialize(c.here(), "rows") if c.env else None
        from .compiler import Compiler

        before, env = c.rows, c.env
        reader = Compiler(c.graph, c.params, c.procedures)
        reader.rows, reader.env = before, env
        reader.match(A.Match(False, (m.part,), None))
        matched = materialize(reader.here(), "matched")
        if before is None:
            lost = c.spark.range(0 if not matched.isEmpty() else 1).select(F.lit(1).alias(fresh("unit")))
        else:
            keys = list(dict.fromkeys(x for b in env.values() for x in [b.key]))
            there = matched.select(*[col(k).alias(f"__{k}") for k in keys]).distinct()
            on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__{k}")) for k in keys])
            lost = before.join(there, on, "left_anti")
        lost = materialize(lost, "lost")
        new_names = [n for n in reader.env if n not in env]
        tables = []
        if not matched.isEmpty():
            c.rows, c.env = matched, reader.env
            for item in m.on_match:
                self.set(item)
            tables.append((c.rows, c.env))
        if not lost.isEmpty():
            mentioned = A.variables(m.part) & set(env)
            keys = [env[n].key for n in mentioned]
            values = [x for e in (m.part,) for x in self.value_keys(e, env)]
            one = lost.dropDuplicates(list(dict.fromkeys(keys + values))) if keys or values else lost.limit(1)
            c.rows, c.env = one, env
            self.create(m.part)
            for item in m.on_create:
                self.set(item)
            tables.append((c.rows, c.env))
        # both kinds of rows, with what they matched or made under common names
        frames = []
        shared = {n: {f: fresh("m") for f in set.intersection(*[set(e[n].fields) for _, e in tables])} for n in [*env, *new_names]}
        for rows, e in tables:
            frames.append(rows.select(*[col(e[n].fields[f]).alias(a) for n, fs in shared.items() for f, a in fs.items()]))
        c.rows = materialize(reduce(DataFrame.unionByName, frames), "rows")
        c.env = {n: Binding(tables[0][1][n].kind, fs) for n, fs in shared.items()}
        self.refresh()

    def value_keys(self, part: A.Part, env: dict[str, Binding]) -> list[str]:
        names = set().union(*[A.variables(x.props) for x in (*part.nodes, *part.rels) if x.props is not None] or [set()])
        return [env[n].key for n in names if n in env]

    # --- SET, REMOVE, DELETE

    def change(self, b: Binding, columns: dict[str, Column], rows: DataFrame) -> None:
        """Columns of the elements that the rows hold get new values; of several for one element any one is kept."""
        kind, key = b.kind, "id" if b.kind == "node" else "eid"
        old = self.table(kind)
        news = rows.where(col(b.key).isNotNull()).select(col(b.key).alias("__key"), *[v.alias(f"__new_{k}") for k, v in columns.items()]).dropDuplicates(["__key"])
        both = old.join(news, F.col(key) == F.col("__key"), "left")
        out = []
        for c in [*old.columns, *[k for k in columns if k not in old.columns]]:
            if c not in columns:
                out.append(col(c))
            elif c in old.columns:
                new = col(f"__new_{c}").cast(old.schema[c].dataType)
                out.append(F.when(F.col("__key").isNotNull(), new).otherwise(col(c)).alias(c))
            else:
                out.append(col(f"__new_{c}").alias(c))
        self.put(kind, materialize(both.select(*out), "updated"))
        self.refresh()
        self.c.rows = materialize(self.c.rows, "rows")

    def set(self, s: A.SetItem) -> None:
        c = self.c
        b = c.env[s.var]
        old = self.table(b.kind).columns
        if s.kind == "labels":
            columns: dict[str, Column] = {}
            if "labels" in old:
                columns["labels"] = F.array_union(F.coalesce(col(b.fields["labels"]), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in s.labels]))
            if "label" in old:
                columns["label"] = F.lit(s.labels[-1])
            return self.change(b, columns, c.rows)
        x: Expressions = c.expressions()
        if s.kind == "prop":
            return self.change(b, self.keyed(b, {s.key: x(c.lifted(s.value))}), c.rows)
        if isinstance(s.value, A.Param):
            values = {k: x.constant(v) for k, v in c.params[s.value.name].items()}
        elif isinstance(s.value, A.MapOf):
            values = {k: x(v) for k, v in s.value.items}
        else:
            raise CypherError("SET takes a map or a parameter here")
        if s.kind == "replace":
            none = {k: F.lit(None) for k in old if k not in SYSTEM[b.kind]}
            values = none | values
            return self.change(b, {k: v for k, v in values.items() if k not in SYSTEM[b.kind]}, c.rows)
        self.change(b, self.keyed(b, values), c.rows)

    def keyed(self, b: Binding, values: dict[str, Column]) -> dict[str, Column]:
        """New columns by property; properties without a column of their own go into the props map if there is one."""
        own = {k: v for k, v in values.items() if k in b.fields or "props" not in b.fields}
        extra = {k: v for k, v in values.items() if k not in own}
        if extra:
            there = F.map_filter(col(b.fields["props"]), lambda k, v: ~k.isin(*extra))
            pairs = [p for k, v in extra.items() for p in (F.lit(k), v.cast("string"))]
            own["props"] = F.map_concat(F.coalesce(there, F.create_map().cast("map<string,string>")), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))
        return own

    def remove(self, s: A.SetItem) -> None:
        b = self.c.env[s.var]
        if s.kind == "prop":
            if s.key in b.fields or "props" in b.fields:
                self.change(b, self.keyed(b, {s.key: F.lit(None).cast("string")}), self.c.rows)
            return
        columns = {}
        if "labels" in b.fields:
            columns["labels"] = F.array_except(col(b.fields["labels"]), F.array(*[F.lit(x) for x in s.labels]))
        if "label" in b.fields:
            columns["label"] = F.when(~col(b.fields["label"]).isin(*s.labels), col(b.fields["label"]))
        self.change(b, columns, self.c.rows)

    def delete(self, d: A.Delete) -> None:
        c = self.c
        g = c.graph
        gone = {k: [c.rows.select(col(c.env[v].key).alias("__gone")) for v in d.vars if c.env[v].kind == k] for k in ("node", "relationship")}
        vertices, edges = g.vertices, g.edges
        if gone["relationship"]:
            ids = reduce(DataFrame.unionByName, gone["relationship"]).distinct()
            edges = edges.join(ids, F.col("eid") == F.col("__gone"), "left_anti")
        if gone["node"]:
            ids = materialize(reduce(DataFrame.unionByName, gone["node"]).distinct(), "gone")
            for end in ("src", "dst"):
                if not d.detach and not edges.join(ids, F.col(end) == F.col("__gone"), "left_semi").isEmpty():
                    raise CypherError("a node with relationships is deleted by DETACH DELETE")
                edges = edges.join(ids, F.col(end) == F.col("__gone"), "left_anti")
            vertices = vertices.join(ids, F.col("id") == F.col("__gone"), "left_anti")
        c.graph = Graph(materialize(vertices, "vertices"), materialize(edges, "edges"), g.directed)
        self.refresh()
