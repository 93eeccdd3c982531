"""Patterns to joins: a pattern graph over vertices and edges becomes equi-joins that Catalyst orders and executes.

Each pattern variable is bound to flat columns, one per field, so that Catalyst prunes what a query does not use.
"""

from __future__ import annotations

from dataclasses import replace as changed
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph
from ..runtime import materialize
from . import ast as A
from .expressions import Binding, Expressions, col, has_labels
from .lexer import CypherError

_numbers = count()


def fresh(stem: str) -> str:
    return f"{stem}{next(_numbers)}"


def bind(df: DataFrame, kind: str, stem: str) -> tuple[DataFrame, Binding]:
    """df with fresh column names, and the binding to them."""
    n = fresh(stem)
    fields = {c: f"{n}_{c}" for c in df.columns}
    return df.select(*[col(c).alias(a) for c, a in fields.items()]), Binding(kind, fields)


def joined(rows: DataFrame | None, other: DataFrame, on: Column | None = None) -> DataFrame:
    if rows is None:
        return other if on is None else other.where(on)
    return rows.crossJoin(other) if on is None else rows.join(other, on)


class Patterns:
    def __init__(self, graph: Graph, params: dict) -> None:
        self.graph, self.params = graph, params

    # --- elements

    def constrained(self, rows: DataFrame, b: Binding, labels: tuple[str, ...], props: A.MapOf | A.Param | None, env: dict[str, Binding]) -> DataFrame:
        """rows where the element has all labels and all inline properties."""
        tests = [has_labels(b, labels)] if labels else []
        x = Expressions(rows, env, self.params)
        if isinstance(props, A.Param):
            props = A.MapOf(tuple((k, A.Literal(v)) for k, v in self.params[props.name].items()))
        for key, value in props.items if props else ():
            tests.append(x.compared("=", x.property(b, key), x(value)))
        return rows.where(reduce(lambda a, c: a & c, tests)) if tests else rows

    def node(self, rows: DataFrame | None, env: dict[str, Binding], n: A.NodePattern, at: Column | None) -> tuple[DataFrame, Binding]:
        """rows joined with the vertices that a node pattern matches; at: the id to join on, if there is one."""
        inner = n.props is not None and not A.variables(n.props)
        v, b = bind(self.graph.vertices, "node", "v")
        v = self.constrained(v, b, n.labels, n.props if inner else None, {})
        rows = joined(rows, v, at == col(b.key) if at is not None else None)
        return (rows if inner or n.props is None else self.constrained(rows, b, (), n.props, env)), b

    def oriented(self, r: A.RelPattern, flip: bool) -> tuple[DataFrame, Binding]:
        """Edges that a relationship pattern matches, with __a (near end) and __b (far end). flip: walked from the
        pattern's right node to its left one."""
        e = self.graph.edges
        if r.types:
            e = e.where(F.col("type").isin(*r.types))
        out = e.withColumns({"__a": F.col("src"), "__b": F.col("dst")})
        back = e.withColumns({"__a": F.col("dst"), "__b": F.col("src")})
        way = r.direction if self.graph.directed else "both"
        if flip and way != "both":
            way = "in" if way == "out" else "out"
        if way == "both":
            out = out.unionByName(back.where(F.col("src") != F.col("dst")))
        df, b = bind(out if way != "in" else back, "relationship", "e")
        if r.props is not None and not A.variables(r.props):
            df = self.constrained(df, b, (), r.props, {})
        return df, b

    # --- a whole MATCH

    def match(self, rows: DataFrame | None, env: dict[str, Binding], parts: tuple[A.Part, ...]) -> tuple[DataFrame, dict[str, Binding]]:
        env = dict(env)
        used: list[tuple[A.RelPattern, Binding]] = []
        # parts that hang on bound variables first, so that a product is made only where nothing links them
        todo = list(parts)
        while todo:
            part = next((p for p in todo if any(n.var in env for n in p.nodes)), todo[0])
            todo.remove(part)
            rows = self.part(rows, env, part, used)
        return rows, env

    def part(self, rows: DataFrame | None, env: dict[str, Binding], part: A.Part, used: list) -> DataFrame:
        nodes, rels = part.nodes, part.rels
        found: list[Binding | None] = [env.get(n.var) if n.var else None for n in nodes]
        steps: list[Binding | None] = [None] * len(rels)
        start = next((i for i, b in enumerate(found) if b is not None), None)
        if start is None:
            weight = [bool(n.props) * 2 + bool(n.labels) for n in nodes]
            start = weight.index(max(weight))
        n = nodes[start]
        if found[start] is not None:
            rows = self.constrained(rows, found[start], n.labels, n.props, env)
        elif n.var is None and not n.labels and n.props is None and rels and not rels[min(start, len(rels) - 1)].variable:
            found[start] = None  # the first edge brings its near end along
        else:
            rows, found[start] = self.node(rows, env, n, None)
            if n.var:
                env[n.var] = found[start]
        order = [(i, i + 1, False) for i in range(start, len(rels))] + [(i, i, True) for i in range(start - 1, -1, -1)]
        for i, to, flip in order:
            near = i + 1 if flip else i
            to = i if flip else i + 1
            rows, steps[i], found[near], found[to] = self.step(rows, env, rels[i], flip, nodes[near], nodes[to], found[near], found[to], used)
        if part.path:
            rows = self.path(rows, env, part, found, steps)
        return rows

    def step(self, rows, env, r: A.RelPattern, flip: bool, near_node, node: A.NodePattern, near: Binding | None, far: Binding | None, used: list):
        if r.var and r.var in env:
            raise CypherError(f"relationship `{r.var}` is already bound")
        if node.var and far is None:
            far = env.get(node.var)
        if r.variable:
            rows, rel, end = self.walk(rows, near, r, flip, self.ends(node, far))
        else:
            e, rel = self.oriented(r, flip)
            on = [col(near.key) == col(rel.fields["__a"])] if near is not None else []
            if far is not None:
                on.append(col(far.key) == col(rel.fields["__b"]))
            rows = joined(rows, e, reduce(lambda a, c: a & c, on) if on else None)
            if near is None:
                near = Binding("node", {"id": rel.fields["__a"]})
            end = rel.fields["__b"]
            rel = changed(rel, fields={k: c for k, c in rel.fields.items() if k not in ("__a", "__b")})
            if r.props is not None and A.variables(r.props):
                rows = self.constrained(rows, rel, (), r.props, env)
        if far is None:
            if node.var is None and not node.labels and node.props is None:
                far = Binding("node", {"id": end})  # nothing is asked of the vertex: its id is the edge's end
            else:
                rows, far = self.node(rows, env, node, col(end))
        else:
            if r.variable:
                rows = rows.where(col(far.key) == col(end))
            rows = self.constrained(rows, far, node.labels, node.props, env)
        if node.var:
            env[node.var] = far
        rows = self.unique(rows, r, rel, used)
        if r.var:
            env[r.var] = rel
        return rows, rel, near, far

    def unique(self, rows: DataFrame, r: A.RelPattern, rel: Binding, used: list) -> DataFrame:
        """No edge stands for two relationships of one MATCH. Patterns of different types cannot meet."""
        for other_pattern, other in used:
            if r.types and other_pattern.types and not set(r.types) & set(other_pattern.types):
                continue
            many = [b.kind == "relationships" for b in (rel, other)]
            if not any(many):
                rows = rows.where(col(rel.key) != col(other.key))
            elif all(many):
                ids = [F.transform(col(b.key), lambda x: x["eid"]) for b in (rel, other)]
                rows = rows.where(~F.arrays_overlap(*ids))
            else:
                one, several = (other, rel) if many[0] else (rel, other)
                rows = rows.where(~F.exists(col(several.key), lambda x: x["eid"] == col(one.key)))
        used.append((r, rel))
        return rows

    def ends(self, node: A.NodePattern, far: Binding | None) -> DataFrame | None:
        """(__end): vertices where a walk may end, if the end's pattern says so by itself."""
        inner = node.props is not None and not A.variables(node.props)
        if far is not None or not (node.labels or inner):
            return None
        v, b = bind(self.graph.vertices, "node", "v")
        return self.constrained(v, b, node.labels, node.props if inner else None, {}).select(col(b.key).alias("__end"))

    def walk(self, rows: DataFrame, near: Binding, r: A.RelPattern, flip: bool, ends: DataFrame | None) -> tuple[DataFrame, Binding, str]:
        """Paths of low to high edges, no edge twice: one join per length. Frontiers of three edges and more that are
        walked on from are written to the shared folder, so each edge join runs once; without an upper bound the walk
        goes on until no path grows, which it must, since no edge is taken twice. Where the wanted ends are known and
        the length is bounded, a path only takes edges from whose far end an end can still be reached."""
        stem = fresh("w")
        value, end = f"{stem}_value", f"{stem}_end"
        low = r.low if r.low is not None else 1
        empty = F.expr("cast(array() as array<struct<eid:bigint,type:string,src:bigint,dst:bigint,to:bigint>>)")
        frontier = rows.withColumns({value: empty, end: col(near.key).cast("bigint")})
        reached = [frontier] if low == 0 else []
        leads = self.leading(r, flip, ends, r.high - 1) if ends is not None and r.high is not None else None
        for k in count(1) if r.high is None else range(1, r.high + 1):
            e, b = self.oriented(r, flip)
            f = b.fields
            hop = F.struct(*[col(f[c]).cast(t).alias(c) for c, t in (("eid", "bigint"), ("type", "string"), ("src", "bigint"), ("dst", "bigint"))], col(f["__b"]).cast("bigint").alias("to"))
            if leads is not None:
                e = e.join(leads[r.high - k], col(f["__b"]) == F.col("__end"), "left_semi")
            e = e.select(col(f["__a"]).alias("__near"), hop.alias("__hop"))
            grown = frontier.join(e, col(end) == F.col("__near")).where(~F.exists(col(value), lambda x: x["eid"] == F.col("__hop.eid")))
            grown = grown.withColumns({value: F.concat(col(value), F.array("__hop")), end: F.col("__hop.to")})
            frontier = grown.drop("__near", "__hop")
            if k > 2 and k != r.high:
                frontier = materialize(frontier, "walk")
                if r.high is None and frontier.isEmpty():
                    break
            if k >= low:
                reached.append(frontier)
        out = reduce(DataFrame.unionByName, reached)
        if flip:
            out = out.withColumn(value, F.reverse(col(value)))
        return out, Binding("relationships", {"value": value}), end

    def leading(self, r: A.RelPattern, flip: bool, ends: DataFrame, most: int) -> list[DataFrame]:
        """(__end) by number of edges, 0 to `most`: vertices from which at most so many edges lead to a wanted end. Each
        is written out, so that its size is known where edges are held against it."""
        out = [ends]
        for _ in range(most):
            e, b = self.oriented(r, flip)
            more = e.join(out[-1], col(b.fields["__b"]) == F.col("__end"), "left_semi").select(col(b.fields["__a"]).alias("__end"))
            out.append(materialize(out[-1].unionByName(more).distinct(), "leading"))
        return out

    def path(self, rows: DataFrame, env, part: A.Part, found: list, steps: list) -> DataFrame:
        """A named path: its node ids and its relationships in pattern order."""
        node = lambda c: F.struct(c.cast("bigint").alias("id"))
        nodes, rels = [F.array(node(col(found[0].key)))], []
        for i, b in enumerate(steps):
            if b.kind == "relationships":
                inner = F.transform(col(b.key), lambda x: F.struct(x["to"].alias("id")))
                nodes.append(inner)
                rels.append(F.transform(col(b.key), lambda x: F.struct(x["eid"].alias("eid"), x["type"].alias("type"), x["src"].alias("src"), x["dst"].alias("dst"))))
            else:
                f = b.fields
                rels.append(F.array(F.struct(col(f["eid"]).cast("bigint").alias("eid"), col(f["type"]).cast("string").alias("type"), col(f["src"]).cast("bigint").alias("src"), col(f["dst"]).cast("bigint").alias("dst"))))
                nodes.append(F.array(node(col(found[i + 1].key))))
        none = F.expr("cast(array() as array<struct<eid:bigint,type:string,src:bigint,dst:bigint>>)")
        name = fresh("p")
        env[part.path] = Binding("path", {"value": name})
        return rows.withColumn(name, F.struct(F.concat(*nodes).alias("nodes"), (F.concat(*rels) if rels else none).alias("relationships")))
