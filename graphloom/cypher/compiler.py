"""Clauses to DataFrames: the whole query is one logical plan for Catalyst; only updates and unbounded walks act."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..graph import Graph
from . import ast as A
from .analyzer import analyze, has_aggregate, is_aggregate
from .expressions import Binding, Expressions, col, whole
from .lexer import CypherError
from .parser import parse
from .patterns import Patterns, fresh, joined
from .procedures import PROCEDURES
from .updates import Updates


@dataclass(frozen=True)
class Result:
    """The graph after the query, and the rows of its RETURN (None without one)."""

    graph: Graph
    rows: DataFrame | None


def run(graph: Graph, text: str, params: dict | None = None, procedures: dict | None = None) -> Result:
    """Runs a query; the given graph stays as it is, updates are in the result's graph."""
    tree = parse(text)
    graph = graph.keyed()  # relationships of one MATCH are told apart by their numbers
    known = PROCEDURES | (procedures or {})
    queries = tree.queries if isinstance(tree, A.Union) else (tree,)
    outs = []
    for q in queries:
        analyze(q, known)
        done = Compiler(graph, params or {}, known).query(q)
        graph = done.graph
        outs.append(done.rows)
    if len(outs) == 1:
        return Result(graph, outs[0])
    if any(o is None or o.columns != outs[0].columns for o in outs):
        raise CypherError("the queries of a UNION return the same columns")
    rows = reduce(DataFrame.union, outs)
    return Result(graph, rows if tree.all else rows.distinct())


def cypher(graph: Graph, text: str, params: dict | None = None, procedures: dict | None = None) -> DataFrame:
    """The rows that a query returns; columns are named as the items are written or aliased."""
    rows = run(graph, text, params, procedures).rows
    if rows is None:
        raise CypherError("the query returns nothing")
    return rows


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return rows.select(F.to_json(F.struct(*[col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


class Compiler:
    def __init__(self, graph: Graph, params: dict, procedures: dict) -> None:
        self.graph, self.params, self.procedures = graph, params, procedures
        self.rows: DataFrame | None = None
        self.env: dict[str, Binding] = {}

    @property
    def spark(self) -> SparkSession:
        return self.graph.vertices.sparkSession

    def here(self) -> DataFrame:
        """The rows so far; one row without columns of meaning at the beginning."""
        if self.rows is None:
            self.rows = self.spark.range(1).select(F.lit(1).alias(fresh("unit")))
        return self.rows

    def query(self, q: A.Query) -> Result:
        out = None
        for c in q.clauses:
            if isinstance(c, A.Match):
                self.optional(c) if c.optional else self.match(c)
            elif isinstance(c, A.Unwind):
                self.unwind(c)
            elif isinstance(c, A.With):
                self.project(c.projection)
            elif isinstance(c, A.Return):
                out = self.returned(c.projection)
            elif isinstance(c, A.CallProcedure):
                self.call(c)
                if c is q.clauses[-1]:
                    out = self.rows.select(*[whole(b).alias(n) for n, b in self.env.items()])
            else:
                u = Updates(self)
                u.apply(c)
        return Result(self.graph, out)

    # --- expressions with patterns inside

    def expressions(self) -> Expressions:
        return Expressions(self.here(), self.env, self.params)

    def lifted(self, e: A.Node) -> A.Node:
        """The expression with its patterns computed as columns of the rows: each is compiled once from the distinct
        values of the variables that it shares with the rows, and joined back on their keys."""

        def change(n: A.Node) -> A.Node:
            if isinstance(n, A.PatternExpr):
                return A.Column_(self.subquery((n.pattern,), n.where, None))
            if isinstance(n, A.Exists):
                return A.Column_(self.subquery(n.patterns, n.where, None))
            if isinstance(n, A.PatternComprehension):
                return A.Column_(self.subquery((n.pattern,), n.where, n.body))
            if isinstance(n, A.Call) and n.name.lower() in ("size", "exists") and n.args and isinstance(n.args[0], A.PatternExpr):
                p = n.args[0]
                if n.name.lower() == "exists":
                    return change(p)
                return A.Call("size", (A.Column_(self.subquery((p.pattern,), p.where, A.Literal(1))),))
            return n

        return A.rebuild(e, change)

    def subquery(self, parts: tuple[A.Part, ...], where: A.Node | None, body: A.Node | None) -> str:
        """Column with whether the pattern is there (no body) or the list of the body's values over its matches."""
        rows = self.here()
        mentioned = set().union(*[A.variables(x) for x in (*parts, where, body) if x is not None])
        shared = [n for n in self.env if n in mentioned]
        name = fresh("s")
        inner = self.inner(parts, where, shared)
        keys = list(dict.fromkeys(self.env[n].key for n in shared))
        value = F.lit(True) if body is None else inner.expressions()(inner.lifted(body))
        agg = F.first(F.lit(True)) if body is None else F.collect_list(value)
        aliases = [fresh("k") for _ in keys]
        found = inner.here().groupBy(*[col(k).alias(a) for k, a in zip(keys, aliases)]).agg(agg.alias(name))
        if not keys:
            # one row in either case; a list of matches is as long as they are many, so it is not broadcast by a hint
            self.rows = rows.crossJoin(found.select(F.coalesce(name, F.lit(False)).alias(name)) if body is None else found)
            return name
        on = reduce(lambda a, c: a & c, [col(k).eqNullSafe(col(a)) for k, a in zip(keys, aliases)])
        out = rows.join(found, on, "left").drop(*aliases)
        empty = F.lit(False) if body is None else F.array().cast(found.schema[name].dataType)
        self.rows = out.withColumn(name, F.coalesce(col(name), empty))
        return name

    def inner(self, parts: tuple[A.Part, ...], where: A.Node | None, shared: list[str]) -> Compiler:
        """A compiler that has matched parts from the distinct values of the shared variables."""
        c = Compiler(self.graph, self.params, self.procedures)
        if shared:
            bound = {n: self.env[n] for n in shared}
            columns = list(dict.fromkeys(x for b in bound.values() for x in b.fields.values()))
            keys = list(dict.fromkeys(b.key for b in bound.values()))
            c.rows, c.env = self.here().select(*[col(x) for x in columns]).dropDuplicates(keys), bound
            # an optional match may have left a variable null: such a row matches nothing
            for b in bound.values():
                if b.kind in ("node", "relationship"):
                    c.rows = c.rows.where(col(b.key).isNotNull())
        c.match(A.Match(False, parts, where))
        return c

    # --- reading clauses

    def match(self, c: A.Match) -> None:
        self.rows, self.env = Patterns(self.graph, self.params).match(self.rows, self.env, c.parts)
        if c.where is not None:
            where = self.lifted(c.where)
            self.rows = self.rows.where(self.expressions()(where).cast("boolean"))

    def optional(self, c: A.Match) -> None:
        mentioned = set().union(*[A.variables(x) for x in (*c.parts, c.where) if x is not None])
        shared = [n for n in self.env if n in mentioned]
        inner = self.inner(c.parts, c.where, shared)
        rows, found = self.here(), inner.here()
        keys = list(dict.fromkeys(self.env[n].key for n in shared))
        held = {x for n in shared for x in self.env[n].fields.values()}
        aliases = {k: fresh("k") for k in keys}
        new = [x for n, b in inner.env.items() if n not in self.env for x in b.fields.values() if x not in held]
        found = found.select(*[col(k).alias(a) for k, a in aliases.items()], *[col(x) for x in dict.fromkeys(new)])
        on = reduce(lambda a, x: a & x, [col(k).eqNullSafe(col(a)) for k, a in aliases.items()], F.lit(True))
        self.rows = rows.join(found, on, "left").drop(*aliases.values())
        self.env = self.env | {n: b for n, b in inner.env.items() if n not in self.env}

    def unwind(self, c: A.Unwind) -> None:
        e = self.lifted(c.expr)
        name = fresh("u")
        x = self.expressions()
        value = x(e)
        if isinstance(x.type_of(value), T.NullType):
            value = F.array().cast("array<string>")
        elif not isinstance(x.type_of(value), T.ArrayType):
            value = F.array(value)
        self.rows = self.here().withColumn(name, F.explode(value))
        self.env = self.env | {c.var: Binding("value", {"value": name})}

    def call(self, c: A.CallProcedure) -> None:
        p = self.procedures[c.name.lower()]
        args = []
        for a in c.args:
            if isinstance(a, A.Param):
                args.append(self.params[a.name])
            elif isinstance(a, A.Literal):
                args.append(a.value)
            elif isinstance(a, A.Unary) and isinstance(a.arg, A.Literal):
                args.append(-a.arg.value if a.op == "-" else a.arg.value)
            else:
                raise CypherError("a procedure's arguments are constants or parameters")
        df = p.run(self.graph, *args)
        env = dict(self.env)
        columns = []
        for name, alias in c.yields or tuple((n, n) for n in p.columns):
            column = fresh("y")
            columns.append(col(name).alias(column))
            env[alias] = Binding("value", {"value": column})
        self.rows, self.env = joined(self.rows, df.select(*columns)), env
        if c.where is not None:
            where = self.lifted(c.where)
            self.rows = self.rows.where(self.expressions()(where).cast("boolean"))

    # --- projections

    def project(self, p: A.Projection) -> None:
        """WITH, and all of RETURN but the final columns: the new rows and variables."""
        items = [A.Item(A.Var(n), n, True) for n in self.env] if p.star else []
        items += list(p.items)
        before = self.env
        if any(has_aggregate(i.expr) for i in items):
            self.aggregate(items)
            before = {}
        else:
            env: dict[str, Binding] = {}
            for i in items:
                if isinstance(i.expr, A.Var) and i.expr.name in self.env:
                    env[i.alias] = self.env[i.expr.name]
                    continue
                e = self.lifted(i.expr)
                column = fresh("c")
                self.rows = self.here().withColumn(column, self.expressions()(e))
                env[i.alias] = Binding("value", {"value": column})
            self.env = env
        if p.distinct:
            self.rows = self.here().dropDuplicates(list(dict.fromkeys(b.key for b in self.env.values())))
            before = {}
        if p.order:
            known = {i.expr: i.alias for i in reversed(items)}
            env = self.env
            self.env = before | env
            keys = []
            for e, up in p.order:
                e = A.rebuild(e, lambda n: A.Var(known[n]) if n in known else n) if not (isinstance(e, A.Var) and e.name in env) else e
                c = self.order_key(self.lifted(e))
                keys.append(c.asc_nulls_last() if up else c.desc_nulls_first())
            self.rows = self.here().orderBy(*keys)
            self.env = env
        if p.skip is not None:
            self.rows = self.here().offset(self.bound(p.skip))
        if p.limit is not None:
            self.rows = self.here().limit(self.bound(p.limit))
        kept = list(dict.fromkeys(x for b in self.env.values() for x in b.fields.values()))
        self.rows = self.here().select(*[col(x) for x in kept]) if kept else self.here()
        if p.where is not None:
            where = self.lifted(p.where)
            self.rows = self.rows.where(self.expressions()(where).cast("boolean"))

    def order_key(self, e: A.Node) -> Column:
        if isinstance(e, A.Var) and self.env[e.name].kind in ("node", "relationship"):
            return col(self.env[e.name].key)
        return self.expressions()(e)

    def bound(self, e: A.Node) -> int:
        v = self.params.get(e.name) if isinstance(e, A.Param) else e.value if isinstance(e, A.Literal) else None
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherError("SKIP and LIMIT take a whole number from 0 on")
        return v

    def aggregate(self, items: list[A.Item]) -> None:
        """Items without an aggregate are the grouping keys; a node or relationship groups by its id."""
        keys = [i for i in items if not has_aggregate(i.expr)]
        rest = [i for i in items if has_aggregate(i.expr)]
        calls: dict[A.Node, str] = {}

        def collect(n: A.Node) -> A.Node:
            if is_aggregate(n):
                return A.Column_(calls.setdefault(n, fresh("a")))
            return n

        post = [A.rebuild(i.expr, collect) for i in rest]
        env: dict[str, Binding] = {}
        group: list[str] = []
        carried: list[str] = []
        for i in keys:
            if isinstance(i.expr, A.Var) and i.expr.name in self.env:
                b = env[i.alias] = self.env[i.expr.name]
                group.append(b.key)
                carried += [x for x in b.fields.values() if x != b.key]
            else:
                e = self.lifted(i.expr)
                column = fresh("g")
                self.rows = self.here().withColumn(column, self.expressions()(e))
                env[i.alias] = Binding("value", {"value": column})
                group.append(column)
        aggs = []
        for call, name in calls.items():
            args = () if isinstance(call, A.CountStar) else tuple(self.lifted(a) for a in call.args)
            column = self.aggregate_of(call, args)
            aggs.append(column.alias(name))
        group = list(dict.fromkeys(group))
        aggs += [F.first(col(x)).alias(x) for x in dict.fromkeys(carried) if x not in group]
        self.rows = self.here().groupBy(*[col(g) for g in group]).agg(*aggs)
        # what is left around the aggregates may use the grouping keys
        known = {i.expr: i.alias for i in keys}
        self.env = env
        new: dict[str, Binding] = {}
        for i, e in zip(rest, post):
            e = A.rebuild(e, lambda n: A.Var(known[n]) if n in known else n)
            for v in A.variables(e) - set(env):
                raise CypherError(f"`{v}` is neither grouped nor aggregated in {i.alias}")
            column = fresh("c")
            self.rows = self.rows.withColumn(column, self.expressions()(e))
            new[i.alias] = Binding("value", {"value": column})
        self.env = {i.alias: (env | new)[i.alias] for i in items}

    def aggregate_of(self, call: A.Node, args: tuple[A.Node, ...]) -> Column:
        if isinstance(call, A.CountStar):
            return F.count(F.lit(1))
        name = call.name.lower()
        x = self.expressions()
        first = args[0]
        element = isinstance(first, A.Var) and self.env.get(first.name) is not None and self.env[first.name].kind in ("node", "relationship")
        value = col(self.env[first.name].key) if element and name == "count" else x(first)
        if name in ("sum", "avg", "stdev", "stdevp", "percentilecont", "percentiledisc") and isinstance(x.type_of(value), T.StringType):
            value = value.try_cast("double")
        if name.startswith("percentile"):
            p = args[1].value if isinstance(args[1], A.Literal) else self.params[args[1].name]
            if name == "percentilecont":
                return F.percentile(value, float(p))
            column = fresh("q")
            self.rows = self.here().withColumn(column, value)
            kind = self.rows.schema[column].dataType
            return F.expr(f"percentile_disc({float(p)}) within group (order by `{column}`)").cast(kind)
        if name == "count":
            return F.count_distinct(value) if call.distinct else F.count(value)
        if name == "sum":
            return F.coalesce(F.sum_distinct(value) if call.distinct else F.sum(value), F.lit(0))
        if name == "collect":
            return F.collect_set(value) if call.distinct else F.collect_list(value)
        plain = {"avg": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}[name]
        if call.distinct and name == "avg":
            return F.expr("avg(distinct " + self.named(value) + ")")
        return plain(value)

    def named(self, value: Column) -> str:
        column = fresh("d")
        self.rows = self.here().withColumn(column, value)
        return f"`{column}`"

    def returned(self, p: A.Projection) -> DataFrame:
        self.project(p)
        return self.rows.select(*[whole(b).alias(n) for n, b in self.env.items()])
