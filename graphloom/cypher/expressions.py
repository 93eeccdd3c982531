"""Expressions to columns. Three-valued logic is SQL's; strings meet numbers by try_cast, never by an error."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import ast as A
from .functions import SCALARS, SIZED
from .lexer import CypherError


@dataclass(frozen=True)
class Binding:
    """What a variable stands for: columns of the current rows. fields: property or system field -> column name."""

    kind: str  # node, relationship, relationships, path, value
    fields: dict[str, str]

    @property
    def key(self) -> str:
        """The column that identifies the value."""
        return self.fields["id" if self.kind == "node" else "eid" if self.kind == "relationship" else "value"]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Expressions:
    def __init__(self, rows: DataFrame, env: dict[str, Binding], params: dict, local: dict[str, Column] | None = None) -> None:
        self.rows, self.env, self.params, self.local = rows, env, params, local or {}

    def inside(self, **local: Column) -> Expressions:
        return Expressions(self.rows, self.env, self.params, self.local | local)

    def type_of(self, c: Column) -> T.DataType | None:
        """The column's type; None where it hangs on a lambda's variable."""
        log = logging.getLogger("DataFrameQueryContextLogger")
        was, log.disabled = log.disabled, True
        try:
            return self.rows.select(c.alias("x")).schema[0].dataType
        except AnalysisException:
            return None
        finally:
            log.disabled = was

    # --- values

    def __call__(self, e: A.Node) -> Column:
        return getattr(self, "_" + type(e).__name__.lower().rstrip("_"))(e)

    def _literal(self, e: A.Literal) -> Column:
        return self.constant(e.value)

    def constant(self, v) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[self.constant(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.constant(x).alias(k) for k, x in v.items()])
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("bigint")
        return F.lit(v)

    def _param(self, e: A.Param) -> Column:
        if e.name not in self.params:
            raise CypherError(f"parameter ${e.name} is not given")
        return self.constant(self.params[e.name])

    def _column(self, e: A.Column_) -> Column:
        return col(e.name)

    def _var(self, e: A.Var) -> Column:
        if e.name in self.local:
            return self.local[e.name]
        return whole(self.env[e.name])

    def _prop(self, e: A.Prop) -> Column:
        if isinstance(e.base, A.Var) and e.base.name not in self.local:
            b = self.env[e.base.name]
            if b.kind in ("node", "relationship"):
                return self.property(b, e.key)
        base = self(e.base)
        kind = self.type_of(base)
        if isinstance(kind, T.StructType) and e.key not in kind.names:
            return F.lit(None)
        if isinstance(kind, T.MapType):
            return F.try_element_at(base, F.lit(e.key))
        return base.getField(e.key)

    def property(self, b: Binding, key: str) -> Column:
        if key in b.fields:
            return col(b.fields[key])
        if "props" in b.fields:
            return F.try_element_at(col(b.fields["props"]), F.lit(key))
        return F.lit(None).cast("string")

    def _haslabels(self, e: A.HasLabels) -> Column:
        b = self.env[e.base.name] if isinstance(e.base, A.Var) and e.base.name in self.env else None
        if b is None:
            raise CypherError("a label test needs a node variable")
        if b.kind == "relationship":
            return col(b.fields["type"]).isin(*e.labels)
        return has_labels(b, e.labels)

    def _mapof(self, e: A.MapOf) -> Column:
        return F.struct(*[self(v).alias(k) for k, v in e.items]) if e.items else F.lit(None)

    def _listof(self, e: A.ListOf) -> Column:
        items = [self(x) for x in e.items]
        kinds = {type(self.type_of(c)) for c in items} - {T.NullType, type(None)}
        if len(kinds) > 1 and T.StringType in kinds:
            items = [c.cast("string") for c in items]
        return F.array(*items)

    def _index(self, e: A.Index) -> Column:
        base = self(e.base)
        kind = self.type_of(base)
        if isinstance(kind, T.MapType):
            return F.try_element_at(base, self(e.at))
        if isinstance(kind, T.StructType):
            return base.getField(str(e.at.value)) if isinstance(e.at, A.Literal) and e.at.value in kind.names else F.lit(None)
        at = self(e.at)
        return F.try_element_at(base, F.when(at >= 0, at + 1).otherwise(at).cast("int"))

    def _slice(self, e: A.Slice) -> Column:
        base = self(e.base)
        n = F.size(base)
        place = lambda c: F.least(F.greatest(F.when(c < 0, c + n).otherwise(c), F.lit(0)), n)
        a = place(self(e.start)) if e.start is not None else F.lit(0)
        b = place(self(e.stop)) if e.stop is not None else n
        return F.slice(base, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    # --- operators

    def _unary(self, e: A.Unary) -> Column:
        c = self(e.arg)
        return ~c.cast("boolean") if e.op == "NOT" else -c if e.op == "-" else c

    def _chain(self, e: A.Chain) -> Column:
        out, left = None, e.first
        for op, right in e.rest:
            one = self.compare(op, left, right)
            out, left = one if out is None else out & one, right
        return out

    def compare(self, op: str, left: A.Node, right: A.Node) -> Column:
        bound = [self.env[x.name] if isinstance(x, A.Var) and x.name not in self.local and self.env[x.name].kind in ("node", "relationship") else None for x in (left, right)]
        if all(bound) and op in ("=", "<>"):
            same = col(bound[0].key) == col(bound[1].key) if bound[0].kind == bound[1].kind else F.lit(False)
            return same if op == "=" else ~same
        return self.compared(op, self(left), self(right))

    def compared(self, op: str, a: Column, b: Column) -> Column:
        ta, tb = self.type_of(a), self.type_of(b)
        if isinstance(ta, T.StringType) and isinstance(tb, _NUMERIC):
            a, ta = a.try_cast("double"), T.DoubleType()
        elif isinstance(tb, T.StringType) and isinstance(ta, _NUMERIC):
            b, tb = b.try_cast("double"), T.DoubleType()
        elif isinstance(ta, T.StringType) and isinstance(tb, T.BooleanType):
            a = a.try_cast("boolean")
        elif isinstance(tb, T.StringType) and isinstance(ta, T.BooleanType):
            b = b.try_cast("boolean")
        elif isinstance(ta, T.BooleanType) and isinstance(tb, _NUMERIC) or isinstance(tb, T.BooleanType) and isinstance(ta, _NUMERIC):
            never = F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "<>"))
            return never if op in ("=", "<>") else F.lit(None).cast("boolean")
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def _binary(self, e: A.Binary) -> Column:
        if e.op == "AND":
            return self(e.left).cast("boolean") & self(e.right).cast("boolean")
        if e.op == "OR":
            return self(e.left).cast("boolean") | self(e.right).cast("boolean")
        if e.op == "XOR":
            return self(e.left).cast("boolean") != self(e.right).cast("boolean")
        a, b = self(e.left), self(e.right)
        if e.op == "IN":
            return self.member(a, b, e)
        if e.op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            return {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[e.op](a, b) if e.op != "=~" else F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        ta, tb = self.type_of(a), self.type_of(b)
        if e.op == "+":
            if isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType):
                return F.concat(a if isinstance(ta, T.ArrayType) else F.array(a), b if isinstance(tb, T.ArrayType) else F.array(b))
            if any(isinstance(t, T.StringType) or isinstance(x, A.Literal) and isinstance(x.value, str) for t, x in ((ta, e.left), (tb, e.right))):
                return F.concat(a.cast("string"), b.cast("string"))
            return a + b
        if e.op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        a, b = (x.try_cast("double") if isinstance(t, T.StringType) else x for x, t in ((a, ta), (b, tb)))
        if e.op == "/":
            if isinstance(ta, _WHOLE) and isinstance(tb, _WHOLE):
                q = F.abs(a) - F.abs(a) % F.nullif(F.abs(b), F.lit(0))
                return (F.signum(a) * F.signum(b) * (q / F.nullif(F.abs(b), F.lit(0)))).cast("bigint")
            return F.try_divide(a, b)
        if e.op == "%":
            return F.try_mod(a, b)
        return a - b if e.op == "-" else a * b

    def member(self, a: Column, b: Column, e: A.Binary) -> Column:
        if isinstance(e.right, A.ListOf):
            tests = [self.compared("=", a, self(x)) for x in e.right.items]
            return reduce(lambda p, q: p | q, tests) if tests else F.lit(False)
        return F.exists(b, lambda x: x == a)

    def _isnull(self, e: A.IsNull) -> Column:
        if isinstance(e.arg, A.Var) and e.arg.name in self.env and e.arg.name not in self.local and self.env[e.arg.name].kind in ("node", "relationship"):
            c = col(self.env[e.arg.name].key)
        else:
            c = self(e.arg)
        return c.isNotNull() if e.negated else c.isNull()

    def _case(self, e: A.Case) -> Column:
        out = None
        subject = self(e.subject) if e.subject is not None else None
        for cond, value in e.whens:
            test = self(cond) if subject is None else self.compared("=", subject, self(cond))
            out = F.when(test, self(value)) if out is None else out.when(test, self(value))
        return out.otherwise(self(e.otherwise)) if e.otherwise is not None else out

    # --- lists

    def _comprehension(self, e: A.Comprehension) -> Column:
        out = self(e.source)
        if e.where is not None:
            out = F.filter(out, lambda x: self.inside(**{e.var: x})(e.where))
        return F.transform(out, lambda x: self.inside(**{e.var: x})(e.body)) if e.body is not None else out

    def _quantifier(self, e: A.Quantifier) -> Column:
        source, test = self(e.source), lambda x: self.inside(**{e.var: x})(e.where)
        if e.kind == "single":
            return F.size(F.filter(source, test)) == 1
        return {"all": F.forall, "any": F.exists}.get(e.kind, lambda s, t: ~F.exists(s, t))(source, test)

    def _reduce(self, e: A.Reduce) -> Column:
        return F.aggregate(self(e.source), self(e.start), lambda acc, x: self.inside(**{e.acc: acc, e.var: x})(e.body))

    # --- functions

    def _call(self, e: A.Call) -> Column:
        name = e.name.lower()
        first = e.args[0] if e.args else None
        b = self.env.get(first.name) if isinstance(first, A.Var) and first.name not in self.local else None
        if name == "id" and b is not None:
            return col(b.key)
        if name == "labels" and b is not None:
            return labels_of(b)
        if name == "type" and b is not None:
            return col(b.fields["type"])
        if name in ("startnode", "endnode") and b is not None:
            return col(b.fields["src" if name == "startnode" else "dst"])
        if name in ("properties", "keys") and b is not None and b.kind in ("node", "relationship"):
            system = ("id", "label", "labels", "props") if b.kind == "node" else ("eid", "src", "dst", "type", "props")
            own = [(k, c) for k, c in b.fields.items() if k not in system]
            if name == "properties":
                return F.struct(*[col(c).alias(k) for k, c in own]) if own else col(b.fields["props"]) if "props" in b.fields else F.lit(None)
            there = F.filter(F.array(*[F.when(col(c).isNotNull(), F.lit(k)) for k, c in own]), lambda k: k.isNotNull()) if own else F.array().cast("array<string>")
            return F.concat(there, F.map_keys(col(b.fields["props"]))) if "props" in b.fields else there
        if b is not None and b.kind in ("path", "relationships") and name in ("nodes", "relationships", "length", "size"):
            value = col(b.fields["value"])
            steps = value if b.kind == "relationships" else value.getField("relationships")
            return F.size(steps) if name in ("length", "size") else value.getField(name) if b.kind == "path" else steps
        args = [self(a) for a in e.args]
        if name in SIZED:
            return SIZED[name](args[0], args[0] is not None and (self.type_of(args[0]) or T.ArrayType(T.LongType())).simpleString())
        if name == "exists":
            return args[0].isNotNull()
        if name == "keys":
            kind = self.type_of(args[0])
            return F.array(*[F.lit(n) for n in kind.names]) if isinstance(kind, T.StructType) else F.map_keys(args[0])
        if name == "isempty" and isinstance(self.type_of(args[0]), T.StringType):
            return F.length(args[0]) == 0
        if name not in SCALARS:
            raise CypherError(f"there is no function {e.name}")
        try:
            return SCALARS[name](*args)
        except TypeError as err:
            raise CypherError(f"{e.name} does not take {len(args)} arguments") from err


def whole(b: Binding) -> Column:
    """A variable as one value: a struct of its columns, null where an optional match found nothing."""
    if b.kind in ("node", "relationship"):
        return F.when(col(b.key).isNotNull(), F.struct(*[col(c).alias(k) for k, c in b.fields.items()]))
    return col(b.fields["value"])


def has_labels(b: Binding, labels: tuple[str, ...]) -> Column:
    if "labels" in b.fields:
        return reduce(lambda a, c: a & c, [F.array_contains(col(b.fields["labels"]), label) for label in labels])
    if "label" in b.fields:
        return reduce(lambda a, c: a & c, [col(b.fields["label"]) == label for label in labels])
    return F.lit(False)


def labels_of(b: Binding) -> Column:
    if "labels" in b.fields:
        return col(b.fields["labels"])
    return F.when(col(b.fields["label"]).isNotNull(), F.array(col(b.fields["label"]))).otherwise(F.array().cast("array<string>"))
