"""Expressions to Spark columns: names and kinds are checked against the schema first, and fail closed.

Comparisons of a field with a literal stay comparisons of the bare column wherever that means the same,
so that Catalyst pushes them to the scan.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions.errors import refuse
from quillon.functions.scalar import Typed
from quillon.functions.schema import UNORDERED, WHOLE, EntitySchema, FieldSpec
from quillon.plans import nodes as N

FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


def kind_name(f: FieldSpec) -> str:
    if f.kind in WHOLE:
        return "int"
    return {"decimal": "dec", "float32": "float", "float64": "float", "timestamp": "ts"}.get(f.kind, f.kind)


class Scope:
    """What names mean: fields of an entity, or outputs of an aggregation by node."""

    def __init__(self, schema: EntitySchema, alias: str | None = None, outputs: dict | None = None) -> None:
        self.schema, self.alias, self.outputs = schema, alias, outputs or {}

    def strip(self, path: tuple[str, ...]) -> tuple[str, ...]:
        own = {self.schema.name.lower(), (self.alias or self.schema.name).lower()}
        if len(path) > 1 and path[0].lower() in own and not any(f.name.lower() == path[0].lower() for f in self.schema.fields):
            return path[1:]
        return path

    def spec(self, path: tuple[str, ...]) -> FieldSpec:
        path = self.strip(path)
        f = self.schema.field(path[0])
        for p in path[1:]:
            if f.kind != "record":
                refuse("unknown_field", ".".join(path))
            f = next((x for x in f.of if x.name.lower() == p.lower()), None) or refuse("unknown_field", ".".join(path))
        return f

    def field(self, path: tuple[str, ...]) -> Typed:
        f, at = self.spec(path), self.strip(path)
        names = [self.schema.field(at[0]).name, *at[1:]]
        col = F.col(".".join(f"`{n}`" for n in names))
        return Typed(col, kind_name(f), f.scale if f.kind == "decimal" else 0)


def literal(x: N.Lit) -> Typed:
    if x.kind == "int":
        if abs(x.value) < 2**63:
            return Typed(F.lit(x.value), "int")
        return Typed(F.lit(Decimal(x.value)), "dec", 0)
    if x.kind == "decimal":
        return Typed(F.lit(x.value), "dec", max(0, -x.value.as_tuple().exponent))
    if x.kind == "null":
        return Typed(F.lit(None), "null")
    return Typed(F.lit(bytearray(x.value) if x.kind == "blob" else x.value), x.kind)


def bound(x: N.Lit, kind: str) -> Typed:
    """A text literal as a value of another field kind."""
    if x.kind == "text" and kind in ("ts", "date"):
        try:
            v = dt.datetime.fromisoformat(x.value)
        except ValueError:
            refuse("type_mismatch", f"{x.value!r} is no {kind}")
        return Typed(F.lit(v.date()) if kind == "date" else F.lit(v.isoformat(sep=" ")).cast("timestamp"), kind)
    if x.kind == "text" and kind in ("ulid", "enum", "intbig", "natbig"):
        return Typed(F.lit(x.value), kind)
    if x.kind == "blob" and kind in ("principal", "subaccount"):
        return Typed(F.lit(bytearray(x.value)), kind)
    return literal(x)


def _whole_shift(x: Any, scope: Scope) -> tuple[N.Field, int] | None:
    """(field, shift) of field + c or field - c over a whole-number field."""
    if isinstance(x, N.Binary) and x.op in "+-" and isinstance(x.left, N.Field) and isinstance(x.right, N.Lit) and x.right.kind == "int" and x.left not in scope.outputs and kind_name(scope.spec(x.left.path)) == "int":
        return x.left, x.right.value if x.op == "+" else -x.right.value
    return None


def compare(op: str, left: Any, right: Any, scope: Scope) -> Typed:
    if isinstance(left, N.Lit) and not isinstance(right, N.Lit):
        op, left, right = FLIP[op], right, left
    if isinstance(right, N.Lit) and right.kind == "int" and (shift := _whole_shift(left, scope)) and abs(right.value - shift[1]) < 2**63:
        left, right = shift[0], N.Lit(right.value - shift[1], "int")
    a = typed(left, scope)
    b = bound(right, a.kind) if isinstance(right, N.Lit) else typed(right, scope)
    x, y = a.col, b.col
    if "null" in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), "bool")
    if a.kind != b.kind or a.kind == "dec":
        if not {a.kind, b.kind} <= S.NUMERIC:
            refuse("type_mismatch", f"{a.kind} can't be compared with {b.kind}")
        if a.kind == "float" and isinstance(right, N.Lit) and len(str(right.value).replace("-", "").replace(".", "")) <= 15:
            y = F.lit(float(right.value))  # the shortest text of a double orders as the double does
        elif a.kind == "int" and isinstance(right, N.Lit) and right.kind == "decimal":
            y = F.lit(right.value)
        else:
            x, y = S.decimal(a).col, S.decimal(b).col
    elif op not in ("=", "!=") and a.kind in UNORDERED:
        refuse("type_mismatch", f"{a.kind} has no order")
    return Typed({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")


def boolean(x: Any, scope: Scope) -> Column:
    t = typed(x, scope)
    if t.kind not in ("bool", "null"):
        refuse("type_mismatch", f"a condition is needed, not {t.kind}")
    return t.col.cast("boolean")


def typed(x: Any, scope: Scope) -> Typed:
    """The column and kind of an expression."""
    if x in scope.outputs:
        return scope.outputs[x]
    if isinstance(x, N.Lit):
        return literal(x)
    if isinstance(x, N.Field):
        if scope.outputs:
            refuse("ungrouped_field", ".".join(x.path))
        return scope.field(x.path)
    if isinstance(x, N.Unary):
        if x.op == "NOT":
            return Typed(~boolean(x.x, scope), "bool")
        d = S.decimal(typed(x.x, scope))
        return Typed(-d.col, "dec", d.scale)
    if isinstance(x, N.Binary):
        if x.op in ("AND", "OR"):
            a, b = boolean(x.left, scope), boolean(x.right, scope)
            return Typed(a & b if x.op == "AND" else a | b, "bool")
        if x.op in FLIP:
            return compare(x.op, x.left, x.right, scope)
        return S.arithmetic(x.op, typed(x.left, scope), typed(x.right, scope))
    if isinstance(x, N.InList):
        known = [i for i in x.items if i.kind != "null"]
        target = typed(x.x, scope)
        if isinstance(x.x, N.Field) and known and len({i.kind for i in known}) == 1 and target.kind in (known[0].kind, "date", "ts", "ulid", "enum"):
            hit = target.col.isin([bound(i, target.kind).col for i in known])
        else:
            hit = reduce(lambda a, b: a | b, [compare("=", x.x, i, scope).col for i in known], F.lit(False))
        if len(known) < len(x.items):
            hit = hit | F.lit(None).cast("boolean")
        hit = F.when(target.col.isNull(), None).otherwise(hit) if len(known) < len(x.items) or not known else hit
        return Typed(~hit if x.negated else hit, "bool")
    if isinstance(x, N.Test):
        t = typed(x.x, scope)
        if x.what == "NULL":
            return Typed(t.col.isNotNull() if x.negated else t.col.isNull(), "bool")
        if x.what == "MISSING":
            return Typed(F.lit(x.negated), "bool")
        size = F.char_length(t.col) if t.kind == "text" else F.size(t.col) if t.kind in ("list", "set", "map") else None
        empty = F.lit(False) if size is None else F.coalesce((size > 0) if x.negated else (size == 0), F.lit(False))
        return Typed(F.when(t.col.isNull(), False).otherwise(empty), "bool")
    if isinstance(x, N.Case):
        values = [typed(v, scope) for _, v in x.arms] + [typed(x.default, scope) if x.default is not None else Typed(F.lit(None), "null")]
        cols, to = S.align(values, "CASE")
        out = F.when(boolean(x.arms[0][0], scope), cols[0])
        for (c, _), v in zip(x.arms[1:], cols[1:-1], strict=True):
            out = out.when(boolean(c, scope), v)
        return Typed(out.otherwise(cols[-1]), to.kind, to.scale)
    if isinstance(x, N.Func):
        return call(x, scope)
    if isinstance(x, N.Agg):
        refuse("misplaced_aggregate", x.name)
    raise TypeError(x)


def call(x: N.Func, scope: Scope) -> Typed:
    name = S.ALIASES.get(x.name, x.name)
    if name in ("ROUND", "TRUNC"):
        if not 1 <= len(x.args) <= 2:
            refuse("arity", f"{name} takes 1 or 2 arguments")
        scale = 0
        if len(x.args) == 2:
            s = x.args[1]
            if not isinstance(s, N.Lit) or s.kind != "int" or not 0 <= s.value <= 28:
                refuse("scale", f"{name} takes a whole scale from 0 to 28")
            scale = s.value
        return (S.round_ if name == "ROUND" else S.trunc)(typed(x.args[0], scope), scale)
    if name == "COLLECTION_CONTAINS":
        t, item = typed(x.args[0], scope), x.args[1]
        if t.kind not in ("list", "set"):
            return Typed(F.lit(False), "bool")
        return Typed(F.coalesce(F.array_contains(t.col, literal(item).col), F.lit(False)), "bool")
    if name not in S.FUNCTIONS:
        refuse("unknown_function", x.name)
    least, most, f = S.FUNCTIONS[name]
    if not least <= len(x.args) <= most:
        refuse("arity", f"{name} takes {least} to {most} arguments")
    return f(*(typed(a, scope) for a in x.args))


def aggregate(x: N.Agg, scope: Scope, order: list[Column] | None = None) -> Typed:
    """The aggregate as a column; a FILTER admits a row only where it is true."""
    key = [scope.field((k,)) for k in scope.schema.key]
    pk = key[0].col if len(key) == 1 else F.struct(*[k.col for k in key])
    arg = typed(x.arg, scope) if x.arg is not None else Typed(F.lit(1), "int") if x.name in ("COUNT", "EXISTS") else Typed(pk, key[0].kind if len(key) == 1 else "record", key[0].scale)
    if x.distinct and x.where is not None:
        refuse("distinct_filter", "DISTINCT and FILTER don't go together")
    admit = (lambda c: F.when(boolean(x.where, scope), c)) if x.where is not None else (lambda c: c)
    if x.name == "COUNT":
        return Typed((F.count_distinct if x.distinct else F.count)(admit(arg.col)), "int")
    if x.name == "EXISTS":
        return Typed(F.count(admit(F.lit(1))) > 0, "bool")
    if x.name in ("SUM", "AVG"):
        d = S.decimal(arg)
        c = admit(d.col)
        total = (F.sum_distinct if x.distinct else F.sum)(c)
        if x.name == "SUM":
            return Typed(total, "dec", d.scale)
        n = (F.count_distinct if x.distinct else F.count)(c)
        return Typed(F.when(n > 0, S.divide(Typed(total, "dec", d.scale), Typed(n, "int")).col), "dec", 18)
    if x.name in ("MIN", "MAX"):
        if x.arg is not None and arg.kind in UNORDERED:
            refuse("type_mismatch", f"{arg.kind} has no order")
        return Typed((F.min if x.name == "MIN" else F.max)(admit(arg.col)), arg.kind, arg.scale)
    ordering = F.struct(*order) if order else F.struct(*[k.col for k in key])
    return Typed((F.min_by if x.name == "FIRST" else F.max_by)(admit(arg.col), F.when(boolean(x.where, scope), ordering) if x.where is not None else ordering), arg.kind, arg.scale)
