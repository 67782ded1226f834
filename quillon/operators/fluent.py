"""Fluent queries: the same statements as SQL's, built from Python.

    db.query("orders").filter(field("o_totalprice") > 100).order_by("o_orderdate").limit(10).execute()
"""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import Row

from quillon.functions.errors import refuse
from quillon.operators.paging import Page, exact_keys, grouped_page, scalar_page
from quillon.plans import nodes as N
from quillon.plans.admission import PUBLIC, GroupLimits, Policy, ReadIntent, admit
from quillon.plans.compile import Scope
from quillon.plans.select import Source, run, sort_columns, total_order

MAX_KEYS, MAX_KEY_BYTES = 1024, 256 << 10


def lit(v: Any) -> Any:
    if isinstance(v, Expr):
        return v.node
    if isinstance(v, N.Lit | N.Field | N.Func | N.Binary):
        return v
    kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "decimal" if isinstance(v, float | Decimal) else "blob" if isinstance(v, bytes) else "text"
    return N.Lit(Decimal(str(v)) if kind == "decimal" else v if kind in ("null", "bool", "int", "blob") else str(v), kind)


class Expr:
    """A value or condition. Comparisons, arithmetic and the methods below give new ones."""

    def __init__(self, node: Any) -> None:
        self.node = node

    def _op(self, op: str, other: Any) -> Expr:
        return Expr(N.Binary(op, self.node, lit(other)))

    def _fn(self, name: str, *args: Any) -> Expr:
        return Expr(N.Func(name, (self.node, *map(lit, args))))

    eq = __eq__ = lambda self, o: self._op("=", o)  # type: ignore[assignment]
    ne = __ne__ = lambda self, o: self._op("!=", o)  # type: ignore[assignment]
    lt = __lt__ = lambda self, o: self._op("<", o)
    lte = __le__ = lambda self, o: self._op("<=", o)
    gt = __gt__ = lambda self, o: self._op(">", o)
    gte = __ge__ = lambda self, o: self._op(">=", o)
    add = __add__ = lambda self, o: self._op("+", o)
    sub = __sub__ = lambda self, o: self._op("-", o)
    mul = __mul__ = lambda self, o: self._op("*", o)
    div = __truediv__ = lambda self, o: self._op("/", o)
    __and__ = lambda self, o: self._op("AND", o)
    __or__ = lambda self, o: self._op("OR", o)
    __invert__ = lambda self: Expr(N.Unary("NOT", self.node))
    __hash__ = None  # type: ignore[assignment]

    eq_field = lambda self, f: self._op("=", field(f))
    ne_field = lambda self, f: self._op("!=", field(f))
    lt_field = lambda self, f: self._op("<", field(f))
    lte_field = lambda self, f: self._op("<=", field(f))
    gt_field = lambda self, f: self._op(">", field(f))
    gte_field = lambda self, f: self._op(">=", field(f))

    def in_(self, *values: Any) -> Expr:
        return Expr(N.InList(self.node, tuple(map(lit, values))))

    def not_in(self, *values: Any) -> Expr:
        return Expr(N.InList(self.node, tuple(map(lit, values)), True))

    def between(self, low: Any, high: Any) -> Expr:
        return (self >= low) & (self <= high)

    def not_between(self, low: Any, high: Any) -> Expr:
        return (self < low) | (self > high)

    def between_fields(self, low: str, high: str) -> Expr:
        return self.between(field(low), field(high))

    def not_between_fields(self, low: str, high: str) -> Expr:
        return self.not_between(field(low), field(high))

    is_null = lambda self: Expr(N.Test("NULL", self.node))
    is_not_null = lambda self: Expr(N.Test("NULL", self.node, True))
    is_missing = lambda self: Expr(N.Test("MISSING", self.node))
    is_empty = lambda self: Expr(N.Test("EMPTY", self.node))
    is_not_empty = lambda self: Expr(N.Test("EMPTY", self.node, True))
    contains_item = lambda self, v: self._fn("COLLECTION_CONTAINS", v)
    eq_ci = text_eq_ci = lambda self, v: self._fn("EQ_CI", v)
    contains = text_contains = lambda self, v: self._fn("CONTAINS", v)
    contains_ci = text_contains_ci = lambda self, v: self._fn("CONTAINS_CI", v)
    starts_with = lambda self, v: self._fn("STARTS_WITH", v)
    starts_with_ci = lambda self, v: self._fn("STARTS_WITH_CI", v)
    ends_with = lambda self, v: self._fn("ENDS_WITH", v)
    ends_with_ci = lambda self, v: self._fn("ENDS_WITH_CI", v)
    round = lambda self, scale=0: self._fn("ROUND", scale)
    trunc = lambda self, scale=0: self._fn("TRUNC", scale)
    trim = lambda self: self._fn("TRIM")
    ltrim = lambda self: self._fn("LTRIM")
    rtrim = lambda self: self._fn("RTRIM")
    lower = lambda self: self._fn("LOWER")
    upper = lambda self: self._fn("UPPER")
    length = lambda self: self._fn("LENGTH")
    left = lambda self, n: self._fn("LEFT", n)
    right = lambda self, n: self._fn("RIGHT", n)
    replace = lambda self, a, b: self._fn("REPLACE", a, b)
    substring = lambda self, start, *n: self._fn("SUBSTRING", start, *n)
    position = lambda self, needle: Expr(N.Func("POSITION", (lit(needle), self.node)))
    alias = lambda self, name: N.Item(self.node, name)


def field(path: str) -> Expr:
    return Expr(N.Field(tuple(path.split("."))))


def fn(name: str, *args: Any) -> Expr:
    """A scalar function by its SQL name."""
    return Expr(N.Func(name.upper(), tuple(map(lit, args))))


def true() -> Expr:
    return Expr(N.Lit(True, "bool"))


def false() -> Expr:
    return Expr(N.Lit(False, "bool"))


def agg(name: str, arg: Any = None, distinct: bool = False, where: Expr | None = None) -> Expr:
    """COUNT, SUM, AVG, MIN, MAX, FIRST, LAST or EXISTS; without argument MIN to LAST give primary keys."""
    arg = field(arg).node if isinstance(arg, str) else None if arg is None else lit(arg)
    return Expr(N.Agg(name.upper(), arg, distinct, where.node if where is not None else None))


class Query:
    """An immutable query of one entity. Policy PUBLIC refuses what its lane doesn't admit."""

    def __init__(self, db: Any, entity: str, s: N.Select | None = None, policy: Policy | None = None, intent: ReadIntent = ReadIntent.UNSPECIFIED) -> None:
        self.db, self.entity, self.s, self.policy, self.intent = db, entity, s or N.Select(entity), policy, intent

    def _with(self, **new: Any) -> Query:
        return Query(self.db, self.entity, replace(self.s, **new), self.policy, self.intent)

    def public(self) -> Query:
        return Query(self.db, self.entity, self.s, PUBLIC, ReadIntent.PUBLIC_PAGE)

    def intended(self, intent: ReadIntent) -> Query:
        """The query with a declared intent, which its metrics name."""
        return Query(self.db, self.entity, self.s, self.policy, intent)

    def execute_complete_small_set(self, most: int = 100) -> list[Row]:
        """All rows, or an error if there are more than `most`: never a part of them."""
        rows = run(replace(self.s, limit=most + 1), self._source()).collect()
        return rows if len(rows) <= most else refuse("complete_set", f"more than {most} rows")

    def filter(self, e: Expr) -> Query:
        return self._with(where=e.node if self.s.where is None else N.Binary("AND", self.s.where, e.node))

    def select(self, *items: Any) -> Query:
        return self._with(items=self.s.items + tuple(i if isinstance(i, N.Item) else N.Item(field(i).node if isinstance(i, str) else lit(i)) for i in items))

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def order_by(self, *terms: Any) -> Query:
        return self._with(order=self.s.order + tuple(N.Order(field(t).node if isinstance(t, str) else lit(t)) for t in terms))

    def order_by_desc(self, *terms: Any) -> Query:
        return self._with(order=self.s.order + tuple(N.Order(field(t).node if isinstance(t, str) else lit(t), True) for t in terms))

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def group_by(self, *fields: str) -> Query:
        return self._with(group=self.s.group + tuple(field(f).node for f in fields), items=self.s.items + tuple(N.Item(field(f).node) for f in fields))

    def aggregate(self, **named: Expr) -> Query:
        return self._with(items=self.s.items + tuple(N.Item(e.node, n) for n, e in named.items()))

    def having(self, e: Expr) -> Query:
        return self._with(having=e.node)

    def _source(self) -> Source:
        src = self.db.source(self.entity)
        self.db.intents[self.intent] += 1
        if self.policy is not None:
            admit(self.s, src.schema, self.policy)
        return src

    def execute(self) -> DataFrame:
        first = [i.expr for i in self.s.items if isinstance(i.expr, N.Agg) and i.expr.name in ("FIRST", "LAST")]
        if first and not self.s.group:
            refuse("terminal", "FIRST and LAST of a whole query are first() and last()")
        return run(self.s, self._source())

    def execute_grouped(self, limits: GroupLimits = GroupLimits(), cursor: str | None = None) -> Page:  # noqa: B008
        """A page of groups; more groups than the budget's fail the read."""
        src = self._source()
        run(replace(self.s, limit=None, order=()), src, limits.max_groups, limits.max_bytes, limits.max_distinct)
        return grouped_page(self.s, src, self.db.secret, cursor)

    def execute_live_page(self, cursor: str | None = None) -> Page:
        return scalar_page(self.s, self._source(), self.db.secret, cursor, None)

    def execute_exhaustive_page(self, cursor: str | None = None) -> Page:
        """A page of a walk over one version; a change of the entity ends the walk with restart_required."""
        return scalar_page(self.s, self._source(), self.db.secret, cursor, self.db.revision(self.entity))

    def pages(self, exhaustive: bool = False):
        cursor, step = None, self.execute_exhaustive_page if exhaustive else self.execute_live_page
        while True:
            page = step(cursor)
            yield page
            if (cursor := page.cursor) is None:
                return

    def execute_exact_count(self) -> int:
        if self.s.group or self.s.distinct or any(N.has_aggregate(i.expr) for i in self.s.items):
            refuse("count_shape", "an exact count is of a scalar query")
        return run(replace(self.s, items=(N.Item(N.Field((self.db.schema(self.entity).key[0],))),), order=() if self.s.limit is None and not self.s.offset else self.s.order), self._source()).count()

    def exists(self) -> bool:
        return not run(replace(self.s, order=(), limit=1), self._source()).isEmpty()

    def _edge(self, last: bool) -> Any:
        """The primary key of the first or last row in the query's order."""
        src = self._source()
        scope = Scope(src.schema)
        df = run(replace(self.s, items=(), order=self.s.order), src)
        terms = [(c, desc != last) for c, desc in total_order(self.s, scope)]
        row = df.orderBy(*sort_columns(terms)).limit(1).select(*src.schema.key).collect()
        return None if not row else row[0][0] if len(src.schema.key) == 1 else tuple(row[0])

    def first(self) -> Any:
        return self._edge(False)

    def last(self) -> Any:
        return self._edge(True)

    def terminal(self, e: Expr) -> Any:
        """The value of one global aggregate over the query's window."""
        return run(replace(self.s, items=(N.Item(e.node, "value"),)), self._source()).first()["value"]

    def get(self, key: Any) -> Row | None:
        return self.get_many([key])[0]

    def get_many(self, keys: list[Any]) -> list[Row | None]:
        """Rows of primary keys, by position; repeated keys repeat, missing ones give None."""
        if len(keys) > MAX_KEYS or len(repr(keys)) > MAX_KEY_BYTES:
            refuse("key_bound", f"at most {MAX_KEYS} keys")
        src = self.db.source(self.entity)
        wanted = [k if isinstance(k, tuple) else (k,) for k in keys]
        found = exact_keys(src.df, src.schema.key, wanted).collect() if keys else []
        return [None if r[src.schema.key[0]] is None else Row(*src.df.columns)(*r[1:]) for r in found]

    def explain(self, mode: str = "LOGICAL") -> str:
        from quillon.plans.explain import explain

        src = self.db.source(self.entity)  # nothing runs
        return explain(self.s, src.schema, run(self.s, src), mode)


__all__ = ["Expr", "Query", "ReadIntent", "agg", "false", "field", "fn", "lit", "true"]
