"""SELECT to a DataFrame: scalar, grouped and global-aggregate lanes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.errors import QueryError, refuse
from quillon.functions.schema import UNORDERED, EntitySchema
from quillon.plans import nodes as N
from quillon.plans.compile import Scope, aggregate, boolean, typed

CONDITIONS = {"STARTS_WITH", "ENDS_WITH", "CONTAINS", "STARTS_WITH_CI", "ENDS_WITH_CI", "CONTAINS_CI", "EQ_CI", "COLLECTION_CONTAINS"}
#: Default most groups of SQL.
SQL_GROUPS = 10_000


def render(x: Any) -> str:
    """An expression as text: the name of an output without alias, and the stable part of fingerprints."""
    if isinstance(x, N.Lit):
        return "NULL" if x.value is None else repr(x.value) if x.kind == "text" else str(x.value)
    if isinstance(x, N.Field):
        return ".".join(x.path)
    if isinstance(x, N.Unary):
        return f"({'NOT ' if x.op == 'NOT' else '-'}{render(x.x)})"
    if isinstance(x, N.Binary):
        return f"({render(x.left)} {x.op} {render(x.right)})"
    if isinstance(x, N.InList):
        return f"({render(x.x)} {'NOT ' if x.negated else ''}IN ({', '.join(map(render, x.items))}))"
    if isinstance(x, N.Test):
        return f"({render(x.x)} IS {'NOT ' if x.negated else ''}{x.what})"
    if isinstance(x, N.Func):
        return f"{x.name}({', '.join(map(render, x.args))})"
    if isinstance(x, N.Case):
        arms = " ".join(f"WHEN {render(c)} THEN {render(v)}" for c, v in x.arms)
        return f"CASE {arms}{f' ELSE {render(x.default)}' if x.default is not None else ''} END"
    if isinstance(x, N.Agg):
        out = f"{x.name}({'DISTINCT ' if x.distinct else ''}{'*' if x.arg is None else render(x.arg)})"
        return out + (f" FILTER (WHERE {render(x.where)})" if x.where is not None else "")
    return str(x)


def canonical(x: Any) -> Any:
    """AND and OR flattened and sorted, double NOT removed, literals of comparisons on the right: for fingerprints."""
    if isinstance(x, N.Unary) and x.op == "NOT" and isinstance(x.x, N.Unary) and x.x.op == "NOT":
        return canonical(x.x.x)
    if isinstance(x, N.Binary) and x.op in ("AND", "OR"):
        parts: list[str] = []

        def flat(y: Any) -> None:
            if isinstance(y, N.Binary) and y.op == x.op:
                flat(y.left)
                flat(y.right)
            else:
                parts.append(str(canonical(y)))

        flat(x)
        return f"{x.op}[{', '.join(sorted(set(parts)))}]"
    if isinstance(x, N.Binary) and isinstance(x.left, N.Lit) and x.op in "=!=<=>=":
        return render(N.Binary({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(x.op, x.op), x.right, x.left))
    return render(x) if x is not None else "-"


def fingerprint(s: N.Select, schema: EntitySchema) -> str:
    """SHA-256 of the statement's meaning and the schema that it was planned against."""
    parts = [schema.fingerprint(), s.entity.lower(), [(render(i.expr), i.alias) for i in s.items], canonical(s.where), s.distinct, [render(g) for g in s.group], canonical(s.having), [(render(o.expr), o.desc) for o in s.order], s.limit, s.offset]
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def output_name(i: N.Item) -> str:
    return i.alias or (i.expr.path[-1] if isinstance(i.expr, N.Field) else render(i.expr))


def lane(s: N.Select) -> str:
    return "grouped" if s.group else "global" if any(N.has_aggregate(i.expr) for i in s.items) else "scalar"


def sort_columns(order: list[tuple[Column, bool]]) -> list[Column]:
    """Ascending has nulls first, descending last."""
    return [c.desc_nulls_last() if desc else c.asc_nulls_first() for c, desc in order]


def order_terms(s: N.Select, schema: EntitySchema) -> list[N.Order]:
    """ORDER BY with aliases replaced by what they name; repeated terms are refused."""
    aliases = {i.alias.lower(): i.expr for i in s.items if i.alias}
    out: list[N.Order] = []
    for o in s.order:
        e = o.expr
        if isinstance(e, N.Field) and len(e.path) == 1 and e.path[0].lower() in aliases:
            e = aliases[e.path[0].lower()]
        if any(x.expr == e for x in out) and not (isinstance(e, N.Field) and e.path[-1] in schema.key):
            refuse("duplicate_order", render(e))
        out.append(N.Order(e, o.desc))
    return out


def total_order(s: N.Select, scope: Scope) -> list[tuple[Column, bool]]:
    """The query's order with the primary key behind it."""
    out, seen = [], set()
    for o in order_terms(s, scope.schema):
        t = typed(o.expr, scope)
        if t.kind in UNORDERED or not isinstance(o.expr, N.Field) and t.kind not in ("bool", "text", "int", "dec", "float", "ts", "null"):
            refuse("unordered", f"{render(o.expr)} can't be ordered")
        if isinstance(o.expr, N.Field):
            seen.add(scope.strip(o.expr.path)[-1].lower())
        out.append((t.col, o.desc))
    return out + [(scope.field((k,)).col, False) for k in scope.schema.key if k.lower() not in seen]


def window(df: DataFrame, s: N.Select) -> DataFrame:
    df = df.offset(s.offset) if s.offset else df
    return df.limit(s.limit) if s.limit is not None else df


@dataclass
class Source:
    """An entity to read: its schema and rows."""

    schema: EntitySchema
    df: DataFrame


def _named(items: tuple, scope: Scope) -> list[Column]:
    names = [output_name(i) for i in items]
    if len({n.lower() for n in names}) < len(names):
        refuse("duplicate_output", "two outputs have one name")
    out = []
    for i, n in zip(items, names, strict=True):
        if isinstance(i.expr, N.Lit):
            refuse("literal_projection", "a literal alone can't be projected")
        if isinstance(i.expr, N.Func) and i.expr.name in CONDITIONS:
            refuse("condition_projection", f"{i.expr.name} is for conditions")
        out.append(typed(i.expr, scope).col.alias(n))
    return out


def run(s: N.Select, src: Source, max_groups: int | None = None, max_bytes: int | None = None, max_distinct: int | None = None) -> DataFrame:
    """The statement's rows. A grouped statement over a budget fails as a whole: more than max_groups groups,
    more bytes of their rows, or more values in its DISTINCT aggregates."""
    scope = Scope(src.schema, s.alias)
    df = src.df.filter(boolean(s.where, scope)) if s.where is not None else src.df
    if s.where is not None and N.has_aggregate(s.where):
        refuse("misplaced_aggregate", "WHERE has no aggregates")
    return {"scalar": _scalar, "grouped": _grouped, "global": _global}[lane(s)](s, df, scope, (max_groups, max_bytes, max_distinct))


def _scalar(s: N.Select, df: DataFrame, scope: Scope, _: tuple) -> DataFrame:
    if s.having is not None:
        refuse("having_without_group", "HAVING needs GROUP BY or a global aggregate")
    items = s.items or tuple(N.Item(N.Field((f.name,))) for f in scope.schema.fields)
    if s.distinct:
        out = df.select(*_named(items, scope)).distinct()
        inner = Scope(scope.schema, s.alias, {i.expr: typed(i.expr, scope)._replace(col=F.col(f"`{output_name(i)}`")) for i in items})
        try:
            order = [(typed(o.expr, inner).col, o.desc) for o in order_terms(s, scope.schema)]
        except QueryError as e:
            refuse("distinct_order", f"ORDER BY must derive from the distinct outputs ({e})")
        if order or s.limit is not None or s.offset:
            order += [(F.col(f"`{output_name(i)}`"), False) for i in items if inner.outputs[i.expr].kind not in UNORDERED]
            out = out.orderBy(*sort_columns(order))
        return window(out, s)
    if s.order or s.limit is not None or s.offset:
        df = window(df.orderBy(*sort_columns(total_order(s, scope))), s)
    return df.select(*_named(items, scope))


def _aggregates(s: N.Select) -> list[N.Agg]:
    found: dict[N.Agg, None] = {}
    for e in [*(i.expr for i in s.items), *([s.having] if s.having is not None else []), *(o.expr for o in order_terms_loose(s))]:
        found.update(dict.fromkeys(y for y in N.walk(e) if isinstance(y, N.Agg)))
    return list(found)


def order_terms_loose(s: N.Select) -> list[N.Order]:
    aliases = {i.alias.lower(): i.expr for i in s.items if i.alias}
    return [N.Order(aliases.get(o.expr.path[0].lower(), o.expr) if isinstance(o.expr, N.Field) and len(o.expr.path) == 1 else o.expr, o.desc) for o in s.order]


def _global(s: N.Select, df: DataFrame, scope: Scope, _: tuple) -> DataFrame:
    """Order, offset and limit choose the input rows; terms that name an output of the aggregation are inert."""
    if s.distinct:
        refuse("distinct_aggregate", "SELECT DISTINCT has no global aggregates")
    order = tuple(o for o in order_terms_loose(s) if not N.has_aggregate(o.expr))
    if s.limit is not None or s.offset:
        base = N.Select(s.entity, (), None, order=order, limit=s.limit, offset=s.offset)
        df = window(df.orderBy(*sort_columns(total_order(base, scope))), base)
    aggs = _aggregates(s)
    made = [aggregate(a, scope) for a in aggs]
    out = df.agg(*[t.col.alias(f"__a{i}") for i, t in enumerate(made)])
    after = Scope(scope.schema, s.alias, {a: t._replace(col=F.col(f"__a{i}")) for i, (a, t) in enumerate(zip(aggs, made, strict=True))})
    if s.having is not None:
        out = out.filter(boolean(s.having, after))
    return out.select(*_named(s.items, after))


def _grouped(s: N.Select, df: DataFrame, scope: Scope, budget: tuple) -> DataFrame:
    if not s.items:
        refuse("grouped_star", "a grouped SELECT lists its outputs")
    if len(set(s.group)) < len(s.group):
        refuse("duplicate_group_field", "a group key is there twice")
    seen = False
    for i in s.items:
        seen |= N.has_aggregate(i.expr)
        if seen and i.expr in s.group:
            refuse("grouped_projection_order", "group keys come before aggregates")
    aggs, terms = _aggregates(s), order_terms(s, scope.schema)
    if not aggs:
        refuse("empty_aggregates", "a grouped SELECT has an aggregate")
    if any(N.has_aggregate(o.expr) for o in terms):
        if s.limit is None:
            refuse("grouped_order_limit", "ORDER BY an aggregate needs LIMIT")
    elif any(k >= len(s.group) or o.expr != s.group[k] for k, o in enumerate(terms)):
        refuse("grouped_order_prefix", "ORDER BY follows the group keys in their order")
    keys, made = [typed(g, scope) for g in s.group], [aggregate(a, scope) for a in aggs]
    max_groups, max_bytes, max_distinct = budget
    distinct = [aggregate(N.Agg("COUNT", a.arg, True), scope).col.alias(f"__d{i}") for i, a in enumerate(aggs) if a.distinct and max_distinct is not None]
    out = df.groupBy(*[t.col.alias(f"__k{i}") for i, t in enumerate(keys)]).agg(*[t.col.alias(f"__a{i}") for i, t in enumerate(made)], *distinct)
    if max_groups is not None:
        rows = out.limit(max_groups + 1).collect()  # one run; its size is the budget's
        if len(rows) > max_groups:
            refuse("group_budget", f"more than {max_groups} groups")
        if max_bytes is not None and sum(len(str(v)) for r in rows for v in r) > max_bytes:
            refuse("group_bytes", f"more than {max_bytes} bytes of groups")
        if max_distinct is not None and sum(r[c] for r in rows for c in out.columns if c.startswith("__d")) > max_distinct:
            refuse("distinct_budget", f"more than {max_distinct} distinct values")
        out = out.sparkSession.createDataFrame(rows, out.schema)
    outputs = {g: t._replace(col=F.col(f"__k{i}")) for i, (g, t) in enumerate(zip(s.group, keys, strict=True))}
    outputs |= {a: t._replace(col=F.col(f"__a{i}")) for i, (a, t) in enumerate(zip(aggs, made, strict=True))}
    after = Scope(scope.schema, s.alias, outputs)
    if s.having is not None:
        out = out.filter(boolean(s.having, after))
    if terms or s.limit is not None or s.offset:
        order = [(typed(o.expr, after).col, o.desc) for o in terms]
        order += [(F.col(f"__k{i}"), False) for i, g in enumerate(s.group) if all(o.expr != g for o in terms)]
        out = window(out.orderBy(*sort_columns(order)), s)
    return out.select(*_named(s.items, after))
