"""Keyset pages: live ones over whatever the entity holds now, exhaustive ones over one version.

A cursor is an authenticated token that is bound to the plan and carries the last row's order values. The
next page starts strictly behind them, so a page costs a filter and a bounded sort at any depth.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from quillon.functions.errors import refuse
from quillon.plans import nodes as N
from quillon.plans.compile import Scope, boolean, typed
from quillon.plans.select import Source, _named, fingerprint, order_terms, run, sort_columns, total_order

VERSION, MAX_TOKEN, MAX_TERMS, MAX_PAGE = 1, 8 << 10, 32, 1024


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: str | None


def _pack(v: Any) -> Any:
    for tag, kind in (("d", Decimal), ("t", dt.datetime), ("y", dt.date)):
        if isinstance(v, kind):
            return [tag, str(v) if tag == "d" else v.isoformat()]
    return ["b", base64.b64encode(bytes(v)).decode()] if isinstance(v, (bytes, bytearray)) else ["v", v]


def _unpack(x: list) -> Any:
    tag, v = x
    return {"d": Decimal, "t": dt.datetime.fromisoformat, "y": dt.date.fromisoformat, "b": lambda s: bytearray(base64.b64decode(s))}.get(tag, lambda s: s)(v)


def seal(secret: bytes, body: dict) -> str:
    raw = json.dumps(body, separators=(",", ":")).encode()
    token = base64.urlsafe_b64encode(hmac.new(secret, raw, hashlib.sha256).digest() + raw).decode()
    return token if len(token) <= MAX_TOKEN else refuse("cursor_size", "the order values are too long for a cursor")


def unseal(secret: bytes, token: str) -> dict:
    try:
        raw = base64.urlsafe_b64decode(token.encode()) if len(token) <= MAX_TOKEN else b""
    except ValueError:
        raw = b""
    if len(raw) < 33 or not hmac.compare_digest(hmac.new(secret, raw[32:], hashlib.sha256).digest(), raw[:32]):
        refuse("cursor_invalid", "the cursor isn't one of ours")
    return json.loads(raw[32:])


def behind(terms: list[tuple[Column, bool]], values: list[Any]) -> Column:
    """Rows strictly behind the values: nulls are first ascending, last descending."""
    out, same = F.lit(False), F.lit(True)
    for (c, desc), v in zip(terms, values, strict=True):
        if v is None:
            after = F.lit(False) if desc else c.isNotNull()
        else:
            after = (c < F.lit(v)) | c.isNull() if desc else c > F.lit(v)
        out = out | (same & F.coalesce(after, F.lit(False)))
        same = same & c.eqNullSafe(F.lit(v))
    return out


def scalar_page(s: N.Select, src: Source, secret: bytes, cursor: str | None, proof: str | None) -> Page:
    """One page of a scalar query in its order. proof: the version an exhaustive walk is bound to."""
    if s.offset:
        refuse("cursor_offset", "pages go without OFFSET")
    if s.distinct or s.group or any(N.has_aggregate(i.expr) for i in s.items):
        refuse("cursor_shape", "only scalar queries have row pages")
    size = s.limit if s.limit is not None else MAX_PAGE
    if not 1 <= size <= MAX_PAGE:
        refuse("page_size", f"a page has 1 to {MAX_PAGE} rows")
    scope, plan = Scope(src.schema, s.alias), fingerprint(replace(s, limit=None), src.schema)
    terms = total_order(s, scope)
    if len(terms) > MAX_TERMS:
        refuse("cursor_terms", f"at most {MAX_TERMS} order terms")
    df = src.df.filter(boolean(s.where, scope)) if s.where is not None else src.df
    if cursor is not None:
        body = unseal(secret, cursor)
        if body["v"] != VERSION or body["p"] != plan:
            refuse("cursor_plan", "the cursor belongs to another query")
        if body.get("proof") != proof:
            refuse("restart_required", "the data has changed since the walk began")
        df = df.filter(behind(terms, [_unpack(x) for x in body["k"]]))
    items = s.items or tuple(N.Item(N.Field((f.name,))) for f in src.schema.fields)
    outputs = F.struct(*_named(items, scope)).alias("row")
    keys = F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(terms)]).alias("key")
    found = df.orderBy(*sort_columns(terms)).limit(size + 1).select(outputs, keys).collect()
    token = None
    if len(found) > size:
        token = seal(secret, {"v": VERSION, "p": plan, "proof": proof, "k": [_pack(x) for x in found[size - 1].key]})
    return Page([r.row for r in found[:size]], token)


def grouped_page(s: N.Select, src: Source, secret: bytes, cursor: str | None) -> Page:
    """One page of groups in the order of their keys; the next begins behind the last group."""
    if s.offset:
        refuse("cursor_offset", "pages go without OFFSET")
    if any(N.has_aggregate(o.expr) for o in order_terms(s, src.schema)):
        refuse("cursor_shape", "pages of groups go by their keys")
    size = s.limit if s.limit is not None else MAX_PAGE
    plan = fingerprint(replace(s, limit=None), src.schema)
    scope = Scope(src.schema, s.alias)
    desc = {o.expr: o.desc for o in s.order}
    terms = [(typed(g, scope).col, desc.get(g, False)) for g in s.group]
    df = src.df
    if cursor is not None:
        body = unseal(secret, cursor)
        if body["v"] != VERSION or body["p"] != plan:
            refuse("cursor_plan", "the cursor belongs to another query")
        df = df.filter(behind(terms, [_unpack(x) for x in body["k"]]))
    keyed = tuple(N.Item(g, f"__key{i}") for i, g in enumerate(s.group))
    items = tuple(N.Item(i.expr, i.alias or (i.expr.path[-1] if isinstance(i.expr, N.Field) else None)) for i in s.items)
    order = tuple(N.Order(g, desc.get(g, False)) for g in s.group)
    found = run(replace(s, items=keyed + items, order=order, limit=size + 1), Source(src.schema, df)).collect()
    token = None
    n = len(keyed)
    if len(found) > size:
        token = seal(secret, {"v": VERSION, "p": plan, "k": [_pack(x) for x in found[size - 1][:n]]})
    names = found[0].__fields__[n:] if found else []
    return Page([Row(*names)(*r[n:]) for r in found[:size]], token)


def exact_keys(df: DataFrame, key: tuple[str, ...], wanted: list[tuple]) -> DataFrame:
    """Rows for keys in the order asked, repeats included; a key without row gives nulls. Column __at counts from 0."""
    fields = [df.schema[k] for k in key]
    schema = ", ".join(["__at int", *(f"`__k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields))])
    asked = df.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(wanted)], schema)
    few = df.join(F.broadcast(asked.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(key)]).distinct()), list(key), "left_semi")
    on = [F.col(f"__k{i}") == F.col(f"`{k}`") for i, k in enumerate(key)]
    return asked.join(few, on, "left").orderBy("__at").select("__at", *[f"`{c}`" for c in df.columns])
