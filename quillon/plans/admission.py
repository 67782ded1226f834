"""Read admission: what a lane lets through, judged on the statement and the declared indexes.

A refusal has a code and happens before anything runs; codes come in one order of precedence.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from quillon.functions.errors import refuse
from quillon.functions.schema import EntitySchema
from quillon.plans import nodes as N
from quillon.plans.select import lane


class ReadIntent(Enum):
    """What a caller's terminal means to read. Diagnostic only; it grants nothing."""

    UNSPECIFIED = "unspecified"
    BOUNDED_ROW_WINDOW = "bounded_row_window"
    EXISTENCE_CHECK = "existence_check"
    PUBLIC_PAGE = "public_page"
    COMPLETE_SMALL_SET = "complete_small_set"
    EXACT_AGGREGATE = "exact_aggregate"
    TRUSTED_ADMIN_BATCH = "trusted_admin_batch"


@dataclass(frozen=True)
class GroupLimits:
    """Budgets of a grouped read: groups, bytes of their rows, and distinct values of DISTINCT aggregates."""

    max_groups: int = 100
    max_bytes: int = 64 << 10
    max_distinct: int = 1024


@dataclass(frozen=True)
class Policy:
    require_limit: bool = True
    require_index: bool = True
    allow_full_scan: bool = False
    allow_sort: bool = False
    max_rows: int = 100
    max_keys: int = 1024
    groups: GroupLimits | None = GroupLimits()


PUBLIC = Policy()
TRUSTED = Policy(False, False, True, True, 1 << 31, 1 << 31, None)


def conjuncts(x: Any) -> list[Any]:
    return conjuncts(x.left) + conjuncts(x.right) if isinstance(x, N.Binary) and x.op == "AND" else [] if x is None else [x]


def restricted(where: Any) -> tuple[set[str], set[str]]:
    """Fields with an equality (or IN), and with a range, that every row must meet."""
    equal, ranged = set(), set()
    for c in conjuncts(where):
        if isinstance(c, N.Binary) and isinstance(c.left, N.Field) and isinstance(c.right, N.Lit):
            (equal if c.op == "=" else ranged if c.op in ("<", "<=", ">", ">=") else set()).add(c.left.path[-1].lower())
        elif isinstance(c, N.InList) and not c.negated and isinstance(c.x, N.Field):
            equal.add(c.x.path[-1].lower())
        elif isinstance(c, N.Func) and c.name == "STARTS_WITH" and isinstance(c.args[0], N.Field):
            ranged.add(c.args[0].path[-1].lower())
    return equal, ranged


def access(s: N.Select, schema: EntitySchema) -> tuple[str, tuple[str, ...]]:
    """(kind, keys) of the declared access that serves the condition: by_key, index_prefix, index_range or full_scan."""
    equal, ranged = restricted(s.where)
    for c in conjuncts(s.where):
        if isinstance(c, N.Lit) and c.value is False:
            return "empty", ()
    if {k.lower() for k in schema.key} <= equal:
        return "by_key", schema.key
    for keys, name in [(schema.key, "key"), *((i.keys, "index") for i in schema.indexes if i.where is None)]:
        first = keys[0].lower()
        if first in equal:
            return f"{name}_prefix", keys
        if first in ranged:
            return f"{name}_range", keys
    return "full_scan", ()


def sorts(s: N.Select, schema: EntitySchema) -> bool:
    """Whether no declared key or index has the order."""
    want = [o.expr.path[-1].lower() if isinstance(o.expr, N.Field) and not o.desc else None for o in s.order]
    orders = [[k.lower() for k in schema.key], *([k.lower() for k in i.keys] for i in schema.indexes)]
    equal, _ = restricted(s.where)
    return bool(want) and all(want != [k for k in o if k not in equal][: len(want)] for o in orders)


def admit(s: N.Select, schema: EntitySchema, policy: Policy) -> None:
    if lane(s) == "grouped" and policy.groups is not None and s.limit is None and policy.require_limit:
        refuse("grouped_budget_required", "a grouped read needs a limit")
    kind, _ = access(s, schema)
    if kind == "full_scan" and not policy.allow_full_scan:
        refuse("full_scan", f"no key or index of {schema.name} serves the condition")
    if policy.require_index and kind == "full_scan":
        refuse("index_required", schema.name)
    if policy.require_limit and s.limit is None and kind != "by_key":
        refuse("limit_required", "the read is unbounded")
    if (s.limit or 0) > policy.max_rows:
        refuse("row_bound", f"at most {policy.max_rows} rows")
    keys = max((len(c.items) for c in conjuncts(s.where) if isinstance(c, N.InList)), default=0)
    if keys > policy.max_keys:
        refuse("key_bound", f"at most {policy.max_keys} keys")
    if not policy.allow_sort and sorts(s, schema):
        refuse("materialized_sort", "no key or index has the order")
