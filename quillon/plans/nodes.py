"""Expression and statement nodes that SQL and the fluent builders share."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any
    kind: str  # text int decimal bool null blob


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Unary:
    op: str  # NOT NEG
    x: Any


@dataclass(frozen=True)
class Binary:
    op: str  # OR AND = != < <= > >= + - * /
    left: Any
    right: Any


@dataclass(frozen=True)
class InList:
    x: Any
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Test:
    """IS [NOT] NULL, MISSING and EMPTY."""

    what: str
    x: Any
    negated: bool = False


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Case:
    arms: tuple  # of (condition, value)
    default: Any


@dataclass(frozen=True)
class Agg:
    name: str  # COUNT SUM AVG MIN MAX FIRST LAST EXISTS
    arg: Any = None  # None: rows, or the primary key
    distinct: bool = False
    where: Any = None


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Any
    desc: bool = False


@dataclass(frozen=True)
class Select:
    entity: str
    items: tuple = ()  # empty: all fields
    where: Any = None
    distinct: bool = False
    group: tuple = ()
    having: Any = None
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Insert:
    entity: str
    columns: tuple | None
    rows: tuple | None  # of tuples of literals; None with select; () is DEFAULT VALUES
    select: Select | None = None
    returning: tuple | None = None


@dataclass(frozen=True)
class Update:
    entity: str
    sets: tuple
    where: Any
    order: tuple = ()
    limit: int | None = None
    returning: tuple | None = None


@dataclass(frozen=True)
class Delete:
    entity: str
    where: Any
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    returning: tuple | None = None


@dataclass(frozen=True)
class Ddl:
    action: str
    entity: str | None
    args: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Show:
    what: str
    entity: str | None = None
    verbose: bool = False


@dataclass(frozen=True)
class Explain:
    statement: Any
    mode: str = "LOGICAL"  # LOGICAL EXECUTION JSON VERBOSE


DEFAULT = Lit("DEFAULT", "default")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def walk(x: Any):
    """x and every node below it."""
    yield x
    if isinstance(x, Unary | Test):
        yield from walk(x.x)
    elif isinstance(x, Binary):
        yield from walk(x.left)
        yield from walk(x.right)
    elif isinstance(x, InList):
        yield from walk(x.x)
        for i in x.items:
            yield from walk(i)
    elif isinstance(x, Func):
        for a in x.args:
            yield from walk(a)
    elif isinstance(x, Case):
        for c, v in x.arms:
            yield from walk(c)
            yield from walk(v)
        if x.default is not None:
            yield from walk(x.default)
    elif isinstance(x, Agg):
        for y in (x.arg, x.where):
            if y is not None:
                yield from walk(y)


def has_aggregate(x: Any) -> bool:
    return any(isinstance(y, Agg) for y in walk(x))
