"""Scalar functions with exact value semantics, as Spark columns.

A typed column is (Column, kind); kinds are bool, text, int, dec, float, date, ts, blob, null and names of
other field kinds. Arithmetic is decimal and checked. Floats take part in it through their shortest text
with FLOAT_SCALE decimals; a quotient has 18, rounded half away from zero.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.errors import refuse

FLOAT_SCALE = 8
WIDE = "decimal(38,18)"
NUMERIC = {"int", "dec", "float", "ts"}


class Typed(NamedTuple):
    col: Column
    kind: str
    scale: int = 0  # of dec


def decimal(x: Typed) -> Typed:
    """x as a decimal."""
    if x.kind == "int":
        return Typed(x.col.cast("decimal(20,0)"), "dec", 0)
    if x.kind == "dec":
        return x
    if x.kind == "float":
        return Typed(x.col.cast(f"decimal(22,{FLOAT_SCALE})"), "dec", FLOAT_SCALE)
    if x.kind == "ts":
        return Typed(F.unix_millis(x.col.cast("timestamp")).cast("decimal(20,0)"), "dec", 0)
    if x.kind == "null":
        return Typed(F.lit(None).cast("decimal(20,0)"), "dec", 0)
    refuse("type_mismatch", f"a number is needed, not {x.kind}")


def text(x: Typed) -> Column:
    if x.kind not in ("text", "null"):
        refuse("type_mismatch", f"a text is needed, not {x.kind}")
    return x.col.cast("string")


def divide(a: Typed, b: Typed) -> Typed:
    """The quotient with 18 decimals where the operands leave room for them (under 12 whole digits of the dividend,
    10 of the divisor), else with fewer, 6 at least. Operands keep their own scale."""
    x, y = decimal(a), decimal(b)
    near = [(d.col, None) if t.kind == "int" else (d.col.try_cast(f"decimal({whole + d.scale},{d.scale})"), 10**whole) for t, d, whole in ((a, x, 12), (b, y, 10))]
    exact = (near[0][0] / near[1][0]).cast(WIDE)
    fits = [F.abs(d.col) < F.lit(most).cast("decimal(20,0)") for d, (_, most) in zip((x, y), near, strict=True) if most]
    if not fits:
        return Typed(exact, "dec", 18)
    far = (x.col.cast(f"decimal(38,{x.scale})") / y.col.cast(f"decimal(38,{y.scale})")).cast(WIDE)
    held = fits[0] if len(fits) == 1 else fits[0] & fits[1]
    return Typed(F.when(held, exact).otherwise(far), "dec", 18)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "/":
        decimal(a), decimal(b)
        return divide(a, b)
    x, y = decimal(a), decimal(b)
    if op == "*":
        return Typed(x.col * y.col, "dec", x.scale + y.scale)
    return Typed(x.col + y.col if op == "+" else x.col - y.col, "dec", max(x.scale, y.scale))


def guarded(bad: Column, what: str, value: Column) -> Column:
    """value, or an error where bad holds; null where the input is null."""
    return F.when(bad, F.raise_error(F.lit(f"not_representable: {what}")).cast("double")).otherwise(value)


def _float(f: Callable[[Column], Column], bad: Callable[[Column], Column] | None = None, what: str = "") -> Callable[..., Typed]:
    def run(x: Typed) -> Typed:
        v = decimal(x).col.cast("double")
        y = f(v)
        return Typed((guarded(bad(v), what, y) if bad else y).cast(WIDE), "dec", 18)

    return run


def log(base: Typed, x: Typed) -> Typed:
    b, v = decimal(base).col.cast("double"), decimal(x).col.cast("double")
    return Typed(guarded((b <= 0) | (b == 1) | (v <= 0), "LOG", F.ln(v) / F.ln(b)).cast(WIDE), "dec", 18)


def power(x: Typed, y: Typed) -> Typed:
    return Typed(F.pow(decimal(x).col.cast("double"), decimal(y).col.cast("double")).cast(WIDE), "dec", 18)


def round_(x: Typed, scale: int = 0) -> Typed:
    d = decimal(x)
    return d if d.scale <= scale else Typed(F.round(d.col, scale), "dec", scale)


def trunc(x: Typed, scale: int = 0) -> Typed:
    d = decimal(x)
    if d.scale <= scale:
        return d
    step = F.lit(10**scale).cast("decimal(20,0)")
    whole = F.floor(F.abs(d.col) * step).cast("decimal(30,0)")
    return Typed((F.when(d.col < 0, -whole).otherwise(whole) / step).cast(f"decimal(38,{scale})"), "dec", scale)


def trim(x: Column, left: bool, right: bool) -> Column:
    """Unicode white space off either end."""
    x = F.regexp_replace(x, r"(?U)^\s+", "") if left else x
    return F.regexp_replace(x, r"(?U)\s+\z", "") if right else x


def substring(x: Typed, start: Typed, size: Typed | None = None) -> Typed:
    t, s = text(x), start.col.cast("int")
    n = size.col.cast("int") if size else F.lit(2**31 - 1)
    bad = (s <= 0) | (n <= 0)
    return Typed(F.when(t.isNull() | s.isNull() | n.isNull(), None).when(bad, F.lit("")).otherwise(F.substring(t, F.greatest(s, F.lit(1)), F.greatest(n, F.lit(0)))), "text")


def side(x: Typed, n: Typed, right: bool) -> Typed:
    return Typed((F.right if right else F.left)(text(x), n.col.cast("int")), "text")


def octets(x: Typed) -> Typed:
    if x.kind not in ("text", "blob", "null"):
        refuse("type_mismatch", "OCTET_LENGTH takes a text or a blob")
    return Typed(F.octet_length(x.col).cast("long"), "int")


def same_kind(parts: list[Typed], what: str) -> Typed:
    """Casts for parts that must share a kind; numbers meet as decimals."""
    kinds = {p.kind for p in parts} - {"null"}
    if len(kinds) > 1:
        if not kinds <= NUMERIC:
            refuse("type_mismatch", f"{what} mixes {', '.join(sorted(kinds))}")
        return Typed(F.lit(None), "dec", max(decimal(p).scale for p in parts if p.kind != "null"))
    kind = kinds.pop() if kinds else "null"
    return Typed(F.lit(None), kind, max((p.scale for p in parts), default=0))


def align(parts: list[Typed], what: str) -> tuple[list[Column], Typed]:
    to = same_kind(parts, what)
    cast = lambda p: p.col if to.kind != "dec" or p.kind == "null" else decimal(p).col.cast(f"decimal(38,{min(18, to.scale)})")
    return [cast(p) for p in parts], to


def coalesce(*parts: Typed) -> Typed:
    cols, to = align(list(parts), "COALESCE")
    return Typed(F.coalesce(*cols), to.kind, to.scale)


def nullif(a: Typed, b: Typed) -> Typed:
    cols, _ = align([a, b], "NULLIF")
    return Typed(F.when(cols[0] == cols[1], None).otherwise(a.col), a.kind, a.scale)


def _text(f: Callable[[Column], Column], kind: str = "text") -> Callable[[Typed], Typed]:
    return lambda x: Typed(f(text(x)), kind)


def _find(f: Callable[[Column, Column], Column]) -> Callable[[Typed, Typed], Typed]:
    return lambda x, y: Typed(f(text(x), text(y)), "bool")


#: name: (least arguments, most arguments, function of typed columns). ROUND and TRUNC take a literal scale, apart.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Typed]]] = {
    "ABS": (1, 1, lambda x: Typed(F.abs(decimal(x).col), "dec", decimal(x).scale)),
    "CBRT": (1, 1, _float(F.cbrt)),
    "CEIL": (1, 1, lambda x: Typed(F.ceil(decimal(x).col).cast("decimal(38,0)"), "dec")),
    "COALESCE": (2, 255, coalesce),
    "CONTAINS": (2, 2, _find(F.contains)),
    "ENDS_WITH": (2, 2, _find(F.endswith)),
    "EXP": (1, 1, _float(F.exp)),
    "FLOOR": (1, 1, lambda x: Typed(F.floor(decimal(x).col).cast("decimal(38,0)"), "dec")),
    "LEFT": (2, 2, lambda x, n: side(x, n, False)),
    "LENGTH": (1, 1, _text(lambda x: F.char_length(x).cast("long"), "int")),
    "LN": (1, 1, _float(F.ln, lambda v: v <= 0, "LN")),
    "LOG": (2, 2, log),
    "LOG2": (1, 1, _float(F.log2, lambda v: v <= 0, "LOG2")),
    "LOG10": (1, 1, _float(F.log10, lambda v: v <= 0, "LOG10")),
    "LOWER": (1, 1, _text(F.lower)),
    "LTRIM": (1, 1, _text(lambda x: trim(x, True, False))),
    "MOD": (2, 2, lambda x, y: Typed(decimal(x).col % decimal(y).col, "dec", max(decimal(x).scale, decimal(y).scale))),
    "NULLIF": (2, 2, nullif),
    "OCTET_LENGTH": (1, 1, octets),
    "POSITION": (2, 2, lambda n, x: Typed(F.position(text(n), text(x)).cast("long"), "int")),
    "POWER": (2, 2, power),
    "REPLACE": (3, 3, lambda x, a, b: Typed(F.replace(text(x), text(a), text(b)), "text")),
    "RIGHT": (2, 2, lambda x, n: side(x, n, True)),
    "RTRIM": (1, 1, _text(lambda x: trim(x, False, True))),
    "SIGN": (1, 1, lambda x: Typed(F.signum(decimal(x).col.cast("double")).cast("decimal(1,0)"), "dec")),
    "SQRT": (1, 1, _float(F.sqrt, lambda v: v < 0, "SQRT")),
    "STARTS_WITH": (2, 2, _find(F.startswith)),
    "STARTS_WITH_CI": (2, 2, _find(lambda x, y: F.startswith(F.lower(x), F.lower(y)))),
    "ENDS_WITH_CI": (2, 2, _find(lambda x, y: F.endswith(F.lower(x), F.lower(y)))),
    "CONTAINS_CI": (2, 2, _find(lambda x, y: F.contains(F.lower(x), F.lower(y)))),
    "EQ_CI": (2, 2, _find(lambda x, y: F.lower(x) == F.lower(y))),
    "SUBSTRING": (2, 3, substring),
    "TRIM": (1, 1, _text(lambda x: trim(x, True, True))),
    "UPPER": (1, 1, _text(F.upper)),
}
ALIASES = {"CEILING": "CEIL", "POW": "POWER", "TRUNCATE": "TRUNC"}
