"""Value validators: conditions that hold for valid values, explicit, never run by writes. Null gives null."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillon.functions import normalizers as Z

#: ISO 639-1 codes.
LANGUAGES = """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu
fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn
ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os
pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw
ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
""".split()


def _case(f):
    return lambda c: c == f(c)


camel, kebab, snake, title = _case(Z.camel), _case(Z.kebab), _case(Z.snake), _case(Z.title)
lower, upper, sentence = _case(Z.lower_words), _case(Z.upper_words), _case(Z.sentence)
upper_camel, upper_kebab, upper_snake, lower_uscore = _case(Z.upper_camel), _case(Z.upper_kebab), _case(Z.upper_snake), _case(Z.snake)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def alpha_uscore(c: Column) -> Column:
    return matches(c, r"[\p{IsAlphabetic}_]*")


def alphanum_uscore(c: Column) -> Column:
    return matches(c, r"[\p{IsAlphabetic}\p{N}_]*")


def ascii_only(c: Column) -> Column:
    return matches(c, r"[\x00-\x7F]*")


def rgb_hex(c: Column) -> Column:
    return matches(c, "[0-9A-Fa-f]{6}")


def rgba_hex(c: Column) -> Column:
    return matches(c, "[0-9A-Fa-f]{8}")


def mime_type(c: Column) -> Column:
    part = r"[0-9A-Za-z](?:[0-9A-Za-z+.\-]*[0-9A-Za-z])?"
    return matches(c, f"{part}/{part}")


def url(c: Column) -> Column:
    label = r"[0-9A-Za-z](?:[0-9A-Za-z\-]*[0-9A-Za-z])?"
    host = rf"(?:{label}(?:\.{label})*|\[[0-9A-Fa-f:.]+\])"
    return matches(c, rf"https?://{host}(?::[0-9]{{1,5}})?(?:[/?#][^\p{{Cntrl}}\s@]*)?")


def e164(c: Column) -> Column:
    return matches(c, r"\+[1-9][0-9]{6,14}")


def sha256_hex(c: Column) -> Column:
    return matches(c, "[0-9A-Fa-f]{64}")


def utf8(c: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(c.cast("string")) if hasattr(F, "is_valid_utf8") else F.decode(c, "UTF-8").isNotNull()


def iso_country(c: Column, spark: SparkSession) -> Column:
    """ISO 3166-1 alpha-2 codes, as Java's Locale lists them."""
    return c.isin(list(spark._jvm.java.util.Locale.getISOCountries()))


def iso_language(c: Column) -> Column:
    return c.isin(LANGUAGES)


def in_array(c: Column, values: list[Any]) -> Column:
    return c.isin(values)


def max_decimal_places(c: Column, places: int) -> Column:
    return c == F.round(c, places)


def lt(c: Column, x: Any) -> Column:
    return c < F.lit(x)


def gt(c: Column, x: Any) -> Column:
    return c > F.lit(x)


def lte(c: Column, x: Any) -> Column:
    return c <= F.lit(x)


def gte(c: Column, x: Any) -> Column:
    return c >= F.lit(x)


def equal(c: Column, x: Any) -> Column:
    return c == F.lit(x)


def not_equal(c: Column, x: Any) -> Column:
    return c != F.lit(x)


def in_range(c: Column, low: Any, high: Any) -> Column:
    return c.between(F.lit(low), F.lit(high))


def multiple_of(c: Column, x: Any) -> Column:
    """Never valid for a target of zero."""
    d = Decimal(str(x))
    return F.when(c.isNotNull(), F.lit(False)) if d == 0 else (c.cast("decimal(38,18)") % F.lit(d)) == 0


def _size(c: Column, kind: str) -> Column:
    return F.size(c) if kind == "list" else F.octet_length(c) if kind == "blob" else F.char_length(c)


def length_equal(c: Column, n: int, kind: str = "text") -> Column:
    return F.when(c.isNotNull(), _size(c, kind) == n)


def length_min(c: Column, n: int, kind: str = "text") -> Column:
    return F.when(c.isNotNull(), _size(c, kind) >= n)


def length_max(c: Column, n: int, kind: str = "text") -> Column:
    return F.when(c.isNotNull(), _size(c, kind) <= n)


def length_range(c: Column, low: int, high: int, kind: str = "text") -> Column:
    return F.when(c.isNotNull(), _size(c, kind).between(low, high))
