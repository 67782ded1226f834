"""Value normalizers: explicit column functions, never run by writes. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.scalar import trim as _trim

#: Boundaries of words besides _, - and space: lower to upper, the end of an acronym, letters and digits.
BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"


def words(c: Column) -> Column:
    """The words of a name as an array."""
    return F.filter(F.split(F.regexp_replace(c, BOUNDARY, " "), r"[_\- ]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def kebab(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), "-")


def snake(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), "_")


def upper_snake(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.upper), "_")


def upper_kebab(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.upper), "-")


def title(c: Column) -> Column:
    return F.array_join(F.transform(words(c), _capital), " ")


def lower_words(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), " ")


def upper_words(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.upper), " ")


def sentence(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w, i: F.when(i == 0, _capital(w)).otherwise(F.lower(w))), " ")


def upper_camel(c: Column) -> Column:
    return F.array_join(F.transform(words(c), _capital), "")


def camel(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), "")


def trim(c: Column) -> Column:
    return _trim(c, True, True)


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9A-Za-z]", "")


def numeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _ascii(c: Column, to_upper: bool) -> Column:
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, low if to_upper else high, high if to_upper else low)


def rgb_hex(c: Column) -> Column:
    """Six upper-case hex digits; FFFFFF for anything else."""
    x = F.upper(trim(F.regexp_replace(trim(c), r"^#+", "")))
    return F.when(c.isNull(), None).when(x.rlike(r"\A[0-9A-F]{6}\z"), x).otherwise(F.lit("FFFFFF"))


def rgba_hex(c: Column) -> Column:
    """Eight upper-case hex digits; six get FF; FFFFFFFF for anything else."""
    x = F.upper(trim(F.regexp_replace(trim(c), r"^#+", "")))
    return F.when(c.isNull(), None).when(x.rlike(r"\A[0-9A-F]{8}\z"), x).when(x.rlike(r"\A[0-9A-F]{6}\z"), F.concat(x, F.lit("FF"))).otherwise(F.lit("FFFFFFFF"))


def mime_type(c: Column) -> Column:
    return _ascii(trim(c), False)


def url(c: Column) -> Column:
    """https:// before an address without scheme; other schemes are errors."""
    x = trim(c)
    head = F.regexp_extract(x, r"\A([^/?#]*)", 1)
    odd = x.contains("://") | (head.contains(":") & ~head.rlike(r":[0-9]+\z"))
    bad = F.raise_error(F.lit("URL scheme must be http or https")).cast("string")
    return F.when(x.rlike(r"\Ahttps?://"), x).when(odd, bad).otherwise(F.concat(F.lit("https://"), x))


def e164(c: Column) -> Column:
    x = trim(c)
    return F.when(x.rlike(r"\A[0-9]+\z"), F.concat(F.lit("+"), x)).otherwise(x)


def iso_country(c: Column) -> Column:
    return _ascii(trim(c), True)


def iso_language(c: Column) -> Column:
    return _ascii(trim(c), False)


def clamp(c: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError("clamp needs low <= high")
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def round_decimal_places(c: Column, places: int) -> Column:
    """Half away from zero."""
    return F.round(c, places)
