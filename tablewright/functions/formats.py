"""Format checks as Column expressions: true, false, or null for null. Only ASCII letters and digits count in codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def _fit(pattern: str, prepare: Callable[[Column], Column] = lambda v: v) -> Callable[[Column], Column]:
    return lambda c: X.matches(prepare(X.stripped(c)), pattern)


def _digits_mod_97(v: Column) -> Column:
    """Remainder of the number that letters (A is 10) and digits spell."""

    def add(have: Column, sign: Column) -> Column:
        n = F.ascii(sign)
        return F.when(n >= 65, (have * 100 + n - 55) % 97).otherwise((have * 10 + n - 48) % 97)

    return F.aggregate(F.split(v, ""), F.lit(0), add)


def is_iban(c: Column) -> Column:
    """Two letters, two digits and at least 11 more; the rearranged number leaves 1 on division by 97."""
    v = F.upper(F.replace(X.stripped(c), F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(v, 5, 1 << 20), F.substring(v, 1, 4))
    return F.when(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}$"), _digits_mod_97(turned) == 1).otherwise(v.isNull() & F.lit(None))


def is_lei(c: Column) -> Column:
    v = F.upper(X.stripped(c))
    return F.when(v.rlike("^[A-Z0-9]{20}$"), _digits_mod_97(v) == 1).otherwise(v.isNull() & F.lit(None))


def is_npi(c: Column) -> Column:
    """Ten digits that pass the Luhn check behind 80840."""
    v = X.stripped(c)
    return F.when(v.rlike("^[0-9]{10}$"), F.call_function("luhn_check", F.concat(F.lit("80840"), v))).otherwise(v.isNull() & F.lit(None))


def is_gtin(c: Column) -> Column:
    """8, 12, 13 or 14 digits; weighted 3 and 1 from the right, with the check digit, they sum to a multiple of 10."""
    v = X.stripped(c)
    places = F.sequence(F.lit(0), F.length(v) - 1)
    total = F.aggregate(places, F.lit(0), lambda s, i: s + (F.ascii(F.substring(F.reverse(v), i + 1, F.lit(1))) - 48) * F.when(i % 2 == 1, 3).otherwise(1))
    return F.when(v.rlike("^([0-9]{8}|[0-9]{12,14})$"), total % 10 == 0).otherwise(v.isNull() & F.lit(None))


FORMATS: dict[str, Callable[[Column], Column]] = {
    "email": _fit(X.EMAIL),
    "uuid": _fit("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
    "iso8601": _fit(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$"),
    "date": _fit(r"^\d{4}-\d{2}-\d{2}$"),
    "e164": _fit(r"^\+?[1-9]\d{6,14}$", lambda v: F.translate(v, " -", "")),
    "iso3166_alpha2": _fit("^[A-Z]{2}$", F.upper),
    "iso4217": lambda c: F.upper(X.stripped(c)).isin(*X.CURRENCIES),
    "postal_code": _fit(r"^[A-Za-z0-9][A-Za-z0-9\s\-]{2,9}$"),
    "bic": _fit("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$", F.upper),
    "iban": is_iban,
    "npi": is_npi,
    "gtin": is_gtin,
    "lei": is_lei,
}
CHECKSUMS = ("gtin", "iban", "lei", "npi")


def fits(name: str | None, c: Column) -> Column:
    """Whether a text has a format; a format that isn't known fits all."""
    check = FORMATS.get(name or "")
    return check(c) if check else F.lit(True)
