"""Column expressions on text: stripping, names, numbers, value types. Null and blank are one thing: no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Currencies that are recognised, alphabetically.
CURRENCIES = tuple(sorted("AED AUD BRL CAD CHF CLP CNY CZK DKK EUR GBP GHS HKD HUF IDR ILS INR JPY KES KRW MXN MYR NGN NOK NZD PHP PLN RON RUB SAR SEK SGD THB TRY USD ZAR".split()))
WORD_BOOLEANS = ("true", "false", "yes", "no", "y", "n", "t", "f")

#: Characters that are white space in Unicode.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
INTEGER = r"^[+-]?\d+$"
POINT_NUMBER = r"^[+-]?(?:\d+\.\d*|\.\d+)$"
PERCENT = r"^[+-]?\d+(?:\.\d+)?\s*%$"
DATE = r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})$"
#: A prefix is enough: what follows hours and minutes isn't looked at.
DATETIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def matches(c: Column, pattern: str) -> Column:
    """Regular expression with Unicode digits and white space."""
    return c.rlike("(?U)" + pattern)


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def value_or_null(c: Column) -> Column:
    """Stripped text; null if nothing is left."""
    return F.nullif(stripped(c.cast("string")), F.lit(""))


def as_text(c: Column, kind: T.DataType) -> Column:
    """Text of a typed value, booleans as True and False, doubles without exponent from 0.0001 to 1e16."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size = F.abs(c)
        long = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?[1-9])0+$|(\.0)0+$", "$1$2")
        small = F.regexp_replace(c.cast("decimal(38,22)").cast("string"), "0+$", "")
        return F.when((size >= 1e7) & (size < 1e16), long).when((size >= 1e-4) & (size < 1e-3), small).otherwise(c.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def normalized_name(c: Column) -> Column:
    """``studentEmail`` and ``Student E-Mail`` in lower case with single underscores."""
    parted = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", "_")
    joined = F.regexp_replace(stripped(F.lower(parted)), "[^a-z0-9]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def name_tokens(c: Column) -> Column:
    """Distinct parts of a name, as it is after ``normalized_name``."""
    return F.array_remove(F.array_distinct(F.split(c, "_")), "")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; meant for short texts such as names."""
    xs, ys = F.split(a, ""), F.split(b, "")
    first = F.transform(F.concat(F.array(F.lit("")), ys), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            value = F.when(F.get(ys, j) == x, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.element_at(now, -1)))
            return F.concat(now, F.array(value))

        return F.aggregate(F.sequence(F.lit(0), F.size(ys) - 1), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(xs, first, row), -1))


def similarity(a: Column, b: Column) -> Column:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_subsequence(a, b) / total)


def number(c: Column) -> Column:
    """Double of a text without thousands commas and per-cent signs, null if it isn't one. Words such as inf aren't numbers."""
    x = F.replace(F.regexp_replace(value_or_null(c), "%+$", ""), F.lit(","), F.lit(""))
    x = stripped(x)
    return F.when(x.rlike(FLOAT), x.try_cast("double"))


def value_type(v: Column) -> Column:
    """Logical type of a stripped, non-blank text: the first rule that fits."""
    low = F.lower(v)
    opened = F.substring(v, 1, 1)
    parsed = F.try_parse_json(F.when(opened.isin("[", "{"), v)).isNotNull()
    return (
        F.when(matches(v, EMAIL), "email")
        .when((F.length(v) == 3) & F.upper(v).isin(*CURRENCIES), "currency_code")
        .when(matches(v, PERCENT), "percentage")
        .when(matches(v, INTEGER), "integer")
        .when(matches(v, POINT_NUMBER), "decimal")
        .when(low.isin(*WORD_BOOLEANS), "boolean")
        .when(matches(v, DATETIME), "timestamp")
        .when(matches(v, DATE), "date")
        .when(parsed & (opened == "["), "array")
        .when(parsed, "json")
        .otherwise("string")
    )


def masked(v: Column, email: Column | bool) -> Column:
    """A value with all but its first sign hidden; of an e-mail address only the first letter stays."""
    mail = F.when(F.instr(v, "@") > 0, F.concat(F.when(F.instr(v, "@") > 1, F.substring(v, 1, 1)).otherwise(""), F.lit("***@***"))).otherwise("***")
    plain = F.when(F.length(v) <= 2, F.repeat(F.lit("*"), F.length(v))).otherwise(F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), F.length(v) - 1)))
    email = F.lit(email) if isinstance(email, bool) else email
    return F.when(v == "", v).when(email, mail).otherwise(plain)
