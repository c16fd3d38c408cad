"""Profiles of all columns of a table, in one aggregation over distinct values.

Rows are unpivoted to (field, value) and grouped by both, so that regular expressions run once for each distinct value and
the plan stays the same for wide tables. Values are grouped in their own types; only distinct ones are made text. They are then
counted by what they look like, and a last aggregation makes one row a field. Result columns: ``PROFILE_COLUMNS``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction
from pyspark.sql.window import Window

from ..functions import text as X

PROFILE_COLUMNS = ["field", "position", "row_count", "null_count", "distinct_count", "inferred_type", "min", "max", "sum_len", "enum_candidates", "sample_values", "patterns", "pii_flags"]
ENUM_MOST = 20
#: Columns in which cells are grouped, with their types.
SLOTS = {"whole": "BIGINT", "real": "DOUBLE", "time": "TIMESTAMP_NTZ", "other": "STRING"}
#: Types in order of what wins among equally frequent ones.
PRECEDENCE = {"email": 9, "currency_code": 8, "boolean": 7, "integer": 6, "percentage": 6, "decimal": 5, "timestamp": 5, "date": 4, "json": 4, "array": 4, "string": 1}
#: Parts of a normalised name that speak for personal data.
NAME_SIGNS = {
    "email": "email e_mail",
    "phone": "phone mobile cell telephone fax",
    "name": "first_name last_name given_name family_name full_name surname fname lname",
    "national_id": "ssn social_security national_id nino tax_id passport",
    "dob": "dob birth_date birthdate date_of_birth",
    "address": "address street addr postal zip zipcode",
    "mrn": "mrn medical_record patient_mrn",
    "account_number": "account_number acct_num iban account_no card_number",
    "ip_address": "ip_address ip_addr client_ip",
}


def _has_letters(v: Column, n: int) -> Column:
    return v.rlike("^[A-Za-z]{%d}$" % n)


def value_patterns(v: Column) -> dict[str, tuple[Column, float]]:
    """Predicates on a stripped text by pattern, with the share of values from which a column has it."""
    whole, mail = X.matches(v, X.INTEGER), X.matches(v, X.EMAIL)
    checks = {
        "email": mail,
        "uuid_like": v.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        "integer": whole,
        "decimal": X.matches(v, X.POINT_NUMBER),
        "timestamp_iso": X.matches(v, X.DATETIME),
        "date": X.matches(v, X.DATE),
        "currency_like": X.matches(v, r"^[$€£¥]\s?\d"),
        "currency_code_like": (F.length(v) == 3) & F.upper(v).isin(*X.CURRENCIES),
        "iban_like": X.matches(F.replace(v, F.lit(" "), F.lit("")), r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"),
        "gtin_like": X.matches(v, r"^(?:\d{8}|\d{12,14})$"),
        "postal_code_like": X.matches(v, r"^(?:\d{5}(?:-\d{4})?|[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d)$"),
        "phone_like": X.matches(v, r"^\+?[\d\s().\-]{7,}$") & X.matches(v, r"\d"),
        "country_code_like": _has_letters(v, 2),
        "identifier_like": v.rlike(r"^[A-Za-z0-9][A-Za-z0-9_\-]{2,}$") & ~whole & ~mail,
    }
    return {k: (c, 0.95 if k == "identifier_like" else 0.9) for k, c in checks.items()}


def name_flags(name: Column) -> Column:
    """Kinds of personal data that a field's name speaks for."""
    n = X.normalized_name(name)
    return F.array_compact(F.array(*[F.when(n.rlike("|".join(signs.split())), F.lit(flag)) for flag, signs in NAME_SIGNS.items()]))


def all_flags(name: Column, mails: Column, ssn: Column, ips: Column) -> Column:
    """Flags of the name, then of the values: all are e-mail addresses, any is a social security number, all are IPs."""
    by_value = F.array_compact(F.array(F.when(mails, F.lit("email")), F.when(ssn, F.lit("national_id")), F.when(ips, F.lit("ip_address"))))
    return F.array_distinct(F.concat(name_flags(name), by_value))


def long_form(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(row, field, value): every cell as text, blank ones as null."""
    row = F.col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
    cells = [X.as_text(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]
    names = {f"c{i}": f.name for i, f in enumerate(df.schema)}
    wide = df.select(row.alias("row"), *cells)
    parts = ", ".join(f"{i}, c{i}" for i in range(len(names)))
    tall = wide.select("row", F.expr(f"stack({len(names)}, {parts}) AS (position, value)"))
    return tall.withColumn("value", F.when(X.stripped(F.col("value")) != "", F.col("value")))


def distinct_cells(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(position, value, num, n, first): distinct cells as text, with their number, count and first row. Blank ones have no value, and there
    may be several of them. Whole numbers, doubles and times, whose texts differ if they differ, are grouped before they are made text."""
    row = F.col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
    days, slots, parts = [], [], []
    for i, f in enumerate(df.schema):
        c, own = F.col("`" + f.name.replace("`", "``") + "`"), {}
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            own["whole"] = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            own["whole"] = F.unix_date(c).cast("long")
            days.append(i)
        elif isinstance(f.dataType, T.DoubleType):  # grouping takes 0.0 and -0.0 for equal
            own |= {"real": F.when(c != 0, c), "other": F.when(c == 0, c.cast("string"))}
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):  # as shown: an hour that clocks repeat has each text twice
            own["time"] = c.cast("timestamp_ntz")
        else:
            own["other"] = X.as_text(c, f.dataType)
        slots += [x.alias(f"{k}{i}") for k, x in own.items()]
        parts.append(f"{i}, " + ", ".join(f"{k}{i}" if k in own else f"CAST(NULL AS {t})" for k, t in SLOTS.items()))
    tall = df.select(row.alias("row"), *slots).select("row", F.expr(f"stack({len(parts)}, {', '.join(parts)}) AS (position, {', '.join(SLOTS)})"))
    # groups that outgrow memory are sorted by the first key before the others: one with many values makes that fast
    groups = tall.groupBy(*SLOTS, "position").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    whole = F.col("whole").cast("string")
    if days:
        whole = F.when(F.col("position").isin(days), F.date_from_unix_date(F.col("whole").cast("int")).cast("string")).otherwise(whole)
    text = F.coalesce(whole, X.as_text(F.col("real"), T.DoubleType()), F.col("time").cast("string"), F.when(X.stripped(F.col("other")) != "", F.col("other")))
    finite = F.when(~F.isnan("real") & (F.abs("real") != float("inf")), F.col("real"))
    num = F.coalesce(F.when(~F.col("position").isin(days), F.col("whole").cast("double")), finite, X.number(F.col("other")))
    return groups.select("position", text.alias("value"), num.alias("num"), "n", "first")


def profile(df: DataFrame, order_by: str | None = None, sample_values: int = 5, mask_pii: bool = True, mask_enum: bool = False) -> DataFrame:
    """One row a column, in order; rates stay numerator and denominator. ``order_by``: integer column that orders the rows, else
    they come as scanned. An empty table gives a row of zeros and type ``unknown`` for each column."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, field string")
    # what a value looks like: its kind, and a bit for each pattern or other property
    checks = value_patterns(F.col("v"))
    traits = {k: c for k, (c, _) in checks.items()} | {
        "words": F.lower("v").isin(*X.WORD_BOOLEANS),
        "ssn": X.matches(F.col("v"), r"^\d{3}-\d{2}-\d{4}$"),
        "ips": X.matches(F.col("v"), r"^(?:\d{1,3}\.){3}\d{1,3}$"),
    }
    bits = functools.reduce(Column.__add__, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(traits.values())])
    seen = distinct_cells(df, order_by).withColumn("v", X.stripped(F.col("value")))
    seen = seen.withColumns({"kind": F.when(F.col("v").isNotNull(), X.value_type(F.col("v"))), "bits": F.when(F.col("v").isNotNull(), bits)})
    looks = seen.groupBy("position", "kind", "bits").agg(
        F.sum("n").alias("n"),
        F.count("value").alias("distinct"),
        F.sum(F.length("value") * F.col("n")).alias("sum_len"),
        F.min("num").alias("num_min"),
        F.max("num").alias("num_max"),
        F.min("first").alias("first"),
        InternalFunction.collect_top_k(F.col("value"), ENUM_MOST, True).alias("least"),  # all of them, where a field has so few
    )
    has = {k: F.col("bits").bitwiseAND(1 << i) > 0 for i, k in enumerate(traits)}
    aggs = [
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("kind").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.sum("distinct").alias("distinct_count"),
        F.sum("sum_len").alias("sum_len"),
        F.min("num_min").alias("num_min"),
        F.max("num_max").alias("num_max"),
        F.bool_and(has["words"]).alias("words"),
        F.bool_and(has["email"]).alias("mails"),
        F.bool_or(has["ssn"]).alias("ssn"),
        F.bool_and(has["ips"]).alias("ips"),
        F.array_sort(F.flatten(F.collect_list("least"))).alias("least"),
    ]
    for t in PRECEDENCE:
        aggs += [F.sum(F.when(F.col("kind") == t, F.col("n")).otherwise(0)).alias(f"n_{t}"), F.min(F.when(F.col("kind") == t, F.col("first"))).alias(f"at_{t}")]
    aggs += [F.sum(F.when(has[k], F.col("n")).otherwise(0)).alias(f"p_{k}") for k in checks]
    stats = names.join(looks.groupBy("position").agg(*aggs), "position", "left")

    full = F.coalesce(F.col("row_count") - F.col("null_count"), F.lit(0))
    mode = F.array_max(F.array(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(p).alias("p"), (-F.col(f"at_{t}")).alias("at"), F.lit(t).alias("t")) for t, p in PRECEDENCE.items()]))["t"]
    numbers = F.col("n_integer") + F.col("n_decimal")
    kind = (
        F.when(full == 0, "unknown")
        .when(F.col("words"), "boolean")
        .when(F.col("n_integer") == full, "integer")
        .when(numbers == full, "decimal")
        .when((mode == "string") & (F.col("sum_len") >= 60 * full), "text")
        .otherwise(mode)
    )
    numeric = F.col("inferred_type").isin("integer", "decimal", "percentage")
    unique = F.when(full > 0, F.col("distinct_count") / full).otherwise(0.0)
    few = (F.col("distinct_count") > 0) & (F.col("distinct_count") <= ENUM_MOST) & (unique < 0.5)
    by_share = [F.when((full > 0) & (F.col(f"p_{k}") >= share * full), F.lit(k)) for k, (_, share) in checks.items()]
    by_total = [
        F.when((F.col("min") >= 0) & (F.col("max") <= 1), F.lit("range_0_to_1")),
        F.when((F.col("min") >= 0) & (F.col("max") <= 4), F.lit("range_0_to_4")),
        F.when(F.col("min") >= 0, F.lit("positive_number")),
        F.when(unique >= 0.9, F.lit("mostly_unique")),
        F.when(few, F.lit("enum_like")),
        F.when((F.col("row_count") > 0) & (F.col("null_count") >= 0.5 * F.col("row_count")), F.lit("high_null_rate")),
    ]
    stats = (
        stats.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("row_count", "null_count", "distinct_count")})
        .withColumn("inferred_type", kind)
        .withColumns({"min": F.when(numeric, F.col("num_min")), "max": F.when(numeric, F.col("num_max"))})
        .withColumn("patterns", F.array_compact(F.array(*by_share, *by_total)))
        .withColumn("pii_flags", all_flags(F.col("field"), F.col("mails"), F.col("ssn"), F.col("ips")))
        .withColumn("enum_candidates", F.when(few, F.col("least")))
    )
    place = F.row_number().over(Window.partitionBy("position").orderBy("row"))
    heads = long_form(df, order_by).where("value IS NOT NULL").withColumn("place", place).where(F.col("place") <= sample_values)
    heads = heads.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("sample_values"))
    out = stats.join(heads, "position", "left")
    mail, flagged = F.array_contains("pii_flags", "email"), F.size("pii_flags") > 0
    hidden = lambda c: F.when(flagged, F.transform(c, lambda x: X.masked(x, mail))).otherwise(F.col(c))
    if mask_pii:
        out = out.withColumn("sample_values", hidden("sample_values"))
    if mask_enum:
        out = out.withColumn("enum_candidates", hidden("enum_candidates"))
    return out.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>"))).select(*PROFILE_COLUMNS)
