"""Scores of every source field against every target field, and a one-to-one assignment.

Fields are few, so the pairs are a broadcast cross join of two small tables. Signals are Column expressions; the greedy
assignment is a fold over one array a group, so that many sources or providers are assigned in parallel as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.schema import AUTO, LOW, REVIEW, UNMAPPED

WEIGHTS = {"alias": 0.40, "name": 0.20, "type": 0.15, "pattern": 0.15, "range": 0.10, "semantic": 0.0}
FLOOR, REVIEW_FROM, AUTO_FROM = 0.30, 0.70, 0.90

_NEAR_TYPES = {
    "integer": {"decimal": 0.85, "percentage": 0.7},
    "decimal": {"percentage": 0.85, "integer": 0.6},
    "percentage": {"decimal": 0.85},
    "date": {"timestamp": 0.85},
    "timestamp": {"date": 0.8},
    "email": {"string": 0.7},
    "string": {"text": 0.9, "email": 0.5},
    "text": {"string": 0.9},
}
_FORMAT_PATTERN = {"date": "date", "e164": "phone_like", "email": "email", "gtin": "gtin_like", "iban": "iban_like", "iso3166_alpha2": "country_code_like", "iso4217": "currency_code_like", "iso8601": "timestamp_iso", "postal_code": "postal_code_like", "uuid": "uuid_like"}
_TAG_PATTERNS = {"identifier": ["identifier_like", "mostly_unique", "uuid_like"], "money": ["currency_like", "decimal", "positive_number"], "timestamp": ["date", "timestamp_iso"]}


def alias_signal(source: Column, canonical: Column, aliases: Column) -> Column:
    """1 where the normalised name is the target's name or one of its aliases, else 0."""
    n = X.normalized_name(source)
    return F.when((n == X.normalized_name(canonical)) | F.array_contains(F.transform(aliases, X.normalized_name), n), 1.0).otherwise(0.0)


def name_parts(source: Column, canonical: Column, aliases: Column) -> Column:
    """Struct (s, target): greatest similarity to the name or an alias, the first of equals; with no likeness the name and 0."""
    n = X.normalized_name(source)
    names = F.concat(F.array(canonical), aliases)
    # array_max takes the greatest place at a tie, so places count down
    scored = F.transform(names, lambda t, i: F.struct(X.similarity(n, X.normalized_name(t)).alias("s"), (-i).alias("at"), X.normalized_name(t).alias("t")))
    best = F.array_max(scored)
    return F.struct(best["s"].alias("s"), F.when(best["s"] > 0, best["t"]).otherwise(canonical).alias("target"))


def name_signal(source: Column, canonical: Column, best: Column) -> Column:
    """Similarity, and 0.05 for each word shared with the target's name, 1 at most. Both are short, so it isn't rounded before."""
    shared = F.size(F.array_intersect(X.name_tokens(X.normalized_name(source)), X.name_tokens(X.normalized_name(canonical))))
    return F.when(best < 1, F.least(F.lit(1.0), best + 0.05 * shared)).otherwise(best)


def type_signal(source: Column, target: Column) -> Column:
    score = F.when(source == "unknown", 0.3).when(source == target, 1.0)
    for s, near in _NEAR_TYPES.items():
        for t, v in near.items():
            score = score.when((source == s) & (target == t), v)
    return score.when(target.isin("string", "text"), 0.5).otherwise(0.2)


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def tag_support(patterns: Column, tags: Column) -> Column:
    """Structs (n, at, tag, found) of the tags that patterns support."""
    known = F.create_map(*[x for k, v in _TAG_PATTERNS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    all_tags = F.transform(tags, lambda t, i: F.struct(F.size(F.array_intersect(F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")), patterns)).alias("n"), (-i).alias("at"), t.alias("tag"), F.array_intersect(F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")), patterns).alias("found")))
    return F.filter(all_tags, lambda x: x["n"] > 0)


def pattern_signal(patterns: Column, fmt: Column, tags: Column, has_enum: Column) -> Column:
    """1 where a pattern confirms the format; 0.6 and 0.2 a pattern that supports a tag; 0.7 at least for few values against an enum."""
    wanted = F.try_element_at(_literal_map(_FORMAT_PATTERN), fmt)
    support = F.array_max(F.transform(tag_support(patterns, tags), lambda x: x["n"]))
    tagged = F.when(support.isNotNull(), F.least(F.lit(1.0), 0.6 + 0.2 * support)).otherwise(0.0)
    few = has_enum & F.array_contains(patterns, "enum_like")
    return F.when(F.size(patterns) == 0, 0.0).when(F.coalesce(F.array_contains(patterns, wanted), F.lit(False)), 1.0).otherwise(F.greatest(tagged, F.when(few, 0.7).otherwise(0.0)))


def range_signal(low: Column, high: Column, lo: Column, hi: Column) -> Column:
    """1 inside the target's bounds, 0.4 partly, 0 outside or where bounds are missing on a side."""
    inside = (low >= F.coalesce(lo, F.lit(float("-inf")))) & (high <= F.coalesce(hi, F.lit(float("inf"))))
    apart = (high < F.coalesce(lo, F.lit(float("-inf")))) | (low > F.coalesce(hi, F.lit(float("inf"))))
    return F.when((lo.isNull() & hi.isNull()) | low.isNull() | high.isNull(), 0.0).when(inside, 1.0).when(apart, 0.0).otherwise(0.4)


def confidence(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum with weights scaled to 1, to four decimals, between 0 and 1."""
    used = {k: w for k, w in (weights or WEIGHTS).items() if w > 0}
    total = sum(used.values()) or 1.0
    score = F.lit(0.0)
    for k, w in used.items():
        score = score + F.lit(w / total) * signals.get(k, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4)))


def status(c: Column, auto: float = AUTO_FROM, review: float = REVIEW_FROM) -> Column:
    return F.when(c >= auto, AUTO).when(c >= review, REVIEW).otherwise(LOW)


def candidates(profiles: DataFrame, canonical: DataFrame, weights: dict[str, float] | None = None, floor: float = FLOOR, semantic=None) -> DataFrame:
    """Pairs from ``floor`` on, with signals, reasons, and ``rank`` within the source field.

    profiles: as ``operators.profile``; canonical: as ``plans.schema.canonical_frame``. Columns ``group`` on both sides, if
    any, keep providers apart. ``semantic``: function of (source text, target text) columns."""
    by = ["group"] if "group" in profiles.columns and "group" in canonical.columns else []
    # the table of target fields is as long as a schema
    x = profiles.join(F.broadcast(canonical), by) if by else profiles.crossJoin(F.broadcast(canonical))
    f, c = F.col("field"), F.col("canonical")
    x = x.withColumn("near", name_parts(f, c, F.col("aliases")))
    signals = {
        "alias": alias_signal(f, c, F.col("aliases")),
        "name": F.round(name_signal(f, c, F.col("near.s")), 4),
        "type": type_signal(F.coalesce("declared_type", "inferred_type") if "declared_type" in profiles.columns else F.col("inferred_type"), F.col("type")),
        "pattern": F.round(pattern_signal(F.col("patterns"), F.col("format"), F.col("tags"), F.col("has_enum")), 4),
        "range": range_signal(F.col("min"), F.col("max"), F.col("lo"), F.col("hi")),
    }
    if semantic is not None and (weights or WEIGHTS).get("semantic", 0) > 0:
        signals["semantic"] = semantic(F.trim(F.replace(f, F.lit("_"), F.lit(" "))), F.col("words"))
    x = x.withColumns({f"s_{k}": v for k, v in signals.items()})
    own = {k: F.col(f"s_{k}") for k in signals}
    x = x.withColumn("confidence", confidence(own, weights)).where(F.col("confidence") >= floor)
    x = x.withColumn("reasons", reasons()).withColumn("signals", F.create_map(*[y for k in signals for y in (F.lit(k), F.col(f"s_{k}"))]))
    order = Window.partitionBy(*by, "position").orderBy(F.desc("confidence"), F.desc("s_alias"), F.desc("s_name"), "place")
    return x.withColumn("rank", F.row_number().over(order)).select(*by, "field", "position", "inferred_type", "canonical", "place", "confidence", "rank", "signals", "reasons")


def reasons() -> Column:
    """Why a pair has its score, in words; for the columns that ``candidates`` makes."""
    f, c, n = F.col("field"), F.col("canonical"), X.normalized_name(F.col("field"))
    wanted = F.try_element_at(_literal_map(_FORMAT_PATTERN), F.col("format"))
    best = F.array_max(tag_support(F.col("patterns"), F.col("tags")))
    bounds = F.format_string("observed %s to %s, target %s to %s", F.col("min").cast("string"), F.col("max").cast("string"), F.coalesce(F.col("lo").cast("string"), F.lit("any")), F.coalesce(F.col("hi").cast("string"), F.lit("any")))
    return F.array_compact(F.array(
        F.when(n == X.normalized_name(c), F.format_string("%s is the target's name", f)).when(F.col("s_alias") == 1, F.format_string("%s is an alias of %s", f, c)),
        F.when(F.col("s_name") > 0, F.format_string("name similarity %.2f of %s and %s", F.col("s_name"), f, F.col("near.target"))),
        F.format_string("type %s for %s", F.col("inferred_type"), F.col("type")),
        F.when(F.array_contains("patterns", wanted), F.format_string("pattern %s confirms format %s", wanted, F.col("format")))
        .when(best.isNotNull() & (F.col("s_pattern") > 0), F.format_string("patterns %s support tag %s", F.array_join(F.array_sort(best["found"]), " "), best["tag"]))
        .when(F.col("s_pattern") > 0, F.lit("few distinct values fit the enumeration")),
        F.when((F.col("lo").isNotNull() | F.col("hi").isNotNull()) & F.col("min").isNotNull() & F.col("max").isNotNull(), bounds),
    ))


def assign(ranked: DataFrame, profiles: DataFrame, auto: float = AUTO_FROM, review: float = REVIEW_FROM) -> DataFrame:
    """(field, position, canonical, confidence, status, inferred_type, signals, reasons): each source field with the best target
    that no field before it took. Fields come in order of their best confidence, position and name."""
    by = ["group"] if "group" in ranked.columns else []
    own = ranked.groupBy(*by, "position").agg(F.array_sort(F.collect_list(F.struct("rank", "canonical"))).alias("c"), F.max("confidence").alias("best"))
    fields = profiles.select(*by, "field", "position", "inferred_type")
    lists = fields.join(own, [*by, "position"], "left").select(*by, F.struct((-F.coalesce("best", F.lit(0.0))).alias("b"), "position", "field", F.transform(F.coalesce("c", F.array().cast("array<struct<rank:int,canonical:string>>")), lambda s: s["canonical"]).alias("c")).alias("x"))
    groups = lists.groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<position:int,canonical:string>>").alias("out"))

    def take(have: Column, x: Column) -> Column:
        pick = F.get(F.filter(x["c"], lambda t: ~F.array_contains(have["taken"], t)), F.lit(0))
        return F.struct(F.when(pick.isNull(), have["taken"]).otherwise(F.array_append(have["taken"], pick)).alias("taken"), F.array_append(have["out"], F.struct(x["position"].alias("position"), pick.alias("canonical"))).alias("out"))

    decided = groups.select(*by, F.inline(F.aggregate("xs", start, take, lambda s: s["out"])))
    out = decided.join(fields, [*by, "position"]).join(ranked.select(*by, "position", "canonical", "confidence", "signals", "reasons"), [*by, "position", "canonical"], "left")
    none = F.col("canonical").isNull()
    return out.select(
        *by, "field", "position", "canonical", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(none, UNMAPPED).otherwise(status(F.col("confidence"), auto, review)).alias("status"),
        "inferred_type", "signals", F.when(none, F.array(F.lit("no target field from the floor on"))).otherwise(F.col("reasons")).alias("reasons"))
