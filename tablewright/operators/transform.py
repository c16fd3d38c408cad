"""Source rows to target columns: renaming, coercion, and the values that couldn't be coerced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.schema import Entity, Mapping

TRUE, FALSE = ("true", "yes", "y", "t", "1"), ("false", "no", "n", "f", "0")


def coerced(c: Column, kind: str | None) -> Column:
    """Value in the Spark type of a logical type; null for blank and for what can't be coerced."""
    v = X.value_or_null(c)
    plain = F.replace(v, F.lit(","), F.lit(""))
    number = F.when(plain.rlike(X.FLOAT), plain.try_cast("double"))
    if kind == "integer":
        return F.when(F.contains(v, F.lit(".")), F.when(F.abs(number) < 9.2e18, number.cast("long"))).when(plain.rlike("^[+-]?[0-9]+$"), plain.try_cast("long"))
    if kind == "decimal":
        return number
    if kind == "percentage":
        bare = F.replace(X.stripped(F.regexp_replace(v, "%+$", "")), F.lit(","), F.lit(""))
        return F.when(bare.rlike(X.FLOAT), bare.try_cast("double"))
    if kind == "boolean":
        return F.when(F.lower(v).isin(*TRUE), True).when(F.lower(v).isin(*FALSE), False)
    return F.upper(v) if kind == "currency_code" else v


def failed(c: Column, kind: str | None) -> Column:
    """Whether a value is there and can't be coerced."""
    return X.value_or_null(c).isNotNull() & coerced(c, kind).isNull()


def _text(df: DataFrame, name: str) -> Column:
    return X.as_text(F.col("`" + name.replace("`", "``") + "`"), df.schema[name].dataType)


def _plan(df: DataFrame, mapping: Mapping, entity: Entity | None, include_review: bool) -> dict[str, str]:
    """Source column by target column, in the order of the output; of two sources of a target the later counts."""
    used = {s: t for s, t in mapping.usable(include_review).items() if s in df.columns}
    last = {t: s for s, t in used.items()}
    order = [n for n in entity.fields if n in last] if entity else list(dict.fromkeys(used.values()))
    return {t: last[t] for t in order}


def transform(df: DataFrame, mapping: Mapping, entity: Entity | None = None, keep_unmapped: bool = False, include_review: bool = False) -> DataFrame:
    """The target columns of every row, a single projection. Without an entity values stay as they are. ``keep_unmapped``: the
    columns that no usable mapping names follow, unless a target column has their name."""
    plan = _plan(df, mapping, entity, include_review)
    own = lambda s: F.col("`" + s.replace("`", "``") + "`")
    out = [(coerced(_text(df, s), entity.fields[t].type) if entity else own(s)).alias(t) for t, s in plan.items()]
    if keep_unmapped:
        mapped = set(mapping.usable(include_review))
        out += [own(c) for c in df.columns if c not in mapped and c not in plan]
    return df.select(*out)


def checked(df: DataFrame, mapping: Mapping, entity: Entity, include_review: bool = False) -> DataFrame:
    """Target columns as text, where coercion failed with the raw value: what rules are checked on."""
    out = []
    for t, s in _plan(df, mapping, entity, include_review).items():
        raw, kind = _text(df, s), entity.fields[t].type
        value = coerced(raw, kind)
        shown = F.when(value, "True").when(~value, "False") if kind == "boolean" else value.cast("string")
        out.append(F.coalesce(shown, X.value_or_null(raw)).alias(t))
    return df.select(*out)


def coercion_errors(df: DataFrame, mapping: Mapping, entity: Entity, include_review: bool = False, row: str | None = None) -> DataFrame:
    """(row, field, value, target_type) of every value that couldn't be coerced. ``row``: column that numbers the rows."""
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    cells = []
    for t, s in _plan(df, mapping, entity, include_review).items():
        raw, kind = _text(df, s), entity.fields[t].type
        cells.append(F.when(failed(raw, kind), F.struct(F.lit(t).alias("field"), raw.alias("value"), F.lit(kind).alias("target_type"))))
    if not cells:
        return df.sparkSession.createDataFrame([], "row long, field string, value string, target_type string")
    return df.select(number.alias("row"), F.inline(F.array_compact(F.array(*cells))))
