"""Differences between a new batch of a source and the mapping made for an earlier one, as joins of small field tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import APPROVED, AUTO, REVIEW, Entity, Mapping, utc_now

NO_DRIFT, DRIFT, NOT_CHECKED = "no_drift", "drift_detected", "not_checked"
_MAP = "field string, canonical string, status string, inferred_type string, confidence double"


@dataclass
class DriftReport:
    status: str
    missing_fields: list[str] = field(default_factory=list)
    new_fields: list[str] = field(default_factory=list)
    type_changes: list[dict] = field(default_factory=list)
    unmapped_required: list[str] = field(default_factory=list)
    suggested_remappings: list[dict] = field(default_factory=list)
    created_at: str = ""


def mapping_frame(spark: SparkSession, mapping: Mapping) -> DataFrame:
    """One row a source field."""
    return spark.createDataFrame([(m.source_field, m.canonical_field, m.status, m.signals.get("_inferred_type"), float(m.confidence)) for m in mapping.mappings], _MAP)


def _mapped(x: DataFrame) -> DataFrame:
    return x.where(F.col("canonical").isNotNull() & F.col("status").isin(AUTO, APPROVED, REVIEW))


def missing_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new, "field", "left_anti").select("field")


def new_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, "field", "left_anti").select("field")


def type_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, old_type, new_type) of fields in both with another type; a type that wasn't recorded didn't change."""
    now = new.select("field", F.col("inferred_type").alias("new_type"))
    return old.select("field", F.col("inferred_type").alias("old_type")).join(now, "field").where(F.col("old_type") != F.col("new_type"))


def unmapped_required(required: DataFrame, new: DataFrame) -> DataFrame:
    """Required target fields (canonical) that nothing is mapped to any more."""
    return required.join(_mapped(new), "canonical", "left_anti").select("canonical")


def remappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, canonical, confidence): new fields whose target was that of a field that is missing now."""
    orphans = _mapped(old).join(new, "field", "left_anti").select("canonical").distinct()
    fresh = new.where(F.col("canonical").isNotNull() & F.col("status").isin(AUTO, REVIEW)).join(old, "field", "left_anti")
    return fresh.join(orphans, "canonical", "left_semi").select("field", "canonical", "confidence")


def detect(spark: SparkSession, previous: Mapping, now: Mapping, entity: Entity) -> DriftReport:
    """Report from the earlier mapping and the one suggested for the new batch. Lists are sorted by field; remappings come in the
    order of the new batch's fields."""
    old, new = mapping_frame(spark, previous), mapping_frame(spark, now)
    required = spark.createDataFrame([(f.name,) for f in entity.fields.values() if f.required], "canonical string")
    names = lambda df: sorted(r[0] for r in df.collect())  # noqa: E731  # field names only
    r = DriftReport(NO_DRIFT, names(missing_fields(old, new)), names(new_fields(old, new)), [x.asDict() for x in type_changes(old, new).orderBy("field").collect()], names(unmapped_required(required, new)), created_at=utc_now())
    place = {m.source_field: i for i, m in enumerate(now.mappings)}
    found = sorted(remappings(old, new).collect(), key=lambda x: place[x.field])
    r.suggested_remappings = [{"source_field": x.field, "canonical_field": x.canonical, "confidence": x.confidence} for x in found]
    if r.missing_fields or r.new_fields or r.type_changes or r.unmapped_required:
        r.status = DRIFT
    return r
