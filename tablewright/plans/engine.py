"""Entry point of the library: profile, map, validate, transform, compare and onboard with one configuration."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, match, rules, transform
from ..operators.profile import profile
from ..sources import readers
from . import semantic
from .schema import Entity, Mapping, Suggestion, canonical_frame, load_entity, utc_now


@dataclass(frozen=True)
class Config:
    """``sample_limit``: rows that profiles look at, all if null. Transformation and validation take all rows in any case."""

    auto_approve_threshold: float = match.AUTO_FROM
    review_threshold: float = match.REVIEW_FROM
    mapping_floor: float = match.FLOOR
    weights: dict[str, float] = field(default_factory=lambda: dict(match.WEIGHTS))
    sample_limit: int | None = None
    sample_values: int = 5
    mask_pii: bool = True
    mask_enum: bool = True
    ai: semantic.SemanticConfig = field(default_factory=semantic.SemanticConfig)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            doc = yaml.safe_load(f) or {}
        if unknown := set(doc) - {f.name for f in dataclasses.fields(cls)}:
            raise ValueError(f"unknown settings {', '.join(sorted(unknown))}")
        if "ai" in doc:
            doc["ai"] = semantic.SemanticConfig(**doc["ai"])
        return cls(**doc)

    def with_overrides(self, **changes: Any) -> Config:
        known = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if k in known and v is not None})


@dataclass
class FieldProfile:
    name: str
    inferred_type: str
    null_rate: float
    unique_rate: float
    sample_values: list[str]
    patterns: list[str]
    min: float | None
    max: float | None
    avg_str_len: float | None
    distinct_count: int
    enum_candidates: list[str] | None
    pii_flags: list[str]
    position: int
    declared_type: str | None = None


@dataclass
class Profile:
    """Profile of a source, rates rounded as Python rounds. ``frame`` keeps the unrounded one."""

    source_metadata: dict[str, Any]
    row_count_sampled: int
    fields: list[FieldProfile]
    created_at: str
    frame: DataFrame | None = field(default=None, repr=False)

    def patterns(self) -> dict[str, list[str]]:
        return {f.name: f.patterns for f in self.fields}


_FRAME = "field string, position int, inferred_type string, min double, max double, patterns array<string>, declared_type string"


class Engine:
    """The library's operations on one Spark session."""

    def __init__(self, spark: SparkSession, config: Config | None = None, semantic_signal=None):
        self.spark, self.config, self.signal = spark, config or Config(), semantic_signal
        if self.signal is None and self.config.ai.enabled:
            self.signal = semantic.build(self.config.ai)
            if self.config.weights.get("semantic", 0) <= 0:
                self.config = self.config.with_overrides(weights=self.config.weights | {"semantic": self.config.ai.weight})

    # profiles

    def profile(self, df: DataFrame, metadata: dict[str, Any] | None = None, limit: int | None = None, declared: dict[str, str] | None = None) -> Profile:
        """Profile of a table, or of its first ``limit`` rows."""
        limit = limit or self.config.sample_limit
        frame = profile(df.limit(limit) if limit else df, sample_values=self.config.sample_values, mask_pii=self.config.mask_pii, mask_enum=self.config.mask_enum and self.config.mask_pii)
        rows = sorted(frame.collect(), key=lambda r: r.position)  # one row a column
        fields = []
        for r in rows:
            full = r.row_count - r.null_count
            fields.append(FieldProfile(
                r.field, r.inferred_type, round(r.null_count / r.row_count, 4) if r.row_count else 0.0, round(r.distinct_count / full, 4) if full else 0.0, r.sample_values, r.patterns, r.min, r.max,
                round(r.sum_len / full, 2) if full else None, r.distinct_count, r.enum_candidates, r.pii_flags, r.position, (declared or {}).get(r.field)))
        return Profile(metadata or {"type": "records"}, max((r.row_count for r in rows), default=0), fields, utc_now(), frame)

    def profile_records(self, records: list[dict[str, Any]], metadata: dict[str, Any] | None = None) -> Profile:
        """Profile of Python dictionaries; columns in order of first appearance, missing keys as null."""
        names = list(dict.fromkeys(k for r in records for k in r))
        if not names:
            return Profile(metadata or {"type": "records"}, len(records), [], utc_now())
        rows = [tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in records]
        return self.profile(self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), metadata)

    def profile_csv(self, path: str, limit: int | None = None, **options: Any) -> Profile:
        """Profile of a CSV file, whatever its ending; ``profile_json`` and ``profile_jsonl`` likewise."""
        return self._profile_as("csv", path, limit, options)

    def profile_json(self, path: str, limit: int | None = None, **options: Any) -> Profile:
        return self._profile_as("json", path, limit, options)

    def profile_jsonl(self, path: str, limit: int | None = None, **options: Any) -> Profile:
        return self._profile_as("jsonl", path, limit, options)

    def _profile_as(self, kind: str, path: str, limit: int | None, options: dict[str, Any]) -> Profile:
        return self.profile(readers.reader_for(kind)(self.spark, path=path, **options), {"type": kind, "path": path, "format": kind, "entity": "default"}, limit)

    #: Profilers of types of source that bring their own: function of (engine, settings).
    profilers: dict[str, Any] = {}

    @classmethod
    def register_profiler(cls, kind: str, profiler) -> None:
        cls.profilers[kind.strip().lower()] = profiler

    def profile_source(self, path: str, limit: int | None = None) -> Profile:
        kind = os.path.splitext(path)[1].lower().lstrip(".")
        return self.profile(readers.read_path(self.spark, path), {"type": kind, "path": path, "format": kind, "entity": "default"}, limit)

    def profile_source_config(self, path: str) -> Profile:
        source = readers.load_source(path)
        if own := self.profilers.get(source["type"].strip().lower()):
            return own(self, source)
        limit = int(source["sample_limit"]) if "sample_limit" in source else None
        return self.profile(readers.read_source(self.spark, source), {"type": source["type"], "path": source.get("path"), "entity": source.get("entity", "default")}, limit)

    # mappings

    def suggest(self, prof: Profile, entity: Entity) -> Mapping:
        """Best one-to-one mapping of a profile's fields."""
        fields = self.spark.createDataFrame([(f.name, f.position, f.inferred_type, f.min, f.max, f.patterns, f.declared_type) for f in prof.fields], _FRAME)
        c = self.config
        ranked = match.candidates(fields, canonical_frame(self.spark, entity), c.weights, c.mapping_floor, self.signal)
        rows = match.assign(ranked, fields, c.auto_approve_threshold, c.review_threshold).orderBy("position").collect()  # one row a column
        found = [Suggestion(r.field, r.canonical, r.confidence, r.status, list(r.reasons), dict(r.signals or {}) | {"_inferred_type": r.inferred_type}) for r in rows]
        return Mapping({"domain": entity.domain, "entity": entity.entity, "version": entity.version}, found, utc_now())

    def suggest_mappings(self, prof: Profile, schema_path: str) -> Mapping:
        return self.suggest(prof, load_entity(schema_path))

    # rules, rows

    def rules(self, mapping: Mapping, entity: Entity, prof: Profile | None = None) -> list[rules.Rule]:
        return rules.rules_for(entity, mapping, prof.patterns() if prof else None)

    def transform(self, df: DataFrame, mapping: Mapping, entity: Entity | None = None, **options: bool) -> DataFrame:
        return transform.transform(df, mapping, entity, **options)

    def validate(self, df: DataFrame, mapping: Mapping, entity: Entity, checks: list[rules.Rule], include_review: bool = True) -> rules.Report:
        return rules.validate(transform.checked(df, mapping, entity, include_review), checks)

    def coercion_errors(self, df: DataFrame, mapping: Mapping, entity: Entity, include_review: bool = False, row: str | None = None) -> DataFrame:
        return transform.coercion_errors(df, mapping, entity, include_review, row)

    def write_csv(self, df: DataFrame, path: str, single: bool = False) -> None:
        """CSV with a header, nulls empty, quotes doubled. ``single``: one file, for small results."""
        own = lambda c: F.col("`" + c.replace("`", "``") + "`")
        out = df.select(*[F.when(own(f.name), "True").when(~own(f.name), "False").alias(f.name) if f.dataType.typeName() == "boolean" else own(f.name) for f in df.schema])
        (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", escape='"')

    def drift(self, df: DataFrame, previous: Mapping, entity: Entity) -> drift.DriftReport:
        """What a new batch has otherwise than the mapping made for an earlier one."""
        return drift.detect(self.spark, previous, self.suggest(self.profile(df), entity), entity)
