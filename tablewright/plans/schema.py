"""Target schemas, mappings and rules as small driver-side records; YAML and JSON in and out."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TYPES = ("string", "text", "integer", "decimal", "boolean", "date", "timestamp", "email", "currency_code", "percentage", "json", "array", "unknown")
PII_LEVELS = ("none", "low", "moderate", "high", "phi")
AUTO, REVIEW, LOW, UNMAPPED, APPROVED = "auto_approved", "requires_review", "low_confidence", "unmapped", "approved"


class SchemaError(ValueError):
    """A target schema that can't be used."""


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass(frozen=True)
class Field:
    """A column of a target schema."""

    name: str
    type: str
    required: bool = False
    description: str | None = None
    aliases: list[str] = field(default_factory=list)
    min: float | None = None
    max: float | None = None
    enum: list[str] | None = None
    unit: str | None = None
    format: str | None = None
    pii: str | None = None
    standard: dict[str, str] | None = None
    semantic_tags: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Entity:
    """A versioned target schema."""

    domain: str
    entity: str
    version: int
    fields: dict[str, Field]
    primary_key: list[str] = field(default_factory=list)
    standards: list[str] = field(default_factory=list)

    def struct(self) -> T.StructType:
        """Spark schema after transformation, with each field's description as metadata."""
        kinds = {"integer": T.LongType(), "decimal": T.DoubleType(), "percentage": T.DoubleType(), "boolean": T.BooleanType()}
        return T.StructType([T.StructField(f.name, kinds.get(f.type, T.StringType()), not f.required, {k: v for k, v in dataclasses.asdict(f).items() if v not in (None, [])}) for f in self.fields.values()])


def entity_from(doc: Any) -> Entity:
    """Entity of a parsed document, or ``SchemaError``."""
    if not isinstance(doc, dict):
        raise SchemaError("a target schema is a mapping")
    missing = [k for k in ("domain", "entity", "version", "fields") if k not in doc]
    if missing:
        raise SchemaError(f"the target schema lacks {', '.join(missing)}")
    specs = doc["fields"]
    if not isinstance(specs, dict) or not specs:
        raise SchemaError("fields is a mapping with one entry at least")
    known = {f.name for f in dataclasses.fields(Field)} - {"name"}
    fields = {}
    for name, spec in specs.items():
        if not isinstance(spec, dict) or "type" not in spec:
            raise SchemaError(f"field {name!r} is a mapping with a type")
        if spec["type"] not in TYPES:
            raise SchemaError(f"field {name!r} has type {spec['type']!r}; types are {', '.join(TYPES)}")
        if spec.get("pii") is not None and spec["pii"] not in PII_LEVELS:
            raise SchemaError(f"field {name!r} has pii level {spec['pii']!r}; levels are {', '.join(PII_LEVELS)}")
        if extra := set(spec) - known:
            raise SchemaError(f"field {name!r} has unknown keys {', '.join(sorted(extra))}")
        fields[name] = Field(name=name, **{k: v for k, v in spec.items() if v is not None})
    keys = list(doc.get("primary_key") or [])
    if unknown := [k for k in keys if k not in fields]:
        raise SchemaError(f"primary_key names unknown fields {', '.join(unknown)}")
    try:
        return Entity(str(doc["domain"]), str(doc["entity"]), int(doc["version"]), fields, keys, list(doc.get("standards") or []))
    except (TypeError, ValueError) as error:
        raise SchemaError(str(error)) from error


def load_entity(path: str) -> Entity:
    if not os.path.isfile(path):
        raise SchemaError(f"no target schema at {path}")
    with open(path, encoding="utf-8") as f:
        return entity_from(yaml.safe_load(f))


_CANON = T.StructType([
    T.StructField("place", T.IntegerType()), T.StructField("canonical", T.StringType()), T.StructField("type", T.StringType()), T.StructField("required", T.BooleanType()),
    T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("has_enum", T.BooleanType()),
    T.StructField("format", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("words", T.StringType())])


def canonical_frame(spark: SparkSession, entity: Entity) -> DataFrame:
    """One row a target field."""
    rows = []
    for i, f in enumerate(entity.fields.values()):
        words = " ".join(p for p in (f.name.replace("_", " "), *f.aliases, *f.semantic_tags, f.description) if p)
        rows.append((i, f.name, f.type, f.required, list(f.aliases), None if f.min is None else float(f.min), None if f.max is None else float(f.max), bool(f.enum), f.format, list(f.semantic_tags), words))
    return spark.createDataFrame(rows, _CANON)


@dataclass
class Suggestion:
    """What a source field is mapped to, and why."""

    source_field: str
    canonical_field: str | None
    confidence: float
    status: str
    reasons: list[str] = field(default_factory=list)
    signals: dict[str, Any] = field(default_factory=dict)


@dataclass
class Mapping:
    canonical: dict[str, Any]
    mappings: list[Suggestion]
    created_at: str | None = None

    def usable(self, include_review: bool = False) -> dict[str, str]:
        """Target field by source field, of approved mappings and on demand of those to review."""
        good = {AUTO, APPROVED} | ({REVIEW} if include_review else set())
        return {m.source_field: m.canonical_field for m in self.mappings if m.canonical_field and m.status in good}

    def promote(self, source_field: str) -> Mapping:
        """Copy in which a person approved one suggestion."""
        return dataclasses.replace(self, mappings=[dataclasses.replace(m, status=APPROVED) if m.source_field == source_field and m.canonical_field else m for m in self.mappings])


def to_plain(x: Any) -> Any:
    return dataclasses.asdict(x) if dataclasses.is_dataclass(x) else [to_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_json(x: Any, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(to_plain(x), f, indent=2, default=str)
        f.write("\n")


def load_mapping(path: str) -> Mapping:
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    return Mapping(doc["canonical"], [Suggestion(**m) for m in doc["mappings"]], doc.get("created_at"))
