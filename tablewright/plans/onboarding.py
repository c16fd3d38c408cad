"""Onboarding: all sources of a provider through the engine to a readiness report; many providers to a portfolio."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import yaml

from ..operators import drift, readiness
from ..sources import readers
from .engine import Engine
from .schema import AUTO, LOW, REVIEW, UNMAPPED, load_entity, utc_now, write_json


@dataclass(frozen=True)
class Source:
    name: str
    entity: str
    path: str
    canonical: str
    drift_path: str | None = None


@dataclass(frozen=True)
class Policy:
    minimum_readiness_score: int = 90
    require_required_fields: bool = True
    require_validation_pass: bool = True


@dataclass(frozen=True)
class Provider:
    id: str
    name: str
    sources: list[Source]
    environment: str = "staging"
    policy: Policy = field(default_factory=Policy)
    output_dir: str | None = None


@dataclass
class Report:
    provider_id: str
    provider_name: str
    environment: str
    status: str
    readiness_score: int
    summary: dict
    component_scores: dict
    sources: list[dict]
    deployment_recommendation: str
    auto_deploy_allowed: bool
    next_action: str
    created_at: str


def load_provider(path: str) -> Provider:
    """Provider of a YAML file; paths in it are relative to the file."""
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    base = os.path.dirname(os.path.abspath(path))
    at = lambda p: None if p is None else os.path.normpath(os.path.join(base, p))
    who = doc.get("provider") or {}
    sources = [Source(s["name"], s["entity"], at(s["path"]), at(s["canonical"]), at(s.get("drift_path"))) for s in doc.get("sources") or []]
    return Provider(
        who.get("id") or doc.get("provider_id", "unknown"), who.get("name") or doc.get("provider_name", "Unknown Provider"), sources, who.get("environment", "staging"),
        Policy(**(doc.get("deployment") or {})), at((doc.get("output") or {}).get("dir")))


def outcome(engine: Engine, s: Source) -> readiness.Outcome:
    """One source through profile, mapping, rules, transformation, validation and comparison."""
    entity = load_entity(s.canonical)
    df = readers.read_path(engine.spark, s.path)
    prof = engine.profile(df)
    mapping = engine.suggest(prof, entity)
    number = lambda st: sum(m.status == st for m in mapping.mappings)
    report = engine.validate(df, mapping, entity, engine.rules(mapping, entity, prof))
    moved = drift.NOT_CHECKED
    if s.drift_path:
        moved = engine.drift(readers.read_path(engine.spark, s.drift_path), mapping, entity).status
    return readiness.Outcome(
        s.name, s.entity, len(mapping.mappings), number(AUTO), number(REVIEW), number(LOW), number(UNMAPPED), sorted(set(mapping.usable(True).values())), [f.name for f in entity.fields.values() if f.required],
        report.passed, len(report.findings), sum(not f.passed and f.severity == "error" for f in report.findings), moved)


def may_deploy(policy: Policy, r: readiness.Readiness) -> bool:
    return r.score >= policy.minimum_readiness_score and (r.required_fields_covered or not policy.require_required_fields) and (r.validation_passed or not policy.require_validation_pass)


def onboard(engine: Engine, config_path: str, write: bool = True) -> Report:
    """Readiness report of one provider; its sources run side by side."""
    p = load_provider(config_path)
    with ThreadPoolExecutor(4) as pool:
        outcomes = list(pool.map(lambda s: outcome(engine, s), p.sources))
    r = readiness.readiness(engine.spark, outcomes)
    status = readiness.status_of(r.score)
    report = Report(p.id, p.name, p.environment, status, r.score, r.summary, r.component_scores, r.sources, readiness.ADVICE[status], may_deploy(p.policy, r), readiness.NEXT[status], utc_now())
    if write and p.output_dir:
        write_json(report, os.path.join(p.output_dir, f"{p.id}_readiness.json"))
    return report


def onboard_all(engine: Engine, folder: str, write: bool = True, combined_out: str | None = None) -> tuple[list[Report], dict]:
    """Reports of every YAML file of a folder, by name, and their number in each band."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    files = sorted(n for n in os.listdir(folder) if n.endswith((".yml", ".yaml")))
    if not files:
        raise FileNotFoundError(f"no provider configuration in {folder}")
    reports = [onboard(engine, os.path.join(folder, n), write) for n in files]
    total = {"total_providers": len(reports)} | {k: sum(r.status == k for r in reports) for k in readiness.NEXT}
    total["providers"] = [{"provider_id": r.provider_id, "provider_name": r.provider_name, "readiness_score": r.readiness_score, "status": r.status, "auto_deploy_allowed": r.auto_deploy_allowed} for r in reports]
    total["created_at"] = utc_now()
    if write and combined_out:
        write_json(total, combined_out)
    return reports, total
