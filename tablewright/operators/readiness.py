"""Readiness of a provider: five ratios of its sources' outcomes, weighted to a score from 0 to 100."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .drift import NO_DRIFT, NOT_CHECKED

WEIGHTS = {"schema_mapping": 0.35, "required_fields": 0.25, "validation": 0.15, "auto_approved": 0.15, "drift": 0.10}
READY, MINOR, NEEDS_REVIEW, BLOCKED = "ready_for_auto_deploy", "ready_with_minor_review", "needs_mapping_review", "blocked"
NEXT = {READY: "auto_deploy", MINOR: "review_then_deploy", NEEDS_REVIEW: "resolve_mappings", BLOCKED: "block_and_escalate"}
ADVICE = {
    READY: "Required fields are mapped and validation passed: the canonical package can be deployed.",
    MINOR: "Coverage is good: have the mappings marked for review confirmed, then deploy.",
    NEEDS_REVIEW: "Mappings or required fields are open: settle them and run onboarding again.",
    BLOCKED: "Required fields are missing or validation fails: this provider can't be onboarded yet.",
}
SCHEMA = "provider string, source string, entity string, total int, auto int, review int, low int, unmapped int, covered array<string>, required array<string>, passed boolean, findings int, failures int, drift string"


@dataclass(frozen=True)
class Outcome:
    """What the pipeline found for one source."""

    source: str
    entity: str
    total: int
    auto: int
    review: int
    low: int
    unmapped: int
    covered: list[str]
    required: list[str]
    passed: bool
    findings: int = 0
    failures: int = 0
    drift: str = NOT_CHECKED


@dataclass
class Readiness:
    score: int
    summary: dict
    component_scores: dict[str, dict]
    required_fields_covered: bool
    validation_passed: bool
    sources: list[dict] = field(default_factory=list)


def outcome_frame(spark: SparkSession, outcomes: list[tuple[str, Outcome]]) -> DataFrame:
    return spark.createDataFrame([(p, o.source, o.entity, o.total, o.auto, o.review, o.low, o.unmapped, sorted(o.covered), sorted(o.required), o.passed, o.findings, o.failures, o.drift) for p, o in outcomes], SCHEMA)


def required_coverage(outcomes: DataFrame) -> DataFrame:
    """(provider, required, covered): required target fields over all entities, those of an entity covered by any of its sources."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    by_entity = outcomes.groupBy("provider", "entity").agg(union("required").alias("r"), union("covered").alias("c"))
    return by_entity.groupBy("provider").agg(F.sum(F.size("r")).cast("int").alias("required"), F.sum(F.size(F.array_intersect("r", "c"))).cast("int").alias("covered"))


def ratio(a: Column, b: Column) -> Column:
    """Share between 0 and 1; 1 where there is nothing to satisfy."""
    return F.when(b <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b)))


def totals(outcomes: DataFrame) -> DataFrame:
    """One row a provider: sums, ratios (``q_``) and points (``p_``) of the components, and the score."""
    checked = F.col("drift") != NOT_CHECKED
    sums = outcomes.groupBy("provider").agg(
        *[F.sum(c).cast("int").alias(c) for c in ("total", "auto", "review", "low", "unmapped", "findings", "failures")],
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(checked).alias("checked"), F.count_if(F.col("drift") == NO_DRIFT).alias("steady"))
    x = sums.join(required_coverage(outcomes), "provider").withColumn("mapped", F.col("auto") + F.col("review"))
    parts = {
        "schema_mapping": ratio(F.col("mapped"), F.col("total")),
        "required_fields": ratio(F.col("covered"), F.col("required")),
        "validation": ratio(F.col("findings") - F.col("failures"), F.col("findings")),
        "auto_approved": ratio(F.col("auto"), F.col("mapped")),
        "drift": ratio(F.col("steady"), F.col("checked")),
    }
    x = x.withColumns({f"q_{k}": v for k, v in parts.items()})
    x = x.withColumns({f"p_{k}": F.round(F.col(f"q_{k}") * (w * 100), 2) for k, w in WEIGHTS.items()})
    score = sum((F.col(f"p_{k}") for k in WEIGHTS), F.lit(0.0))
    return x.withColumn("score", F.bround(score, 0).cast("int"))


def band(score: Column) -> Column:
    return F.when(score >= 90, READY).when(score >= 80, MINOR).when(score >= 60, NEEDS_REVIEW).otherwise(BLOCKED)


def status_of(score: int) -> str:
    return READY if score >= 90 else MINOR if score >= 80 else NEEDS_REVIEW if score >= 60 else BLOCKED


def rollup(scores: DataFrame) -> DataFrame:
    """One row over all providers: their number, and how many are in each band."""
    b = band(F.col("score"))
    return scores.agg(F.count(F.lit(1)).alias("providers"), *[F.count_if(b == k).alias(k) for k in NEXT])


def readiness(spark: SparkSession, outcomes: list[Outcome]) -> Readiness:
    """Readiness of one provider; without outcomes there is nothing to satisfy."""
    rows = totals(outcome_frame(spark, [("p", o) for o in outcomes])).collect() if outcomes else []  # one row
    t = rows[0].asDict() if rows else dict.fromkeys(("total", "mapped", "auto", "review", "low", "required", "covered"), 0) | {f"q_{k}": 1.0 for k in WEIGHTS} | {f"p_{k}": w * 100 for k, w in WEIGHTS.items()} | {"score": 100, "passed": True}
    done = t["required"] == t["covered"]
    summary = {"total_fields": t["total"], "mapped_fields": t["mapped"], "auto_approved_mappings": t["auto"], "requires_review": t["review"], "low_confidence": t["low"], "required_fields_covered": done}
    parts = {k: {"ratio": round(t[f"q_{k}"], 4), "weight": w, "points": t[f"p_{k}"]} for k, w in WEIGHTS.items()}
    sources = [{"source": o.source, "entity": o.entity, "total_source_fields": o.total, "mapped_fields": o.auto + o.review, "auto_approved": o.auto, "requires_review": o.review, "low_confidence": o.low, "unmapped": o.unmapped, "validation_passed": o.passed, "validation_findings": o.findings, "validation_failures": o.failures, "drift_status": o.drift} for o in outcomes]
    return Readiness(t["score"], summary, parts, done, t["passed"], sources)
