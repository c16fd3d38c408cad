"""Command line: version, profile, suggest, rules, apply, drift-check, onboard, onboard-batch."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import rules
from .plans import onboarding
from .plans.engine import Config, Engine, FieldProfile, Profile
from .plans.schema import load_entity, load_mapping, to_plain, write_json
from .sources import readers

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, kw in options:
            c.add_argument(flag, **kw)

    need, flag = {"required": True}, {"action": "store_true"}
    engine = ("--engine-config", {})
    command("version")
    command("profile", ("--source", {}), ("--source-config", {}), ("--out", {"default": "profile.json"}), engine)
    command("suggest", ("--profile", need), ("--canonical", need), ("--out", {"default": "suggestions.json"}), engine)
    command("rules", ("--suggestions", need), ("--canonical", need), ("--out", {"default": "validation_rules.yml"}))
    command("apply", ("--source", need), ("--mapping", need), ("--canonical", {}), ("--out", {"default": "canonical_output"}), ("--keep-unmapped", flag), ("--include-review", flag), engine)
    command("drift-check", ("--source", need), ("--mapping", need), ("--canonical", need), ("--out", {"default": "drift_report.json"}), engine)
    command("onboard", ("--config", need), ("--out", {}), engine)
    command("onboard-batch", ("--config-dir", need), ("--combined-out", {}), engine)
    return p


def load_profile(path: str) -> Profile:
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    return Profile(doc["source_metadata"], doc["row_count_sampled"], [FieldProfile(**x) for x in doc["fields"]], doc["created_at"])


def profile_document(p: Profile) -> dict:
    return {"source_metadata": p.source_metadata, "row_count_sampled": p.row_count_sampled, "created_at": p.created_at, "fields": [to_plain(f) for f in p.fields]}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "rules":
        found = rules.rules_for(load_entity(a.canonical), load_mapping(a.suggestions))
        rules.save_rules(found, a.out)
        print(f"{len(found)} rules in {a.out}")
        return 0
    spark = spark or SparkSession.builder.appName("tablewright").getOrCreate()
    engine = Engine(spark, Config.from_yaml(a.engine_config) if a.engine_config else None)
    if a.command == "profile":
        if bool(a.source) == bool(a.source_config):
            _parser().error("give either --source or --source-config")
        p = engine.profile_source(a.source) if a.source else engine.profile_source_config(a.source_config)
        write_json(profile_document(p), a.out)
        print(f"{len(p.fields)} fields of {p.row_count_sampled} rows in {a.out}")
    elif a.command == "suggest":
        m = engine.suggest(load_profile(a.profile), load_entity(a.canonical))
        write_json(m, a.out)
        for s in m.mappings:
            print(f"{s.source_field} -> {s.canonical_field or '-'} {s.confidence:.2f} {s.status}")
    elif a.command == "apply":
        entity = load_entity(a.canonical) if a.canonical else None
        df, m = readers.read_path(spark, a.source), load_mapping(a.mapping)
        out = engine.transform(df, m, entity, keep_unmapped=a.keep_unmapped, include_review=a.include_review)
        engine.write_csv(out, a.out)
        errors = engine.coercion_errors(df, m, entity, a.include_review).count() if entity else 0
        print(f"{len(out.columns)} columns in {a.out}, {errors} values not coerced")
    elif a.command == "drift-check":
        r = engine.drift(readers.read_path(spark, a.source), load_mapping(a.mapping), load_entity(a.canonical))
        write_json(r, a.out)
        print(r.status)
    elif a.command == "onboard":
        r = onboarding.onboard(engine, a.config, write=True)
        if a.out:
            write_json(r, a.out)
        print(f"{r.provider_id}: {r.readiness_score} {r.status}, {r.next_action}")
    else:
        reports, total = onboarding.onboard_all(engine, a.config_dir, combined_out=a.combined_out)
        for r in reports:
            print(f"{r.provider_id}: {r.readiness_score} {r.status}")
        print(f"{total['total_providers']} providers")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
