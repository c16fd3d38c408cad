import json

import pytest
import yaml
from pyspark.sql import functions as F

from tablewright import cli
from tablewright.functions import formats, text as X
from tablewright.operators import drift, match, profile, readiness, rules, transform
from tablewright.plans import onboarding, semantic
from tablewright.plans import schema as S
from tablewright.plans.engine import Config, Engine
from tablewright.sources import readers
from tablewright.streaming import batches

PERSON = {
    "domain": "d", "entity": "person", "version": 1, "primary_key": ["id"], "fields": {
        "id": {"type": "string", "required": True, "semantic_tags": ["identifier"], "aliases": ["person_id", "pid"]},
        "email": {"type": "email", "required": True, "format": "email", "aliases": ["mail"]},
        "age": {"type": "integer", "min": 0, "max": 120, "aliases": ["years"]},
        "active": {"type": "boolean", "aliases": ["is_active"]},
        "born": {"type": "date", "pii": "phi", "aliases": ["dob"]}}}
ROWS = [("p-%03d" % i, f"a{i}@x.org", str(20 + i), "yes" if i % 2 else "no", f"19{50 + i}-01-02") for i in range(20)]
COLUMNS = ["pid", "mail", "years", "is_active", "dob"]


def one(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_value_types(spark):
    want = {"a@b.co": "email", "usd": "currency_code", "12 %": "percentage", "-7": "integer", "1.": "decimal", "Yes": "boolean", "1": "integer", "2024-01-02T03:04": "timestamp", "1/2/2024": "date", '{"a": 1}': "json", "[1, 2]": "array", "[x": "string", "1e5": "string"}
    assert dict(zip(want, one(spark, X.value_type, list(want)))) == want


def test_names_and_numbers(spark):
    assert one(spark, X.normalized_name, ["studentEmail", " Home  Phone ", "__a--b__", "ABC", ""]) == ["student_email", "home_phone", "a_b", "abc", ""]
    assert one(spark, X.number, ["1,234.5", "12%", " -3 ", "abc", "", None, "nan", "1e3", "1d"]) == [1234.5, 12.0, -3.0, None, None, None, None, 1000.0, None]
    assert one(spark, X.value_or_null, ["  x ", "\t", None]) == ["x", None, None]
    assert one(spark, lambda v: X.masked(v, False), ["ab", "abc", ""]) == ["**", "a**", ""]
    assert one(spark, lambda v: X.masked(v, True), ["joe@x.y", "@x", "none"]) == ["j***@***", "***@***", "***"]
    assert one(spark, lambda v: X.similarity(v, F.lit("student_id")), ["banner_id", "student_id", "zzz"]) == [pytest.approx(8 / 19), 1.0, 0.0]


@pytest.mark.parametrize("name,good,bad", [
    ("email", ["a@b.c"], ["a@b", "a b@c.d"]), ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]), ("iso8601", ["2024-01-02", "2024-01-02T03:04:05.1Z"], ["02.01.2024"]),
    ("date", ["2024-13-99"], ["2024-1-1"]), ("e164", ["+49 170-1234567"], ["0170"]), ("iso3166_alpha2", ["de"], ["deu"]), ("iso4217", ["eur"], ["xxx"]), ("postal_code", ["SW1A 1AA"], ["1"]),
    ("bic", ["deutdeff"], ["DEUT"]), ("iban", ["GB82 WEST 1234 5698 7654 32"], ["GB82WEST12345698765433", "GB82"]), ("npi", ["1234567893"], ["1234567890", "12"]),
    ("gtin", ["4006381333931", "96385074"], ["4006381333932", "123"]), ("lei", ["5493001KJTIIGC8Y1R12"], ["5493001KJTIIGC8Y1R13"]), ("no such format", ["x"], [])])
def test_formats(spark, name, good, bad):
    assert one(spark, lambda v: formats.fits(name, v), good + bad) == [True] * len(good) + [False] * len(bad)


def test_profile(spark):
    e = Engine(spark)
    p = e.profile_records([{"id": 1, "flag": "yes", "note": " "}, {"id": 2, "flag": "no", "ssn": "123-45-6789"}, {"id": 2, "flag": "yes", "e_mail": "a@b.co"}])
    by = {f.name: f for f in p.fields}
    assert list(by) == ["id", "flag", "note", "ssn", "e_mail"] and p.row_count_sampled == 3
    assert (by["id"].inferred_type, by["id"].unique_rate, by["id"].min, by["id"].max, by["id"].avg_str_len) == ("integer", 0.6667, 1.0, 2.0, 1.0)
    assert by["flag"].inferred_type == "boolean" and by["note"].inferred_type == "unknown" and by["note"].patterns[-1] == "high_null_rate"
    assert by["ssn"].pii_flags == ["national_id"] and by["ssn"].sample_values == ["1" + "*" * 10] and by["e_mail"].sample_values == ["a***@***"]


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, str(i % 7), None if i % 3 else 1.5) for i in range(200)], "i int, a string, b double")
    one_, many = (sorted(profile.profile(x, order_by="i").collect()) for x in (df.coalesce(1), df.repartition(7)))
    assert one_ == many
    assert profile.profile(df.limit(0)).select("inferred_type").distinct().collect()[0][0] == "unknown"


def test_profile_reads_its_table_once(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS few", "CAST(id AS string) AS t").write.parquet(str(tmp_path / "t"))
    p = profile.profile(spark.read.parquet(str(tmp_path / "t"))).drop("sample_values")
    assert p._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [(r.distinct_count, r.enum_candidates) for r in p.orderBy("position").collect()] == [(100, None), (3, ["0", "1", "2"]), (100, None)]


def test_profile_tells_values_apart_by_their_texts(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("""SELECT * FROM VALUES
        (-0.0D, timestamp'2024-11-03 05:30:00', date'2024-01-05', 9223372036854775807L, ' '), (0.0D, timestamp'2024-11-03 06:30:00', date'2024-01-05', 9223372036854775806L, ''),
        (CAST('NaN' AS double), timestamp'2024-11-03 07:30:00', date'9999-12-31', 9223372036854775806L, 'x '), (2.5e7D, NULL, NULL, NULL, 'x') AS t(real, time, day, whole, text)""")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # where clocks showed 1:30 twice
        by = {r.field: r for r in profile.profile(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {k: (r.null_count, r.distinct_count, r.inferred_type) for k, r in by.items()} == {"real": (0, 4, "decimal"), "time": (1, 2, "timestamp"), "day": (1, 2, "date"), "whole": (1, 2, "integer"), "text": (2, 2, "string")}
    assert (by["real"].sample_values, by["day"].sum_len, by["text"].sum_len) == (["-0.0", "0.0", "NaN", "25000000.0"], 30, 3)
    many = spark.range(2100).selectExpr("id % 20 AS twenty", "id % 21 AS more", "IF(id % 20 < 9, CAST(id % 20 AS string), repeat('x', CAST(id % 20 AS int))) AS mixed")
    enums = [r.enum_candidates for r in profile.profile(many).orderBy("position").collect()]
    assert enums == [sorted(map(str, range(20))), None, sorted([*map(str, range(9)), *("x" * i for i in range(9, 20))])]


def person(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS)), S.entity_from(PERSON)


def test_mapping_rules_and_rows(spark):
    df, entity = person(spark)
    e = Engine(spark)
    p = e.profile(df)
    m = e.suggest(p, entity)
    assert [(x.source_field, x.canonical_field) for x in m.mappings] == list(zip(COLUMNS, ["id", "email", "age", "active", "born"]))
    assert all(x.reasons and x.signals["_inferred_type"] for x in m.mappings)
    checks = e.rules(m, entity, p)
    assert {(r.field, r.rule) for r in checks} == {("id", "not_null"), ("id", "unique"), ("email", "not_null"), ("email", "valid_email"), ("age", "range"), ("born", "valid_datetime"), ("born", "pii_present")}
    assert e.validate(df, m, entity, checks).passed
    bad = df.union(spark.createDataFrame([("p-001", "nope", "1.9e3", "maybe", "x"), (None, None, "130", None, " ")], df.schema))
    report = e.validate(bad, m, entity, checks)
    failed = {(f.field, f.rule): f.failed_count for f in report.findings if not f.passed}
    assert not report.passed and failed == {("id", "not_null"): 1, ("id", "unique"): 1, ("email", "not_null"): 1, ("email", "valid_email"): 1, ("age", "range"): 2, ("born", "valid_datetime"): 1}
    out = e.transform(bad, m, entity, include_review=True)
    assert dict(out.dtypes)["age"] == "bigint" and out.where("age = 1900").count() == 1
    errors = e.coercion_errors(bad, m, entity, include_review=True).select("field", "value", "target_type").collect()
    assert [tuple(r) for r in errors] == [("active", "maybe", "boolean")]
    kept = e.transform(bad, S.Mapping({}, [S.Suggestion("pid", "id", 1, S.AUTO)]), entity, keep_unmapped=True)
    assert kept.columns == ["id", "mail", "years", "is_active", "dob"]
    promoted = S.Mapping({}, [S.Suggestion("pid", "id", 0.5, S.LOW)]).promote("pid")
    assert promoted.usable() == {"pid": "id"}


def test_target_is_taken_once(spark):
    e = Engine(spark)
    df = spark.createDataFrame([("1", "2")], "pid string, person_id string")
    m = e.suggest(e.profile(df), S.entity_from({"domain": "d", "entity": "e", "version": 1, "fields": {"id": PERSON["fields"]["id"]}}))
    assert [x.canonical_field for x in m.mappings] == ["id", None] and m.mappings[1].status == S.UNMAPPED


def test_semantic_signal(spark):
    df, entity = person(spark)
    e = Engine(spark, Config(ai=semantic.SemanticConfig("openai", options={"embed": lambda ts: [[float(len(t)), 1.0] for t in ts]})))
    m = e.suggest(e.profile(df.select("pid", "mail")), entity)
    assert all(0 <= x.signals["semantic"] <= 1 for x in m.mappings) and e.config.weights["semantic"] == 0.15
    for name in ("claude", "no such"):
        with pytest.raises(ValueError):
            semantic.build(semantic.SemanticConfig(name))


def test_drift_and_stream(spark, tmp_path):
    df, entity = person(spark)
    e = Engine(spark)
    m = e.suggest(e.profile(df), entity)
    assert e.drift(df, m, entity).status == drift.NO_DRIFT
    new = df.withColumnRenamed("pid", "person_id").drop("mail").withColumn("years", F.lit("old"))
    r = e.drift(new, m, entity)
    assert (r.missing_fields, r.new_fields, r.unmapped_required) == (["mail", "pid"], ["person_id"], ["email"])
    assert r.type_changes == [{"field": "years", "old_type": "integer", "new_type": "string"}] and [x["canonical_field"] for x in r.suggested_remappings] == ["id"]
    new.write.parquet(str(tmp_path / "in"))
    seen = []
    q = batches.watch_drift(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), e, m, entity, lambda n, x: seen.append(x.status), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [drift.DRIFT]


def test_readiness(spark):
    a = readiness.Outcome("a", "p", 4, 2, 1, 1, 0, ["id"], ["id", "email"], True, 4, 0, drift.NO_DRIFT)
    b = readiness.Outcome("b", "p", 4, 4, 0, 0, 0, ["email"], ["id", "email"], True, 4, 1, drift.NOT_CHECKED)
    r = readiness.readiness(spark, [a, b])
    assert r.required_fields_covered and r.component_scores["schema_mapping"]["ratio"] == 0.875
    assert r.score == round(35 * 0.875 + 25 + 15 * 7 / 8 + 15 * 6 / 7 + 10)
    assert readiness.readiness(spark, []).score == 100
    assert [readiness.status_of(x) for x in (90, 89, 79, 59)] == [readiness.READY, readiness.MINOR, readiness.NEEDS_REVIEW, readiness.BLOCKED]


@pytest.mark.parametrize("change", [{"fields": {}}, {"version": "x"}, {"primary_key": ["nope"]}, {"fields": {"a": {"type": "no"}}}, {"fields": {"a": {"type": "string", "pii": "no"}}}, {"fields": {"a": {"type": "string", "odd": 1}}}, {"fields": {"a": "string"}}])
def test_bad_schemas(change):
    with pytest.raises(S.SchemaError):
        S.entity_from(PERSON | change)


def test_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('x;y\n1;"p;q"\n2;\n')
    (tmp_path / "b.json").write_text('{"meta": 1, "records": [{"z": 1, "a": "t"}, {"m": true}]}')
    (tmp_path / "b2.json").write_text('[{"z": 1}, {"a": 2}]')
    (tmp_path / "c.jsonl").write_text('{"q": 1, "b": 2}\n\n[1]\n{"b": 3}\n')
    (tmp_path / "bad.jsonl").write_text('{"q": 1\n')
    assert [tuple(r) for r in readers.read_path(spark, str(tmp_path / "a.csv")).collect()] == [("1", "p;q"), ("2", None)]
    j = readers.read_path(spark, str(tmp_path / "b.json"))
    assert j.columns == ["z", "a", "m"] and j.count() == 2
    assert readers.read_path(spark, str(tmp_path / "b2.json")).columns == ["z", "a"]
    n = readers.read_path(spark, str(tmp_path / "c.jsonl"))
    assert n.columns == ["q", "b"] and n.count() == 2
    for path in ("bad.jsonl", "d.txt", "missing.csv"):
        with pytest.raises(Exception):
            readers.read_path(spark, str(tmp_path / path)).count()
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}") for i in range(25)])
    df = readers.read_source(spark, {"type": "SQLite", "path": str(tmp_path / "s.db"), "table": "t", "rows": 10})
    assert df.count() == 25 and df.rdd.getNumPartitions() == 3
    monkeypatch.setenv("TW_DIR", str(tmp_path))
    (tmp_path / "src.yml").write_text("source: {type: csv, path: '${TW_DIR}/a.csv', password: abc, sample_limit: 1}")
    source = readers.load_source(str(tmp_path / "src.yml"))
    assert source["path"] == str(tmp_path / "a.csv") and readers.inline_secrets(source) == ["password"]
    with pytest.raises(readers.SourceError):
        readers.interpolated({"a": ["${TW_NOT_SET}"]})
    with pytest.raises(readers.SourceError):
        readers.reader_for("nothing")


def test_command_line_and_onboarding(spark, tmp_path, capsys):
    df, _ = person(spark)
    (tmp_path / "p.yml").write_text(yaml.safe_dump(PERSON))
    (tmp_path / "p.csv").write_text("\n".join([",".join(COLUMNS), *map(",".join, ROWS)]))
    at = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main(list(a), spark)
    assert run("version") == 0
    run("profile", "--source", at("p.csv"), "--out", at("profile.json"))
    run("suggest", "--profile", at("profile.json"), "--canonical", at("p.yml"), "--out", at("m.json"))
    run("rules", "--suggestions", at("m.json"), "--canonical", at("p.yml"), "--out", at("rules.yml"))
    run("apply", "--source", at("p.csv"), "--mapping", at("m.json"), "--canonical", at("p.yml"), "--include-review", "--out", at("out"))
    run("drift-check", "--source", at("p.csv"), "--mapping", at("m.json"), "--canonical", at("p.yml"), "--out", at("drift.json"))
    assert spark.read.csv(at("out"), header=True).count() == 20 and json.loads((tmp_path / "drift.json").read_text())["status"] == "no_drift"
    assert "valid_email" in (tmp_path / "rules.yml").read_text()
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "one.yml").write_text(yaml.safe_dump({"provider": {"id": "one", "name": "One"}, "sources": [{"name": "s", "entity": "person", "path": "../p.csv", "canonical": "../p.yml", "drift_path": "../p.csv"}], "output": {"dir": "../reports"}}))
    run("onboard-batch", "--config-dir", at("conf"), "--combined-out", at("all.json"))
    report = json.loads((tmp_path / "reports" / "one_readiness.json").read_text())
    assert report["readiness_score"] == 91 and json.loads((tmp_path / "all.json").read_text())["total_providers"] == 1
    with pytest.raises(FileNotFoundError):
        onboarding.onboard_all(Engine(spark), str(tmp_path / "reports"))
    assert "one: 91" in capsys.readouterr().out


def test_connectors_hooks_and_endings(spark, tmp_path):
    path = tmp_path / "people.dat"
    path.write_text('[{"b": 1, "a": "x"},\n {"a": "y"}, 3, null, "z", [1]]')
    e = Engine(spark)
    assert [(f.name, f.distinct_count) for f in e.profile_json(str(path)).fields] == [("b", 1), ("a", 2)]
    (tmp_path / "rows.dat").write_text("n|m\n1|x\n2|y\n")
    assert [f.name for f in e.profile_csv(str(tmp_path / "rows.dat")).fields] == ["n", "m"]
    (tmp_path / "lines.dat").write_text('{"n": 1}\n\n[2]\n{"n": 3, "m": 4}\n')
    assert e.profile_jsonl(str(tmp_path / "lines.dat")).row_count_sampled == 2
    (tmp_path / "wrapped.json").write_text('{"total": 1, "items": [{"a": 1}, 7]}')
    c = readers.Connector(spark, {"type": "json", "path": str(tmp_path / "wrapped.json")})
    assert c.test_connection() and c.list_entities() == ["default"] and c.get_metadata()["columns"] == ["a"] and c.frame().count() == 1
    assert not readers.Connector(spark, {"type": "csv", "path": str(tmp_path / "absent")}).test_connection()
    with pytest.raises(readers.SourceError):
        readers.Connector(spark, {"type": "none such"})
    readers.register("Fixed", lambda spark, rows: spark.range(rows))
    Engine.register_profiler("fixed", lambda engine, source: source["rows"])
    try:
        assert readers.read_source(spark, {"type": "fixed", "rows": 4}).count() == 4
        (tmp_path / "s.yml").write_text("source: {type: fixed, rows: 5}\n")
        assert e.profile_source_config(str(tmp_path / "s.yml")) == 5
    finally:
        del readers.READERS["fixed"], Engine.profilers["fixed"]


def test_csv_sink_doubles_quotes(spark, tmp_path):
    df = spark.createDataFrame([('say "a,b"', True, None), ("", None, 1)], "`t` string, b boolean, `n`` x` int")
    Engine(spark).write_csv(df, str(tmp_path / "out"), single=True)
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_text() == 't,b,n` x\n"say ""a,b""",True,\n,,1\n'
