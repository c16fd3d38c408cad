"""Queries over the engine's own operators on whole tables, with the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats, text as X
from .operators import drift, match, profile, readiness, rules, transform
from .plans import schema, semantic
from .plans.engine import Engine
from .session import scratch
from .sources import readers
from .streaming import batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# profiles

_CODES = ", ".join(f"'{c}'" for c in X.CURRENCIES)
_KIND_SQL = f"""CASE WHEN regexp_matches(v, '{X.EMAIL}') THEN 'email' WHEN length(v) = 3 AND upper(v) IN ({_CODES}) THEN 'currency_code'
 WHEN regexp_matches(v, '{X.PERCENT}') THEN 'percentage' WHEN regexp_matches(v, '{X.INTEGER}') THEN 'integer' WHEN regexp_matches(v, '{X.POINT_NUMBER}') THEN 'decimal'
 WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f') THEN 'boolean' WHEN regexp_matches(v, '{X.DATETIME}') THEN 'timestamp' WHEN regexp_matches(v, '{X.DATE}') THEN 'date'
 WHEN v[1] = '[' AND json_valid(v) THEN 'array' WHEN v[1] = '{{' AND json_valid(v) THEN 'json' ELSE 'string' END"""
_PATTERN_SQL = {
    "email": f"regexp_matches(v, '{X.EMAIL}')",
    "uuid_like": "regexp_matches(v, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')",
    "integer": f"regexp_matches(v, '{X.INTEGER}')",
    "decimal": f"regexp_matches(v, '{X.POINT_NUMBER}')",
    "timestamp_iso": f"regexp_matches(v, '{X.DATETIME}')",
    "date": f"regexp_matches(v, '{X.DATE}')",
    "currency_like": r"regexp_matches(v, '^[$€£¥]\s?\d')",
    "currency_code_like": f"length(v) = 3 AND upper(v) IN ({_CODES})",
    "iban_like": r"regexp_matches(replace(v, ' ', ''), '^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$')",
    "gtin_like": r"regexp_matches(v, '^(\d{8}|\d{12,14})$')",
    "postal_code_like": r"regexp_matches(v, '^(\d{5}(-\d{4})?|[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d)$')",
    "phone_like": r"regexp_matches(v, '^\+?[\d\s().\-]{7,}$') AND regexp_matches(v, '\d')",
    "country_code_like": "regexp_matches(v, '^[A-Za-z]{2}$')",
    "identifier_like": rf"regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9_\-]{{2,}}$') AND NOT regexp_matches(v, '{X.INTEGER}') AND NOT regexp_matches(v, '{X.EMAIL}')",
}


def profile_sql(table: str) -> str:
    """Profile of all columns of a view. Columns are unpivoted as text."""
    shares = ",\n".join(f"coalesce(sum(n) FILTER (WHERE v IS NOT NULL AND {p}), 0) AS p_{k}" for k, p in _PATTERN_SQL.items())
    by_share = ", ".join(f"CASE WHEN filled > 0 AND p_{k} >= {0.95 if k == 'identifier_like' else 0.9} * filled THEN '{k}' END" for k in _PATTERN_SQL)
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in profile.PRECEDENCE.items()) + " END"
    return f"""
WITH u AS (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {table}) ON COLUMNS(*) INTO NAME field VALUE value),
total AS (SELECT count(*) AS row_count FROM {table}),
d AS (SELECT field, value, count(*) AS n FROM u WHERE trim(value, E' \\t\\n\\r\\f\\v') <> '' GROUP BY ALL),
k AS (SELECT *, {_KIND_SQL} AS kind, try_cast(CASE WHEN regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN x END AS DOUBLE) AS num
  FROM (SELECT *, trim(value, E' \\t\\n\\r\\f\\v') AS v, replace(trim(rtrim(trim(value, E' \\t\\n\\r\\f\\v'), '%')), ',', '') AS x FROM d)),
s AS (SELECT field, sum(n) AS filled, count(*) AS distinct_count, sum(n * length(value)) AS sum_len, min(num) AS lo, max(num) AS hi,
  bool_and(lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f')) AS words, coalesce(sum(n) FILTER (WHERE kind = 'integer'), 0) AS ints,
  coalesce(sum(n) FILTER (WHERE kind IN ('integer', 'decimal')), 0) AS numbers, bool_and({_PATTERN_SQL['email']}) AS mails,
{shares} FROM k GROUP BY field),
m AS (SELECT field, arg_max(kind, c * 100 + {rank}) AS mode FROM (SELECT field, kind, sum(n) AS c FROM k GROUP BY ALL) GROUP BY field),
t AS (SELECT s.*, row_count, CASE WHEN words THEN 'boolean' WHEN ints = filled THEN 'integer' WHEN numbers = filled THEN 'decimal'
  WHEN mode = 'string' AND sum_len >= 60 * filled THEN 'text' ELSE mode END AS inferred_type, distinct_count / filled AS uniq FROM s JOIN m USING (field), total),
r AS (SELECT *, CASE WHEN inferred_type IN ('integer', 'decimal', 'percentage') THEN lo END AS min_, CASE WHEN inferred_type IN ('integer', 'decimal', 'percentage') THEN hi END AS max_,
  distinct_count <= 20 AND uniq < 0.5 AS few FROM t),
e AS (SELECT field, string_agg(value, '|' ORDER BY value) AS vs FROM d SEMI JOIN (SELECT field FROM r WHERE few) USING (field) GROUP BY field)
SELECT r.field, CAST(row_count AS BIGINT) AS row_count, CAST(row_count - filled AS BIGINT) AS null_count, CAST(distinct_count AS BIGINT) AS distinct_count, inferred_type, min_ AS min, max_ AS max,
  CAST(sum_len AS BIGINT) AS sum_len, e.vs AS enum_candidates,
  array_to_string(list_filter([{by_share}, CASE WHEN min_ >= 0 AND max_ <= 1 THEN 'range_0_to_1' END, CASE WHEN min_ >= 0 AND max_ <= 4 THEN 'range_0_to_4' END,
   CASE WHEN min_ >= 0 THEN 'positive_number' END, CASE WHEN uniq >= 0.9 THEN 'mostly_unique' END, CASE WHEN few THEN 'enum_like' END,
   CASE WHEN row_count - filled >= 0.5 * row_count THEN 'high_null_rate' END], lambda x: x IS NOT NULL), '|') AS patterns,
  CASE WHEN mails THEN 'email' ELSE '' END AS pii_flags
FROM r LEFT JOIN e ON r.field = e.field"""


def _profile_query(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = profile.profile(_table(spark, sf_dir, table)).drop("position", "sample_values")
        return p.withColumns({c: F.array_join(c, "|") for c in ("enum_candidates", "patterns", "pii_flags")})

    return run


for _t in ("events", "customer", "orders", "lineitem", "part", "supplier", "nation", "region", "labels", "documents", "conversations"):
    query(f"profile_{_t}", profile_sql(_t))(_profile_query(_t))


@query("profile_sample_values", """
SELECT 's_name' AS field, string_agg(s_name, '|' ORDER BY s_suppkey) AS samples FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5)
UNION ALL SELECT 's_acctbal', string_agg(CAST(s_acctbal AS VARCHAR), '|' ORDER BY s_suppkey) FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5)""")
def profile_sample_values(spark, sf_dir):
    p = profile.profile(_table(spark, sf_dir, "supplier"), order_by="s_suppkey")
    return p.where(F.col("field").isin("s_name", "s_acctbal")).select("field", F.array_join("sample_values", "|").alias("samples"))


@query("value_types_json", "SELECT event_id, CASE WHEN props[1] = '[' AND json_valid(props) THEN 'array' WHEN props[1] = '{' AND json_valid(props) THEN 'json' ELSE 'string' END AS kind FROM events")
def value_types_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", X.value_type(X.stripped(F.col("props"))).alias("kind"))


_MAIL_IN_TEXT = r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+"


@query("mask_values", rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL_IN_TEXT}')) AS v FROM documents)
SELECT doc_id AS id, 'email' AS kind, v[1] || '***@***' AS masked, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT c_custkey, 'name', c_name[1] || repeat('*', length(c_name) - 1), 1 FROM customer""")
def mask_values(spark, sf_dir):
    mails = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(_MAIL_IN_TEXT), F.lit(0))).alias("v"))
    a = mails.groupBy("id", F.lit("email").alias("kind"), X.masked(F.col("v"), True).alias("masked")).agg(F.count(F.lit(1)).alias("n"))
    b = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("name").alias("kind"), X.masked(F.col("c_name"), False).alias("masked"), F.lit(1).cast("long").alias("n"))
    return a.unionByName(b)


_NAMES = ["Student Email", "homePhone", "c_name", "LastName", "tax-id", "DOB", "postalCode", "client_ip", "patient MRN", "IBAN", "cancelled", "ip_address", "amount", "__a--b__"]
_NAMES_SQL = ", ".join(f"('{n}')" for n in _NAMES)
_NORMAL_SQL = "trim(regexp_replace(lower(trim(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))), '[^a-z0-9]+', '_', 'g'), '_')"


@query("pii_flags_by_name", f"WITH n AS (SELECT name, {_NORMAL_SQL.format('name')} AS x FROM (VALUES {_NAMES_SQL}) t(name)) SELECT name, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{'|'.join(s.split())}') THEN '{f}' END" for f, s in profile.NAME_SIGNS.items()) + "], lambda v: v IS NOT NULL), '|') AS flags FROM n")
def pii_flags_by_name(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", F.array_join(profile.name_flags(F.col("name")), "|").alias("flags"))


@query("normalize_names", f"SELECT DISTINCT s AS name, {_NORMAL_SQL.format('s')} AS normal FROM (SELECT p_type AS s FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT name FROM (VALUES {_NAMES_SQL}) t(name))")
def normalize_names(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select("p_brand")).union(_table(spark, sf_dir, "orders").select("o_orderpriority"))
    names = names.distinct().union(spark.createDataFrame([(n,) for n in _NAMES], "name string")).distinct()
    return names.select("name", X.normalized_name(F.col("name")).alias("normal"))


@query("name_similarity", """
WITH RECURSIVE dp(a, b, i, r) AS (
  SELECT lower(n_name), lower(r_name), 0, list_transform(range(length(r_name)), lambda j: 0) FROM nation, region
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + 1 ELSE r[k] END)))
  FROM dp WHERE i < length(a))
SELECT a, b, round(2.0 * r[length(b)] / (length(a) + length(b)), 6) AS similarity FROM dp WHERE i = length(a)""")
def name_similarity(spark, sf_dir):
    a, b = _table(spark, sf_dir, "nation").select(F.lower("n_name").alias("a")), _table(spark, sf_dir, "region").select(F.lower("r_name").alias("b"))
    return a.crossJoin(b).select("a", "b", F.round(X.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# matching

_TYPES_SQL = ", ".join(f"('{t}')" for t in schema.TYPES)


@query("type_signal", """
WITH t(t) AS (SELECT unnest(['string', 'text', 'integer', 'decimal', 'percentage', 'boolean', 'date', 'timestamp', 'email', 'currency_code', 'json', 'array', 'unknown'])),
near(s, c, v) AS (VALUES ('integer', 'decimal', 0.85), ('integer', 'percentage', 0.7), ('decimal', 'percentage', 0.85), ('decimal', 'integer', 0.6), ('percentage', 'decimal', 0.85), ('date', 'timestamp', 0.85),
  ('timestamp', 'date', 0.8), ('email', 'string', 0.7), ('string', 'text', 0.9), ('string', 'email', 0.5), ('text', 'string', 0.9))
SELECT s.t AS source, c.t AS target, CAST(CASE WHEN s.t = 'unknown' THEN 0.3 WHEN s.t = c.t THEN 1.0 WHEN n.v IS NOT NULL THEN n.v WHEN c.t IN ('string', 'text') THEN 0.5 ELSE 0.2 END AS DOUBLE) AS score
FROM t s CROSS JOIN t c LEFT JOIN near n ON n.s = s.t AND n.c = c.t""")
def type_signal(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in schema.TYPES], "source string")
    return t.crossJoin(t.withColumnRenamed("source", "target")).select("source", "target", match.type_signal(F.col("source"), F.col("target")).alias("score"))


@query("range_signal", """
SELECT a.p_partkey, CASE WHEN a.lo >= 900 AND a.hi <= 1000 THEN 1.0 WHEN a.hi < 900 OR a.lo > 1000 THEN 0.0 ELSE 0.4 END::DOUBLE AS score
FROM (SELECT p_partkey, p_retailprice - p_size AS lo, p_retailprice + p_size AS hi FROM part) a""")
def range_signal(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - F.col("p_size")).alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return p.select("p_partkey", match.range_signal(F.col("lo"), F.col("hi"), F.lit(900.0), F.lit(1000.0)).alias("score"))


@query("confidence_status", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS a, l_tax * 10 AS n, l_quantity / 50 AS t FROM lineitem),
c AS (SELECT *, greatest(0, least(1, round(a * 0.4 + n * 0.2 + t * 0.15 + 0.15 + 0.0, 4))) AS c FROM s)
SELECT CASE WHEN c >= 0.9 THEN 'auto_approved' WHEN c >= 0.7 THEN 'requires_review' ELSE 'low_confidence' END AS status, count(*) AS n FROM c GROUP BY 1""")
def confidence_status(spark, sf_dir):
    signals = {"alias": F.col("l_discount") * 10, "name": F.col("l_tax") * 10, "type": F.col("l_quantity") / 50, "pattern": F.lit(1.0), "range": F.lit(0.0)}
    return _table(spark, sf_dir, "lineitem").groupBy(match.status(match.confidence(signals)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_CUSTOMER = schema.entity_from({
    "domain": "sales", "entity": "client", "version": 1, "fields": {
        "client_id": {"type": "integer", "required": True, "semantic_tags": ["identifier"], "aliases": ["c_custkey", "customer_key"]},
        "client_name": {"type": "string", "required": True, "pii": "moderate", "aliases": ["c_name"]},
        "balance": {"type": "decimal", "min": -1000, "max": 10000, "semantic_tags": ["money"], "aliases": ["c_acctbal"]},
        "segment": {"type": "string", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "aliases": ["c_mktsegment"]},
        "nation": {"type": "integer", "aliases": ["nation_key"]}}})
_ORDER = schema.entity_from({
    "domain": "sales", "entity": "order", "version": 1, "fields": {
        "order_id": {"type": "integer", "required": True, "semantic_tags": ["identifier"]}, "client_id": {"type": "integer", "required": True}, "state": {"type": "string", "enum": ["F", "O"]},
        "total": {"type": "decimal", "min": 1000, "max": 400000}, "ordered_at": {"type": "timestamp", "format": "iso8601"}, "priority": {"type": "integer"}}})
_ORDER_MAP = schema.Mapping({"domain": "sales", "entity": "order", "version": 1}, [
    schema.Suggestion(s, t, c, st) for s, t, c, st in (
        ("o_orderkey", "order_id", 0.95, schema.AUTO), ("o_custkey", "client_id", 0.92, schema.AUTO), ("o_orderstatus", "state", 0.91, schema.AUTO), ("o_totalprice", "total", 0.9, schema.APPROVED),
        ("o_orderdate", "ordered_at", 0.8, schema.REVIEW), ("o_orderpriority", "priority", 0.75, schema.REVIEW))])


_TARGETS_SQL = """(VALUES
  (0, 'client_id', 'integer', ['c_custkey', 'customer_key'], NULL::DOUBLE, NULL::DOUBLE, false, ['identifier']), (1, 'client_name', 'string', ['c_name'], NULL, NULL, false, []),
  (2, 'balance', 'decimal', ['c_acctbal'], -1000, 10000, false, ['money']), (3, 'segment', 'string', ['c_mktsegment'], NULL, NULL, true, []), (4, 'nation', 'integer', ['nation_key'], NULL, NULL, false, []))
  AS t(place, canonical, type, aliases, lo, hi, has_enum, tags)"""
#: Scores of every field of ``customer`` against every target: common subsequence, words, alias, types, patterns, bounds.
_CANDIDATES_SQL = f"""
WITH RECURSIVE p AS (SELECT field, inferred_type, min, max, string_split(patterns, '|') AS patterns FROM ({profile_sql('customer')})), t AS (SELECT * FROM {_TARGETS_SQL}),
names AS (SELECT field, canonical, unnest(list_prepend(canonical, aliases)) AS name FROM p, t),
dp(a, b, i, r) AS (
  SELECT DISTINCT field, name, 0, list_transform(range(length(name)), lambda j: 0) FROM names
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + 1 ELSE r[k] END)))
  FROM dp WHERE i < length(a)),
like_ AS (SELECT field, canonical, max(2.0::DOUBLE * r[length(b)] / (length(a) + length(b))) AS s FROM dp JOIN names ON a = field AND b = name WHERE i = length(a) GROUP BY 1, 2),
x AS (
  SELECT p.field, t.canonical, place, CASE WHEN p.field = t.canonical OR list_contains(aliases, p.field) THEN 1.0 ELSE 0.0 END::DOUBLE AS alias,
    round(CASE WHEN s < 1 THEN least(1.0::DOUBLE, s + 0.05 * len(list_intersect(string_split(p.field, '_'), string_split(t.canonical, '_')))) ELSE s END, 4) AS name,
    CASE WHEN inferred_type = type THEN 1.0 WHEN inferred_type = 'integer' AND type = 'decimal' THEN 0.85 WHEN inferred_type = 'decimal' AND type = 'integer' THEN 0.6 WHEN type = 'string' THEN 0.5 ELSE 0.2 END::DOUBLE AS kind,
    greatest(CASE WHEN 'identifier' IN tags THEN len(list_intersect(patterns, ['identifier_like', 'mostly_unique', 'uuid_like'])) WHEN 'money' IN tags THEN len(list_intersect(patterns, ['currency_like', 'decimal', 'positive_number'])) ELSE 0 END, 0) AS support,
    has_enum AND list_contains(patterns, 'enum_like') AS few,
    CASE WHEN (lo IS NULL AND hi IS NULL) OR min IS NULL OR max IS NULL THEN 0.0 WHEN min >= lo AND max <= hi THEN 1.0 WHEN max < lo OR min > hi THEN 0.0 ELSE 0.4 END::DOUBLE AS bounds
  FROM p CROSS JOIN t JOIN like_ l ON l.field = p.field AND l.canonical = t.canonical),
c AS (SELECT *, round(0.4::DOUBLE * alias + 0.2::DOUBLE * name + 0.15::DOUBLE * kind + 0.15::DOUBLE * greatest(CASE WHEN support > 0 THEN least(1.0::DOUBLE, 0.6 + 0.2 * support) ELSE 0 END, CASE WHEN few THEN 0.7 ELSE 0 END) + 0.1::DOUBLE * bounds, 4) AS confidence FROM x),
ranked AS (SELECT field, canonical, confidence, CAST(row_number() OVER (PARTITION BY field ORDER BY confidence DESC, alias DESC, name DESC, place) AS INTEGER) AS rank FROM c WHERE confidence >= 0.3)
"""


@query("suggest_customer_mapping", _CANDIDATES_SQL + """, o AS (SELECT field, row_number() OVER (ORDER BY max(confidence) DESC, field) AS i, list(struct_pack(t := canonical, c := confidence) ORDER BY rank) AS cs FROM ranked GROUP BY field),
g AS (
  SELECT 0 AS i, NULL::VARCHAR AS field, NULL::STRUCT(t VARCHAR, c DOUBLE) AS pick, []::VARCHAR[] AS taken
  UNION ALL
  SELECT i, field, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.t) END
  FROM (SELECT o.i, o.field, g.taken, list_filter(o.cs, lambda v: NOT list_contains(g.taken, v.t))[1] AS pick FROM g JOIN o ON o.i = g.i + 1))
SELECT field, pick.t AS canonical, CASE WHEN pick.c >= 0.9 THEN 'auto_approved' WHEN pick.c >= 0.7 THEN 'requires_review' ELSE 'low_confidence' END AS status FROM g WHERE i > 0""")
def suggest_customer_mapping(spark, sf_dir):
    e = Engine(spark)
    found = e.suggest(e.profile(_table(spark, sf_dir, "customer")), _CUSTOMER).mappings  # one row a column
    return spark.createDataFrame([(m.source_field, m.canonical_field, m.status) for m in found], "field string, canonical string, status string")


@query("candidate_ranking", _CANDIDATES_SQL + "SELECT field, canonical, confidence, rank FROM ranked")
def candidate_ranking(spark, sf_dir):
    p = profile.profile(_table(spark, sf_dir, "customer"))
    return match.candidates(p, schema.canonical_frame(spark, _CUSTOMER)).select("field", "canonical", "confidence", "rank")


@query("greedy_assignment", """
WITH RECURSIVE c AS (SELECT r_regionkey AS grp, n_nationkey AS position, 'f' || n_nationkey AS field, 't' || (n_nationkey * k % 4) AS canonical, round(0.95 - 0.03 * k - 0.01 * (n_nationkey % 5), 4) AS conf
  FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 2, 3]) AS k)),
d AS (SELECT grp, position, field, canonical, max(conf) AS conf FROM c GROUP BY ALL),
o AS (SELECT grp, position, field, row_number() OVER (PARTITION BY grp ORDER BY max(conf) DESC, position) AS i FROM d GROUP BY grp, position, field),
l AS (SELECT grp, position, list(canonical ORDER BY conf DESC) AS cs FROM d GROUP BY grp, position),
g AS (
  SELECT grp, 0 AS i, NULL::INTEGER AS position, NULL::VARCHAR AS pick, []::VARCHAR[] AS taken FROM (SELECT DISTINCT grp FROM o)
  UNION ALL
  SELECT x.grp, x.i, x.position, x.pick, CASE WHEN x.pick IS NULL THEN x.taken ELSE list_append(x.taken, x.pick) END FROM (
    SELECT g.grp, o.i, o.position, g.taken, list_filter(l.cs, lambda v: NOT list_contains(g.taken, v))[1] AS pick
    FROM g JOIN o ON o.grp = g.grp AND o.i = g.i + 1 JOIN l ON l.grp = o.grp AND l.position = o.position) x)
SELECT grp, position, pick AS canonical FROM g WHERE i > 0""")
def greedy_assignment(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("position"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("field"), F.lit("string").alias("inferred_type"))
    c = n.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("group", "position", F.concat(F.lit("t"), (F.col("position") * F.col("k") % 4).cast("string")).alias("canonical"), F.round(0.95 - 0.03 * F.col("k") - 0.01 * (F.col("position") % 5), 4).alias("confidence"))
    c = c.groupBy("group", "position", "canonical").agg(F.max("confidence").alias("confidence"))
    from pyspark.sql.window import Window

    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("group", "position").orderBy(F.desc("confidence")))).withColumns({"signals": F.lit(None).cast("map<string,double>"), "reasons": F.array(F.lit(""))})
    return match.assign(ranked, n).select(F.col("group").alias("grp"), "position", "canonical")


# transformation and validation


@query("transform_orders", "SELECT o_orderkey AS order_id, o_custkey AS client_id, o_orderstatus AS state, o_totalprice AS total, CAST(o_orderdate AS VARCHAR) AS ordered_at, CAST(NULL AS BIGINT) AS priority FROM orders")
def transform_orders(spark, sf_dir):
    return transform.transform(_table(spark, sf_dir, "orders"), _ORDER_MAP, _ORDER, include_review=True)


@query("transform_keep_unmapped", "SELECT o_orderkey AS order_id, o_custkey AS client_id, o_orderstatus AS state, o_totalprice AS total, o_orderdate, o_orderpriority FROM orders")
def transform_keep_unmapped(spark, sf_dir):
    return transform.transform(_table(spark, sf_dir, "orders"), _ORDER_MAP, _ORDER, keep_unmapped=True)


@query("coercion_errors", "SELECT o_orderkey AS row, 'priority' AS field, o_orderpriority AS value, 'integer' AS target_type FROM orders")
def coercion_errors(spark, sf_dir):
    return transform.coercion_errors(_table(spark, sf_dir, "orders"), _ORDER_MAP, _ORDER, include_review=True, row="o_orderkey")


@query("coerce_values", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR) AS d, CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR) || '%' AS p, l_returnflag AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d, CAST(trunc(CAST(d AS DOUBLE)) AS BIGINT) AS as_integer, CAST(d AS DOUBLE) AS as_decimal, CAST(rtrim(p, '%') AS DOUBLE) AS as_percentage,
  CASE WHEN b = 'N' THEN false END AS as_boolean, upper(b) AS as_currency FROM v""")
def coerce_values(spark, sf_dir):
    v = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string").alias("d"), F.concat((F.round(F.col("l_tax") * 100)).cast("int").cast("string"), F.lit("%")).alias("p"), F.col("l_returnflag").alias("b"))
    kinds = {"as_integer": ("d", "integer"), "as_decimal": ("d", "decimal"), "as_percentage": ("p", "percentage"), "as_boolean": ("b", "boolean"), "as_currency": ("b", "currency_code")}
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "d", *[transform.coerced(F.col(c), t).alias(k) for k, (c, t) in kinds.items()])


@query("validation_report", """
SELECT 'order_id' AS field, 'not_null' AS rule, count(*) FILTER (WHERE o_orderkey IS NULL) AS failed FROM orders
UNION ALL SELECT 'order_id', 'unique', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'client_id', 'not_null', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders
UNION ALL SELECT 'state', 'allowed_values', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'total', 'range', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) FROM orders
UNION ALL SELECT 'ordered_at', 'valid_datetime', 0""")
def validation_report(spark, sf_dir):
    df = transform.checked(_table(spark, sf_dir, "orders"), _ORDER_MAP, _ORDER, include_review=True)
    checks = rules.rules_for(_ORDER, _ORDER_MAP, {"o_orderkey": ["mostly_unique"]})
    one = rules.failures(df, checks)
    return one.select(F.inline(F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(r.rule).alias("rule"), F.col(f"r{i}").cast("long").alias("failed")) for i, r in enumerate(checks)])))


_CONTACT = schema.entity_from({
    "domain": "sales", "entity": "contact", "version": 1, "fields": {
        "id": {"type": "string", "required": True, "pii": "high", "semantic_tags": ["identifier"]}, "mail": {"type": "email", "required": True}, "currency": {"type": "currency_code"},
        "gtin": {"type": "string", "format": "gtin"}, "country": {"type": "string", "format": "iso3166_alpha2"}, "seen": {"type": "date", "format": "date"}, "score": {"type": "decimal", "min": 0, "max": 50}}})


@query("validation_failures", f"""
WITH c AS (SELECT c_custkey AS k FROM customer), n AS (SELECT count(*) AS n FROM c), g AS (SELECT k, lpad(CAST(k * 104729 + 4006381333931 AS VARCHAR), 13, '0') AS g FROM c)
SELECT 'id' AS field, 'not_null' AS rule, 'error' AS severity, true AS passed, 0 AS failed FROM n
UNION ALL SELECT 'id', 'unique', 'warning', false, n - (SELECT count(DISTINCT k - k % 10 // 9) FROM c) FROM n
UNION ALL SELECT 'id', 'pii_present', 'info', true, 0 FROM n
UNION ALL SELECT 'mail', 'not_null', 'error', false, (SELECT count(*) FROM c WHERE k % 5 < 3) FROM n
UNION ALL SELECT 'mail', 'valid_email', 'error', false, (SELECT count(*) FROM c WHERE k % 5 = 3) FROM n
UNION ALL SELECT 'mail', 'unexpected_nulls', 'warning', false, (SELECT count(*) FROM c WHERE k % 5 < 3) FROM n
UNION ALL SELECT 'currency', 'valid_currency_code', 'error', false, (SELECT count(*) FROM c WHERE k % 4 = 1) FROM n
UNION ALL SELECT 'gtin', 'valid_checksum', 'error', false, (SELECT count(*) FROM g WHERE list_sum(list_transform(range(1, 14), lambda i: (ascii(substr(g, i::INTEGER, 1)) - 48) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 <> 0) FROM n
UNION ALL SELECT 'country', 'valid_format', 'error', false, (SELECT count(*) FROM c WHERE k % 6 = 0) FROM n
UNION ALL SELECT 'seen', 'valid_datetime', 'error', false, (SELECT count(*) FROM c WHERE k % 7 = 0) FROM n
UNION ALL SELECT 'score', 'range', 'error', false, (SELECT count(*) FROM c WHERE k % 60 > 50 OR k % 8 = 0) FROM n
UNION ALL SELECT '', 'overall', '', false, n FROM n""")
def validation_failures(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    df = _table(spark, sf_dir, "customer").select(
        text(k - F.floor(k % 10 / 9)).alias("id"), F.when(k % 5 == 3, "no mail").when(k % 5 == 4, F.concat(F.lit("m"), text(k), F.lit("@x.example"))).otherwise("  ").alias("mail"),
        F.when(k % 4 == 0, " usd").when(k % 4 == 1, "XXX").when(k % 4 == 2, "EUR").alias("currency"), F.lpad(text(k * 104729 + 4006381333931), 13, "0").alias("gtin"), F.when(k % 6 == 0, "D3").otherwise("DE").alias("country"),
        F.when(k % 7 == 0, "soon").otherwise(F.concat(F.lit("2024-02-"), F.lpad(text(k % 28 + 1), 2, "0"))).alias("seen"), F.when(k % 8 == 0, "much").otherwise(text(k % 60)).alias("score"))
    mapping = schema.Mapping({}, [schema.Suggestion(c, c, 0.95, schema.AUTO) for c in df.columns])
    report = rules.validate(transform.checked(df, mapping, _CONTACT), rules.rules_for(_CONTACT, mapping, {"id": ["mostly_unique"], "mail": ["high_null_rate"]}))
    rows = [(f.field, f.rule, f.severity, f.passed, f.failed_count) for f in report.findings] + [("", "overall", "", report.passed, report.row_count)]
    return spark.createDataFrame(rows, "field string, rule string, severity string, passed boolean, failed long")


# sources and sinks


@query("scan_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'says \"a;b\", ' || o_orderstatus ELSE o_orderstatus END AS note, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END END AS even FROM orders")
def scan_csv(spark, sf_dir):
    """Written by the CSV sink, read by the scan that a file's ending chooses."""
    k = F.col("o_orderkey")
    df = _table(spark, sf_dir, "orders").select(k, F.when(k % 9 == 0, F.concat(F.lit('says "a;b", '), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus")).alias("note"), F.when(k % 4 > 0, F.col("o_custkey") % 2 == 0).alias("even"))
    path = scratch(spark, "csv") + ".csv"
    Engine(spark).write_csv(df, path)
    return readers.read_path(spark, path)


@query("scan_csv_separator", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def scan_csv_separator(spark, sf_dir):
    path = scratch(spark, "csv") + ".csv"
    _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True, sep=";")
    return readers.read_source(spark, {"type": "csv", "path": path})


@query("scan_jsonl", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal FROM customer")
def scan_jsonl(spark, sf_dir):
    """Blank lines and lines that hold no object are skipped."""
    path = scratch(spark, "jsonl") + ".jsonl"
    lines = _table(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("value"), (F.col("c_custkey") % 50).alias("k"))
    lines.select(F.explode(F.when(F.col("k") == 0, F.array("value", F.lit(""), F.lit("[7]"))).otherwise(F.array("value")))).write.text(path)
    return readers.read_path(spark, path)


@query("scan_json", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_json(spark, sf_dir):
    """A document for each region, an array or an object that wraps one; other elements are dropped."""
    path = scratch(spark, "json") + ".json"
    n = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey"))), ", 5, ").alias("o"))
    n.select(F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("["), "o", F.lit(', "x"]'))).otherwise(F.concat(F.lit('{"total": 3, "items": ['), "o", F.lit("]}"))).alias("value")).repartition(5).write.text(path)
    return readers.read_path(spark, path)


_MOD97 = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN ascii(substr({0}, i::INTEGER, 1)) >= 65 THEN ascii(substr({0}, i::INTEGER, 1)) - 55 + 100 ELSE ascii(substr({0}, i::INTEGER, 1)) - 48 END::BIGINT)), lambda s, d: CASE WHEN d >= 100 THEN (s * 100 + d - 100) % 97 ELSE (s * 10 + d) % 97 END)"
_GTIN = "(list_sum(list_transform(range(1, 14), lambda i: (ascii(substr(g, i::INTEGER, 1)) - 48) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0)"
_LUHN = "(list_sum(list_transform(range(1, 16), lambda i: (CASE WHEN i % 2 = 0 THEN (ascii(substr('80840' || n, i::INTEGER, 1)) - 48) * 2 - CASE WHEN (ascii(substr('80840' || n, i::INTEGER, 1)) - 48) > 4 THEN 9 ELSE 0 END ELSE ascii(substr('80840' || n, i::INTEGER, 1)) - 48 END))) % 10 = 0)"


@query("checksum_formats", f"""
WITH v AS (SELECT c_custkey, 'GB' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || 'WEST' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 14, '0') AS b, lpad(CAST(c_custkey * 104729 + 4006381333931 AS VARCHAR), 13, '0') AS g,
  lpad(CAST(c_custkey * 7 + 1234567893 AS VARCHAR), 10, '0') AS n, '5493' || lpad(CAST(c_custkey * 31 AS VARCHAR), 14, 'A') || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS l FROM customer)
SELECT c_custkey, {_MOD97.format("(substr(b, 5) || substr(b, 1, 4))")} = 1 AS iban, {_GTIN} AS gtin, {_LUHN} AS npi, {_MOD97.format("l")} = 1 AS lei FROM v""")
def checksum_formats(spark, sf_dir):
    k = F.col("c_custkey")
    pad = lambda c, n, s="0": F.lpad(c.cast("string"), n, s)
    v = _table(spark, sf_dir, "customer").select(
        k, F.concat(F.lit("GB"), pad(k % 100, 2), F.lit("WEST"), pad(k * 7919, 14)).alias("b"), pad(k * 104729 + 4006381333931, 13).alias("g"), pad(k * 7 + 1234567893, 10).alias("n"),
        F.concat(F.lit("5493"), pad(k * 31, 14, "A"), pad(k % 100, 2)).alias("l"))
    return v.select("c_custkey", formats.is_iban(F.col("b")).alias("iban"), formats.is_gtin(F.col("g")).alias("gtin"), formats.is_npi(F.col("n")).alias("npi"), formats.is_lei(F.col("l")).alias("lei"))


_CONTACTS_SQL = r"""(SELECT n_name AS v FROM nation UNION SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders
  UNION SELECT 'c' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '@mail.example' WHEN 1 THEN '@mail' ELSE ' @mail.example' END FROM customer
  UNION SELECT CASE c_custkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '+0' ELSE '' END || (4930000000 + c_custkey) FROM customer
  UNION SELECT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 9, 4) || '-4' || substr(md5(CAST(c_custkey AS VARCHAR)), 14, 3) || CASE c_custkey % 2 WHEN 0 THEN '-a' ELSE 'a' END || substr(md5(CAST(c_custkey AS VARCHAR)), 18, 3) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 21, 12) FROM customer)"""


@query("plain_formats", rf"""
SELECT v, regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email, regexp_matches(v, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') AS uuid,
  regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AS iso8601, regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AS date,
  regexp_matches(translate(v, ' -', ''), '^\+?[1-9][0-9]{{6,14}}$') AS e164, length(v) = 2 AND regexp_matches(upper(v), '^[A-Z]{{2}}$') AS iso3166_alpha2,
  regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9\s\-]{{2,9}}$') AS postal_code, regexp_matches(upper(v), '^[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?$') AS bic FROM {_CONTACTS_SQL}""")
def plain_formats(spark, sf_dir):
    k, mod = F.col("c_custkey"), lambda n: F.col("c_custkey") % n
    h = F.md5(k.cast("string"))
    customer = _table(spark, sf_dir, "customer")
    v = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("v")).union(_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string")))
    v = v.union(customer.select(F.concat(F.lit("c"), k.cast("string"), F.when(mod(3) == 0, "@mail.example").when(mod(3) == 1, "@mail").otherwise(" @mail.example"))))
    v = v.union(customer.select(F.concat(F.when(mod(3) == 0, "+").when(mod(3) == 1, "+0").otherwise(""), (F.lit(4930000000) + k).cast("string"))))
    v = v.union(customer.select(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.when(mod(2) == 0, "-a").otherwise("a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))).distinct()
    return v.select("v", *[formats.fits(k, F.col("v")).alias(k) for k in ("email", "uuid", "iso8601", "date", "e164", "iso3166_alpha2", "postal_code", "bic")])


# drift and readiness

_OLD = [("id", "key", "auto_approved", "integer", 0.95), ("mail", "email", "auto_approved", "email", 0.9), ("amt", "amount", "requires_review", "decimal", 0.8), ("note", None, "unmapped", "text", 0.0), ("day", "date", "low_confidence", "date", 0.5)]
_NEW = [("id", "key", "auto_approved", "string", 0.92), ("e_mail", "email", "auto_approved", "email", 0.9), ("amt", "amount", "requires_review", "decimal", 0.75), ("extra", None, "unmapped", "string", 0.0)]
_literal = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_DRIFT_SQL = f"WITH o(field, canonical, status, t, c) AS (VALUES {_literal(_OLD)}), n(field, canonical, status, t, c) AS (VALUES {_literal(_NEW)}) "


def _maps(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.createDataFrame(x, "field string, canonical string, status string, inferred_type string, confidence double") for x in (_OLD, _NEW))


@query("drift_fields", _DRIFT_SQL + """
SELECT 'missing' AS kind, field, NULL AS old, NULL AS new FROM (SELECT field FROM o EXCEPT SELECT field FROM n) UNION ALL SELECT 'new', field, NULL, NULL FROM (SELECT field FROM n EXCEPT SELECT field FROM o)
UNION ALL SELECT 'type', o.field, o.t, n.t FROM o JOIN n USING (field) WHERE o.t <> n.t
UNION ALL SELECT 'unmapped', v, NULL, NULL FROM (VALUES ('key'), ('date')) r(v) WHERE v NOT IN (SELECT canonical FROM n WHERE canonical IS NOT NULL AND status IN ('auto_approved', 'approved', 'requires_review'))
UNION ALL SELECT 'remap', n.field, NULL, n.canonical FROM n WHERE n.field NOT IN (SELECT field FROM o) AND n.canonical IN (SELECT canonical FROM o WHERE field NOT IN (SELECT field FROM n) AND canonical IS NOT NULL AND status <> 'low_confidence')""")
def drift_fields(spark, sf_dir):
    old, new = _maps(spark)
    none = F.lit(None).cast("string")
    required = spark.createDataFrame([("key",), ("date",)], "canonical string")
    shape = lambda df, kind, f, a=none, b=none: df.select(F.lit(kind).alias("kind"), F.col(f).alias("field"), a.alias("old"), b.alias("new"))
    out = shape(drift.missing_fields(old, new), "missing", "field").union(shape(drift.new_fields(old, new), "new", "field"))
    out = out.union(shape(drift.type_changes(old, new), "type", "field", F.col("old_type"), F.col("new_type")))
    return out.union(shape(drift.unmapped_required(required, new), "unmapped", "canonical")).union(shape(drift.remappings(old, new), "remap", "field", none, F.col("canonical")))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes made of nations: the provider is the region."""
    k = F.col("n_nationkey")
    kinds = lambda *ks: F.array(*[F.concat(F.lit("f"), (k % x).cast("string")) for x in ks])
    return _table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("provider"), F.col("n_name").alias("source"), (k % 2).cast("string").alias("entity"), F.lit(10).alias("total"), (k % 6).cast("int").alias("auto"), (k % 4).cast("int").alias("review"),
        F.lit(1).alias("low"), F.lit(0).alias("unmapped"), F.array_distinct(kinds(5, 3)).alias("covered"), F.array_distinct(kinds(3, 4)).alias("required"), (k % 7 != 0).alias("passed"), F.lit(8).alias("findings"), (k % 3).cast("int").alias("failures"),
        F.when(k % 3 == 0, "not_checked").when(k % 3 == 1, "no_drift").otherwise("drift_detected").alias("drift"))


_READY_SQL = """
WITH o AS (SELECT CAST(n_regionkey AS VARCHAR) AS provider, n_nationkey % 2 AS entity, n_nationkey AS k FROM nation),
r AS (SELECT provider, entity, unnest(['f' || (k % 3), 'f' || (k % 4)]) AS f FROM o), c AS (SELECT provider, entity, unnest(['f' || (k % 5), 'f' || (k % 3)]) AS f FROM o),
q AS (SELECT provider, count(*) AS required, count(*) FILTER (WHERE hit) AS covered FROM (SELECT DISTINCT r.provider, r.entity, r.f, c.f IS NOT NULL AS hit FROM r LEFT JOIN c USING (provider, entity, f)) GROUP BY 1),
s AS (SELECT provider, count(*) * 10 AS total, sum(k % 6) AS auto, sum(k % 6 + k % 4) AS mapped, count(*) * 8 AS findings, sum(k % 3) AS failures, count(*) FILTER (WHERE k % 3 > 0) AS checked, count(*) FILTER (WHERE k % 3 = 1) AS steady FROM o GROUP BY 1),
p AS (SELECT provider, required, covered, round(least(1, mapped / total) * 35, 2) + round(covered / required * 25, 2) + round((findings - failures) / findings * 15, 2) + round(CASE WHEN mapped = 0 THEN 1 ELSE auto / mapped END * 15, 2)
  + round(CASE WHEN checked = 0 THEN 1 ELSE steady / checked END * 10, 2) AS points FROM s JOIN q USING (provider)),
t AS (SELECT provider, CAST(required AS INTEGER) AS required, CAST(covered AS INTEGER) AS covered, CAST(round_even(points, 0) AS INTEGER) AS score FROM p)
"""
_BAND_SQL = "CASE WHEN score >= 90 THEN 'ready_for_auto_deploy' WHEN score >= 80 THEN 'ready_with_minor_review' WHEN score >= 60 THEN 'needs_mapping_review' ELSE 'blocked' END"


@query("readiness_scores", _READY_SQL + f"SELECT provider, required, covered, score, {_BAND_SQL} AS band FROM t")
def readiness_scores(spark, sf_dir):
    return readiness.totals(_outcomes(spark, sf_dir)).select("provider", "required", "covered", "score", readiness.band(F.col("score")).alias("band"))


@query("portfolio_rollup", _READY_SQL + "SELECT count(*) AS providers, " + ", ".join(f"count(*) FILTER (WHERE {_BAND_SQL} = '{b}') AS {b}" for b in readiness.NEXT) + " FROM t")
def portfolio_rollup(spark, sf_dir):
    return readiness.rollup(readiness.totals(_outcomes(spark, sf_dir)))


# extensions


@query("cosine_unit", "SELECT a.vec_id, round(greatest(0, least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_unit(spark, sf_dir):
    a = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(semantic.cosine_unit(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("events_window_profile", "SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS null_value, count(DISTINCT value) AS distinct_value, count(*) FILTER (WHERE event_type IS NULL) AS null_type, count(DISTINCT event_type) AS distinct_type FROM events GROUP BY 1")
def events_window_profile(spark, sf_dir):
    return batches.window_profile(_table(spark, sf_dir, "events"), "ts", "1 day", {"value": F.col("value"), "type": F.col("event_type")})
