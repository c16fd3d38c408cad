"""Sources by format name: files, object stores, databases, SQLite, REST, Excel. All give a DataFrame."""

from __future__ import annotations

import csv
import json
import logging
import os
import re
from collections.abc import Callable, Iterator
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import scratch, ship

log = logging.getLogger(__name__)
_WRAPPERS = ("records", "data", "items", "rows", "results")
_SECRET = {"password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "secret_key", "private_key", "credentials"}


class SourceError(ValueError):
    """A source, or its configuration, that can't be used."""


def head_of(spark: SparkSession, path: str, size: int = 8192) -> str:
    """First characters of the first file at a path, by Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceError(f"nothing at {path}")
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(f.getPath()) for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", ".")))
        if not files:
            return ""
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    line = spark.read.option("wholetext", False).text(str(p)).limit(200).collect()  # a bounded head
    return "\n".join(r.value for r in line)[:size]


def delimiter_of(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, **options: Any) -> DataFrame:
    """All columns as text, names from the header. The separator is sniffed from the head of the first file if not given."""
    sep = delimiter or delimiter_of(head_of(spark, path))
    return spark.read.options(**options).csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"', enforceSchema=False)


def read_json(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """JSON documents: an array of objects, an object that wraps one under a usual key, or one object. Elements that aren't objects
    are left out. Columns come in the order in which keys first appear."""
    whole = spark.read.text(path, wholetext=True)
    kind = F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1)
    if whole.where(~kind.isin("[", "{") | F.try_parse_json("value").isNull()).limit(1).count():
        raise SourceError(f"{path} isn't a JSON array or object")
    wrapped = F.coalesce(*[F.when(F.substring(x := F.get_json_object("value", f"$.{k}"), 1, 1) == "[", x) for k in _WRAPPERS])
    array = F.when(kind == "[", F.col("value")).otherwise(wrapped)
    objects = F.when(array.isNotNull(), F.from_json(array, "array<string>")).otherwise(F.array("value"))
    # objects one a line, which are read once for the schema and once for the rows
    lines = scratch(spark, "json")
    whole.select(F.explode(objects).alias("o")).where(F.json_object_keys("o").isNotNull()).select(F.regexp_replace("o", r"[\r\n]+", " ").alias("value")).write.text(lines)
    return _objects(spark, spark.read.text(lines), lines, options)


def _objects(spark: SparkSession, objects: DataFrame, path: str, options: dict[str, Any]) -> DataFrame:
    """Objects, one a line (column value), as columns with the schema of the lines at a path."""
    schema = spark.read.options(**options).json(path, mode="DROPMALFORMED").schema
    if not schema.fields:
        return objects.drop("value")
    df = objects.select(F.from_json("value", schema).alias("r")).select("r.*")
    return df.select(*["`" + c.replace("`", "``") + "`" for c in _first_seen(objects.select(F.col("value").alias("o")), df.columns)])


def _first_seen(objects: DataFrame, names: list[str]) -> list[str]:
    """Names in the order of first appearance among JSON objects (column o)."""
    keys = objects.select(F.monotonically_increasing_id().alias("r"), F.posexplode(F.json_object_keys("o")).alias("p", "k"))
    order = [x.k for x in keys.groupBy("k").agg(F.min(F.struct("r", "p")).alias("at")).orderBy("at").collect()]  # names only
    return [k for k in order if k in names] + [c for c in names if c not in order]


def read_jsonl(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """One object a line. Blank lines and lines with another value are skipped; a line that isn't JSON is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.where(F.try_parse_json("value").isNull()).limit(1).count():
        raise SourceError(f"{path} has a line that isn't JSON")
    objects = lines.where(F.json_object_keys("value").isNotNull())
    return _objects(spark, objects, path, options)


class SqliteSource(DataSource):
    """Table of a SQLite file, in ranges of rowid. The file has to be readable on every executor."""

    @classmethod
    def name(cls) -> str:
        return "tw_sqlite"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")]
        if not names:
            raise SourceError(f"no table {self.options['table']}")
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", 100_000))

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [_Range(a, a + self.rows) for a in range(lo, hi + 1, self.rows)] if lo is not None else [_Range(0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        with self._open() as db:
            for r in db.execute(f"SELECT * FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.lo, partition.hi)):
                yield tuple(None if v is None else str(v) for v in r)


class RestSource(DataSource):
    """Pages of a JSON API: ``url`` with ``{page}``, from page 1 until one is empty; records under ``records_key`` if given."""

    @classmethod
    def name(cls) -> str:
        return "tw_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(dict(self.options))


class _RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.key, self.limit = options["url"], options.get("records_key") or options.get("recordskey"), int(options.get("limit", 0))

    def read(self, partition) -> Iterator[tuple]:
        from urllib.request import urlopen

        page, n = 1, 0
        while True:
            with urlopen(self.url.replace("{page}", str(page)), timeout=30) as r:
                doc = json.load(r)
            rows = doc.get(self.key, []) if self.key else doc
            for x in rows:
                yield (json.dumps(x),)
                n += 1
                if n == self.limit:
                    return
            if not rows or "{page}" not in self.url:
                return
            page += 1


def _sqlite(spark: SparkSession, path: str, table: str | None = None, entity: str | None = None, **options: Any) -> DataFrame:
    ship(spark).dataSource.register(SqliteSource)
    return spark.read.format("tw_sqlite").options(path=path, table=table or entity or "", **options).load()


def _rest(spark: SparkSession, url: str, records_key: str | None = None, limit: int = 0, **_: Any) -> DataFrame:
    ship(spark).dataSource.register(RestSource)
    pages = spark.read.format("tw_rest").options(url=url, records_key=records_key or "", limit=limit).load()
    schema = pages.select(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first().s.replace("OBJECT<", "STRUCT<")
    return pages.select(F.from_json("value", schema).alias("r")).select("r.*")


def _excel(spark: SparkSession, path: str, sheet: str | int = 0, entity: str | None = None, **_: Any) -> DataFrame:
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=entity or sheet, dtype=str)
    except ImportError as error:
        raise SourceError("reading Excel needs openpyxl") from error
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))


def _jdbc(prefix: str, port: int) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, table: str | None = None, entity: str | None = None, host: str = "localhost", database: str = "", url: str | None = None, **options: Any) -> DataFrame:
        opts = {k: str(v) for k, v in options.items()}
        at = url or f"jdbc:{prefix}://{host}:{opts.pop('port', port)}/{database}"
        return spark.read.format("jdbc").options(url=at, dbtable=table or entity or "", pushDownLimit="true", **opts).load()

    return read


def _by_format(name: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str | None = None, entity: str | None = None, **options: Any) -> DataFrame:
        reader = spark.read.format(name).options(**{k: str(v) for k, v in options.items()})
        return reader.load(path) if path else reader.load()

    return read


def _store(scheme: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, bucket: str, prefix: str = "", format: str = "parquet", account: str | None = None, entity: str | None = None, **options: Any) -> DataFrame:  # noqa: A002
        place = f"{bucket}@{account}.dfs.core.windows.net" if account else bucket
        return read_source(spark, {"type": format, "path": f"{scheme}://{place}/{prefix}", **options})

    return read


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv, "json": read_json, "jsonl": read_jsonl, "ndjson": read_jsonl, "parquet": _by_format("parquet"), "orc": _by_format("orc"), "excel": _excel, "sqlite": _sqlite,
    "postgres": _jdbc("postgresql", 5432), "postgresql": _jdbc("postgresql", 5432), "mysql": _jdbc("mysql", 3306), "redshift": _jdbc("redshift", 5439), "bigquery": _by_format("bigquery"), "snowflake": _by_format("snowflake"),
    "s3": _store("s3a"), "gcs": _store("gs"), "azure_blob": _store("abfss"), "azure": _store("abfss"), "rest_api": _rest, "rest": _rest,
}


def register(kind: str, read: Callable[..., DataFrame]) -> None:
    """Make ``read(spark, **settings)`` the reader of a type of source."""
    READERS[kind.strip().lower()] = read


def reader_for(kind: str) -> Callable[..., DataFrame]:
    try:
        return READERS[kind.strip().lower()]
    except KeyError:
        raise SourceError(f"unknown source type {kind!r}; types are {', '.join(sorted(READERS))}") from None


def read_source(spark: SparkSession, source: dict[str, Any]) -> DataFrame:
    """DataFrame of a source's settings: ``type``, and what its reader takes. ``sample_limit`` is for the profiler."""
    read = reader_for(source["type"])
    settings = {k: v for k, v in source.items() if k not in ("type", "sample_limit")}
    if read in (read_csv, read_json, read_jsonl):
        settings.pop("entity", None)
    try:
        return read(spark, **settings)
    except TypeError as error:
        raise SourceError(f"settings of a source of type {source['type']!r}: {error}") from error


def read_path(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Reader by a file's ending; the first ``limit`` rows if given."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if ending not in ("csv", "json", "jsonl", "ndjson", "parquet", "orc"):
        raise SourceError(f"no reader for {path}; use a source configuration")
    df = READERS[ending](spark, path=path)
    return df.limit(limit) if limit else df


def interpolated(x: Any) -> Any:
    """Settings with ``${NAME}`` replaced by environment variables."""
    if isinstance(x, dict):
        return {k: interpolated(v) for k, v in x.items()}
    if isinstance(x, list):
        return [interpolated(v) for v in x]
    if not isinstance(x, str):
        return x

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise SourceError(f"environment variable {m[1]} isn't set")
        return os.environ[m[1]]

    return re.sub(r"\$\{([A-Z0-9_]+)\}", value, x)


def inline_secrets(source: dict[str, Any]) -> list[str]:
    """Keys that hold what looks like a secret, not a reference to the environment."""
    return [k for k, v in source.items() if k.lower() in _SECRET and isinstance(v, str) and v and not re.search(r"\$\{[A-Z0-9_]+\}", v)]


def load_source(path: str) -> dict[str, Any]:
    """Settings under ``source`` of a YAML file."""
    if not os.path.isfile(path):
        raise SourceError(f"no source configuration at {path}")
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)
    source = doc.get("source") if isinstance(doc, dict) else None
    if not isinstance(source, dict) or "type" not in source:
        raise SourceError("a source configuration has a mapping 'source' with a 'type'")
    for k in inline_secrets(source):
        log.warning("%s in %s looks like a secret; refer to the environment instead", k, path)
    return interpolated(source)


class Connector:
    """A configured source: whether it can be read, what it holds, and its rows."""

    def __init__(self, spark: SparkSession, source: dict[str, Any]):
        reader_for(source["type"])
        self.spark, self.source = spark, source

    def test_connection(self) -> bool:
        """Whether the source answers with a row or none; what it raises is logged."""
        try:
            self.frame().limit(1).collect()
        except Exception as error:
            log.warning("no answer from a source of type %s: %s", self.source["type"], error)
            return False
        return True

    def list_entities(self) -> list[str]:
        """Tables of the source: those of a SQLite file, else the one that is configured."""
        if self.source["type"] == "sqlite":
            import sqlite3

            with sqlite3.connect(f"file:{self.source['path']}?mode=ro", uri=True) as db:
                return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return [self.source.get("entity") or self.source.get("table") or "default"]

    def get_metadata(self) -> dict[str, Any]:
        """Type, path, entities and columns."""
        return {"type": self.source["type"], "path": self.source.get("path"), "entity": self.source.get("entity", "default"), "entities": self.list_entities(), "columns": self.frame().columns}

    def frame(self) -> DataFrame:
        return read_source(self.spark, self.source)
