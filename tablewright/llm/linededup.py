"""Line deduplication with levelled sorted runs of line hashes.

A line is known by 128 bits of hash of its text without blanks at both ends. ``LineRuns`` keeps the hashes met so far in
sorted runs. A batch's own first lines are merge-anti-joined with the runs, what is new becomes a run of level 0, and when
a level holds ``fanout`` runs they are compacted in one run of the next level. A line of a document stays where it
occurs first, by id and then by line number; blank lines always stay.

Results for odd input: null text gives null text; an empty text stays empty; null ids sort before all others and count as
one id; rows that repeat an id are the same document, so equal lines at the same place in both stay. With an empty table
the result is empty. Ids are of any type that orders. A text may be of any length and number of lines; one task holds it whole. Of
equal lines in one document the first stays. Other columns pass through in ``dedup_documents``, whatever their names, and
aren't read by ``line_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import col, drop_path, fresh, shared_path, written

_KEY = ["h1", "h2"]


def _trim(x: Column) -> Column:
    return F.trim(F.translate(x, "\t\r\f\x0b", "    "))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit("line"), line)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, h1, h2) of every line that isn't blank; ``no`` counts from 0 and includes blank lines."""
    x = docs.select(col(id_col).alias("k"), F.posexplode(F.split(col(text_col).cast("string"), "\n")).alias("no", "line"))
    x = x.select("k", "no", _trim(F.col("line")).alias("line")).where("line <> ''")
    h1, h2 = _hashes(F.col("line"))
    return x.select("k", "no", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """Sorted runs of line hashes with the place (id, no) of each line's first occurrence, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.schema = None

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_path(self.spark, f"run{level}")
        rows.repartition(*_KEY).sortWithinPartitions(*_KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of lines; every id in it has to sort after those of earlier batches."""
        first = batch.groupBy(*_KEY).agg(F.min(F.struct("k", "no")).alias("at"))
        self.schema = first.schema
        for path in (p for level in self.levels for p in level):
            first = first.join(self._read(path).select(*_KEY).hint("merge"), _KEY, "left_anti")
        self._write(first, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self.spark.read.schema(self.schema).parquet(*old), level + 1)
                for p in old:
                    drop_path(self.spark, p)
            level += 1

    def firsts(self) -> DataFrame:
        """(h1, h2, at) of all lines met."""
        return self.spark.read.schema(self.schema).parquet(*[p for level in self.levels for p in level])


def _bounds(docs: DataFrame, id_col: str, batches: int, sample: int = 10_000) -> list:
    """Ids that part the documents in about equal batches: quantiles of a bounded sample by hash. They decide the sizes of batches alone."""
    some = docs.select(col(id_col).alias("k")).where("k IS NOT NULL")
    some = some.orderBy(F.xxhash64("k"), "k").limit(sample if batches > 1 else 0).orderBy("k").collect()
    return sorted({some[len(some) * i // batches].k for i in range(1, batches)}) if some else []


def _mark(no: Column, h1: Column, h2: Column) -> Column:
    """Number of a line in its document, with 32 bits of hash above it, which tell apart rows that repeat an id."""
    return F.shiftleft(F.xxhash64(h1, h2), 32).bitwiseOR(no.cast("long"))


def repeated_lines(docs: DataFrame, batches: int = 5, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, gone) of each document that loses lines; ``gone``: marks of those lines. The documents come in ``batches`` ranges of
    ids, one after another."""
    spark = docs.sparkSession
    all_lines = written(lines(docs, id_col, text_col), "lines")
    bounds = [None, *_bounds(docs, id_col, batches), None]
    runs = LineRuns(spark, fanout)
    for lo, hi in zip(bounds, bounds[1:]):
        part = all_lines
        if hi is not None:
            part = part.where((F.col("k") <= F.lit(hi)) | (F.col("k").isNull() if lo is None else F.lit(False)))
        if lo is not None:
            part = part.where(F.col("k") > F.lit(lo))
        runs.add(part)
    again = all_lines.join(runs.firsts(), _KEY).where(~F.struct("k", "no").eqNullSafe(F.col("at")))
    return again.groupBy("k").agg(F.collect_set(_mark(F.col("no"), F.col("h1"), F.col("h2"))).alias("gone"))


def _joined(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """The documents with two columns more, and those: the marks of what they lose (null where nothing), the lines left."""
    k, g, left = fresh(docs, "gone_id"), fresh(docs, "gone_lines"), fresh(docs, "left_lines")
    x = docs.join(gone.select(F.col("k").alias(k), F.col("gone").alias(g)), col(id_col).eqNullSafe(F.col(k)), "left")
    split = F.split(col(text_col).cast("string"), "\n")
    marks = F.transform(split, lambda line, no: _mark(no, *_hashes(_trim(line))))
    # by hash set, in proportion to the number of lines; marks differ as numbers do, and the order stays
    stay = F.transform(F.array_except(marks, F.col(g)), lambda m: F.get(split, m.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))
    # a column of its own: within one select an alias that names an input column would stand for it in lambdas
    return x.withColumn(left, F.when(F.col(g).isNull(), split).otherwise(stay)), F.col(g), F.col(left)


def line_dedup(docs: DataFrame, batches: int = 5, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_removed): every document without the lines that occur earlier."""
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    x, gone, left = _joined(narrow, repeated_lines(docs, batches, fanout, id_col, text_col), "id", "text")
    removed = F.when(F.col("text").isNull() | gone.isNull(), 0).otherwise(F.size(F.split("text", "\n")) - F.size(left))
    n = F.when(F.col("text").isNotNull(), F.size(left) + removed).otherwise(0)
    return x.select(F.col("id").alias(id_col), F.array_join(left, "\n").alias("text"), n.alias("n_lines"), removed.alias("n_removed"))


def dedup_documents(docs: DataFrame, batches: int = 5, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with repeated lines cut out of the text and ``chars_col`` counted anew. A document that had lines and
    keeps none but blank ones only repeats others, and goes."""
    x, gone, left = _joined(docs, repeated_lines(docs, batches, fanout, id_col, text_col), id_col, text_col)
    x = x.where(gone.isNull() | F.exists(left, lambda line: _trim(line) != ""))
    text = F.array_join(left, "\n")
    out = []
    for f in docs.schema:
        if f.name == text_col:
            out.append(F.when(gone.isNotNull(), text).otherwise(col(text_col)).alias(f.name))
        elif f.name == chars_col:
            out.append(F.when(gone.isNotNull(), F.length(text)).otherwise(col(chars_col)).cast(f.dataType).alias(f.name))
        else:
            out.append(col(f.name))
    return x.select(*out)
