"""Token counts with a digest cache.

A text's normalised content (line ends as LF, no white space at its ends) and the tokenizer's version each have a SHA-256
digest. Counts that the cache holds for both digests are joined; of all other contents one copy each is encoded, and the
counts are appended to the cache, a Parquet table in the shared folder or wherever the caller keeps it.

Results for odd input: a null text has a null count, an empty one 0; null ids are kept, rows that repeat an id each have
the count of their own text. With an empty table the result is empty. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import byte_slices, col, shared_path, tokenizer_file, written
from .bpe import PATTERN

_CACHE = "digest binary, tokenizer string, n_tokens int"


def version_digest(path: str) -> str:
    """Digest of the vocabulary file and the split pattern."""
    h = hashlib.sha256(PATTERN.encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def normalised(text: F.Column) -> F.Column:
    """Content that is counted."""
    x = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.trim(x, F.lit(" \t\n"))


def _cached(spark, path: str, tokenizer: str) -> DataFrame:
    try:
        cache = spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # no cache yet
        cache = spark.createDataFrame([], _CACHE)
    # runs that raced may have appended the same content twice
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str | None = None, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row. ``cache``: folder of the cache, read and appended to; a new one if null."""
    spark = docs.sparkSession
    path = vocabulary or tokenizer_file()
    cache = cache or shared_path(spark, "token-cache")
    version = version_digest(path)
    src = docs.select(col(id_col).alias("k"), normalised(col(text_col).cast("string")).alias("x"))
    digest = F.unhex(F.sha2(F.col("x"), 256))
    keys = written(src.select("k", digest.alias("digest")), "token-keys")

    misses = keys.where("digest IS NOT NULL").groupBy("digest").agg(F.min("k").alias("k0"))
    misses = misses.join(_cached(spark, cache, version).select("digest"), "digest", "left_anti").withColumnRenamed("digest", "d0")
    todo = src.join(misses, F.col("k").eqNullSafe(F.col("k0"))).where(digest == F.col("d0")).select("d0", "x")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = None
        for batch in batches:
            for part in byte_slices(batch, "x"):
                if encoding is None:
                    with open(path, "rb") as f:
                        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
                    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
                n = np.array([len(encoding.encode_ordinary(t)) for t in part.column("x").to_pylist()], np.int32)
                yield pa.RecordBatch.from_arrays([part.column("d0"), pa.array(n)], ["digest", "n_tokens"])

    fresh = todo.mapInArrow(count, "digest binary, n_tokens int").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return keys.join(_cached(spark, cache, version), "digest", "left").select(F.col("k").alias(id_col), "n_tokens")
