"""Vector tables: cleaning, unit length, packed shards that searches pair with each other."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import col, written

#: Decimal places at which cosines are compared and reported; equal ones rank by id.
PLACES = 6
PAIR = "id long, neighbour long, score double"


def by_length(vectors: DataFrame, id_col: str, vec_col: str) -> list[tuple[DataFrame, int, int]]:
    """(id, x) with the length of its vectors and their number, for each length of vector: lengths are searched apart. One
    vector an id (the least of those with its id), without null ids and without vectors that are null, empty, zero or
    hold a null or a number that isn't finite. Ids are whole numbers; others raise ValueError."""
    kind = vectors.select(col(id_col)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"ids of vectors are whole numbers; column {id_col} is {kind}")
    x = vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<double>").alias("x")).where("id IS NOT NULL AND size(x) > 0")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = x.where(~bad & F.exists("x", lambda v: v != 0))
    x = written(x.groupBy("id").agg(F.min("x").alias("x")), "vectors")
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()  # one row a length of vector
    return [(x.where(F.size("x") == r.d), r.d, r["count"]) for r in sizes]


def union(spark, found: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], PAIR)
    for x in found:
        out = out.union(x)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def packed(x: DataFrame, s: str, kind: str, partitions: int, d: int) -> DataFrame:
    """(s, ids, xs): one row for each value of column ``s``, with its ids in order and their unit vectors as float64."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, xs = None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([last, pa.array([np.concatenate(ids).tobytes()]), pa.array([unit(np.concatenate(xs)).tobytes()])], ["s", "ids", "xs"])

        for batch in batches:
            s, k, m = batch.column("s"), batch.column("id").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, d)
            parts = s.flatten() if pa.types.is_struct(s.type) else [s]
            new = np.zeros(len(k), bool)
            for p in parts:
                new[1:] |= np.diff(p.to_numpy()) != 0
            cut = [0, *np.flatnonzero(new)] if len(k) else []
            for a, b in zip(cut, [*cut[1:], len(k)]):
                if ids and s[a] != last[0]:
                    yield flush()
                    ids, xs = [], []
                last = s.slice(a, 1)
                ids.append(k[a:b]), xs.append(m[a:b])
        if ids:
            yield flush()

    placed = x.withColumnRenamed(s, "s").repartition(max(1, partitions), "s").sortWithinPartitions("s", "id")
    return placed.mapInArrow(run, f"s {kind}, ids binary, xs binary")


def unpack(ids, xs, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(xs.as_buffer(), np.float64).reshape(-1, d)


def number_of_shards(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def top_places(p: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row of p, in no order; found in the k best of blocks of 32."""
    n, m = p.shape
    if m <= k:
        return np.broadcast_to(np.arange(m), (n, m))
    if m > 64 * k:
        w = 32
        full = m // w * w
        best = np.concatenate([p[:, :full].reshape(n, -1, w).max(2), p[:, full:].max(1, keepdims=True)] if full < m else [p.reshape(n, -1, w).max(2)], axis=1)
        blocks = np.argpartition(-best, k - 1, axis=1)[:, :k]
        places = np.minimum((blocks[:, :, None] * w + np.arange(w)).reshape(n, -1), m - 1)
        own = np.take_along_axis(p, places, 1)
        own[(blocks[:, :, None] * w + np.arange(w)).reshape(n, -1) >= m] = -np.inf
        at = np.argpartition(-own, k - 1, axis=1)[:, :k]
        return np.take_along_axis(places, at, 1)
    return np.argpartition(-p, k - 1, axis=1)[:, :k]


def first_places(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest of each row of p, of equal ones the first; those at minus infinity aren't found."""
    if p.shape[1] > k:
        least = np.take_along_axis(p, top_places(p, k), 1).min(1, keepdims=True)
        more, equal = p > least, p == least
        p = np.where(more | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - more.sum(1, keepdims=True)), p, -np.inf)
    return np.nonzero(p > -np.inf)


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 200_000) -> np.ndarray:
    """Cosines of rows i of a and j of b in float64."""
    return np.concatenate([np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)] or [np.zeros(0)])


def best(pairs: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, neighbour, rank, score) of the k best pairs of each id."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "neighbour", "rank", "score")
