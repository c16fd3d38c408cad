"""Exact top-k search by the three-phase uniform threshold. Similarity is the cosine; the queries are given vectors of the
table, or all.

A list is a shard's vectors with their scores on one block of dimensions; an object's score is the sum over the
blocks. For each query:

1. Every list gives its k best objects; their sums, gathered over all shards, have a k-th best, tau.
2. tau / m, for m blocks, is sent to all shards. An object whose score is below it in every block can't reach tau; the
   others are collected. Scores are made block by block, and no longer for objects that no query of a run can need: what is at
   hand, with the lengths of the rest of query and object, stays below tau.
3. Of those collected, the remaining scores are resolved exactly, in float64.

What moves between tasks is k scores a query and shard in phase 1, tau in phase 2, and about k rows a query after
phase 3. Blocks of queries are paired with the shards of all vectors, each pair a task's unit.

(id, neighbour, rank, score): score to 6 decimals, at which equal ones rank by the neighbour's id; a vector isn't its
own neighbour. Results for odd input: as ``vectors.by_length`` leaves out or joins rows; with fewer than k others a query has
fewer rows; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from ._shared import written

#: Bound on the error of float32 scores of unit vectors, with the rounding of reported ones.
_ERROR = 2e-5


def _runs(own: np.ndarray, q: np.ndarray, step: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for a in range(0, len(q), step):
        s = slice(a, a + step)
        yield s, own[s], q[s].astype(np.float32)


def _needed_pairs(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, t: np.ndarray, dims: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, object) of phase 2: a score of tau / m in some block, and not surely below tau."""
    rest_q = np.array([np.sqrt((q[:, b.start :] ** 2).sum(1)) for b in dims[1:]] + [np.zeros(len(q))])
    rest_x = np.array([np.sqrt((x[:, b.start :] ** 2).sum(1)) for b in dims[1:]] + [np.zeros(len(x))])
    at = np.arange(len(x))
    sums = np.zeros((len(q), len(x)), np.float32)
    sums[own[:, None] == ids[None]] = -np.inf
    enough = np.zeros((len(q), len(x)), bool)
    for b, rq, rx in zip(dims, rest_q, rest_x):
        p = q[:, b] @ x[at][:, b].T
        sums += p
        enough |= p >= t[:, None] / len(dims) - _ERROR
        can = sums + np.outer(rq, rx[at]) >= t[:, None] - _ERROR
        stays = can.any(0)
        at, sums, enough = at[stays], sums[:, stays], enough[:, stays] & can[:, stays]
    i, j = np.nonzero(enough & (sums >= t[:, None] - _ERROR) & (sums > -np.inf))
    return i, at[j]


def exact_top_k(table: DataFrame, k: int = 10, queries=None, blocks: int = 2, shard_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest neighbours of every vector whose id, column ``id``, meets the condition ``queries`` (SQL); of all without one."""
    found = [_search(x, d, n, k, queries, blocks, shard_rows) for x, d, n in V.by_length(table, id_col, vec_col) if n > 1]
    return V.best(V.union(table.sparkSession, found), k, id_col)


def _search(x: DataFrame, d: int, n: int, k: int, queries, blocks: int, shard_rows: int) -> DataFrame:
    shards = V.number_of_shards(n, shard_rows)
    place = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s")
    lists = written(V.packed(x.select("id", "x", place), "s", "int", shards, d), "topk-shards")
    asked = x.where(queries) if queries else x
    number = asked.count() if queries else n
    runs = V.number_of_shards(number, shard_rows)
    place = F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("s")
    asked = written(V.packed(asked.select("id", "x", place), "s", "int", runs, d), "topk-queries")
    m = min(blocks, d)
    cut = np.linspace(0, d, m + 1).astype(int)
    dims = [slice(a, b) for a, b in zip(cut, cut[1:])]
    other = lists.select(F.col("s").alias("s2"), F.col("ids").alias("ids2"), F.col("xs").alias("xs2"))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: the k best sums among each list's k best."""
        for batch in batches:
            for r in range(batch.num_rows):
                own, q = V.unpack(batch.column("ids")[r], batch.column("xs")[r], d)
                ids, y = V.unpack(batch.column("ids2")[r], batch.column("xs2")[r], d)
                y = y.astype(np.float32)
                out = np.full((len(q), k), -np.inf, np.float32)
                for rows, mine, v in _runs(own, q):
                    p = [v[:, b] @ y[:, b].T for b in dims]
                    for b in p:
                        b[mine[:, None] == ids[None]] = -np.inf
                    places = np.sort(np.concatenate([V.top_places(b, k) for b in p], axis=1), axis=1)
                    sums = sum(np.take_along_axis(b, places, 1) for b in p)
                    sums[:, 1:][places[:, 1:] == places[:, :-1]] = -np.inf  # an object in two lists counts once
                    w = min(k, sums.shape[1])
                    out[rows, :w] = -np.sort(-sums, axis=1)[:, :w]
                yield pa.RecordBatch.from_arrays([batch.column("s").slice(r, 1), pa.array([out.tobytes()])], ["s", "sums"])

    sums = asked.crossJoin(other).mapInArrow(gather, "s int, sums binary")

    def cutoff(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """tau of each query of a run."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, b in zip(batch.column("s").to_pylist(), batch.column("sums").to_pylist()):
                sums = np.frombuffer(b, np.float32).reshape(-1, k)
                have = held.get(s)
                held[s] = sums if have is None else -np.sort(-np.concatenate([have, sums], axis=1), axis=1)[:, :k]
        for s, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([sums[:, -1].astype(np.float32).tobytes()])], ["s", "tau"])

    tau = sums.repartition("s").mapInArrow(cutoff, "s int, tau binary")
    asked = written(asked.join(tau, "s"), "topk-tau")

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3."""
        for batch in batches:
            for r in range(batch.num_rows):
                own, q = V.unpack(batch.column("ids")[r], batch.column("xs")[r], d)
                ids, y = V.unpack(batch.column("ids2")[r], batch.column("xs2")[r], d)
                small, t = y.astype(np.float32), np.frombuffer(batch.column("tau")[r].as_buffer(), np.float32)
                for rows, mine, v in _runs(own, q):
                    i, j = _needed_pairs(mine, v, ids, small, t[rows], dims)
                    i = i + rows.start
                    score = np.round(V.exact(q, y, i, j), V.PLACES)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(score)], ["id", "neighbour", "score"])

    return asked.crossJoin(other).mapInArrow(collect, V.PAIR)
