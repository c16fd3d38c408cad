"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals, asymmetric distance
tables and exact reranking. Similarity is the cosine; the queries are given vectors of the table, or all.

The index is fitted on ``sample`` vectors at most (and 16 million numbers), taken by hash of the id: coarse centroids, about the
square root of the number of vectors and no more than a sixteenth of the sample, and codebooks of residuals. Every vector is then
indexed, once: the written index has its list, one byte a subspace, the length of what its code leaves out, and the vector.

A query goes to the lists that it probes, so what moves grows with queries and probes. There the score of a vector is the
query's product with the list's centroid plus one entry of the query's distance table for each subspace. The best ``rerank`` are
compared exactly, in float64, and so is every other vector whose score, with what its code leaves out, reaches the k-th best of
those: a score is off by that at most, so nothing in a probed list is lost, and equal scores rank by id. A list longer than
``chunk`` vectors is searched in parts, each by a task.

How many lists are probed is measured, not set: for ``calibration`` vectors the exact neighbours are found over all
vectors, and the least number of lists that holds a share ``recall`` of them is taken. As the lists are searched without
loss, that share is the recall of the result. Vectors without cluster structure need many lists, clustered ones few.

(id, neighbour, rank, score): score to 6 decimals. Results for odd input: as ``vectors.by_length`` leaves out or joins
rows; with fewer than k others a query has fewer rows; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors as V
from ._shared import written

#: Bound on the error of float32 scores of unit vectors, with the rounding of reported ones.
_ERROR = 2e-5


@dataclass
class Index:
    """Coarse centroids (lists, d) and codebooks (subspaces, 256 at most, d / subspaces), float32."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int = 1

    def nearest_list(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its list and codes stand for."""
        rest = _spread(x - self.centroids[lists], self.books)
        codes = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)
        for m in range(len(self.books)):
            rest[:, m] -= self.books[m][codes[:, m]]
        return codes, np.sqrt((rest**2).sum((1, 2)))

    def probed(self, q: np.ndarray) -> np.ndarray:
        """(queries, probes): the lists that each query probes."""
        return V.top_places(q @ self.centroids.T, self.probes)


def _nearest(x: np.ndarray, centroids: np.ndarray, step: int = 8192) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(x[a : a + step] @ centroids.T - half).argmax(1) for a in range(0, len(x), step)] or [np.zeros(0, int)])


def _spread(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, subspaces, dimensions of one), zeros at the end where d isn't a multiple."""
    m, _, w = books.shape
    return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)


def _lloyd(x: np.ndarray, centroids: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        at = _nearest(x, centroids)
        o = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[o]) != 0))
        centroids = centroids.copy()
        centroids[at[o][first]] = np.add.reduceat(x[o], first, axis=0) / np.diff(np.append(first, len(o)))[:, None]
    return centroids


def train(x: np.ndarray, lists: int, width: int, coarse_steps: int, fine_steps: int) -> Index:
    """Centroids and codebooks of a sample of unit vectors, by Lloyd steps."""
    d = x.shape[1]
    words = min(256, len(x))
    books = np.zeros((math.ceil(d / width), words, width), np.float32)
    c = _lloyd(x, x[:lists], coarse_steps)
    rest = _spread(x - c[_nearest(x, c)], books)
    for m in range(len(books)):
        books[m] = _lloyd(rest[:, m], rest[:words, m], fine_steps)
    return Index(c, books)


def probes_for(indexed: DataFrame, sample: np.ndarray, ids: np.ndarray, d: int, index: Index, k: int, recall: float, calibration: int) -> int:
    """Least number of lists that holds a share ``recall`` of the exact neighbours of ``calibration`` vectors over all vectors."""
    q, own = sample[-calibration:], ids[-calibration:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                its, v = V.unpack(batch.column("ids")[r], batch.column("xs")[r], d)
                p = np.round(q @ v.T, V.PLACES)
                p[own[:, None] == its[None]] = -np.inf
                who, at = V.first_places(p, k)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(its[at]), pa.array(p[who, at]), pa.array(np.full(len(at), batch.column("l")[r].as_py()))], ["id", "neighbour", "score", "l"])

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    got = indexed.mapInArrow(run, V.PAIR + ", l long").withColumn("rank", rank).where(F.col("rank") <= k).select("id", "l").toArrow()  # k rows a calibration vector
    place = np.argsort(np.argsort(-(q.astype(np.float32) @ index.centroids.T), axis=1), axis=1)
    rank = np.sort(place[got["id"].to_numpy(), got["l"].to_numpy()])
    return int(rank[min(len(rank) - 1, math.ceil(recall * len(rank)))]) + 1 if len(rank) else 1


def neighbours(table: DataFrame, k: int = 10, queries=None, recall: float = 0.96, calibration: int = 256, sample: int = 65_536, rerank: int = 128, width: int = 4, chunk: int = 8192, coarse_steps: int = 6, fine_steps: int = 6, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """About the k nearest neighbours of every vector whose id, column ``id``, meets the condition ``queries`` (SQL); all without one."""
    found = [_search(x, d, n, k, queries, recall, calibration, sample, rerank, width, chunk, coarse_steps, fine_steps) for x, d, n in V.by_length(table, id_col, vec_col) if n > 1]
    return V.best(V.union(table.sparkSession, found), k, id_col)


def _search(x: DataFrame, d: int, n: int, k: int, queries, recall: float, calibration: int, sample: int, rerank: int, width: int, chunk: int, coarse_steps: int, fine_steps: int) -> DataFrame:
    spark = x.sparkSession
    some = x.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max(1, min(sample, (1 << 24) // d))).toArrow()
    ids = some["id"].to_numpy()
    start = V.unit(some["x"].combine_chunks().flatten().to_numpy().reshape(-1, d))
    index = train(start.astype(np.float32), max(1, min(round(math.sqrt(n)), len(start) // 16)), width, coarse_steps, fine_steps)
    fitted = spark.sparkContext.broadcast(index)  # at most a sixteenth of the sample and 256 words a subspace
    chunk = max(1, min(chunk, (1 << 22) // d))

    def enlist(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("x").flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(fitted.value.nearest_list(V.unit(v).astype(np.float32)).astype(np.int32))], ["id", "x", "l"])

    listed = written(x.mapInArrow(enlist, "id long, x array<double>, l int"), "ann-listed")
    sizes = listed.groupBy("l").count().select("l", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    sizes = F.broadcast(written(sizes, "ann-sizes"))  # one row a list, at most a sixteenth of the sample

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, v = batch.column("s")[r].as_py(), V.unpack(batch.column("ids")[r], batch.column("xs")[r], d)[1]
                codes, off = fitted.value.codes(v.astype(np.float32), np.full(len(v), s["l"]))
                yield pa.RecordBatch.from_arrays([pa.array([s["l"]], pa.int32()), pa.array([s["part"]], pa.int32()), batch.column("ids").slice(r, 1), pa.array([codes.tobytes()]), pa.array([off.astype(np.float32).tobytes()]), batch.column("xs").slice(r, 1)], ["l", "part", "ids", "codes", "off", "xs"])

    placed = listed.join(sizes, "l").select("id", "x", F.struct("l", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int").alias("part")).alias("s"))
    indexed = written(V.packed(placed, "s", "struct<l:int,part:int>", V.number_of_shards(n, chunk), d).mapInArrow(build, "l int, part int, ids binary, codes binary, off binary, xs binary"), "ann-index")
    index.probes = probes_for(indexed, start, ids, d, index, k, recall, calibration)
    held = spark.sparkContext.broadcast(index)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, packed by the list that they go to."""
        for batch in batches:
            own, q = batch.column("id").to_numpy(), V.unit(batch.column("x").flatten().to_numpy().reshape(-1, d))
            for a in range(0, len(own), 1024):
                at = held.value.probed(q[a : a + 1024].astype(np.float32))
                o = np.argsort(at.ravel(), kind="stable")
                lists, who = at.ravel()[o], a + o // at.shape[1]
                first = np.flatnonzero(np.append(True, np.diff(lists) != 0)) if len(o) else []
                runs = [who[i:j] for i, j in zip(first, [*first[1:], len(o)])]
                yield pa.RecordBatch.from_arrays([pa.array(lists[first].astype(np.int32)), pa.array([own[r].tobytes() for r in runs], pa.binary()), pa.array([q[r].tobytes() for r in runs], pa.binary())], ["l", "ids", "xs"])

    asked = x.where(queries) if queries else x
    asked = asked.mapInArrow(probe, "l int, ids binary, xs binary").join(sizes, "l")
    asked = asked.select("l", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "ids", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("off"), "xs")
    met = indexed.select("l", "part", F.lit(0).alias("kind"), "ids", "codes", "off", "xs").union(asked).repartition("l", "part").sortWithinPartitions("l", "part", "kind")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v = V.unpack(batch.column("ids")[r], batch.column("xs")[r], d)
                if batch.column("kind")[r].as_py() == 0:
                    codes = np.frombuffer(batch.column("codes")[r].as_buffer(), np.uint8).reshape(len(ids), -1)
                    have = batch.column("l")[r].as_py(), ids, v, codes, np.frombuffer(batch.column("off")[r].as_buffer(), np.float32)
                    continue
                for a in range(0, len(ids), 256):
                    i, j, s = _closest(ids[a : a + 256], v[a : a + 256], *have, held.value, rerank, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i]), pa.array(have[1][j]), pa.array(s)], ["id", "neighbour", "score"])

    return met.mapInArrow(search, V.PAIR)


def _closest(own: np.ndarray, q: np.ndarray, l: int, ids: np.ndarray, y: np.ndarray, codes: np.ndarray, off: np.ndarray, index: Index, rerank: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) and scores of the k best for each query among the vectors of a list, of equal ones those of least
    id. ``ids`` ascend."""
    small = q.astype(np.float32)
    score = np.repeat((small @ index.centroids[l])[:, None], len(ids), axis=1)
    tables = np.einsum("qmw,mcw->mqc", _spread(small, index.books), index.books, optimize=True).astype(np.float32)
    for m in range(len(tables)):
        score += tables[m][:, codes[:, m]]
    score[own[:, None] == ids[None]] = -np.inf
    at = V.top_places(score, max(rerank, k))
    # the k-th best of those by exact comparison: what can't reach it by its score and its error is no neighbour
    true = V.exact(q, y, np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()).reshape(at.shape)
    true[np.take_along_axis(score, at, 1) == -np.inf] = -np.inf
    least = np.partition(true, -k, axis=1)[:, -k, None] - _ERROR if at.shape[1] >= k else -np.inf
    near = (score + off >= least) & (score > -np.inf)
    used = np.flatnonzero(near.any(0))
    p = np.round(q @ y[used].T, V.PLACES)
    p[~near[:, used]] = -np.inf
    i, j = V.first_places(p, k)
    return i, used[j], p[i, j]
