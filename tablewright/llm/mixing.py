"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gives an exact quota of documents in the proportion of the target weights, none more often than once. The
total is the largest at which the sources that fall short, taken whole, lack a share ``slack`` of it together: a source of a
few documents doesn't decide how much of the others is kept. Nor does the null source, of whatever size; it gives its
weight of the total, or all it has. A source's documents are permuted by hash and cut in blocks. A binary tree over the output shards splits the vector of block quotas:
each node draws, without replacement, what its left half of the shards gets of each source, so each shard holds an exact
number of blocks and the shards together hold each quota exactly. A source's permuted blocks are dealt to shards in
ranges that don't meet, and each shard shuffles its documents locally.

Results for odd input: a null source is a source of its own; sources without a weight give nothing; rows with the same id
and source are one document and travel together, at the same place; null ids are one document of their source. Equal
hashes rank by id. Texts aren't read. With an empty table the result is empty. Other columns pass through, whatever their names but
those of the two new ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import col, fresh, written

_NULL = "\0null"


#: Target weights of the query and the pipeline: the sources' sizes to this power.
POWER = 0.7


def quotas(counts: dict[str, int], weights: dict[str, float], slack: float = 0.01) -> dict[str, int]:
    """Documents by source: the largest total at the weights that sources with a name fall short of by ``slack`` of it at
    most, all together. Those that fall short give all they have; fractions are rounded down."""
    w = {s: weights.get(s, 0.0) for s, n in counts.items() if n > 0 and weights.get(s, 0.0) > 0}
    if not w:
        return {}
    reach = {s: counts[s] / x for s, x in w.items() if s != _NULL}
    named = sorted(reach, key=reach.get)  # scarcest first
    over, have, total = -slack * sum(w.values()), 0, math.inf
    for s, after in zip(named, [*named[1:], None]):
        # at this total those so far, taken whole, lack slack of it; it holds if the next one doesn't fall short there
        over, have = over + w[s], have + counts[s]
        total = have / over if over > 0 else math.inf
        if after is not None and total <= reach[after]:
            break
    return {s: math.floor(min(counts[s], total * x + 1e-9)) for s, x in w.items()}


class SplitTree:
    """Which shard gets which of a source's permuted blocks. A node's draw depends on the seed and the node alone, so any
    task finds a block's shard from the root on, and no table of shards exists."""

    def __init__(self, blocks: list[int], shards: int, seed: int, remember: int = 100_000):
        self.blocks, self.shards, self.seed, self.remember = np.asarray(blocks, np.int64), shards, seed, remember
        self.draws: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, have: np.ndarray) -> np.ndarray:
        """Blocks of each source that the shards from lo to the middle get, of those that the shards lo to hi have."""
        got = self.draws.get((lo, hi))
        if got is None:
            mid, total = (lo + hi) // 2, int(have.sum())
            number = total // (hi - lo) * (mid - lo) + min(total % (hi - lo), mid - lo)
            rng = np.random.Generator(np.random.Philox(key=np.array([self.seed, lo << 32 | hi], np.uint64)))
            got = rng.multivariate_hypergeometric(have, number, method="marginals") if total else have
            if len(self.draws) >= self.remember:
                self.draws.clear()
            self.draws[lo, hi] = got
        return got

    def shard_of(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Shard of each (number of source, number of block in it)."""
        out = np.zeros(len(source), np.int32)
        todo = [(0, self.shards, self.blocks, np.arange(len(source)), np.asarray(block, np.int64))]
        while todo:
            lo, hi, have, at, b = todo.pop()
            if hi - lo == 1:
                out[at] = lo
                continue
            take = self.left(lo, hi, have)
            first = b < take[source[at]]
            mid = (lo + hi) // 2
            if first.any():
                todo.append((lo, mid, take, at[first], b[first]))
            if not first.all():
                todo.append((mid, hi, have - take, at[~first], (b - take[source[at]])[~first]))
        return out


def smoothed(counts: dict[str, int], power: float) -> dict[str, float]:
    """Weights in proportion to a power of the sources' sizes; below 1 it lifts the small ones."""
    return {s: n**power for s, n in counts.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, shard_docs: int = 8192, block_docs: int = 32, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", shard_col: str = "shard", position_col: str = "position") -> DataFrame:
    """The documents of the sources' ``quotas``, all columns, with ``shard_col`` and ``position_col``, the place in the shard; each
    partition holds whole shards, in order of position. Without ``weights`` they are the sources' sizes to ``power``. Where the documents
    have a column of either name ValueError is raised."""
    taken = {c.lower() for c in docs.columns} & {shard_col.lower(), position_col.lower()}
    if taken:
        raise ValueError(f"the documents have columns {sorted(taken)}; give other names for shard_col and position_col")
    spark = docs.sparkSession
    src = F.coalesce(col(source_col).cast("string"), F.lit(_NULL))
    unit = docs.select(col(id_col).alias("k"), src.alias("s")).distinct().withColumn("h", F.xxhash64(F.lit(seed), "k", "s"))
    unit = written(unit, "mix-units")
    counts = {r.s: r["count"] for r in unit.groupBy("s").count().collect()}  # one row a source
    quota = quotas(counts, weights if weights is not None else smoothed(counts, power))
    names = sorted(quota)
    shards = max(1, math.ceil(sum(quota.values()) / shard_docs))
    blocks = [math.ceil(quota[s] / block_docs) for s in names]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard of each document by its source and rank there; those beyond the source's quota go."""
        tree, number = SplitTree(blocks, shards, seed), {s: i for i, s in enumerate(names)}
        for batch in batches:
            source = np.array([number.get(s, -1) for s in batch.column("s").to_pylist()], np.int64)
            r = batch.column("r").to_numpy()
            stays = source >= 0
            stays[stays] = r[stays] < np.array([quota[s] for s in names], np.int64)[source[stays]]
            batch = batch.filter(pa.array(stays))
            shard = tree.shard_of(source[stays], r[stays] // block_docs)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "s", "h")), pa.array(shard, pa.int32())], ["k", "s", "h", "shard"])

    # rank within a source, without one task for a whole source: ranks within hash slices, plus the sizes of the slices before
    slices = max(8, math.ceil(sum(counts.values()) / 50_000))
    unit = unit.withColumn("slice", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * slices).cast("int"))
    before = unit.groupBy("s", "slice").count().withColumn("before", F.sum("count").over(Window.partitionBy("s").orderBy("slice")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("s", "slice").orderBy(F.shiftrightunsigned("h", 1), "h", "k")) - 1
    ranked = unit.withColumn("r", rank).join(before, ["s", "slice"]).withColumn("r", F.col("r") + F.col("before"))
    ranked = ranked.select("k", "s", "h", "r").mapInArrow(deal, unit.select("k", "s", "h").withColumn("shard", F.lit(0)).schema)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "h", "s", "k")) - 1
    names = {c: fresh(docs, "mix_" + c) for c in ("k", "s", "shard", "position")}
    dealt = ranked.select("k", "s", "shard", place.cast("int").alias("position")).withColumnsRenamed(names)
    dealt = written(dealt, "mix-dealt")
    out = docs.join(dealt, col(id_col).eqNullSafe(F.col(names["k"])) & (src == F.col(names["s"])))
    # whole shards in each partition, as many partitions as shards or 10,000
    parts = min(shards, 10_000)
    out = out.repartitionById(parts, F.floor(F.col(names["shard"]).cast("long") * parts / shards).cast("int")).sortWithinPartitions(names["shard"], names["position"])
    return out.select(*[col(c) for c in docs.columns], F.col(names["shard"]).alias(shard_col), F.col(names["position"]).alias(position_col))
