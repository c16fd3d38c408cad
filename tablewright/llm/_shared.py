"""Helpers that the operators of this subpackage share: the shared folder, written tables, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_TEST_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only where a local session has none (tests) a temporary folder is made and set as checkpoint folder; on a cluster that raises.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _TEST_ROOTS:
        _TEST_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(_TEST_ROOTS[app])
    return _TEST_ROOTS[app]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/tw-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    for paths in _COLLECTED:
        paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


_COLLECTED: list[list[str]] = []


@contextmanager
def collected():
    """List of the folders that ``written`` makes meanwhile."""
    paths: list[str] = []
    _COLLECTED.append(paths)
    try:
        yield paths
    finally:
        _COLLECTED.remove(paths)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    drop_path(df.sparkSession, df.shared_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by ``written`` or ``shared_path`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file; TABLEWRIGHT_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("TABLEWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)


def trim_memory() -> None:
    """Give memory that this Python worker no longer uses back to the system; workers serve one stage after another."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def byte_slices(batch, column: str, limit: int = 4 << 20):
    """Cut an Arrow record batch in runs of rows with about ``limit`` bytes of ``column`` each (one row at least)."""
    sizes = batch.column(column)
    import numpy as np
    import pyarrow.compute as pc

    n = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        base = n[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(n, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
