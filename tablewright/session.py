"""Getting this package to a session's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers of ``spark``, once an application; those that have it installed lose nothing."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "tablewright.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``; without one in a temporary folder of a local session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/tablewright-{tag}-{uuid.uuid4().hex}"
