"""The batch operators on streams: transformation is stateless and runs as it is; profiles and drift run on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import DriftReport
from ..plans.engine import Engine
from ..plans.schema import Entity, Mapping


def watch_drift(stream: DataFrame, engine: Engine, mapping: Mapping, entity: Entity, report: Callable[[int, DriftReport], None], checkpoint: str) -> StreamingQuery:
    """Compare each micro-batch with a mapping; ``report`` gets the batch's number and result. Empty batches are skipped."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            report(number, engine.drift(batch, mapping, entity))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def window_profile(events: DataFrame, time: str, length: str, values: dict[str, Column], late: str | None = None) -> DataFrame:
    """(window_start, rows, and null_<name>, distinct_<name> (approximate on streams) of each value) of tumbling windows. ``late``: how late
    rows of a stream may come."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    distinct = F.approx_count_distinct if events.isStreaming else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, v in values.items():
        aggs += [F.count_if(v.isNull()).alias(f"null_{k}"), distinct(v).alias(f"distinct_{k}")]
    return events.groupBy(F.window(time, length).alias("w")).agg(*aggs).select(F.col("w.start").alias("window_start"), *[F.col(c) for c in ("rows", *[f"{p}_{k}" for k in values for p in ("null", "distinct")])])
