"""Windowed streams: ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def stream_ticks(samples: DataFrame, step: str, delay: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row per key and tick, emitted when the watermark passes the end of the tick.

    Partial aggregation runs before the shuffle, so a key with many samples costs one row per task and
    tick; whatever is stateful later reads ticks, not samples.
    """
    window = F.window("ts", step)
    return (
        samples.withWatermark("ts", delay).groupBy(*keys, window.alias("_w")).agg(*aggregates)
        .select(*keys, F.col("_w.start").alias("ts"), F.col("_w.end").alias("tick_end"),
                *[c for c in _names(samples, keys, aggregates)])
    )


def _names(samples: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> list[str]:
    return [c for c in samples.groupBy(*keys).agg(*aggregates).columns if c not in keys]
