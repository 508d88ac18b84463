"""Sliding counter rates from partials of one slide, which a stream commits and windows combine.

A partial is what a run of samples of one source does to a rate: its first and last sample, the growth between them
and their number. Two partials that follow each other make one, with the step between the last value of the first and
the first value of the second. A window is a few partials, however many samples lie in it, and no sample is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.ordered import time_chunk, with_neighbour
from tidegauge.streaming.commits import growth, start_commits


def slide_partials(samples: DataFrame, source: Sequence[str], slide_s: int, order: Sequence[str] = ("ts",),
                   value: str = "value", chunk_s: int = 60) -> DataFrame:
    """`(source…, slide, first, last, growth, n)` of a batch of samples; `first` and `last` are `(order…, value)`.

    Neighbours are found within chunks of `chunk_s`, so a source with many samples in one slide is not one task.
    """
    keys = [*source, "slide"]
    rows = samples.select(*source, *order, F.col(value).cast("double").alias("v")).withColumn(
        "slide", F.floor(F.unix_seconds(order[0]) / slide_s) * slide_s)
    paired = with_neighbour(rows, keys, order, ["v"], time_chunk(order[0], min(chunk_s, slide_s)))
    sample = F.struct(*order, "v")
    return paired.groupBy(*keys).agg(
        F.min(sample).alias("first"), F.max(sample).alias("last"), F.sum(growth(F.col("v"), F.col("prev_v"))).alias("growth"),
        F.count(F.lit(1)).alias("n"),
    )


def start_partials(samples: DataFrame, path: str, checkpoint: str, source: Sequence[str], slide_s: int,
                   order: Sequence[str] = ("ts",), value: str = "value", available_now: bool = True) -> StreamingQuery:
    """A stream of samples to a table of partials; every batch commits its own once."""
    return start_commits(samples, path, checkpoint, available_now=available_now,
                         shape=lambda batch: slide_partials(batch, source, slide_s, order, value))


def interleaved(partials: DataFrame, source: Sequence[str]) -> DataFrame:
    """`(source…, slide)` of which two batches brought samples that alternate in time: their partials do not merge."""
    order = Window.partitionBy(*source, "slide").orderBy("first")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return partials.withColumn("_reach", reach).where(F.col("first") < F.col("_reach")).select(*source, "slide").distinct()


def mended(partials: DataFrame, samples: DataFrame, source: Sequence[str], slide_s: int, order: Sequence[str] = ("ts",),
           value: str = "value") -> DataFrame:
    """The partials with those of interleaved slides computed anew from the samples of these slides alone."""
    mixed = interleaved(partials, source)
    keys = [*source, "slide"]
    slide = F.floor(F.unix_seconds(order[0]) / slide_s) * slide_s
    again = samples.withColumn("slide", slide).join(mixed, keys, "left_semi").drop("slide")
    return partials.join(mixed, keys, "left_anti").unionByName(slide_partials(again, source, slide_s, order, value))


def window_rates(partials: DataFrame, source: Sequence[str], window_s: int, slide_s: int) -> DataFrame:
    """`(source…, window_start, ts, rate)` of every window `[start, start + window)` with at least two samples.

    Windows start at every slide. Partials of a window are merged in the order of their samples; only the steps between
    them are added to their own growth.
    """
    if window_s % slide_s:
        raise ValueError("a window must be a whole number of slides")
    keys = [*source, "window_start"]
    starts = F.sequence(F.col("slide") - (window_s - slide_s), F.col("slide"), F.lit(slide_s).cast("bigint"))
    rows = partials.withColumn("window_start", F.explode(starts))
    step = growth(F.col("first.v"), F.lag("last.v").over(Window.partitionBy(*keys).orderBy("first")))
    merged = rows.withColumn("_step", step).groupBy(*keys).agg(
        F.sum(F.col("growth") + F.col("_step")).alias("_total"), F.sum("n").alias("_n"))
    at: Column = F.timestamp_seconds("window_start")
    return merged.where(F.col("_n") > 1).select(
        *source, at.alias("window_start"), F.timestamp_seconds(F.col("window_start") + window_s).alias("ts"),
        (F.col("_total") / window_s).alias("rate"))
