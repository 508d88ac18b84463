"""Micro-batches committed by their id, the pass that closes what a stream leaves open, and late-row accounts.

A batch writes the folder of its id and replaces what an earlier attempt left there, so a replay adds nothing. A
window that the watermark has not passed is in no batch; at shutdown the finishing pass computes these windows from the
source rows that belong to them and commits them under the id the next batch will have. A stream that goes on later
replaces them by itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType


def commit(batch: DataFrame, batch_id: int, path: str, partition: tuple[str, ...] = ()) -> None:
    """Writes the rows of one batch under its id, in place of what an earlier attempt wrote."""
    writer = batch.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{path}/batch={batch_id}")


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All committed rows."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*schema.names)


def start_commits(df: DataFrame, path: str, checkpoint: str, partition: tuple[str, ...] = (), available_now: bool = True,
                  interval: str = "15 seconds", shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts a stream whose batches are committed by id; `shape` turns a batch into what is written, by batch operators."""

    def write(batch: DataFrame, batch_id: int) -> None:
        commit(shape(batch) if shape else batch, batch_id, path, partition)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finished(query: StreamingQuery) -> StreamingQuery:
    """Waits for the end of a stream over all there is; a failure is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def _progress(query: StreamingQuery) -> dict | None:
    last = query.lastProgress
    return last if last is None or isinstance(last, dict) else {"batchId": last.batchId, "eventTime": last.eventTime}


def watermark(query: StreamingQuery) -> dt.datetime | None:
    """Up to which event time the last batch of the stream has closed its windows; none if it ran no batch."""
    last = _progress(query)
    mark = (last or {}).get("eventTime", {}).get("watermark")
    return dt.datetime.fromisoformat(mark.replace("Z", "+00:00")) if mark else None


def close_windows(query: StreamingQuery, source: DataFrame, windows: Callable[[DataFrame], DataFrame], path: str, ts: str,
                  length: str, end: str = "tick_end") -> DataFrame:
    """Commits the windows that a stopped stream holds open and returns them.

    `windows` is the aggregation of the stream, applied to the rows of `source` that a window of `length` beyond the
    watermark can contain; rows before them are not read. A stream that ran no batch has nothing open.
    """
    last, mark = _progress(query), watermark(query)
    if last is None or mark is None:
        return windows(source.limit(0))
    at = F.lit(mark)
    rows = windows(source.where(F.col(ts) >= at - F.expr(f"INTERVAL {length}"))).where(F.col(end) > at)
    commit(rows, last["batchId"] + 1, path)
    return source.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={last['batchId'] + 1}")


class LateRows(StreamingQueryListener):
    """Rows dropped as late, per stream and in sum, over every batch since the listener was added.

    A stream's own recent progress forgets all but its last hundred batches.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        own = str(progress.id)
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.dropped[own] = self.dropped.get(own, 0) + late
        self.batches[own] = self.batches.get(own, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def total(self) -> int:
        return sum(self.dropped.values())


def replay(df: DataFrame, ts: str, pieces: int, folder: str, files: int = 4) -> DataFrame:
    """Writes a table as `pieces` times `files` files, one time range after the other, and opens it as a stream.

    A batch of the stream is one piece, so its state crosses batches and no row comes late.
    """
    spark = df.sparkSession
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.select(at.alias("_t")).approxQuantile("_t", [i / pieces for i in range(1, pieces)], 0.01)
    low = None
    for high in [*sorted(set(cuts)), None]:
        piece = df
        if low is not None:
            piece = piece.where(at > F.lit(int(low)))
        if high is not None:
            piece = piece.where(at <= F.lit(int(high)))
        piece.repartition(files).write.mode("append").parquet(folder)
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


# ---- sliding rates ----------------------------------------------------------------------------------


def growth(value: Column, before: Column) -> Column:
    """Growth of a counter since the sample before; a smaller value is a reset and counts from 0."""
    return F.when(before.isNull(), 0.0).when(value >= before, value - before).otherwise(value)
