"""Sharding by sampled splitters: shards of near equal bytes from range-partitioned keys.

The key is (hash of the text, document id): copies lie together, yet a text that holds a third of the table is
still cut between its documents. A sample drawn with a chance in proportion to each row's size gives splitters at its
quantiles; every row goes to a range between two splitters; ranges that turn out overfull are subdivided by splitters
drawn from them alone. The exact bytes of the ranges, summed up in key order, then say where each shard ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.common import prepare, tables, written

# Ranges hold about this many rows; the driver keeps one splitter per range.
RANGE_ROWS = 100_000
LEAST_RANGES = 4096
SAMPLES_PER_RANGE = 4
OVERFULL = 4


def measured(docs: DataFrame) -> DataFrame:
    """`doc_id`, bytes of the text plus one (null text: 1), its checksum, its hash and the tie of its row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("tie"),
    )


def _sample(rows: DataFrame, wanted: float, total: int) -> np.ndarray:
    """Keys drawn with chance `wanted * size / total`, at most one, by a hash of the row: (key, tie) in order."""
    chance = F.col("size") * F.lit(wanted / max(total, 1))
    draw = F.pmod(F.xxhash64("key", "tie", F.lit("splitter")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.where(draw < chance).select("key", "tie").distinct().toArrow()
    keys = np.array([got.column("key").to_numpy(), got.column("tie").to_numpy()], np.int64).T
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))]


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    """`parts - 1` splitters at even places of the ordered sample, without repeats."""
    if not len(sample):
        return sample
    at = np.unique(np.arange(1, parts) * len(sample) // parts)
    return sample[at]


def _range_of(splitters: np.ndarray):
    """A function over Arrow batches that adds `range`, the number of splitters up to the row's (key, tie)."""
    keys, ties = np.ascontiguousarray(splitters[:, 0]), np.ascontiguousarray(splitters[:, 1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            key = batch.column("key").to_numpy(zero_copy_only=False)
            tie = batch.column("tie").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, "left")
            end = np.searchsorted(keys, key, "right")
            for low in np.unique(at[at < end]):  # splitters inside one text's copies
                high = np.searchsorted(keys, keys[low], "right")
                rows = np.flatnonzero((at == low) & (end == high))
                at[rows] = low + np.searchsorted(ties[low:high], tie[rows], "right")
            yield pa.record_batch([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "range"])

    return add


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_range_of(splitters), f"{fields}, range long")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` of every row.

    Shards follow each other in key order and differ in bytes by little more than one document. Null ids and texts
    and repeated rows are sharded like any other, other columns are ignored, an empty table gives no row. Rows equal
    in id and text may take each other's slot.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = written(spark, measured(docs), "sizes")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(LEAST_RANGES, count // RANGE_ROWS)
    splitters = _quantiles(_sample(rows, ranges * SAMPLES_PER_RANGE, total), ranges).reshape(-1, 2)
    limit = max(1, OVERFULL * total // ranges)

    ranged = _ranged(rows, splitters)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    overfull = [r["range"] for r in sums.where((F.col("bytes") > limit) & (F.col("n") > 1)).collect()]
    if overfull:  # only ranges the sample missed; each gets splitters of its own
        inside = ranged.where(F.col("range").isin(overfull))
        finer = _sample(inside, float(SAMPLES_PER_RANGE * ranges), total * max(1, total // max(limit, 1)) // ranges)
        splitters = np.unique(np.concatenate([splitters, finer]), axis=0)
        ranged = _ranged(rows, splitters)
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))

    # One row per range: what lies before it in key order.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    own = Window.partitionBy("range").orderBy("key", "tie", "text_crc32", "size")
    place = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(place)).withColumn("row", F.row_number().over(own) - 1)
        .join(before, "range")
    )
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int")
    done = written(spark, placed.select("doc_id", "size", "text_crc32", shard.alias("shard"),
                                        (F.col("n_before") + F.col("row")).alias("place")), "shards")
    starts = {r["shard"]: r["start"] for r in done.groupBy("shard").agg(F.min("place").alias("start")).collect()}
    start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)) if starts else F.lit(None)
    slot = F.col("place") - (F.element_at(start, F.col("shard")) if starts else F.lit(0))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
