"""What the operators of this subpackage share: session settings, tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegauge.session import fresh_path
from tidegauge.session import prepare as prepare_session
from tidegauge.sources.tables import read_table


def prepare(spark: SparkSession) -> None:
    """UTC, the package on the executors, and Arrow batches small enough for very long texts."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, name)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there and nothing is computed twice."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of `df` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


KEYS_BROADCAST = 1 << 20  # keys sent to every task; beyond, a join


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose `key`, a long, `wanted` has: few keys go to the tasks that read the rows, many are joined."""
    few = wanted.select(key).distinct()
    if few.count() > KEYS_BROADCAST:
        return rows.join(few, key, "left_semi")
    keys = np.sort(few.toArrow().column(key).to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in tables(batches):
            own = batch.column(key).to_numpy()
            at = np.searchsorted(keys, own)
            yield batch.filter(pa.array(keys[np.minimum(at, len(keys) - 1)] == own if len(keys) else own != own))

    return rows.mapInArrow(keep, rows.schema)
