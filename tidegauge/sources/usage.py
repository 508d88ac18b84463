"""Usage files: monthly wide CSV of one app and metric, with one column per instance."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DATE_FORMAT = "M/d/yy H:mm"
FILE_NAME = r"([^/_]+)_application_([^_/]+)_([^_/]+)_([^_/]+?)(?:\.csv)?$"
FIXED = ("timestamp", "timestamp_date_format")


def parse_identity(df: DataFrame, path: str = "path", apps: Sequence[str] = ("A", "B", "C"),
                   metrics: Sequence[str] = ("CPU", "RAM")) -> tuple[DataFrame, DataFrame]:
    """Adds `provider, app, metric, kind` from a file name; returns `(known, rejected)` rows."""
    names = ["provider", "app", "metric", "kind"]
    parsed = df.select("*", *[F.regexp_extract(path, FILE_NAME, i + 1).alias(n) for i, n in enumerate(names)])
    known = F.col("app").isin(list(apps)) & F.col("metric").isin(list(metrics))
    return parsed.filter(known), parsed.filter(~known)


def parse_time(col) -> Column:
    return F.to_timestamp(col, DATE_FORMAT)


def _headers(spark: SparkSession, folder: str, glob: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header: the cells of the first line of every file, whatever it says.

    One pass over the text in which a task passes on the first line of each file that begins in it, so nothing but one
    line per file leaves the tasks. What reaches the driver is the list of files with their headers.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", "value")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            paths = batch.column("file_path").dictionary_encode()
            for code in dict.fromkeys(paths.indices.to_pylist()):
                path = paths.dictionary[code].as_py()
                if path != seen:
                    at = paths.indices.index(code).as_py()
                    if batch.column("file_block_start")[at].as_py() == 0:
                        yield batch.slice(at, 1).select(["file_path", "value"])
                seen = path

    out: dict[tuple[str, ...], list[str]] = {}
    for row in lines.mapInArrow(first, "file_path string, value string").toLocalIterator():
        cells = next(csv.reader([row["value"].lstrip("\ufeff")]), [])
        out.setdefault(tuple(c.strip() for c in cells), []).append(row["file_path"])
    return out


def scan_usage(spark: SparkSession, folder: str, instances: Sequence[str] | None = None,
               glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """All monthly CSV files below a folder: `(path, instance, ts, value)` and the lines `(path, line)` that do not fit.

    The columns after the first two of each file are its instances, so files are read header by header: one scan per
    different header, and rows are unpivoted where they are read, without a shuffle. A line with too few or too
    many cells, a cell that is no number or a date that does not parse is a reject. An empty cell is a missing value.
    """
    long = rejects = None
    for header, paths in sorted(_headers(spark, folder, glob).items()):
        names = [f"_{i}" for i in range(len(header))]
        kinds = [T.StringType(), T.TimestampType(), *[T.DoubleType()] * (len(header) - 2)]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)] + [T.StructField("_line", T.StringType())])
        # A pruned parser does not see how many cells a line has.
        options = {"header": "true", "columnNameOfCorruptRecord": "_line", "columnPruning": "false", "timestampFormat": DATE_FORMAT}
        rows = spark.read.schema(schema).options(**options).csv(paths)
        rows = rows.withColumn("path", F.col("_metadata.file_path"))
        ts = F.col("_1") if len(header) > 1 else F.lit(None).cast("timestamp")
        bad = F.col("_line").isNotNull() | ts.isNull()
        wanted = [(n, c) for n, c in zip(header[2:], names[2:]) if instances is None or n in instances]
        line = F.coalesce("_line", F.concat_ws(",", *names))
        bad_rows = rows.where(bad).select("path", line.alias("line"))
        rejects = bad_rows if rejects is None else rejects.unionByName(bad_rows)
        if wanted:
            cells = F.array(*[F.struct(F.lit(n).alias("instance"), F.col(c).alias("value")) for n, c in wanted])
            good = rows.where(~bad).select("path", ts.alias("ts"), F.explode(cells).alias("_c")).select(
                "path", "_c.instance", "ts", "_c.value")
            long = good if long is None else long.unionByName(good)
    empty = spark.createDataFrame([], "path string, instance string, ts timestamp, value double")
    return empty if long is None else long, empty.selectExpr("path", "path AS line") if rejects is None else rejects


def read_usage(spark: SparkSession, folder: str, instances: Sequence[str] | None = None) -> DataFrame:
    """The long form of all lines that fit their file's header."""
    return scan_usage(spark, folder, instances)[0]


def read_usage_wide(spark: SparkSession, folder: str, instances: Sequence[str]) -> DataFrame:
    """Files of one app and metric with known instances, columns pruned at the scan."""
    schema = T.StructType(
        [T.StructField(FIXED[0], T.LongType()), T.StructField(FIXED[1], T.StringType())]
        + [T.StructField(i, T.DoubleType()) for i in instances]
    )
    return (
        spark.read.option("header", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").schema(schema).csv(folder)
    )


def unify(parts: Sequence[DataFrame], ts: str = "timestamp_date_format") -> DataFrame:
    """Monthly tables one below the other with the date text parsed; a missing instance column is null."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.withColumn(ts, parse_time(F.col(ts)))


def unpivot_instances(wide: DataFrame, keep: Sequence[str], instances: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keep), list(instances), "instance", "value")


def write_usage_wide(df: DataFrame, folder: str, partition: Sequence[str]) -> None:
    """Wide monthly CSV below one folder per partition value."""
    df.write.mode("errorifexists").option("header", "true").partitionBy(*partition).csv(folder)
