"""Sinks and sources of the stages: splits, trials, forecasts, events, traces, runs, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators.analysis import (
    RUN_METADATA_SCHEMA, RUN_SUMMARY_SCHEMA, flatten_summaries, parse_json,
)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


class MissingStage(FileNotFoundError):
    """A stage was asked for data another stage has not written."""


def require(spark: SparkSession, path: str, stage: str) -> str:
    """The path, or an error that names the stage to run first."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise MissingStage(f"{path} does not exist: run the {stage} stage first")
    return path


def write_splits(split_df: DataFrame, meta: DataFrame, folder: str) -> None:
    """Splits partitioned by split, so a later read of one split prunes the others."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/splits")
    meta.write.mode("overwrite").json(f"{folder}/splits_meta")


def read_splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    splits = spark.read.parquet(require(spark, f"{folder}/splits", "data"))
    meta = spark.read.json(require(spark, f"{folder}/splits_meta", "data"))
    return splits, meta


def write_trials(trials: DataFrame, folder: str) -> None:
    trials.write.mode("overwrite").json(f"{folder}/trials")


def read_trials(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(require(spark, f"{folder}/trials", "tuning"))


def write_forecasts(forecasts: DataFrame, folder: str) -> None:
    forecasts.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/forecasts")


def read_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(require(spark, f"{folder}/forecasts", "results"))


TIMINGS_SCHEMA = "model string, FIT_TIME_TOTAL double, PREDICT_TIME_TOTAL double, FIT_TIME_AVG double, PREDICT_TIME_AVG double"


def write_timings(timings: DataFrame, folder: str) -> None:
    """Seconds of the results stage, one row per series and model."""
    timings.write.mode("overwrite").json(f"{folder}/timings")


def read_timings(spark: SparkSession, folder: str, keys: str = "series_id string") -> DataFrame:
    return spark.read.schema(f"{keys}, {TIMINGS_SCHEMA}").json(require(spark, f"{folder}/timings", "results"))


def write_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    """Warm-up and evaluation rows land in partitions of their own; evaluation reads never touch warm-up."""
    events.write.mode(mode).partitionBy("phase").parquet(f"{folder}/events")


def read_events(spark: SparkSession, folder: str, phase: str | None = "evaluation") -> DataFrame:
    df = spark.read.parquet(require(spark, f"{folder}/events", "scaling"))
    return df if phase is None else df.filter(F.col("phase") == phase)


def write_trace(trace: DataFrame, folder: str, keys: Sequence[str] = ("app",)) -> None:
    """Ordered JSON lines; ordering is by range over (key, index), not in one task."""
    trace.orderBy(*keys, "index").write.mode("overwrite").json(folder)


def write_summary_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(folder)


def _read_json_files(spark: SparkSession, folder: str, name: str, schema: str, skip: str | None) -> DataFrame:
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
        .text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    )
    if skip:
        files = files.filter(~F.col("path").rlike(f"/{skip}/"))
    return parse_json(files, "json", schema)


def read_run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All `summary.json` below a folder, flat; analysis folders and unreadable files are skipped."""
    runs = _read_json_files(spark, folder, "summary.json", RUN_SUMMARY_SCHEMA, "analysis")
    parent = F.element_at(F.split("path", "/"), -3)
    return flatten_summaries(runs.withColumn("run_id", parent))


def read_run_metadata(spark: SparkSession, folder: str, run_ts: str | None = None) -> DataFrame:
    """All `metadata.json` below a folder with dataset, model folder and run timestamp from the path."""
    runs = _read_json_files(spark, folder, "metadata.json", RUN_METADATA_SCHEMA, None)
    parts = F.split("path", "/")
    runs = runs.withColumn("run_ts", F.element_at(parts, -2)).withColumn(
        "model", F.url_decode(F.replace(F.element_at(parts, -3), F.lit("+"), F.lit("%2B")))
    )
    return runs if run_ts is None else runs.filter(F.col("run_ts").contains(run_ts))


def read_batch_state(spark: SparkSession, path: str) -> DataFrame:
    """A batch-state document as `(namespace, state)` rows."""
    schema = "version int, completed array<string>, failed array<string>, pending array<string>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    states = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("names")) for s in ("completed", "failed", "pending")])
    return doc.select(F.explode(states).alias("_s")).select(F.explode("_s.names").alias("namespace"), "_s.state")
