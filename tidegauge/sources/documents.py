"""Run documents: one JSON file per run, scanned with its path, its age and whether it parses.

Nothing is dropped by the scan: a file that is empty or cut off is a row like any other, with its state and its text.
Callers take the good rows on and put the rest into the quarantine table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.operators.analysis import RUN_METADATA_SCHEMA, RUN_SUMMARY_SCHEMA, flatten_summaries

QUARANTINE = "path string, modified timestamp, state string, text string"


def scan_documents(spark: SparkSession, folder: str, glob: str, schema: str, only: str | None = None,
                   skip: str | None = None) -> DataFrame:
    """One row per file below the folder: `(path, modified, state, text, doc)`.

    `state` is ok, empty or corrupt; `doc` has the fields of `schema`, null unless ok; `text` is kept unless ok. `only`
    and `skip` are folder names: files are chosen by their path, before they are read.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    if only is not None:
        files = files.where(path.contains(f"/{only}/"))
    if skip is not None:
        files = files.where(~path.contains(f"/{skip}/"))
    fields = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = files.select(path.alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value", fields.alias("_j"))
    empty = ~F.coalesce("value", F.lit("")).rlike(r"\S")
    state = F.when(empty, "empty").when(F.col("_j").isNull() | F.col("_j._corrupt").isNotNull(), "corrupt").otherwise("ok")
    good = F.col("state") == "ok"
    return rows.withColumn("state", state).select(
        "path", "modified", "state", F.when(~good, F.col("value")).alias("text"),
        F.when(good, F.col("_j").dropFields("_corrupt")).alias("doc"),
    )


def folder_of(level: int, path: str = "path") -> Column:
    """Name of the folder that many levels above the file; 1 is the one it lies in."""
    name = F.element_at(F.split(path, "/"), -1 - level)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def rejects(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("state") != "ok").select("path", "modified", "state", "text")


def quarantine(bad: DataFrame, folder: str) -> DataFrame:
    """Adds rejects to the quarantine table and returns it; a file that is there in the same version is not added again."""
    spark = bad.sparkSession
    held = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held):
        bad = bad.join(spark.read.schema(QUARANTINE).parquet(folder), ["path", "modified"], "left_anti")
    bad.write.mode("append").parquet(folder)
    return spark.read.schema(QUARANTINE).parquet(folder)


def scan_run_summaries(spark: SparkSession, folder: str, glob: str = "summary.json") -> tuple[DataFrame, DataFrame]:
    """Flat rows of all run summaries, with the run's folder as `run_id`, and the rejects; analysis folders are skipped."""
    scanned = scan_documents(spark, folder, glob, RUN_SUMMARY_SCHEMA, skip="analysis")
    good = scanned.where("state = 'ok'").select(folder_of(2).alias("run_id"), "doc.*")
    return flatten_summaries(good), rejects(scanned)


def scan_run_metadata(spark: SparkSession, folder: str, run_ts: str | None = None,
                      glob: str = "metadata.json") -> tuple[DataFrame, DataFrame]:
    """Metadata of all runs, or of the pinned one alone, with `model` and `run_ts` from the path, and the rejects."""
    scanned = scan_documents(spark, folder, glob, RUN_METADATA_SCHEMA, only=run_ts)
    good = scanned.where("state = 'ok'").select(folder_of(2).alias("model"), folder_of(1).alias("run_ts"), "doc.*")
    return good, rejects(scanned)
