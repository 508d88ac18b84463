"""Stream sources and sinks on files; a Kafka source only needs another reader in front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
               files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; `files_per_trigger` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return read_files(spark, folder, schema, f"{name}.parquet")


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON samples from Kafka; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("_v")).select("_v.*")


def start_table(df: DataFrame, path: str, checkpoint: str, partition: tuple[str, ...] = (),
                available_now: bool = True, interval: str = "15 seconds") -> StreamingQuery:
    """Appends to a Parquet table. The file sink commits each batch once, so a restart repeats no row."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    if partition:
        writer = writer.partitionBy(*partition)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_to_table(df: DataFrame, path: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all data there is and returns the table it wrote."""
    query = start_table(df, path, f"{path}-checkpoint", partition)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over all recorded progress."""
    total = 0
    for progress in query.recentProgress:
        operators = progress["stateOperators"] if isinstance(progress, dict) else progress.stateOperators
        for op in operators:
            total += op["numRowsDroppedByWatermark"] if isinstance(op, dict) else op.numRowsDroppedByWatermark
    return total
