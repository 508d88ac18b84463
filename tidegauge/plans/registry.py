"""Query registry, stand-in tables and the SQL that mirrors them.

The test tables have no telemetry, so `events` stands in: an event type is a series (and a namespace),
a user is a pod, `value` is a usage sample, and the JSON in `props` feeds what else a row needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.catalog import Policy
from tidegauge.operators.series import chrono_split, regular_series
from tidegauge.session import prepare
from tidegauge.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3600
LAG = 24

# Cooldowns are longer than the defaults because events of one type are minutes apart.
POLICY = Policy(up_cooldown_s=3600, down_cooldown_s=3 * 3600, vertical_cooldown_s=2 * 3600, startup_grace_s=7200,
                min_memory_mb=512, max_memory_mb=8192, memory_step_mb=256)


def query(name: str, sql: str | None = None):
    """Registers `fn(spark, folder)`; the session is pinned to UTC before the plan is built."""

    def wrap(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def r6(col) -> Column:
    """Six digits for comparisons, by the same IEEE steps on both sides."""
    c = F.col(col) if isinstance(col, str) else col
    return F.rint(c * 1e6) / 1e6


def s6(expr: str) -> str:
    return f"(round_even(({expr}) * 1e6::DOUBLE, 0) / 1e6::DOUBLE)"


def out_ts(col) -> Column:
    """Timestamps leave queries without zone, like the tables they came from."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def events(spark: SparkSession, folder: str, after: str | None = None, until: str | None = None) -> DataFrame:
    """Events with a zoned timestamp; a time range is a filter on the stored column, so the scan prunes by it."""
    table = read_table(spark, folder, "events")
    if after:
        table = table.filter(F.col("ts") > F.lit(after).cast("timestamp_ntz"))
    if until:
        table = table.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


def app_of(user: str = "user_id") -> Column:
    return F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col(user) % 3 + 1).cast("int"))


def k_of() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """`(event_id, ts, series_id, app, instance, k, value)`."""
    return events(spark, folder).select(
        "event_id", "ts", "user_id", F.col("event_type").alias("series_id"), app_of().alias("app"),
        F.concat(app_of(), (F.col("user_id") % 8 + 1).cast("string")).alias("instance"), k_of().alias("k"), "value",
    )


TELE = """tele AS (
  SELECT event_id, ts, user_id, event_type AS series_id,
    CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS app,
    (CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END) || (user_id % 8 + 1)::VARCHAR AS instance,
    json_extract(props, '$.k')::INTEGER AS k, value
  FROM events)"""

CAP = """cap(app, instances, cores, ram_gb, ram_already_gb, total_cores, total_ram_gb) AS (
  VALUES ('A', 12, 4, 32, false, 48, 384), ('B', 8, 4, 128, true, 32, 1024), ('C', 2, 2, 4, false, 4, 8))"""


def hourly(spark: SparkSession, folder: str, direction: str = "forward") -> DataFrame:
    raw = events(spark, folder).select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"))
    return regular_series(raw, HOUR, direction)


def hourly_split(spark: SparkSession, folder: str) -> DataFrame:
    return chrono_split(hourly(spark, folder))


def grid_sql(obs: str, step: str, name: str = "series") -> str:
    """CTEs that turn observed buckets `obs(series_id, b, y)` into the complete grid."""
    return f"""nx AS (
  SELECT *, lead(b) OVER w AS nb, lead(y) OVER w AS ny FROM {obs} WINDOW w AS (PARTITION BY series_id ORDER BY b)),
ex AS (
  SELECT *, unnest(generate_series(b, coalesce(nb - INTERVAL '{step}', b), INTERVAL '{step}')) AS ts FROM nx),
{name} AS (
  SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS step_idx,
    count(*) OVER (PARTITION BY series_id) AS n_steps,
    CASE WHEN nb IS NULL OR ts = b THEN y
      ELSE y + (ny - y) * ((epoch_us(ts) - epoch_us(b)) / (epoch_us(nb) - epoch_us(b))::DOUBLE) END AS y
  FROM ex)"""


HOURLY = """obs AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS b, avg(value) AS y
  FROM events GROUP BY ALL),
""" + grid_sql("obs", "1 hour")

SPLIT = HOURLY + """,
sized AS (
  SELECT *, floor(n_steps * 0.70::DOUBLE)::BIGINT AS n_train, floor(n_steps * 0.15::DOUBLE)::BIGINT AS n_val
  FROM series),
split AS (
  SELECT *, CASE WHEN step_idx < n_train THEN 'train' WHEN step_idx < n_train + n_val THEN 'val' ELSE 'test' END
    AS split
  FROM sized)"""


def cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded scaling cycles: one per event, all columns from the row itself."""
    k = F.col("k")
    modes = F.array(F.lit("horizontal"), F.lit("vertical"), F.lit("combined"))
    models = F.array(F.lit("ExponentialSmoothing"), F.lit("Prophet"), F.lit("FFT"))
    return telemetry(spark, folder).select(
        F.col("event_id"), F.col("ts").alias("timestamp"), F.col("series_id").alias("namespace"), "user_id", "app",
        F.element_at(models, (k % 3 + 1)).alias("model_name"),
        F.concat(F.lower("app"), F.lit("-cpu")).alias("dataset_slug"),
        F.element_at(modes, (F.col("user_id") % 3 + 1).cast("int")).alias("scaling_mode"),
        (k % 10 + 1).cast("int").alias("current_replicas"),
        ((k % 16 + 1) * 512).cast("int").alias("current_memory_mb"),
        (F.col("value") / 50.0).alias("actual_cpu_cores"), (k / 20.0).alias("predicted_cpu_cores"),
        (F.col("value") / 16.0).alias("actual_ram_gb"), (k / 6.0).alias("predicted_ram_gb"),
        F.when(F.col("event_id") < 200, "warmup").otherwise("evaluation").alias("phase"),
        (F.col("k") % 25 == 0).alias("restarted"),
        F.when(k % 4 > 0, k / 100.0).otherwise(0.0).alias("fit_time_cpu_seconds"),
        (k / 1000.0).alias("predict_time_cpu_seconds"), (k / 200.0).alias("fit_time_ram_seconds"),
        F.lit(0.0).alias("predict_time_ram_seconds"), (k / 7).cast("int").alias("refit_skipped"),
    )


CYCLES = TELE + """,
cyc AS (
  SELECT event_id, ts AS timestamp, series_id AS namespace, user_id, app,
    CASE k % 3 WHEN 0 THEN 'ExponentialSmoothing' WHEN 1 THEN 'Prophet' ELSE 'FFT' END AS model_name,
    lower(app) || '-cpu' AS dataset_slug,
    CASE user_id % 3 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' ELSE 'combined' END AS scaling_mode,
    (k % 10 + 1)::INTEGER AS current_replicas, ((k % 16 + 1) * 512)::INTEGER AS current_memory_mb,
    value / 50.0::DOUBLE AS actual_cpu_cores, k / 20.0::DOUBLE AS predicted_cpu_cores,
    value / 16.0::DOUBLE AS actual_ram_gb, k / 6.0::DOUBLE AS predicted_ram_gb,
    CASE WHEN event_id < 200 THEN 'warmup' ELSE 'evaluation' END AS phase, k % 25 = 0 AS restarted,
    CASE WHEN k % 4 > 0 THEN k / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS fit_time_cpu_seconds,
    k / 1000.0::DOUBLE AS predict_time_cpu_seconds, k / 200.0::DOUBLE AS fit_time_ram_seconds,
    0.0::DOUBLE AS predict_time_ram_seconds, trunc(k / 7.0::DOUBLE)::INTEGER AS refit_skipped
  FROM tele)"""

# Policy columns in SQL, with the literals of POLICY.
WANT = CYCLES + """,
want AS (
  SELECT *,
    actual_cpu_cores / greatest(current_replicas, 1) > 0.45::DOUBLE AS sla_cpu_violation,
    actual_ram_gb * 1024 / greatest(current_replicas, 1) > 0.9::DOUBLE * 8192 AS sla_ram_violation,
    greatest(1, least(10, ceil(predicted_cpu_cores / 0.5::DOUBLE)))::INTEGER AS want_replicas,
    greatest(512, least(floor(8192 / greatest(current_replicas, 1)::DOUBLE),
      ceil(ceil(predicted_ram_gb * 1024 / greatest(current_replicas, 1)) / 256::DOUBLE) * 256))::INTEGER
      AS want_memory_mb
  FROM cyc)"""
