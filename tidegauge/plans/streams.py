"""Streaming queries: each runs over all data there is and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.plans.live import COUNTERS, counters
from tidegauge.plans.policy import clocks_sql
from tidegauge.plans.registry import HOURLY, LAG, POLICY, out_ts, query, r6, s6
from tidegauge.session import fresh_path
from tidegauge.sources.tables import read_table
from tidegauge.streaming import rates
from tidegauge.streaming.commits import close_windows, committed, finished, replay, start_commits
from tidegauge.streaming.io import read_files, run_to_table
from tidegauge.streaming.processors import live_forecast
from tidegauge.streaming.stateful import stream_forecast, stream_scaler
from tidegauge.streaming.windows import stream_ticks

DELAY = "10 minutes"
PIECES = 4  # micro-batches a table is replayed in


def samples(table):
    return table.select(
        F.col("event_type").alias("namespace"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def sample_stream(spark, folder):
    return samples(replay(read_table(spark, folder, "events"), "ts", PIECES, fresh_path(spark, "replay")))


def tick_table(spark, folder, step: str, aggregates):
    """Ticks of all events: what the stream closed, and at its end the windows it holds open."""
    path = fresh_path(spark, "ticks")
    ticks = stream_ticks(sample_stream(spark, folder), step, DELAY, ["namespace"], aggregates)
    # A key's ticks of one batch are in one file: whatever files a later stream takes at once, it meets them in order.
    query = finished(start_commits(ticks, path, f"{path}-checkpoint", shape=lambda batch: batch.repartition("namespace")))
    rows = samples(read_table(spark, folder, "events"))
    close_windows(query, rows, lambda part: stream_ticks(part, step, DELAY, ["namespace"], aggregates), path, "ts", step)
    return committed(spark, path, ticks.schema), path


def tick_stream(spark, table, path):
    """The committed ticks as a stream, several files a batch."""
    return read_files(spark, f"{path}/batch=*", table.schema, files_per_trigger=8)


@query("stream_resample", f"""SELECT event_type AS namespace, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01') AS ts,
  {s6("avg(value)")} AS y FROM events GROUP BY ALL""")
def stream_resample(spark, folder):
    table, _ = tick_table(spark, folder, "15 minutes", [F.avg("value").alias("y")])
    return table.select("namespace", out_ts("ts").alias("ts"), r6("y").alias("y"))


@query("stream_forecast")
def stream_forecast_query(spark, folder):
    """Hourly ticks from one stream feed a second one that keeps 500 points and forecasts the next step."""
    table, path = tick_table(spark, folder, "1 hour", [F.avg("value").alias("y")])
    ticks = tick_stream(spark, table, path)
    models = {"FFT": {"trend": "none"}, "SeasonalNaive": {}, "LastValue": {}}
    out = stream_forecast(ticks, models, 3600, LAG, ["namespace"], POLICY.max_history_points)
    return run_to_table(out, fresh_path(spark, "stream-forecast"))


_TICKS = """cyc AS (
  SELECT event_type AS namespace, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01') AS timestamp,
    0::BIGINT AS event_id, 'combined' AS scaling_mode, (max(event_id) % 10 + 1)::INTEGER AS current_replicas,
    ((max(event_id) % 16 + 1) * 512)::INTEGER AS current_memory_mb, avg(value) / 50.0::DOUBLE AS actual_cpu_cores,
    max(json_extract(props, '$.k')::INTEGER) / 20.0::DOUBLE AS predicted_cpu_cores, avg(value) / 16.0::DOUBLE AS actual_ram_gb,
    max(json_extract(props, '$.k')::INTEGER) / 6.0::DOUBLE AS predicted_ram_gb,
    bool_or(json_extract(props, '$.k')::INTEGER % 25 = 0) AS restarted
  FROM events GROUP BY ALL)"""


def tick_cycles(ticks):
    return ticks.select(
        "namespace", F.col("ts").alias("timestamp"), F.lit("combined").alias("scaling_mode"),
        (F.col("last_id") % 10 + 1).cast("int").alias("current_replicas"),
        ((F.col("last_id") % 16 + 1) * 512).cast("int").alias("current_memory_mb"),
        (F.col("mean") / 50.0).alias("actual_cpu_cores"), (F.col("k") / 20.0).alias("predicted_cpu_cores"),
        (F.col("mean") / 16.0).alias("actual_ram_gb"), (F.col("k") / 6.0).alias("predicted_ram_gb"), "restarted",
    )


TICK_AGGREGATES = lambda: [
    F.avg("value").alias("mean"), F.max("k").alias("k"), F.max("event_id").alias("last_id"),
    F.bool_or(F.col("k") % 25 == 0).alias("restarted"),
]


@query("stream_scaler", clocks_sql(_TICKS, "timestamp"))
def stream_scaler_query(spark, folder):
    """Cycles of 15 minutes from one stream feed the scaler, whose clocks live in its state."""
    table, path = tick_table(spark, folder, "15 minutes", TICK_AGGREGATES())
    cycles = tick_cycles(tick_stream(spark, table, path))
    out = stream_scaler(cycles, POLICY, ["namespace"], restarted="restarted")
    done = run_to_table(out, fresh_path(spark, "stream-scaler"))
    return done.select("namespace", out_ts("timestamp").alias("timestamp"), "desired_replicas", "desired_memory_mb",
                       "action_horizontal", "action_vertical", "pod_restart_count")


@query("stream_counter_rate", f"""WITH {COUNTERS}, w AS (
  SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL '1 hour', date_trunc('hour', ts), INTERVAL '1 hour')) AS ws
  FROM cnt),
d AS (
  SELECT *, CASE WHEN lag(value) OVER o IS NULL THEN 0 WHEN value >= lag(value) OVER o THEN value - lag(value) OVER o ELSE value END
    AS inc, count(*) OVER (PARTITION BY pod, ws) AS n
  FROM w WINDOW o AS (PARTITION BY pod, ws ORDER BY ts, event_id))
SELECT namespace, ws + INTERVAL '2 hours' AS ts, {s6("sum(inc) / 7200 * 3600")} AS per_hour FROM d
WHERE n > 1 GROUP BY namespace, ws""")
def stream_counter_rate_query(spark, folder):
    """Counters as a stream of files, rates over sliding windows, summed over the pods of a namespace."""
    source, order = ["namespace", "pod"], ["ts", "event_id"]
    rows = counters(spark, folder)
    stream = replay(rows, "ts", PIECES, fresh_path(spark, "counters"))
    path = fresh_path(spark, "partials")
    finished(rates.start_partials(stream, path, f"{path}-checkpoint", source, 3600, order))
    partials = committed(spark, path, rates.slide_partials(rows.limit(0), source, 3600, order).schema)
    table = rates.window_rates(rates.mended(partials, rows, source, 3600, order), source, 7200, 3600)
    return table.groupBy("namespace", "ts").agg(F.sum("rate").alias("rate")).select(
        "namespace", out_ts("ts").alias("ts"), r6(F.col("rate") * 3600).alias("per_hour")
    )


WARM = 240  # hours of history before the stream begins


@query("stream_warm_forecast", f"""WITH {HOURLY}, tk AS (
  SELECT series_id, b AS ts, y, count(*) OVER (PARTITION BY series_id ORDER BY b) AS n,
    datediff('hour', min(b) OVER (PARTITION BY series_id), b) AS step FROM obs)
SELECT a.series_id AS namespace, a.ts, {s6("a.y")} AS y, least(500, n)::INTEGER AS n_points,
  {s6("greatest(0, coalesce(s.y, a.y))")} AS y_hat
FROM tk a LEFT JOIN series s ON s.series_id = a.series_id AND s.step_idx = a.step + 1 - {LAG}
WHERE a.ts >= TIMESTAMP '2024-01-01' + INTERVAL '{WARM} hours'""")
def stream_warm_forecast(spark, folder):
    """Hourly ticks after a bootstrap: the history begins with the hours before the stream, which then crosses batches."""
    table, path = tick_table(spark, folder, "1 hour", [F.avg("value").alias("y")])
    begins = F.lit("2024-01-01").cast("timestamp") + F.expr(f"INTERVAL {WARM} hours")
    ticks = tick_stream(spark, table, path).where(F.col("ts") >= begins)
    out = live_forecast(ticks, {"SeasonalNaive": {"lag": str(LAG)}}, 3600, LAG, ["namespace"],
                        table.where(F.col("ts") < begins), POLICY.max_history_points)
    path = fresh_path(spark, "warm-forecast")
    finished(start_commits(out, path, f"{path}-checkpoint"))
    done = committed(spark, path, out.schema)
    return done.select("namespace", out_ts("ts").alias("ts"), r6("y").alias("y"), "n_points", r6("y_hat").alias("y_hat"))


@query("stream_event_route", f"""SELECT CASE WHEN event_id < 200 THEN 'warmup' ELSE 'evaluation' END AS phase,
  event_type AS namespace, count(*) AS n_rows, {s6("sum(value)")} AS total FROM events GROUP BY ALL""")
def stream_event_route(spark, folder):
    """Events appended as a stream into one partition per phase."""
    tagged = sample_stream(spark, folder).withColumn(
        "phase", F.when(F.col("event_id") < 200, "warmup").otherwise("evaluation")
    )
    path = fresh_path(spark, "routed")
    finished(start_commits(tagged, path, f"{path}-checkpoint", ("phase",)))
    table = committed(spark, path, tagged.schema)
    return table.groupBy("phase", "namespace").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("value")).alias("total"))
