"""Column functions over the telemetry stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import catalog, functions as fn
from tidegauge.operators import traces
from tidegauge.operators.series import regular_series, to_usage, total_usage as total
from tidegauge.plans.registry import (
    CAP, CYCLES, HOURLY, POLICY, TELE, cycles, events, grid_sql, hourly, out_ts, query, r6, s6, telemetry,
)


@query("cpu_cores", f"""WITH {TELE}, {CAP}
SELECT event_id, app, round_even(value * cores / 100.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS cores_used
FROM tele JOIN cap USING (app)""")
def cpu_cores(spark, folder):
    used = telemetry(spark, folder).join(catalog.capacity(spark).select("app", "cores"), "app")
    return used.select("event_id", "app", fn.cpu_cores("value", "cores").alias("cores_used"))


@query("ram_gb", f"""WITH {TELE}, {CAP}
SELECT event_id, app, {s6("CASE WHEN ram_already_gb THEN value ELSE value * 1000000 / 1073741824.0::DOUBLE END")} AS gb
FROM tele JOIN cap USING (app)""")
def ram_gb(spark, folder):
    rows = telemetry(spark, folder).join(catalog.capacity(spark).select("app", "ram_already_gb"), "app")
    raw = F.when(F.col("ram_already_gb"), F.col("value")).otherwise(F.col("value") * 1000000)
    return rows.select("event_id", "app", r6(fn.ram_gb(raw, "ram_already_gb")).alias("gb"))


@query("total_usage", f"""WITH {TELE}
SELECT app, date_trunc('hour', ts) AS ts,
  {s6("coalesce(sum(CASE WHEN k % 5 > 0 THEN value END), 0.0::DOUBLE)")} AS total_usage
FROM tele GROUP BY ALL""")
def total_usage(spark, folder):
    # Every fifth sample is missing (NaN); an hour with none left counts 0.
    rows = telemetry(spark, folder).select(
        "app", fn.floor_ts("ts", 3600).alias("ts"),
        F.when(F.col("k") % 5 > 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"),
    )
    return total(rows, ["app"]).select("app", out_ts("ts").alias("ts"), r6("y").alias("total_usage"))


@query("capacity_rescale", f"""WITH {TELE}, {CAP}
SELECT event_id, coalesce(cap.app, tele.app) AS app,
  {s6("value * (coalesce(total_cores, 5.0::DOUBLE) / 5.0::DOUBLE)")} AS real_cpu,
  {s6("value * (coalesce(total_ram_gb, 8.0::DOUBLE) / 8.0::DOUBLE)")} AS real_ram,
  {s6("value * (5.0::DOUBLE / coalesce(total_cores, 5.0::DOUBLE))")} AS vm_cpu
FROM tele LEFT JOIN cap ON cap.app = tele.app""")
def capacity_rescale(spark, folder):
    cap = catalog.capacity(spark).select("app", "total_cores", "total_ram_gb")
    vm_cpu, vm_ram = F.lit(POLICY.vm_cpu_cap), F.lit(POLICY.vm_ram_cap)
    real_cpu = F.coalesce(F.col("total_cores").cast("double"), vm_cpu)
    real_ram = F.coalesce(F.col("total_ram_gb").cast("double"), vm_ram)
    return telemetry(spark, folder).join(cap, "app", "left").select(
        "event_id", "app", r6(fn.rescale("value", real_cpu, vm_cpu)).alias("real_cpu"),
        r6(fn.rescale("value", real_ram, vm_ram)).alias("real_ram"),
        r6(fn.rescale("value", vm_cpu, real_cpu)).alias("vm_cpu"),
    )


@query("sanitize_pred", f"""WITH {TELE}
SELECT event_id, CASE WHEN k % 10 IN (0, 1, 2, 3) THEN 99999999.0::DOUBLE ELSE value END AS y_hat FROM tele""")
def sanitize_pred(spark, folder):
    bad = {0: "NaN", 1: "Infinity", 2: "-Infinity"}
    raw = F.when(F.col("k") % 10 == 3, F.lit(None).cast("double"))
    for digit, text in bad.items():
        raw = raw.when(F.col("k") % 10 == digit, F.lit(float(text.replace("Infinity", "inf"))))
    raw = raw.otherwise(F.col("value"))
    return telemetry(spark, folder).select("event_id", fn.sanitize_prediction(raw).alias("y_hat"))


@query("parse_memory", f"""WITH {TELE}, q AS (
  SELECT event_id, k, CASE k % 8 WHEN 0 THEN k || 'Mi' WHEN 1 THEN (k / 2.0::DOUBLE) || 'Gi' WHEN 2 THEN (k * 100) || 'Ki'
    WHEN 3 THEN k || 'M' WHEN 4 THEN (k / 4.0::DOUBLE) || 'G' WHEN 5 THEN (k::BIGINT * 70000)::VARCHAR WHEN 6 THEN ''
    ELSE 'x' || k END AS quantity
  FROM tele)
SELECT event_id, quantity, CASE k % 8 WHEN 0 THEN k WHEN 1 THEN k * 512 WHEN 2 THEN greatest(1, k * 100 // 1024)
  WHEN 3 THEN k WHEN 4 THEN k * 250 WHEN 5 THEN greatest(1, k::BIGINT * 70000 // 1048576) WHEN 6 THEN 0 END::BIGINT
  AS memory_mb
FROM q""")
def parse_memory(spark, folder):
    k = F.col("k")
    text = lambda c: c.cast("string")
    quantity = (
        F.when(k % 8 == 0, F.concat(text(k), F.lit("Mi"))).when(k % 8 == 1, F.concat(text(k / 2.0), F.lit("Gi")))
        .when(k % 8 == 2, F.concat(text(k * 100), F.lit("Ki"))).when(k % 8 == 3, F.concat(text(k), F.lit("M")))
        .when(k % 8 == 4, F.concat(text(k / 4.0), F.lit("G"))).when(k % 8 == 5, text(k.cast("bigint") * 70000))
        .when(k % 8 == 6, F.lit("")).otherwise(F.concat(F.lit("x"), text(k)))
    )
    rows = telemetry(spark, folder).select("event_id", quantity.alias("quantity"))
    return rows.select("*", fn.memory_mb("quantity").alias("memory_mb"))


@query("parse_duration", f"""WITH {TELE}
SELECT event_id, CASE k % 5 WHEN 0 THEN k * 86400 WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN k * 86400 END::BIGINT
  AS seconds FROM tele""")
def parse_duration(spark, folder):
    k = F.col("k")
    text = k.cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(text, F.lit("d"))).when(k % 5 == 1, F.concat(text, F.lit("s")))
        .when(k % 5 == 2, text).when(k % 5 == 3, F.concat(F.lit(" "), text, F.lit("D"))).otherwise(F.concat(text, F.lit("h")))
    )
    return telemetry(spark, folder).select("event_id", fn.duration_s(raw).alias("seconds"))


@query("series_slugs", f"""WITH {CYCLES}
SELECT event_id, dataset_slug, replace(dataset_slug, '-cpu', '-ram') AS other_slug,
  'usage_application_' || app || '_CPU_hist' AS dataset_name,
  CASE model_name WHEN 'ExponentialSmoothing' THEN 'expsm' WHEN 'Prophet' THEN 'prophet' ELSE 'fft' END AS model_slug,
  'ens-' || CASE model_name WHEN 'ExponentialSmoothing' THEN 'expsm' WHEN 'Prophet' THEN 'prophet' ELSE 'fft' END
    || '-custom' AS ensemble_slug,
  'Ensemble[' || model_name || '+Custom]' AS save_name,
  'run-' || CASE model_name WHEN 'ExponentialSmoothing' THEN 'expsm' WHEN 'Prophet' THEN 'prophet' ELSE 'fft' END || '-'
    || dataset_slug || CASE scaling_mode WHEN 'horizontal' THEN '-honly' WHEN 'vertical' THEN '-vonly' ELSE '-hv' END
    AS run_namespace
FROM cyc""")
def series_slugs(spark, folder):
    parts = F.array("model_name", F.lit("Custom"))
    ens = F.lit("Ensemble")
    return cycles(spark, folder).select(
        "event_id", fn.dataset_slug("app", F.lit("CPU")).alias("dataset_slug"),
        fn.other_slug("dataset_slug").alias("other_slug"),
        fn.dataset_name("dataset_slug", "usage", "hist").alias("dataset_name"),
        fn.model_slug("model_name").alias("model_slug"), fn.model_slug(ens, parts).alias("ensemble_slug"),
        fn.save_name(ens, parts).alias("save_name"),
        fn.namespace_name("run", fn.model_slug("model_name"), "dataset_slug", "scaling_mode").alias("run_namespace"),
    )


@query("canonical_ensemble_key", f"""WITH {CYCLES}, n AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Ensemble[' || model_name || '+' || namespace || ']'
    WHEN event_id % 3 = 0 THEN model_name ELSE 'Ensemble[' || namespace || '+' || model_name || ']' END AS name, model_name,
    namespace FROM cyc)
SELECT CASE WHEN name LIKE 'Ensemble%' THEN least(model_name, namespace) || '+' || greatest(model_name, namespace)
  ELSE model_name END AS model_key, count(*) AS n_runs, count(DISTINCT name) AS n_names FROM n GROUP BY 1""")
def canonical_ensemble_key(spark, folder):
    ab = F.format_string("Ensemble[%s+%s]", "model_name", "namespace")
    ba = F.format_string("Ensemble[%s+%s]", "namespace", "model_name")
    name = F.when(F.col("event_id") % 2 == 0, ab).when(F.col("event_id") % 3 == 0, F.col("model_name")).otherwise(ba)
    runs = cycles(spark, folder).select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(fn.canonical_key("name").alias("model_key")).agg(
        F.sum("n").alias("n_runs"), F.count("name").alias("n_names")
    )


@query("json_metric", f"""SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k_value,
  coalesce(json_extract(props, '$.absent')::DOUBLE, json_extract(props, '$.k')::DOUBLE) AS fallback_value,
  -1.0::DOUBLE AS default_value FROM events""")
def json_metric(spark, folder):
    return events(spark, folder).select(
        "event_id", fn.json_number("props", "$.k").alias("k_value"),
        fn.json_number("props", "$.absent", "$.k").alias("fallback_value"),
        fn.json_number("props", "$.absent", default=-1.0).alias("default_value"),
    )


@query("degradation", f"""WITH {TELE}
SELECT event_id, {s6("CASE WHEN k > 0 THEN (value - k) / k * 100 END")} AS mae_degradation_pct,
  {s6("CASE WHEN k > 0 THEN (k - value) / k * 100 END")} AS r2_degradation_pct FROM tele""")
def degradation(spark, folder):
    return telemetry(spark, folder).withColumn("k", F.col("k").cast("double")).select(
        "event_id", r6(fn.worse_by_percent("k", "value")).alias("mae_degradation_pct"),
        r6(fn.lost_percent("k", "value")).alias("r2_degradation_pct"),
    )


@query("ts_floor", """SELECT event_id, time_bucket(INTERVAL '15 seconds', ts, TIMESTAMP '2024-01-01') AS tick,
  time_bucket(INTERVAL '15 seconds', ts, TIMESTAMP '2024-01-01') + INTERVAL '15 seconds' AS next_tick FROM events""")
def ts_floor(spark, folder):
    tick = fn.floor_ts("ts", 15)
    return events(spark, folder).select("event_id", out_ts(tick).alias("tick"), out_ts(fn.next_ts(tick, 15)).alias("next_tick"))


@query("phase_tag", f"""WITH {HOURLY}
SELECT series_id, step_idx, CASE WHEN step_idx < 168 THEN 'warmup' ELSE 'evaluation' END AS phase FROM series""")
def phase_tag(spark, folder):
    return hourly(spark, folder).select("series_id", "step_idx", fn.phase_tag("step_idx", 168).alias("phase"))


_APP_CPU = f"""{TELE}, {CAP}, tot AS (
  SELECT app AS series_id, ts,
    sum(round_even(value * cores / 100.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS y
  FROM tele JOIN cap USING (app) GROUP BY ALL),
obs AS (
  SELECT series_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS b, avg(y) AS y FROM tot GROUP BY ALL),
{grid_sql("obs", "1 hour", "filled")},
series AS (SELECT * REPLACE ({s6("y")} AS y) FROM filled)"""

_APP_RAM = f"""{TELE}, {CAP}, tot AS (
  SELECT app AS series_id, ts, sum(CASE WHEN ram_already_gb THEN value ELSE value * 1e9 / 1073741824.0::DOUBLE END) AS y
  FROM tele JOIN cap USING (app) GROUP BY ALL),
obs AS (
  SELECT series_id, time_bucket(INTERVAL '40 minutes', ts, TIMESTAMP '2024-01-01') AS b, avg(y) AS y FROM tot
  GROUP BY ALL),
{grid_sql("obs", "40 minutes", "filled")},
series AS (SELECT * REPLACE ({s6("y")} AS y) FROM filled)"""


@query("trace_cpu", f"""WITH {_APP_CPU}
SELECT series_id AS app, step_idx AS index, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  greatest(1, round_even(y / total_cores * 297, 0))::INTEGER AS rps,
  round_even(y * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS cpu_actual_cores,
  CASE WHEN step_idx < 168 THEN 'warmup' ELSE 'evaluation' END AS phase
FROM series JOIN cap ON cap.app = series.series_id""")
def trace_cpu(spark, folder):
    cores = catalog.lookup(F.col("app"), 1) * catalog.lookup(F.col("app"), 0)
    return traces.cpu_trace(_cpu_series(spark, folder), cores, 297, 168)


def _cpu_series(spark, folder):
    raw = telemetry(spark, folder).select("app", F.lit("CPU").alias("metric"), "instance", "ts", "value")
    # Sums differ in the last bit between engines; six digits keep a tie at four digits the same tie.
    used = to_usage(raw, catalog.capacity(spark))
    return regular_series(total(used, ["app"]), 3600, keys=["app"]).withColumn("y", r6("y"))


def _ram_series(spark, folder):
    size = F.when(F.col("app") == "B", F.col("value")).otherwise(F.col("value") * 1e9)
    raw = telemetry(spark, folder).select("app", F.lit("RAM").alias("metric"), "instance", "ts", size.alias("value"))
    used = to_usage(raw, catalog.capacity(spark))
    return regular_series(total(used, ["app"]), 2400, keys=["app"]).withColumn("y", r6("y"))


@query("trace_ram", f"""WITH {_APP_RAM}
SELECT series_id AS app, step_idx AS index, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  (round_even(greatest(1024, least(round_even(y / total_ram_gb * 8192, 0), 8192)) / 64::DOUBLE, 0) * 64)::INTEGER
    AS memory_mb,
  round_even(y * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS ram_actual_gb,
  CASE WHEN step_idx < 252 THEN 'warmup' ELSE 'evaluation' END AS phase
FROM series JOIN cap ON cap.app = series.series_id""")
def trace_ram(spark, folder):
    gb = catalog.lookup(F.col("app"), 2) * catalog.lookup(F.col("app"), 0)
    return traces.ram_trace(_ram_series(spark, folder), gb, 1024, 8192, 64, 252)


@query("trace_peak", f"""WITH {_APP_CPU}
SELECT series_id AS app, max(greatest(1, round_even(y / total_cores * 297, 0))::INTEGER) AS peak_rps
FROM series JOIN cap ON cap.app = series.series_id GROUP BY 1""")
def trace_peak(spark, folder):
    cores = catalog.lookup(F.col("app"), 1) * catalog.lookup(F.col("app"), 0)
    return traces.trace_peak(traces.cpu_trace(_cpu_series(spark, folder), cores, 297, 168))


@query("seasonal_lags", """WITH t AS (SELECT event_id, [3600, 2400, 900, 60, 43200][user_id % 5 + 1] AS step_s FROM events)
SELECT event_id, step_s::BIGINT AS step_s, CASE step_s WHEN 3600 THEN 24 WHEN 2400 THEN 36 ELSE 1 END::INTEGER AS known_lag,
  CASE step_s WHEN 3600 THEN 24 WHEN 2400 THEN 36 ELSE 86400 // step_s END::INTEGER AS day_lag FROM t""")
def seasonal_lags(spark, folder):
    """Steps per day of a grid: of the two known ones, and of any."""
    steps = F.array(*[F.lit(s).cast("bigint") for s in (3600, 2400, 900, 60, 43200)])
    rows = events(spark, folder).select("event_id", F.element_at(steps, (F.col("user_id") % 5 + 1).cast("int")).alias("step_s"))
    return rows.select("event_id", "step_s", fn.seasonal_lag("step_s").alias("known_lag"), fn.seasonal_lag("step_s", True).alias("day_lag"))


@query("clamped_prediction", f"SELECT event_id, {s6('greatest(0, value - 100)')} AS y_hat FROM events")
def clamped_prediction(spark, folder):
    """Predictions below zero become zero."""
    return events(spark, folder).select("event_id", r6(fn.non_negative(F.col("value") - 100)).alias("y_hat"))
