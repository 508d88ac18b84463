"""Scans and sinks: usage files, splits, trials, forecasts, events, traces, run documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import floor_ts
from tidegauge.operators import analysis, metrics, series as ops, traces
from tidegauge.operators.models import snaive_forecast
from tidegauge.plans.accuracy import SNAIVE
from tidegauge.plans.forecasts import SES, ses_trials
from tidegauge.plans.policy import EVAL, evaluated
from tidegauge.plans.registry import (
    CYCLES, HOUR, HOURLY, LAG, POLICY, SPLIT, TELE, cycles, events, hourly, hourly_split, out_ts, query, r6, s6, telemetry,
)
from tidegauge.session import fresh_path
from tidegauge.sources import documents, tables, usage

INSTANCES = {a: [f"{a}{i}" for i in range(1, 9)] for a in "ABC"}
CUT = "2024-01-16"


def minute_usage(spark, folder):
    return telemetry(spark, folder).groupBy("app", "instance", floor_ts("ts", 60).alias("ts")).agg(
        F.avg("value").alias("value")
    )


def wide_usage(spark, folder, app: str):
    """Wide table of one app as the usage files hold it: epoch ms, date text, one column per instance."""
    rows = minute_usage(spark, folder).filter(F.col("app") == app)
    wide = rows.groupBy("ts").pivot("instance", INSTANCES[app]).agg(F.first("value"))
    return wide.select(
        (F.unix_seconds("ts") * 1000).alias("timestamp"),
        F.date_format("ts", usage.DATE_FORMAT).alias("timestamp_date_format"), *INSTANCES[app],
    )


MINUTE = TELE + """,
mu AS (SELECT app, instance, date_trunc('minute', ts) AS ts, avg(value) AS value FROM tele GROUP BY ALL)"""


@query("usage_scan", f"WITH {MINUTE} SELECT app, instance, ts, {s6('value')} AS value FROM mu")
def usage_scan(spark, folder):
    """Usage files of all apps written wide and scanned back in long form."""
    out = fresh_path(spark, "usage")
    for app in INSTANCES:
        wide_usage(spark, folder, app).write.option("header", "true").csv(f"{out}/application_{app}/CPU")
    long = usage.read_usage(spark, out).filter(F.col("value").isNotNull())
    app = F.regexp_extract("path", "application_([A-Z])/", 1)
    return long.select(app.alias("app"), "instance", out_ts("ts").alias("ts"), r6("value").alias("value"))


SHORT = "minute(ts) % 7 = 0"


@query("usage_files", f"""WITH {MINUTE}
SELECT app, instance, ts, {s6('value')} AS value, NULL::VARCHAR AS line FROM mu WHERE NOT {SHORT}
UNION ALL SELECT DISTINCT app, NULL, NULL, NULL, epoch_ms(ts) || ',' || strftime(ts, '%-m/%-d/%y %-H:%M') FROM mu WHERE {SHORT}""")
def usage_files(spark, folder):
    """Daily files with quoted headers in capitals and lines that break off: what fits, and the lines that do not."""
    out = fresh_path(spark, "usage-files")
    for app, names in INSTANCES.items():
        wide = wide_usage(spark, folder, app)
        ts = F.timestamp_millis("timestamp")
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wide.columns]
        line = F.when(F.minute(ts) % 7 == 0, F.concat_ws(",", *cells[:2])).otherwise(F.concat_ws(",", *cells))
        rows = wide.select(F.to_date(ts).alias("day"), F.lit(1).alias("o"), line.alias("value"))
        header = ",".join(f'"{c}"' for c in ("TIMESTAMP", "Date, local", *names))
        heads = rows.select("day").distinct().select("day", F.lit(0).alias("o"), F.lit(header).alias("value"))
        rows.unionByName(heads).repartition("day").sortWithinPartitions("day", "o").select("day", "value").write.partitionBy(
            "day").text(f"{out}/application_{app}")
    long, rejects = usage.scan_usage(spark, out, glob="*.txt")
    app = F.regexp_extract("path", "application_([A-Z])/", 1).alias("app")
    good = long.where(F.col("value").isNotNull()).select(
        app, "instance", out_ts("ts").alias("ts"), r6("value").alias("value"), F.lit(None).cast("string").alias("line"))
    return good.unionByName(rejects.select(app, "line"), allowMissingColumns=True)


@query("usage_union", f"""WITH {MINUTE}
SELECT app, instance, ts, {s6("value")} AS value FROM mu""")
def usage_union(spark, folder):
    """Monthly tables of every app one below the other; the second one lacks no row and repeats none."""
    cut, out = F.unix_millis(F.lit(CUT).cast("timestamp")), None
    for app, names in INSTANCES.items():
        wide = wide_usage(spark, folder, app)
        united = usage.unify([wide.filter(F.col("timestamp") < cut), wide.filter(F.col("timestamp") >= cut)])
        long = usage.unpivot_instances(united, ["timestamp_date_format"], names).filter(F.col("value").isNotNull()).select(
            F.lit(app).alias("app"), "instance", out_ts("timestamp_date_format").alias("ts"), r6("value").alias("value"))
        out = long if out is None else out.unionByName(long)
    return out


_FILE = """CASE WHEN k % 9 = 0 THEN 'usage_application_Z_CPU_hist.csv' WHEN k % 9 = 1 THEN 'notes.csv'
  ELSE 'usage_application_' || app || '_' || CASE WHEN k % 2 = 0 THEN 'CPU' ELSE 'RAM' END || '_' || series_id || '.csv' END"""


@query("series_identity", f"""WITH {TELE}
SELECT CASE WHEN k % 9 > 1 THEN app ELSE 'rejected' END AS app,
  CASE WHEN k % 9 > 1 THEN CASE WHEN k % 2 = 0 THEN 'CPU' ELSE 'RAM' END END AS metric,
  CASE WHEN k % 9 > 1 THEN series_id END AS kind, count(*) AS n FROM tele GROUP BY ALL""")
def series_identity(spark, folder):
    k = F.col("k")
    good = F.concat(F.lit("/data/usage_application_"), F.col("app"), F.lit("_"), F.when(k % 2 == 0, "CPU").otherwise("RAM"),
                    F.lit("_"), F.col("series_id"), F.lit(".csv"))
    path = F.when(k % 9 == 0, "/data/usage_application_Z_CPU_hist.csv").when(k % 9 == 1, "/data/notes.csv").otherwise(good)
    known, rejected = usage.parse_identity(telemetry(spark, folder).select(path.alias("path")))
    none = F.lit(None).cast("string")
    both = known.select("app", "metric", "kind").unionByName(
        rejected.select(F.lit("rejected").alias("app"), none.alias("metric"), none.alias("kind"))
    )
    return both.groupBy("app", "metric", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("split_table", f"""WITH {SPLIT}
SELECT series_id, split, count(*) AS n_rows, {s6("avg(y)")} AS mean_y FROM split GROUP BY ALL""")
def split_table(spark, folder):
    """Splits written once, partitioned by split, and read back."""
    out = fresh_path(spark, "splits")
    split = hourly_split(spark, folder)
    tables.write_splits(split, ops.split_meta(split), out)
    splits, _ = tables.read_splits(spark, out)
    return splits.groupBy("series_id", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("y")).alias("mean_y")
    )


@query("tuning_trials", f"""WITH {SES}
SELECT series_id, trial, alpha, 'COMPLETE' AS state, {s6("rmse")} AS rmse FROM tr""")
def tuning_trials(spark, folder):
    """The trial table of a search over the smoothing weight, written and read back."""
    out = fresh_path(spark, "trials")
    params = F.create_map(F.lit("alpha"), F.col("alpha").cast("string"))
    trials = ses_trials(hourly_split(spark, folder)).select(
        "series_id", F.lit("SES").alias("model"), "trial", params.alias("params"), "rmse", F.lit("COMPLETE").alias("state")
    )
    tables.write_trials(trials, out)
    back = tables.read_trials(
        spark, out, "series_id string, model string, trial int, params map<string,string>, rmse double, state string"
    )
    return back.select("series_id", "trial", F.col("params")["alpha"].cast("double").alias("alpha"), "state",
                       r6("rmse").alias("rmse"))


@query("forecast_table", f"""WITH {SNAIVE}
SELECT series_id, model, split, step_idx, {s6("y_hat")} AS y_hat FROM fc""")
def forecast_table(spark, folder):
    out = fresh_path(spark, "forecasts")
    tables.write_forecasts(snaive_forecast(hourly_split(spark, folder), LAG), out)
    return tables.read_forecasts(spark, out).select("series_id", "model", "split", "step_idx", r6("y_hat").alias("y_hat"))


@query("event_route", f"""WITH {CYCLES}
SELECT phase, namespace, count(*) AS n_rows, {s6("sum(actual_cpu_cores)")} AS cores FROM cyc GROUP BY ALL""")
def event_route(spark, folder):
    """Events routed by phase into partitions, then read back phase by phase."""
    out = fresh_path(spark, "events")
    tables.write_events(cycles(spark, folder), out)
    agg = lambda df: df.groupBy("phase", "namespace").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.sum("actual_cpu_cores")).alias("cores")
    )
    evaluation = agg(tables.read_events(spark, out, "evaluation"))
    return evaluation.unionByName(agg(tables.read_events(spark, out, "warmup")))


@query("trace_table", f"""WITH {HOURLY}
SELECT series_id AS app, step_idx AS index, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  greatest(1, round_even({s6("y")} / 400::DOUBLE * 297, 0))::INTEGER AS rps FROM series""")
def trace_table(spark, folder):
    """Ordered JSON traces, one per series, read back."""
    out = fresh_path(spark, "trace")
    base = hourly(spark, folder).withColumn("y", r6("y")).withColumnRenamed("series_id", "app")
    tables.write_trace(traces.cpu_trace(base, F.lit(400.0), 297, 168), out)
    return spark.read.schema("app string, index bigint, timestamp string, rps int").json(out)


def summary_documents(spark, folder):
    """One JSON run summary per namespace and model; documents of one model are cut off and do not parse."""
    keys = ["namespace", "model_name"]
    flat = metrics.ops_summary(evaluated(spark, folder), POLICY, keys, tie=["event_id"])
    nested = metrics.ops_summary_nested(flat, keys)
    text = F.to_json(F.struct(*nested.columns))
    broken = F.col("model_name") == "FFT"
    text = F.when(broken, F.substring(text, 1, 40)).otherwise(text)
    return nested.select(F.col("namespace").alias("run_id"), text.alias("json"))


@query("run_summary_flatten", f"""WITH {EVAL}, f AS (
  SELECT namespace AS run_id, model_name, count(*) FILTER (sla_cpu_violation) / count(*) AS rate,
    avg(abs(predicted_cpu_cores - actual_cpu_cores)) AS mae, avg(abs(predicted_ram_gb - actual_ram_gb)) AS mae_ram,
    round_even(avg(current_replicas) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_replicas
  FROM ev WHERE model_name <> 'FFT' GROUP BY ALL)
SELECT run_id, model_name, {s6("mae")} AS "MAE_cpu", {s6("mae_ram")} AS "MAE_ram",
  {s6("rate")} AS sla_cpu_violation_rate, avg_replicas FROM f""")
def run_summary_flatten(spark, folder):
    parsed = analysis.parse_json(summary_documents(spark, folder), "json", analysis.RUN_SUMMARY_SCHEMA)
    flat = analysis.flatten_summaries(parsed)
    return flat.select("run_id", "model_name", r6("MAE_cpu").alias("MAE_cpu"), r6("MAE_ram").alias("MAE_ram"),
                       r6("sla_cpu_violation_rate").alias("sla_cpu_violation_rate"), "avg_replicas")


@query("run_files", f"""WITH {EVAL}, f AS (
  SELECT namespace, model_name, avg(abs(predicted_cpu_cores - actual_cpu_cores)) AS mae,
    round_even(avg(current_replicas) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_replicas
  FROM ev GROUP BY ALL)
SELECT namespace, CASE WHEN model_name = 'FFT' THEN NULL ELSE model_name END AS model_name,
  CASE WHEN model_name = 'FFT' THEN 'corrupt' ELSE 'ok' END AS state, CASE WHEN model_name <> 'FFT' THEN {s6("mae")} END AS "MAE_cpu",
  CASE WHEN model_name <> 'FFT' THEN avg_replicas END AS avg_replicas FROM f""")
def run_files(spark, folder):
    """One summary file per run, those of one model cut off: the runs that parse and, from the quarantine table, the rest."""
    out = fresh_path(spark, "runs")
    docs = summary_documents(spark, folder).withColumn("model", F.xxhash64("json"))
    docs.repartition("run_id", "model").write.partitionBy("model", "run_id").text(out)
    flat, bad = documents.scan_run_summaries(spark, out, "*.txt")
    held = documents.quarantine(bad, fresh_path(spark, "quarantine"))
    good = flat.select("namespace", "model_name", F.lit("ok").alias("state"), r6("MAE_cpu").alias("MAE_cpu"), "avg_replicas")
    run = F.regexp_extract(documents.folder_of(1), "run_id=(.*)", 1).alias("namespace")
    return good.unionByName(held.select(run, "state"), allowMissingColumns=True)


PINNED = "20240102_000000"


@query("metadata_files", f"""WITH {TELE}, g AS (
  SELECT app, series_id, avg(value) AS mae FROM tele WHERE user_id % 2 = 1 GROUP BY ALL)
SELECT app AS "Dataset", series_id AS "Model", '{PINNED}' AS run_ts, 'ok' AS state, {s6("mae")} AS "MAE" FROM g WHERE series_id <> 'view'
UNION ALL SELECT NULL, series_id, '{PINNED}', 'corrupt', NULL FROM g WHERE series_id = 'view'""")
def metadata_files(spark, folder):
    """Two runs of every model as metadata files, of which only the pinned one is read; documents of one model break off."""
    out = fresh_path(spark, "metadata")
    run = F.when(F.col("user_id") % 2 == 1, PINNED).otherwise("20240101_000000").alias("run_ts")
    scored = telemetry(spark, folder).groupBy("app", "series_id", run).agg(F.avg("value").alias("MAE"))
    scores = F.struct("MAE")
    head = [F.col("app").alias("dataset"), F.lit("Total_Usage").alias("target_col"), F.col("series_id").alias("model_type")]
    text = F.to_json(F.struct(*head, F.struct(scores.alias("test")).alias("metrics")))
    text = F.when(F.col("app") == "A", F.to_json(F.struct(*head, scores.alias("metrics")))).otherwise(text)
    text = F.when(F.col("series_id") == "view", F.substring(text, 1, 30)).otherwise(text)
    docs = scored.select("app", "series_id", "run_ts", text.alias("json"))
    for app in INSTANCES:
        for ts in ("20240101_000000", PINNED):
            part = docs.where((F.col("app") == app) & (F.col("run_ts") == ts)).select("series_id", "json")
            part.repartition("series_id").write.partitionBy("series_id").text(f"{out}/{ts}/{app}")
    meta, bad = documents.scan_run_metadata(spark, out, PINNED, "*.txt")
    good = analysis.results_summary(meta).select("Dataset", "Model", F.lit(PINNED).alias("run_ts"), F.lit("ok").alias("state"),
                                                 r6("MAE").alias("MAE"))
    model = F.regexp_extract(documents.folder_of(1), "series_id=(.*)", 1).alias("Model")
    return good.unionByName(bad.select(model, documents.folder_of(3).alias("run_ts"), "state"), allowMissingColumns=True)


@query("results_summary", f"""WITH {TELE}, g AS (
  SELECT app, series_id, avg(value) AS mae, sqrt(avg(value * value)) AS rmse FROM tele GROUP BY ALL)
SELECT app AS "Dataset", 'Total_Usage' AS "Target", series_id AS "Model", {s6("mae")} AS "MAE", {s6("rmse")} AS "RMSE" FROM g""")
def results_summary(spark, folder):
    """Run metadata as JSON text, nested for some runs and flat for older ones, to one row per run."""
    scored = telemetry(spark, folder).groupBy("app", "series_id").agg(
        F.avg("value").alias("MAE"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("RMSE")
    )
    scores = F.struct("MAE", "RMSE")
    head = [F.col("app").alias("dataset"), F.lit("Total_Usage").alias("target_col"), F.col("series_id").alias("model_type")]
    nested = F.to_json(F.struct(*head, F.struct(scores.alias("test")).alias("metrics")))
    flat = F.to_json(F.struct(*head, scores.alias("metrics")))
    docs = scored.select(F.when(F.col("app") == "A", flat).otherwise(nested).alias("json"))
    out = fresh_path(spark, "summary")
    tables.write_summary_csv(
        analysis.results_summary(analysis.parse_json(docs, "json", analysis.RUN_METADATA_SCHEMA)).drop("components"), out
    )
    back = spark.read.option("header", "true").csv(out)
    return back.select("Dataset", "Target", "Model", *[r6(F.col(c).cast("double")).alias(c) for c in ("MAE", "RMSE")])


@query("bootstrap_history", f"""WITH b AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS ts, avg(value) AS y
  FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL '30 hours' AND ts <= TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT series_id, ts, {s6("y * (48 / 5.0::DOUBLE)")} AS y FROM b""")
def bootstrap_history(spark, folder):
    """Warm start: the last 30 steps before an instant, rescaled to the capacity of the real system."""
    recent = events(spark, folder, "2024-01-18 18:00:00", "2024-01-20 00:00:00").select(
        F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y")
    )
    hist = ops.resample(recent, HOUR)
    return hist.select("series_id", out_ts("ts").alias("ts"), r6(F.col("y") * (F.lit(48.0) / POLICY.vm_cpu_cap)).alias("y"))


