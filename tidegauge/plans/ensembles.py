"""Dynamic-selection ensembles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import analysis, phases, select, walk
from tidegauge.operators.models import register_model
from tidegauge.plans.forecasts import COMPONENTS, arrays
from tidegauge.plans.registry import CYCLES, HOUR, HOURLY, LAG, SPLIT, cycles, hourly_split, query, r6, s6
from tidegauge.session import fresh_path
from tidegauge.sources import tables

BACKWARD, FORWARD = 36, 24
SIMPLE = ["SeasonalNaive", "LastValue", "Mean", "Drift"]

BLOCKS = SPLIT + f""",
sz AS (SELECT DISTINCT series_id, n_train + n_val AS n_prior, n_steps - n_train - n_val AS n_test FROM split),
blk AS (
  SELECT series_id, block, n_prior + block * {FORWARD} AS block_start, least({FORWARD}, n_test - block * {FORWARD}) AS block_len,
    least(block * {FORWARD}, {BACKWARD}) AS tail_len, n_prior + block * {FORWARD} - least(block * {FORWARD}, {BACKWARD}) AS tail_start
  FROM (SELECT *, unnest(generate_series(0::BIGINT, (n_test - 1) // {FORWARD})) AS block FROM sz))"""


@query("ensemble_blocks", f"""WITH {BLOCKS}
SELECT series_id, block, block_start::BIGINT AS block_start, block_len::BIGINT AS block_len, tail_len::BIGINT AS tail_len,
  tail_start::BIGINT AS tail_start FROM blk""")
def ensemble_blocks(spark, folder):
    return select.ensemble_blocks(hourly_split(spark, folder), BACKWARD, FORWARD)


_SCORES = BLOCKS + f""",
cum AS (SELECT series_id, step_idx, y, sum(y) OVER (PARTITION BY series_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS run
  FROM split),
ft AS (
  SELECT t.series_id, b.block, t.step_idx - b.tail_start AS h, t.y, l.y AS last_y, l.run / b.tail_start AS mean_y, f.y AS first_y,
    b.tail_start, coalesce(s.y, l.y) AS season_y
  FROM blk b
  JOIN split t ON t.series_id = b.series_id AND t.step_idx >= b.tail_start AND t.step_idx < b.block_start
  JOIN cum l ON l.series_id = b.series_id AND l.step_idx = b.tail_start - 1
  JOIN split f ON f.series_id = b.series_id AND f.step_idx = 0
  LEFT JOIN split s ON s.series_id = b.series_id AND s.step_idx = b.tail_start - {LAG} + (t.step_idx - b.tail_start) % {LAG}),
sc AS (
  SELECT series_id, block, 0 AS tie, 'SeasonalNaive' AS model, sqrt(avg((y - season_y) ** 2)) AS rmse FROM ft GROUP BY ALL
  UNION ALL SELECT series_id, block, 1, 'LastValue', sqrt(avg((y - last_y) ** 2)) FROM ft GROUP BY ALL
  UNION ALL SELECT series_id, block, 2, 'Mean', sqrt(avg((y - mean_y) ** 2)) FROM ft GROUP BY ALL
  UNION ALL SELECT series_id, block, 3, 'Drift',
    sqrt(avg((y - (last_y + (last_y - first_y) / nullif(tail_start - 1, 0) * (h + 1))) ** 2)) FROM ft GROUP BY ALL)"""


@query("ensemble_scores", f"WITH {_SCORES} SELECT series_id, block, model, {s6('rmse')} AS rmse FROM sc")
def ensemble_scores(spark, folder):
    out = select.simple_component_scores(hourly_split(spark, folder), BACKWARD, FORWARD, LAG)
    return out.withColumn("rmse", r6("rmse"))


@query("ensemble_select", f"""WITH {_SCORES}, win AS (
  SELECT series_id, block, arg_min(model, (rmse, tie)) AS model, min(rmse) AS best_rmse FROM sc GROUP BY ALL)
SELECT series_id, block, coalesce(win.model, 'Mean') AS model, {s6("best_rmse")} AS best_rmse
FROM blk LEFT JOIN win USING (series_id, block)""")
def ensemble_select(spark, folder):
    split = hourly_split(spark, folder)
    scores = select.simple_component_scores(split, BACKWARD, FORWARD, LAG)
    # The first block has no tail yet: it enters without a score and takes the initial component.
    first = select.ensemble_blocks(split, BACKWARD, FORWARD).filter(F.col("tail_len") == 0).select(
        "series_id", "block", F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("rmse")
    )
    picked = select.pick_component(scores.unionByName(first), SIMPLE, "Mean")
    return picked.withColumn("best_rmse", r6("best_rmse"))


@query("ensemble_backtest")
def ensemble_backtest(spark, folder):
    _, forecasts = select.ensemble_backtest(arrays(spark, folder), COMPONENTS, BACKWARD, FORWARD, HOUR)
    return forecasts


@query("ensemble_choices")
def ensemble_choices(spark, folder):
    choices, _ = select.ensemble_backtest(arrays(spark, folder), COMPONENTS, BACKWARD, FORWARD, HOUR)
    return choices


FEW = {"SeasonalNaive": {"lag": str(LAG)}, "LastValue": {}, "Mean": {}}
WINDOWS = range(6, 49)


def walk_sql(prior: str, size: str, windows: str) -> str:
    """CTEs `guess` (every component on every block), `scored` (its error on the tail of every window) and `won`."""
    return SPLIT + f""",
sz AS (SELECT DISTINCT series_id, {prior} AS n_prior, {size} AS n_hold FROM split),
blk AS (SELECT series_id, block, n_prior + block * {FORWARD} AS block_start, least({FORWARD}, n_hold - block * {FORWARD}) AS block_len
  FROM (SELECT *, unnest(generate_series(0::BIGINT, (n_hold - 1) // {FORWARD})) AS block FROM sz)),
cum AS (SELECT series_id, step_idx, y, sum(y) OVER (PARTITION BY series_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS run FROM split),
win AS (SELECT b.*, w, least(block * {FORWARD}, w) AS tail FROM blk b, ({windows}) ws(w)),
org AS (SELECT DISTINCT series_id, block_start - tail AS o, block_start AS z, w, block FROM win WHERE tail > 0),
own AS (SELECT DISTINCT series_id, block_start AS o, block_start + block_len AS z, NULL::BIGINT AS w, block FROM blk),
ask AS (SELECT * FROM org UNION ALL SELECT * FROM own),
fc AS (
  SELECT a.*, t.step_idx, t.y, l.y AS last_y, l.run / a.o AS mean_y, coalesce(s.y, l.y) AS season_y
  FROM ask a JOIN split t ON t.series_id = a.series_id AND t.step_idx >= a.o AND t.step_idx < a.z
  JOIN cum l ON l.series_id = a.series_id AND l.step_idx = a.o - 1
  LEFT JOIN split s ON s.series_id = a.series_id AND s.step_idx = a.o - {LAG} + (t.step_idx - a.o) % {LAG}),
guess AS (
  SELECT series_id, block, w, step_idx, y, 0 AS tie, 'SeasonalNaive' AS model, season_y AS y_hat FROM fc
  UNION ALL SELECT series_id, block, w, step_idx, y, 1, 'LastValue', last_y FROM fc
  UNION ALL SELECT series_id, block, w, step_idx, y, 2, 'Mean', mean_y FROM fc),
scored AS (SELECT series_id, block, w, model, tie, sqrt(avg((y - y_hat) ** 2)) AS rmse FROM guess WHERE w IS NOT NULL GROUP BY ALL),
won AS (
  SELECT b.series_id, b.block, b.w, coalesce(arg_min(model, (rmse, tie)), 'Mean') AS model, min(rmse) AS best_rmse
  FROM win b LEFT JOIN scored s ON s.series_id = b.series_id AND s.block = b.block AND s.w = b.w GROUP BY ALL)"""


@query("ensemble_walk", f"""WITH {walk_sql("n_train + n_val", "n_steps - n_train - n_val", f"VALUES ({BACKWARD}::BIGINT)")}
SELECT g.series_id, g.block, g.model, {s6("best_rmse")} AS best_rmse, step_idx, {s6("y_hat")} AS y_hat
FROM guess g JOIN won ON won.series_id = g.series_id AND won.block = g.block AND won.model = g.model WHERE g.w IS NULL""")
def ensemble_walk(spark, folder):
    """Back-test of the test part in one pass per series and component."""
    out = walk.ensemble_walk(arrays(spark, folder), FEW, BACKWARD, FORWARD, HOUR, initial="Mean")
    return out.withColumn("best_rmse", r6("best_rmse")).withColumn("y_hat", r6("y_hat"))


@query("tune_ensemble", f"""WITH {walk_sql("n_train", "n_val", "SELECT unnest(generate_series(6, 48))")}
SELECT won.series_id, won.w::INTEGER AS backward_window, {s6("sqrt(avg((y - y_hat) ** 2))")} AS rmse
FROM guess g JOIN won ON won.series_id = g.series_id AND won.block = g.block AND won.model = g.model WHERE g.w IS NULL GROUP BY ALL""")
def tune_ensemble(spark, folder):
    """All windows from 6 to 48 on the validation part, every prefix fitted once."""
    out = walk.tune_windows(arrays(spark, folder), FEW, WINDOWS, FORWARD, HOUR, initial="Mean")
    return out.withColumn("rmse", r6("rmse"))


@query("best_window", f"""WITH {walk_sql("n_train", "n_val", "SELECT unnest(generate_series(6, 48))")}, t AS (
  SELECT won.series_id, won.w, sqrt(avg((y - y_hat) ** 2)) AS rmse
  FROM guess g JOIN won ON won.series_id = g.series_id AND won.block = g.block AND won.model = g.model WHERE g.w IS NULL GROUP BY ALL)
SELECT series_id, arg_min(w, (round_even(rmse * 1e6, 0), w))::INTEGER AS backward_window, {s6("min(rmse)")} AS best_rmse
FROM t GROUP BY 1""")
def best_window(spark, folder):
    """The window the search settles on; equal errors go to the shorter one."""
    tuned = tune_ensemble(spark, folder)
    best = select.best_trial(tuned, payload=["rmse"], tie="backward_window")
    return best.select("series_id", "backward_window", "best_rmse")


@query("ensemble_timings", f"""WITH {BLOCKS}
SELECT series_id, 1 + (count(*) - 1) * {len(FEW) + 1} AS evaluations, true AS timed FROM blk GROUP BY 1""")
def ensemble_timings(spark, folder):
    blocks = walk.walk_blocks(arrays(spark, folder), FEW, BACKWARD, FORWARD, HOUR)
    done = walk.ensemble_timings(blocks, len(FEW))
    return done.select("series_id", "evaluations", ((F.col("fit_s") > 0) & (F.col("predict_s") > 0)).alias("timed"))


@query("timings_table", f"""WITH {SPLIT}
SELECT DISTINCT series_id, unnest({list(FEW)}) AS model, true AS timed, true AS halves FROM split""")
def timings_table(spark, folder):
    """Fit and predict seconds of both hold-out parts, each by its own clock, written and read back."""
    log = phases.phase_timings(arrays(spark, folder), FEW, HOUR)
    out = fresh_path(spark, "results")
    tables.write_timings(analysis.fit_timings(log, ["series_id", "model"]), out)
    back = tables.read_timings(spark, out)
    timed = (F.col("FIT_TIME_TOTAL") > 0) & (F.col("PREDICT_TIME_TOTAL") > 0)
    halves = F.abs(F.col("FIT_TIME_TOTAL") - 2 * F.col("FIT_TIME_AVG")) < 1e-9
    return back.select("series_id", "model", timed.alias("timed"), halves.alias("halves"))


def day_median(y, horizon, step_s, params):
    """A user's model: the median of the last day."""
    return np.full(horizon, np.median(y[-(86400 // step_s):]))


@query("user_model", f"""WITH {HOURLY}
SELECT series_id, any_value(n_steps) + h AS step_idx, {s6("median(y)")} AS y_hat
FROM series, (SELECT unnest(generate_series(0::BIGINT, 5)) AS h) WHERE step_idx >= n_steps - 24 GROUP BY series_id, h""")
def user_model(spark, folder):
    """A model a user registers takes part like any other: fitted, stored and read for the prediction."""
    register_model("DayMedian", day_median)
    path = fresh_path(spark, "user-model")
    phases.write_models(phases.fit_models(arrays(spark, folder), {"DayMedian": {}}, HOUR), path)
    done = phases.predict_models(spark.read.parquet(path), 6, HOUR)
    return done.select("series_id", "step_idx", r6("y_hat").alias("y_hat"))


@query("ensemble_online")
def ensemble_online(spark, folder):
    return select.ensemble_select_online(arrays(spark, folder), COMPONENTS, LAG, HOUR)


@query("fit_timings")
def fit_timings(spark, folder):
    """Seconds per series and model, measured around each fit of the backtest components."""
    log = select.timed_fits(arrays(spark, folder), COMPONENTS, HOUR)
    return analysis.fit_timings(log, ["series_id", "model"])


_RUNS = CYCLES + """,
runs AS (
  SELECT app || '_' || namespace AS dataset, model_name AS model, strftime(timestamp, '%Y%m%d_%H%M%S') AS run_ts,
    event_id, actual_cpu_cores AS score FROM cyc)"""


def runs(spark, folder):
    return cycles(spark, folder).select(
        F.concat_ws("_", "app", "namespace").alias("dataset"), F.col("model_name").alias("model"),
        F.date_format("timestamp", "yyyyMMdd_HHmmss").alias("run_ts"), "event_id", F.col("actual_cpu_cores").alias("score"),
    )


@query("latest_run", f"""WITH {_RUNS}
SELECT dataset, model, max(run_ts) AS run_ts, arg_max(event_id, (run_ts, event_id)) AS event_id,
  {s6("arg_max(score, (run_ts, event_id))")} AS score FROM runs GROUP BY ALL""")
def latest_run(spark, folder):
    latest = select.latest_run(runs(spark, folder), ["dataset", "model"], tie=["event_id"])
    return latest.withColumn("score", r6("score"))


@query("component_params", f"""WITH {_RUNS}, l AS (
  SELECT dataset, model, max(run_ts) AS run_ts, arg_max(event_id, (run_ts, event_id)) AS event_id FROM runs GROUP BY ALL),
ens AS (SELECT DISTINCT dataset, unnest(['FFT', 'Prophet']) AS model FROM runs)
SELECT dataset, 'Ensemble[FFT+Prophet]' AS ensemble, model, run_ts, event_id % 7 AS param FROM ens LEFT JOIN l USING (dataset, model)""")
def component_params(spark, folder):
    history = runs(spark, folder)
    params = history.groupBy("dataset", "model", "run_ts").agg((F.max("event_id") % 7).alias("param"))
    parts = F.array(F.lit("FFT"), F.lit("Prophet"))
    ensembles = history.select("dataset").distinct().select(
        "dataset", F.lit("Ensemble[FFT+Prophet]").alias("ensemble"), parts.alias("components")
    )
    return select.component_params(history, params, ensembles).select("dataset", "ensemble", "model", "run_ts", "param")


