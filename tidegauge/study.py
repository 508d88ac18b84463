"""The offline study and the cross-run analysis as a few calls over all series at once.

Every loop over datasets, models and trials is a key column, so one call covers any number of series.
Stages hand over tables below a folder; a stage that finds its input missing names the stage to run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import catalog
from tidegauge.functions import lag_for_step, save_name
from tidegauge.operators import analysis, metrics, models, select, series, traces
from tidegauge.session import prepare
from tidegauge.sources import tables

TRIAL_SCHEMA = ("series_id string, model string, trial int, params map<string,string>, rmse double, state string,"
                " status string")


def usage_series(spark: SparkSession, usage: DataFrame, metric: str, capacity: DataFrame | None = None) -> DataFrame:
    """Regular series of one metric from long samples `(app, metric, instance, ts, value)` of any unit."""
    prepare(spark)
    one = usage.filter(F.col("metric") == metric)
    used = series.to_usage(one, catalog.capacity(spark) if capacity is None else capacity)
    total = series.total_usage(used, ["app", "metric"]).withColumn("series_id", F.concat_ws("_", "app", "metric"))
    return series.regular_series(total, catalog.METRIC_STEPS[metric])


def data_stage(regular: DataFrame, step_s: int, folder: str) -> None:
    split = series.chrono_split(regular)
    tables.write_splits(split, series.split_meta(split, step_s=step_s), folder)


def _arrays(spark: SparkSession, folder: str) -> DataFrame:
    splits, _ = tables.read_splits(spark, folder)
    return series.series_arrays(splits)


def tuning_stage(spark: SparkSession, folder: str, names: Sequence[str], step_s: int, n_trials: int = 30,
                 fixed: dict | None = None, seed: int = 42) -> None:
    """Search of all models on all series; the trial table is written, the best trial is a query on it."""
    trials = select.trial_grid(names, n_trials, seed, fixed)
    tables.write_trials(select.tune(_arrays(spark, folder), trials, step_s), folder)


def best_params(spark: SparkSession, folder: str) -> DataFrame:
    trials = tables.read_trials(spark, folder, TRIAL_SCHEMA)
    return select.best_trial(trials, ["series_id", "model"], payload=["params"])


def training_stage(spark: SparkSession, folder: str, step_s: int) -> DataFrame:
    """Dry run of the best models on train and val: seconds per series and model."""
    best = best_params(spark, folder)
    return analysis.fit_timings(select.timed_fits(_arrays(spark, folder), best, step_s), ["series_id", "model"])


def results_stage(spark: SparkSession, folder: str, step_s: int) -> None:
    """Train predicts val, train and val predict test, with the best parameters of each series."""
    best = best_params(spark, folder)
    tables.write_forecasts(models.forecast_val_test(_arrays(spark, folder), best, step_s), folder)


def ensemble_stage(spark: SparkSession, folder: str, components: Sequence[str], step_s: int, forward: int,
                   backwards: Sequence[int], out: str) -> None:
    """Ensemble of tuned components: best backward window on val, then both hold-out parts walked forward."""
    best = best_params(spark, folder).filter(F.col("model").isin(list(components)))
    arrays = _arrays(spark, folder)
    windows = select.tune_ensemble(arrays, best, backwards, forward, step_s, order=components)
    width = select.best_trial(windows, ["series_id"], payload=[], tie="backward_window")
    tuned = arrays.join(width.select("series_id", "backward_window"), "series_id")
    keys = ["series_id", "backward_window"]
    params = best.join(width.select("series_id", "backward_window"), "series_id")
    name = save_name(F.lit("Ensemble"), F.array(*[F.lit(c) for c in components]))
    both = None
    for part in ("val", "test"):
        _, done = select.ensemble_backtest(tuned, params, F.col("backward_window"), forward, step_s, keys, part=part,
                                           order=components)
        one = done.select(*keys, F.lit(part).alias("split"), name.alias("model"), F.col("model").alias("component"),
                          "step_idx", "y_hat", "status")
        both = one if both is None else both.unionByName(one)
    tables.write_forecasts(both, out)


def evaluate_stage(spark: SparkSession, folder: str, step_s: int, forecasts: str | None = None) -> DataFrame:
    """Metrics of both hold-out parts for every series and model."""
    splits, _ = tables.read_splits(spark, folder)
    done = tables.read_forecasts(spark, forecasts or folder).filter(F.col("y_hat").isNotNull())
    return metrics.evaluate(splits, done.select("series_id", "model", "split", "step_idx", "y_hat"), lag_for_step(step_s))


def analyze(online: DataFrame, offline: DataFrame) -> dict[str, DataFrame]:
    """Tables of the cross-run analysis from flat online summaries and offline results.

    online: flat summaries with `model`; offline: `(dataset_slug, model, run_ts, MAE, RMSE, R2)`.
    """
    pairs = analysis.ensemble_pairs(online, analysis.TEST_METRICS)
    return {
        "comparison": analysis.compare_runs(offline, online),
        "statistical_tests": analysis.wilcoxon(
            pairs, ["model_ensemble", "model_individual", "metric"], "val_ensemble", "val_individual"),
        "oscillations": analysis.bars(online, ["oscillation_horizontal_count", "oscillation_vertical_count"]),
        "overprovision": analysis.bars(online, ["overprovision_ram_minutes"]),
    }


def load_traces(spark: SparkSession, usage: DataFrame, folder: str, warmup: dict[str, int] | None = None) -> None:
    """CPU and RAM load traces of all apps, calibrated, as ordered JSON."""
    steps = {"CPU": 168, "RAM": 252} | (warmup or {})
    cal = catalog.calibration(spark).join(catalog.capacity(spark).select("app", "total_cores", "total_ram_gb"), "app")
    for metric in ("CPU", "RAM"):
        rows = usage_series(spark, usage, metric).withColumn("app", F.split_part("series_id", F.lit("_"), F.lit(1))).join(cal, "app")
        if metric == "CPU":
            trace = traces.cpu_trace(rows, "total_cores", F.col("peak_rps"), steps[metric])
        else:
            trace = traces.ram_trace(rows, "total_ram_gb", F.col("min_memory_mb"), F.col("max_memory_mb"), 64, steps[metric])
        tables.write_trace(trace, f"{folder}/{metric.lower()}")
