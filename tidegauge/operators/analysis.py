"""Cross-run analysis: flattened runs, offline against online, ensemble pairs, signed ranks, pivots."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import (
    canonical_key, components_of, lost_percent, worse_by_percent,
)
from tidegauge.functions.scalars import nan_to_null
from tidegauge.operators.ordered import magnitude_chunk, with_running_sum
from tidegauge.operators.select import latest_run

# Fields of the run summary.
ACCURACY = ("MAE", "RMSE", "R2")
OPERATIONAL = (
    "sla_cpu_violation_rate", "sla_ram_violation_rate", "overprovision_cpu_minutes", "overprovision_ram_minutes",
    "oscillation_horizontal_count", "oscillation_vertical_count", "scale_up_horizontal_count",
    "scale_down_horizontal_count", "scale_up_vertical_count", "scale_down_vertical_count", "avg_replicas",
    "avg_memory_mb", "refit_skip_count", "avg_fit_time_cpu_seconds", "max_fit_time_cpu_seconds",
    "avg_predict_time_cpu_seconds", "max_predict_time_cpu_seconds", "avg_fit_time_ram_seconds",
    "max_fit_time_ram_seconds", "avg_predict_time_ram_seconds", "max_predict_time_ram_seconds",
)
TEST_METRICS = ("MAE_cpu", "MAE_ram", "sla_cpu_violation_rate", "sla_ram_violation_rate",
                "overprovision_cpu_minutes", "overprovision_ram_minutes")
TIMINGS = ("FIT_TIME_TOTAL", "PREDICT_TIME_TOTAL", "FIT_TIME_AVG", "PREDICT_TIME_AVG")
SCORES = ("MAE", "RMSE", "SMAPE", "MASE", "RMSSE", "R2", "NMAE", "NRMSE", "STD_ERRORS")

_accuracy = "struct<" + ",".join(f"{m}:double" for m in (*ACCURACY, "BIAS")) + ">"
RUN_SUMMARY_SCHEMA = (
    "namespace string, model_name string, dataset_slug string, scaling_mode string, components array<string>,"
    " total_cycles bigint, total_duration_seconds double,"
    f" prediction_metrics struct<cpu:{_accuracy},ram:{_accuracy}>,"
    " operational_metrics struct<" + ",".join(f"{c}:double" for c in OPERATIONAL) + ">"
)
_scores = ",".join(f"{m}:double" for m in (*SCORES, *TIMINGS))
RUN_METADATA_SCHEMA = (
    "dataset string, target_col string, model_type string, components array<string>,"
    " best_params map<string,string>,"
    f" metrics struct<validation:struct<{_scores}>,test:struct<{_scores}>,{_scores}>"
)


def _parsed(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, Column]:
    fields = F.from_json(column, schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_j", fields), F.col("_j").isNotNull() & F.col("_j._corrupt").isNull()


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text to columns; `rejected_json` has the rows whose text does not parse."""
    parsed, good = _parsed(df, column, schema)
    return parsed.filter(good).select(*[c for c in df.columns if c != column], "_j.*").drop("_corrupt")


def rejected_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows `parse_json` leaves out, as they came: null texts and texts that do not parse."""
    parsed, good = _parsed(df, column, schema)
    return parsed.filter(~good).select(*df.columns)


def flatten_summaries(runs: DataFrame, carry: Sequence[str] = ("run_id",)) -> DataFrame:
    """Nested run summaries to one flat row per run."""
    out = [F.col(c) for c in (*carry, "model_name", "components", "dataset_slug", "scaling_mode", "namespace")
           if c in runs.columns]
    for m in ("cpu", "ram"):
        out += [F.col(f"prediction_metrics.{m}.{k}").alias(f"{k}_{m}") for k in ACCURACY]
    return runs.select(*out, *[F.col(f"operational_metrics.{c}").alias(c) for c in OPERATIONAL])


def results_summary(metadata: DataFrame) -> DataFrame:
    """One row per run with its test metrics; flat metrics of older runs count as test metrics."""
    pick = lambda k: F.coalesce(F.col(f"metrics.test.{k}"), F.col(f"metrics.{k}")).alias(k)
    parts = [F.col("components")] if "components" in metadata.columns else []
    return metadata.select(
        F.col("dataset").alias("Dataset"), F.col("target_col").alias("Target"), F.col("model_type").alias("Model"),
        *parts, *[pick(k) for k in (*SCORES, *TIMINGS)],
    )


def compare_runs(offline: DataFrame, online: DataFrame) -> DataFrame:
    """Online accuracy against the latest offline test accuracy of the same dataset and model.

    offline: `(dataset_slug, model, run_ts, MAE, RMSE, R2)`; online: flat summaries with `model`.
    Component order does not matter; online rows without an offline run are dropped.
    """
    base = latest_run(offline.withColumn("model_key", canonical_key("model")), ["dataset_slug", "model_key"],
                      tie=("model",))
    cpu = F.col("dataset_slug").endswith("-cpu")
    live = online.withColumn("model_key", canonical_key("model"))
    for k in ACCURACY:
        live = live.withColumn(f"{k}_online", F.when(cpu, F.col(f"{k}_cpu")).otherwise(F.col(f"{k}_ram")))
    joined = live.join(
        base.select("dataset_slug", "model_key", *[F.col(k).alias(f"{k}_offline") for k in ACCURACY]),
        ["dataset_slug", "model_key"],
    )
    return joined.withColumn(
        "mae_degradation_pct", worse_by_percent("MAE_offline", "MAE_online")
    ).withColumn("r2_degradation_pct", lost_percent("R2_offline", "R2_online"))


def ensemble_pairs(runs: DataFrame, metrics: Sequence[str], group: Sequence[str] = ("dataset_slug", "scaling_mode"),
                   order: Sequence[str] = ("run_id",), ensemble_id: Sequence[str] = ("run_id",)) -> DataFrame:
    """Each ensemble run next to the first run of each of its components in the same group, per metric.

    The components of the ensemble name are exploded, so this is an equi-join, not a comparison of all
    pairs of a group.
    """
    is_ensemble = F.col("model").startswith("Ensemble[")
    long = lambda df, keep: df.unpivot(keep, list(metrics), "metric", "value")
    ens = runs.filter(is_ensemble).withColumn("model_ensemble", canonical_key("model"))
    ens = ens.withColumn("model_individual", F.explode(components_of("model")))
    left = long(ens, [*group, *ensemble_id, "model_ensemble", "model_individual"]).withColumnRenamed("value", "val_ensemble")
    first = F.min_by(F.struct(*metrics), F.struct(*order))
    single = runs.filter(~is_ensemble).groupBy(*group, F.col("model").alias("model_individual")).agg(first.alias("_f"))
    single = single.select(*group, "model_individual", *[F.col(f"_f.{m}").alias(m) for m in metrics])
    right = long(single, [*group, "model_individual"]).withColumnRenamed("value", "val_individual")
    both = nan_to_null("val_ensemble").isNotNull() & nan_to_null("val_individual").isNotNull()
    return left.join(right, [*group, "model_individual", "metric"]).filter(both)


def signed_ranks(pairs: DataFrame, group: Sequence[str], a: str, b: str, min_n: int = 3) -> DataFrame:
    """Wilcoxon signed-rank statistic of `a - b` per group: zeros dropped, ties get their average rank.

    Pairs with a missing value, null or NaN, are skipped.

    Equal differences are counted first, so ranks come from running counts over distinct differences,
    cut into value ranges; a large group is never sorted in one task.
    """
    keys = list(group)
    pairs = pairs.filter(nan_to_null(a).isNotNull() & nan_to_null(b).isNotNull())
    d = F.col(a) - F.col(b)
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"),
        F.count_if(d != 0).alias("n_nonzero"),
    )
    ties = pairs.withColumn("_m", F.abs(d)).filter(F.col("_m") > 0).groupBy(*keys, "_m").agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(d > 0).alias("_plus")
    )
    ranked = with_running_sum(ties, keys, ["_m"], F.col("_t"), magnitude_chunk("_m"), "_upto")
    rank = F.col("_upto") - (F.col("_t") - 1) / 2.0
    stats = ranked.groupBy(*keys).agg(
        F.sum(rank * F.col("_plus")).alias("r_plus"), F.sum(rank * (F.col("_t") - F.col("_plus"))).alias("r_minus"),
        F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")).alias("tie_term"),
    )
    zero = {"r_plus": 0.0, "r_minus": 0.0, "tie_term": 0.0}
    return sums.join(stats, keys, "left").na.fill(zero).filter(F.col("n_samples") >= min_n).withColumn(
        "w", F.least("r_plus", "r_minus")
    )


P_METHODS = ("exact", "normal")


def signed_rank_p(w: float, n: int, tie_term: float, n_zero: int, method: str = "exact") -> float:
    """Two-sided p by the chosen method.

    `exact` counts rank subsets, which only says something without ties and zeros; with them the normal limit takes
    its place. Its work grows with the cube of n: choose `normal` for large groups.
    """
    if method not in P_METHODS:
        raise ValueError(f"method must be one of {P_METHODS}, got {method}")
    if n == 0:
        return 1.0
    if method == "exact" and tie_term == 0 and n_zero == 0:
        share = np.zeros(n * (n + 1) // 2 + 1)
        share[0] = 1.0
        for rank in range(1, n + 1):
            shifted = np.append(np.zeros(rank), share[:-rank])
            share = (share + shifted) / 2.0
        return min(1.0, 2.0 * float(share[: int(w) + 1].sum()))
    mean = n * (n + 1) / 4.0
    var = (n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0
    return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2.0)) if var > 0 else 1.0


def wilcoxon(pairs: DataFrame, group: Sequence[str], a: str, b: str, min_n: int = 3, level: float = 0.05,
             method: str = "exact") -> DataFrame:
    """Signed-rank test per group; the p value is a small function on one row per group.

    `p_method` is the method the p value of the row comes from: `exact` becomes `normal` where a group has ties or zeros.
    """
    if method not in P_METHODS:
        raise ValueError(f"method must be one of {P_METHODS}, got {method}")

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, ties: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(x, int(k), t, int(s - k), method) for x, k, t, s in zip(w, n, ties, total)])

    plain = (F.lit(method) == "exact") & (F.col("tie_term") == 0) & (F.col("n_nonzero") == F.col("n_samples"))
    stats = signed_ranks(pairs, group, a, b, min_n)
    return stats.withColumn("p_value", p_value("w", "n_nonzero", "tie_term", "n_samples")).withColumn(
        "significant", F.col("p_value") < level
    ).withColumn("p_method", F.when(plain, "exact").otherwise("normal"))


def pivot_mean(runs: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Mean per (row, column) as a table; the column values are given, so no extra pass looks for them."""
    return runs.dropna(subset=[value]).groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def bars(runs: DataFrame, values: Sequence[str], by: Sequence[str] = ("model", "scaling_mode")) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def timeline(events: DataFrame, kind: str, keys: Sequence[str] = ("namespace",)) -> DataFrame:
    """Data of the replica or memory chart; only runs whose mode scales that dimension."""
    if kind == "replicas":
        return events.filter(F.col("scaling_mode").isin("horizontal", "combined")).select(
            *keys, "timestamp", "current_replicas", "actual_cpu_cores", "predicted_cpu_cores"
        )
    if kind != "memory":
        raise ValueError(f"unknown timeline {kind}")
    mb: Column = F.lit(1024)
    return events.filter(F.col("scaling_mode").isin("vertical", "combined")).select(
        *keys, "timestamp", "current_memory_mb", (F.col("actual_ram_gb") * mb).alias("actual_ram_mb"),
        (F.col("predicted_ram_gb") * mb).alias("predicted_ram_mb"),
    )


def chart_points(errors: DataFrame, n: int = 200, first: str | None = None) -> DataFrame:
    """Truth and forecast of the first `n` steps (counted from `first`)."""
    at = F.col("step_idx") - (F.col(first) if first else F.lit(0))
    return errors.filter(at < n)


def resume_index(events: DataFrame, runs: DataFrame, warmup: Column, keys: Sequence[str] = ("namespace",)) -> DataFrame:
    """Where a run continues: warm-up plus evaluation rows, else warm-up rows, else 0; valid with any row."""
    counts = events.groupBy(*keys).agg(
        F.count_if(F.col("phase") == "evaluation").alias("_eval"), F.count_if(F.col("phase") == "warmup").alias("_warm")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    index = F.when(n("_eval") > 0, warmup + n("_eval")).otherwise(n("_warm"))
    return runs.join(counts, list(keys), "left").select(
        *runs.columns, index.cast("bigint").alias("start_index"), (n("_eval") + n("_warm") > 0).alias("valid")
    )


def missing_stages(runs: DataFrame, artifacts: DataFrame, required: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Required artifacts a run does not have, with the stage that writes them."""
    need = F.explode(F.array(*[
        F.struct(F.lit(a).alias("artifact"), F.lit(s).alias("stage")) for a, s in required.items()
    ]))
    wanted = runs.withColumn("_n", need).select(*keys, "_n.artifact", "_n.stage")
    return wanted.join(artifacts.select(*keys, "artifact"), [*keys, "artifact"], "left_anti")


def align_metrics(cpu: DataFrame, ram: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """CPU and RAM histories on the same tick."""
    return cpu.select(*keys, "ts", F.col("y").alias("cpu")).join(
        ram.select(*keys, "ts", F.col("y").alias("ram")), [*keys, "ts"], how
    )


def fit_timings(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total and mean fit and predict seconds; the mean is over the evaluations, at least one."""
    n = F.greatest(F.sum("evaluations"), F.lit(1))
    return log.groupBy(*keys).agg(
        F.sum("fit_s").alias("FIT_TIME_TOTAL"), F.sum("predict_s").alias("PREDICT_TIME_TOTAL"),
        (F.sum("fit_s") / n).alias("FIT_TIME_AVG"), (F.sum("predict_s") / n).alias("PREDICT_TIME_AVG"),
    )
