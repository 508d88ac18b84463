"""Cross-run analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import analysis as ops
from tidegauge.plans.registry import TELE, query, r6, s6, telemetry

TYPES = ["click", "error", "purchase", "signup", "view"]


def run_table(spark, folder):
    """One run per user and event type: single models, and ensembles in either component order."""
    model = (
        F.when(F.col("series_id") == "click", "FFT").when(F.col("series_id") == "view", "Prophet")
        .when((F.col("series_id") == "error") & (F.col("user_id") % 2 == 0), "Ensemble[FFT+Prophet]")
        .when(F.col("series_id") == "error", "Ensemble[Prophet+FFT]").otherwise("ExponentialSmoothing")
    )
    v = F.col("value")
    return telemetry(spark, folder).groupBy("user_id", "series_id").agg(
        F.avg(v).alias("MAE_cpu"), F.avg(v * 2).alias("MAE_ram"), F.max(v).alias("RMSE_cpu"), F.min(v).alias("RMSE_ram"),
        F.avg(v / 600).alias("R2_cpu"), F.avg(v / 700).alias("R2_ram"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(v > 50, 1.0).otherwise(0.0)).alias("sla_cpu_violation_rate"), F.first("app").alias("app"),
    ).select(
        "*", model.alias("model"),
        F.concat_ws("-", F.lower("app"), F.when(F.col("user_id") % 4 < 2, "cpu").otherwise("ram")).alias("dataset_slug"),
        F.when(F.col("user_id") % 5 < 2, "horizontal").otherwise("combined").alias("scaling_mode"),
        F.col("user_id").alias("run_id"),
    )


RUNS = TELE + """,
runs AS (
  SELECT user_id, user_id AS run_id, series_id, any_value(app) AS app, avg(value) AS mae_cpu, avg(value * 2) AS mae_ram,
    max(value) AS rmse_cpu, min(value) AS rmse_ram, avg(value / 600) AS r2_cpu, avg(value / 700) AS r2_ram,
    avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sla_cpu_violation_rate,
    CASE series_id WHEN 'click' THEN 'FFT' WHEN 'view' THEN 'Prophet' WHEN 'error' THEN
      CASE WHEN user_id % 2 = 0 THEN 'Ensemble[FFT+Prophet]' ELSE 'Ensemble[Prophet+FFT]' END
      ELSE 'ExponentialSmoothing' END AS model,
    lower(any_value(app)) || CASE WHEN user_id % 4 < 2 THEN '-cpu' ELSE '-ram' END AS dataset_slug,
    CASE WHEN user_id % 5 < 2 THEN 'horizontal' ELSE 'combined' END AS scaling_mode
  FROM tele GROUP BY user_id, series_id)"""

_KEY = "CASE WHEN model LIKE 'Ensemble%' THEN 'FFT+Prophet' ELSE model END"


@query("offline_vs_online", f"""WITH {RUNS}, keyed AS (SELECT *, {_KEY} AS model_key FROM runs),
off AS (
  SELECT dataset_slug, model_key, arg_max(mae_cpu, (user_id, series_id)) AS mae_off,
    arg_max(r2_cpu, (user_id, series_id)) AS r2_off
  FROM keyed WHERE user_id % 2 = 0 GROUP BY ALL),
onl AS (SELECT *, CASE WHEN dataset_slug LIKE '%-cpu' THEN mae_cpu ELSE mae_ram END AS mae_on,
    CASE WHEN dataset_slug LIKE '%-cpu' THEN r2_cpu ELSE r2_ram END AS r2_on FROM keyed WHERE user_id % 2 = 1)
SELECT run_id, series_id, dataset_slug, model_key, {s6("mae_off")} AS "MAE_offline", {s6("mae_on")} AS "MAE_online",
  {s6("CASE WHEN mae_off > 0 THEN (mae_on - mae_off) / mae_off * 100 END")} AS mae_degradation_pct,
  {s6("CASE WHEN r2_off > 0 THEN (r2_off - r2_on) / r2_off * 100 END")} AS r2_degradation_pct
FROM onl JOIN off USING (dataset_slug, model_key)""")
def offline_vs_online(spark, folder):
    runs = run_table(spark, folder)
    offline = runs.filter(F.col("user_id") % 2 == 0).select("dataset_slug", "model", F.struct("user_id", "series_id").alias("run_ts"), F.col("MAE_cpu").alias("MAE"),
             F.col("RMSE_cpu").alias("RMSE"), F.col("R2_cpu").alias("R2"))
    online = runs.filter(F.col("user_id") % 2 == 1)
    out = ops.compare_runs(offline, online)
    return out.select("run_id", "series_id", "dataset_slug", "model_key", *[
        r6(c).alias(c) for c in ("MAE_offline", "MAE_online", "mae_degradation_pct", "r2_degradation_pct")
    ])


PAIRS = RUNS + """,
ens AS (
  SELECT dataset_slug, scaling_mode, run_id, 'FFT+Prophet' AS model_ensemble, unnest(['FFT', 'Prophet']) AS model_individual,
    mae_cpu, sla_cpu_violation_rate
  FROM runs WHERE model LIKE 'Ensemble%'),
one AS (
  SELECT dataset_slug, scaling_mode, model AS model_individual, arg_min(mae_cpu, run_id) AS mae_cpu,
    arg_min(sla_cpu_violation_rate, run_id) AS sla FROM runs WHERE model NOT LIKE 'Ensemble%' GROUP BY ALL),
pairs AS (
  SELECT e.dataset_slug, e.scaling_mode, e.run_id, model_ensemble, model_individual, 'MAE_cpu' AS metric,
    e.mae_cpu AS val_ensemble, o.mae_cpu AS val_individual
  FROM ens e JOIN one o USING (dataset_slug, scaling_mode, model_individual)
  UNION ALL
  SELECT e.dataset_slug, e.scaling_mode, e.run_id, model_ensemble, model_individual, 'sla_cpu_violation_rate',
    e.sla_cpu_violation_rate, o.sla
  FROM ens e JOIN one o USING (dataset_slug, scaling_mode, model_individual))"""
METRICS = ["MAE_cpu", "sla_cpu_violation_rate"]


@query("ensemble_pairs", f"""WITH {PAIRS}
SELECT dataset_slug, scaling_mode, run_id, model_ensemble, model_individual, metric, {s6("val_ensemble")} AS val_ensemble,
  {s6("val_individual")} AS val_individual FROM pairs""")
def ensemble_pairs(spark, folder):
    pairs = ops.ensemble_pairs(run_table(spark, folder), METRICS)
    return pairs.select("dataset_slug", "scaling_mode", "run_id", "model_ensemble", "model_individual", "metric",
                        r6("val_ensemble").alias("val_ensemble"), r6("val_individual").alias("val_individual"))


def rank_sql(pairs: str, keys: str, a: str, b: str) -> str:
    return f"""d AS (SELECT *, {a} - {b} AS d FROM {pairs}),
rk AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE
    AS r, count(*) OVER (PARTITION BY {keys}, abs(d)) AS t FROM d WHERE d <> 0),
st AS (SELECT {keys}, coalesce(sum(r) FILTER (d > 0), 0.0::DOUBLE) AS r_plus, coalesce(sum(r) FILTER (d < 0), 0.0::DOUBLE) AS r_minus,
  sum((t * t * t - t) / t::DOUBLE) AS tie_term FROM rk GROUP BY ALL),
al AS (SELECT {keys}, count(*) AS n_samples, count(*) FILTER (d <> 0) AS n_nonzero, avg({a}) AS mean_a, avg({b}) AS mean_b
  FROM d GROUP BY ALL),
wx AS (
  SELECT {keys}, n_samples, n_nonzero, mean_a, mean_b, coalesce(r_plus, 0.0::DOUBLE) AS r_plus, coalesce(r_minus, 0.0::DOUBLE) AS r_minus,
    least(coalesce(r_plus, 0.0::DOUBLE), coalesce(r_minus, 0.0::DOUBLE)) AS w, coalesce(tie_term, 0.0::DOUBLE) AS tie_term
  FROM al LEFT JOIN st USING ({keys}) WHERE n_samples >= 3)"""


# Ranks compare six-digit values, so that equal differences are equal on both sides.
_ROUNDED = f"""pr AS (SELECT * REPLACE ({s6("val_ensemble")} AS val_ensemble, {s6("val_individual")} AS val_individual) FROM pairs)"""


@query("wilcoxon", f"""WITH {PAIRS}, {_ROUNDED}, {rank_sql("pr", "model_ensemble, model_individual, metric", "val_ensemble", "val_individual")}
SELECT model_ensemble, model_individual, metric, n_samples, n_nonzero, r_plus, r_minus, w,
  {s6("mean_a")} AS mean_val_ensemble, {s6("mean_b")} AS mean_val_individual FROM wx""")
def wilcoxon(spark, folder):
    out = ops.signed_ranks(ensemble_pairs.__wrapped__(spark, folder), ["model_ensemble", "model_individual", "metric"],
                           "val_ensemble", "val_individual")
    return out.select("model_ensemble", "model_individual", "metric", "n_samples", "n_nonzero", "r_plus", "r_minus", "w",
                      r6("mean_val_ensemble").alias("mean_val_ensemble"), r6("mean_val_individual").alias("mean_val_individual"))


@query("wilcoxon_raw", f"""WITH pr AS (SELECT event_type AS series_id, round_even(value * 100::DOUBLE, 0) AS a,
  round_even(json_extract(props, '$.k')::DOUBLE * 40, 0) AS b FROM events),
{rank_sql("pr", "series_id", "a", "b")}
SELECT series_id, n_samples, n_nonzero, r_plus, r_minus, w, tie_term FROM wx""")
def wilcoxon_raw(spark, folder):
    """Signed ranks over all events of a type: large groups with many ties."""
    pairs = telemetry(spark, folder).select("series_id", F.rint(F.col("value") * 100).alias("a"),
                                            F.rint(F.col("k") * 40.0).alias("b"))
    out = ops.signed_ranks(pairs, ["series_id"], "a", "b")
    return out.select("series_id", "n_samples", "n_nonzero", "r_plus", "r_minus", "w", "tie_term")


@query("wilcoxon_pvalue")
def wilcoxon_pvalue(spark, folder):
    return ops.wilcoxon(ensemble_pairs.__wrapped__(spark, folder), ["model_ensemble", "model_individual", "metric"],
                        "val_ensemble", "val_individual")


SLUGS = [f"{a}-{m}" for a in "abc" for m in ("cpu", "ram")]
_PIVOT = ", ".join(
    f"""{s6(f"avg(sla_cpu_violation_rate) FILTER (dataset_slug = '{s}')")} AS "{s}" """ for s in SLUGS
)


@query("sla_pivot", f"WITH {RUNS} SELECT model, {_PIVOT} FROM runs GROUP BY 1")
def sla_pivot(spark, folder):
    out = ops.pivot_mean(run_table(spark, folder), "model", "dataset_slug", "sla_cpu_violation_rate", SLUGS)
    return out.select("model", *[r6(F.col(f"`{s}`")).alias(s) for s in SLUGS])


@query("chart_bars", f"""WITH {RUNS} SELECT model, scaling_mode, {s6("avg(mae_cpu)")} AS "MAE_cpu",
  {s6("avg(sla_cpu_violation_rate)")} AS sla_cpu_violation_rate FROM runs GROUP BY ALL""")
def chart_bars(spark, folder):
    out = ops.bars(run_table(spark, folder), METRICS)
    return out.select("model", "scaling_mode", *[r6(m).alias(m) for m in METRICS])

