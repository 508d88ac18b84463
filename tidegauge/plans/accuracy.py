"""Forecast errors and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import analysis, metrics
from tidegauge.operators.models import snaive_forecast
from tidegauge.plans.registry import LAG, SPLIT, hourly_split, query, r6, s6

SNAIVE = SPLIT + """,
fc AS (
  SELECT t.series_id, 'SeasonalNaive' AS model, t.split, t.step_idx, t.y, t.n_train, t.n_val, s.y AS y_hat
  FROM split t JOIN split s ON s.series_id = t.series_id
    AND ((t.split = 'val' AND s.step_idx = t.n_train - 24 + (t.step_idx - t.n_train) % 24)
      OR (t.split = 'test' AND s.step_idx = t.n_train + t.n_val - 24 + (t.step_idx - t.n_train - t.n_val) % 24)))"""


@query("forecast_snaive", f"WITH {SNAIVE} SELECT series_id, model, split, step_idx, {s6('y_hat')} AS y_hat FROM fc")
def forecast_snaive(spark, folder):
    return snaive_forecast(hourly_split(spark, folder), LAG).withColumn("y_hat", r6("y_hat"))


@query("forecast_errors", f"""WITH {SNAIVE}
SELECT series_id, model, split, step_idx, {s6("y")} AS y, {s6("y_hat")} AS y_hat, {s6("y - y_hat")} AS error FROM fc""")
def forecast_errors(spark, folder):
    split = hourly_split(spark, folder)
    return metrics.forecast_errors(split, snaive_forecast(split, LAG)).select(
        "series_id", "model", "split", "step_idx", r6("y").alias("y"), r6("y_hat").alias("y_hat"), r6("error").alias("error")
    )


@query("forecast_chart_data", f"""WITH {SNAIVE}
SELECT series_id, split, step_idx, {s6("y")} AS y, {s6("y_hat")} AS y_hat FROM fc
WHERE step_idx - n_train - CASE split WHEN 'test' THEN n_val ELSE 0 END < 200""")
def forecast_chart_data(spark, folder):
    split = hourly_split(spark, folder)
    begins = F.col("n_train") + F.when(F.col("split") == "test", F.col("n_val")).otherwise(0)
    actual = split.filter(F.col("split") != "train").select("series_id", "step_idx", "y", begins.alias("begins"))
    joined = actual.join(snaive_forecast(split, LAG), ["series_id", "step_idx"])
    return analysis.chart_points(joined, 200, "begins").select(
        "series_id", "split", "step_idx", r6("y").alias("y"), r6("y_hat").alias("y_hat")
    )


def metrics_sql(split: str) -> str:
    train = "split = 'train'" if split == "val" else "split IN ('train', 'val')"
    return f"""m_{split} AS (
  SELECT series_id, model, split, count(*) AS n, avg(abs(y - y_hat)) AS mae, sqrt(avg((y - y_hat) ** 2)) AS rmse,
    avg(abs(y - y_hat) / CASE WHEN abs(y) + abs(y_hat) = 0 THEN 1e-8::DOUBLE ELSE (abs(y) + abs(y_hat)) / 2 END) * 100
      AS smape,
    sum((y - y_hat) ** 2) AS sse, var_pop(y) * count(*) AS sst, avg(y) AS mean_y, stddev_pop(y - y_hat) AS std_e
  FROM fc WHERE split = '{split}' GROUP BY ALL),
d_{split} AS (
  SELECT series_id, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY step_idx) AS d FROM split WHERE {train}),
n_{split} AS (SELECT series_id, avg(abs(d)) AS nmae, sqrt(avg(d * d)) AS nrmse FROM d_{split} WHERE d IS NOT NULL GROUP BY 1),
o_{split} AS (
  SELECT series_id, model, split, n, {s6("mae")} AS "MAE", {s6("rmse")} AS "RMSE", {s6("smape")} AS "SMAPE",
    {s6("CASE WHEN nmae > 0 THEN mae / nmae END")} AS "MASE", {s6("CASE WHEN nrmse > 0 THEN rmse / nrmse END")} AS "RMSSE",
    {s6("CASE WHEN n < 2 THEN NULL WHEN sst = 0 THEN (sse = 0)::INTEGER ELSE 1 - sse / sst END")} AS "R2",
    {s6("CASE WHEN mean_y > 0 THEN mae / mean_y END")} AS "NMAE",
    {s6("CASE WHEN mean_y > 0 THEN rmse / mean_y END")} AS "NRMSE", {s6("std_e")} AS "STD_ERRORS"
  FROM m_{split} LEFT JOIN n_{split} USING (series_id))"""


@query("forecast_metrics", f"""WITH {SNAIVE}, {metrics_sql("val")}, {metrics_sql("test")}
SELECT * FROM o_val UNION ALL SELECT * FROM o_test""")
def forecast_metrics(spark, folder):
    """Validation against train, test against train and val."""
    split = hourly_split(spark, folder)
    out = metrics.evaluate(split, snaive_forecast(split, LAG), LAG)
    for c in ("MAE", "RMSE", "SMAPE", "MASE", "RMSSE", "R2", "NMAE", "NRMSE", "STD_ERRORS"):
        out = out.withColumn(c, r6(c))
    return out
