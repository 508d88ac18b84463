"""Models: smoothing and normal equations as aggregates, the others as fan-outs."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from tidegauge.operators import models, phases, select
from tidegauge.functions import lag_for_step
from tidegauge.operators.series import gap_fill, history_tail, resample, series_arrays
from tidegauge.plans.registry import (
    HOUR, HOURLY, POLICY, SPLIT, events, hourly, hourly_split, query, r6, s6,
)
from tidegauge.session import fresh_path

ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]

# Model parameters of the fan-out queries.
COMPONENTS = {
    "ExponentialSmoothing": {"trend": "none", "seasonal": "additive", "seasonal_periods": "24"},
    "FFT": {"trend": "none"},
    "Prophet": {"daily_seasonality": "auto", "weekly_seasonality": "auto", "yearly_seasonality": "false"},
}

_ALPHA_VALUES = ", ".join(f"({a}::DOUBLE, {i}::INTEGER)" for i, a in enumerate(ALPHAS))

SES = SPLIT + f""",
alphas(alpha, trial) AS (VALUES {_ALPHA_VALUES}),
lv AS (
  SELECT series_id, alpha, trial,
    sum(pow(1 - alpha, n_train - 1 - step_idx) * CASE WHEN step_idx = 0 THEN 1 ELSE alpha END * y) AS level
  FROM split, alphas WHERE split = 'train' GROUP BY ALL),
tr AS (
  SELECT lv.series_id, alpha, trial, level, sqrt(avg((y - level) ** 2)) AS rmse
  FROM lv JOIN split ON split.series_id = lv.series_id AND split = 'val' GROUP BY ALL)"""


def ses_trials(split):
    """Validation RMSE of each alpha: level per (series, alpha), then moments of the validation part.

    The level is constant over the horizon, so the error needs only the mean and the variance of the
    validation values: no rows are multiplied by the number of alphas.
    """
    y = F.when(F.col("split") == "val", F.col("y"))
    moments = split.groupBy("series_id").agg(F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    rank = F.create_map(*[F.lit(x) for i, a in enumerate(ALPHAS) for x in (float(a), i)])
    levels = models.ses_levels(split, ALPHAS).join(moments, "series_id")
    off = F.col("_m") - F.col("level")
    return levels.select("series_id", "alpha", F.element_at(rank, F.col("alpha")).alias("trial"), "level",
                         F.sqrt(F.col("_v") + off * off).alias("rmse"))


@query("forecast_ses", f"WITH {SES} SELECT series_id, alpha, {s6('level')} AS level FROM lv")
def forecast_ses(spark, folder):
    return models.ses_levels(hourly_split(spark, folder), ALPHAS).select("series_id", "alpha", r6("level").alias("level"))


@query("best_trial", f"""WITH {SES}
SELECT series_id, arg_min(trial, (rmse, trial)) AS trial, arg_min(alpha, (rmse, trial)) AS alpha,
  {s6("min(rmse)")} AS best_rmse FROM tr GROUP BY 1""")
def best_trial(spark, folder):
    best = select.best_trial(ses_trials(hourly_split(spark, folder)), payload=["alpha"])
    return best.withColumn("best_rmse", r6("best_rmse"))


_W = {k: 2 * math.pi * k / 24 for k in (1, 2)}
_X = {"one": "1.0::DOUBLE", "t": "step_idx / n_steps::DOUBLE"}
for _k, _w in _W.items():
    _X[f"cos{_k}"] = f"cos(step_idx * {_w!r}::DOUBLE)"
    _X[f"sin{_k}"] = f"sin(step_idx * {_w!r}::DOUBLE)"


def design_columns():
    """Intercept, trend and two daily harmonics as column expressions."""
    out = {"one": F.lit(1.0), "t": F.col("step_idx") / F.col("n_steps")}
    for k, w in _W.items():
        out[f"cos{k}"] = F.cos(F.col("step_idx") * F.lit(w))
        out[f"sin{k}"] = F.sin(F.col("step_idx") * F.lit(w))
    return out


_NAMES = list(_X)
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i:]]
_CELLS = " UNION ALL ".join(
    [f"SELECT series_id, '{a}' AS i, '{b}' AS j, sum({a} * {b}) AS v FROM x GROUP BY 1" for a, b in _PAIRS]
    + [f"SELECT series_id, '{a}' AS i, 'y' AS j, sum({a} * y) AS v FROM x GROUP BY 1" for a in _NAMES]
)
_X_SQL = ", ".join(f"{sql} AS {name}" for name, sql in _X.items())


@query("normal_equations", f"""WITH {HOURLY}, x AS (SELECT series_id, y, {_X_SQL} FROM series),
cells AS ({_CELLS}) SELECT series_id, i, j, {s6("v")} AS value FROM cells""")
def normal_equations(spark, folder):
    out = models.normal_equations(hourly(spark, folder), design_columns(), "y")
    return out.withColumn("value", r6("value"))


@query("fft_spectrum", f"""WITH {HOURLY}, kk AS (
  SELECT series_id, n_steps, unnest(generate_series(0::BIGINT, n_steps // 2)) AS k FROM (SELECT DISTINCT series_id, n_steps FROM series)),
f AS (
  SELECT s.series_id, k, sum(y * cos(2 * pi() * ((k * step_idx) % s.n_steps) / s.n_steps)) AS re,
    -sum(y * sin(2 * pi() * ((k * step_idx) % s.n_steps) / s.n_steps)) AS im
  FROM series s JOIN kk ON kk.series_id = s.series_id GROUP BY ALL)
SELECT series_id, k, {s6("sqrt(re * re + im * im)")} AS amplitude,
  row_number() OVER (PARTITION BY series_id ORDER BY sqrt(re * re + im * im) DESC, k) AS rank
FROM f QUALIFY rank <= 10""")
def fft_spectrum(spark, folder):
    out = models.spectrum(series_arrays(hourly(spark, folder)), 10)
    return out.select("series_id", "k", r6("amplitude").alias("amplitude"), F.col("rank").cast("bigint").alias("rank"))


def arrays(spark, folder):
    return series_arrays(hourly(spark, folder))


@query("forecast_fft")
def forecast_fft(spark, folder):
    return models.forecast(arrays(spark, folder), {"FFT": {"trend": "poly"}}, 24, HOUR)


@query("forecast_holt_winters")
def forecast_holt_winters(spark, folder):
    params = {"trend": "additive", "damped": "true", "seasonal": "additive", "seasonal_periods": "24"}
    return models.forecast(arrays(spark, folder), {"ExponentialSmoothing": params}, 24, HOUR)


SMOOTHED = {"trend": "additive", "damped": "true", "seasonal": "additive", "seasonal_periods": "24"}
WEIGHTS = {"alpha": 0.2, "beta": 0.05, "gamma": 0.1, "phi": 0.9}


@query("smoothing_fixed", f"""WITH RECURSIVE {HOURLY},
st AS (SELECT series_id, list(y ORDER BY step_idx) AS ys FROM series WHERE step_idx < 48 GROUP BY 1),
r(series_id, t, level, slope, season) AS (
  SELECT series_id, 0::BIGINT, list_avg(ys[1:24]), (list_avg(ys[25:48]) - list_avg(ys[1:24])) / 24,
    list_transform(ys[1:24], lambda x: x - list_avg(ys[1:24])) FROM st
  UNION ALL
  SELECT r.series_id, t + 1, level + {WEIGHTS["phi"]}::DOUBLE * slope + {WEIGHTS["alpha"]}::DOUBLE * miss,
    {WEIGHTS["phi"]}::DOUBLE * slope + {WEIGHTS["beta"]}::DOUBLE * ({WEIGHTS["alpha"]}::DOUBLE * miss),
    list_append(season[2:], season[1] + {WEIGHTS["gamma"]}::DOUBLE * {1 - WEIGHTS["alpha"]}::DOUBLE * miss)
  FROM (SELECT r.*, s.y - (level + {WEIGHTS["phi"]}::DOUBLE * slope) - season[1] AS miss
        FROM r JOIN series s ON s.series_id = r.series_id AND s.step_idx = r.t) r),
f AS (SELECT r.* FROM r JOIN (SELECT DISTINCT series_id, n_steps FROM series) n ON n.series_id = r.series_id AND n.n_steps = r.t)
SELECT series_id, t + h - 1 AS step_idx,
  {s6(f"level + slope * ({WEIGHTS['phi']}::DOUBLE * (1 - pow({WEIGHTS['phi']}::DOUBLE, h)) / (1 - {WEIGHTS['phi']}::DOUBLE)) + season[((h - 1) % 24) + 1]")} AS y_hat
FROM f, (SELECT unnest(generate_series(1::BIGINT, 48)) AS h)""")
def smoothing_fixed(spark, folder):
    """Two days ahead by the smoothing recursion at given weights."""
    params = SMOOTHED | {k: str(v) for k, v in WEIGHTS.items()}
    out = models.forecast(arrays(spark, folder), {"Smoothing": params}, 48, HOUR)
    return out.select("series_id", "step_idx", r6("y_hat").alias("y_hat"))


@query("forecast_smoothing")
def forecast_smoothing(spark, folder):
    """The same with fitted weights and start states, from a stored model table."""
    path = fresh_path(spark, "smoothing")
    phases.write_models(phases.fit_models(arrays(spark, folder), {"Smoothing": SMOOTHED}, HOUR), path)
    return phases.predict_models(spark.read.parquet(path), 24, HOUR)


@query("forecast_additive")
def forecast_additive(spark, folder):
    params = {"daily_seasonality": "auto", "weekly_seasonality": "true", "yearly_seasonality": "false",
              "interval_width": "0.9"}
    return models.additive_forecast(hourly_split(spark, folder), params, HOUR)


PENALTIES = (0.02, 0.1, 0.4, 1.0)


@query("trend_changes", f"""SELECT DISTINCT event_type AS series_id, unnest([{", ".join(f"{p}::DOUBLE" for p in PENALTIES)}]) AS penalty,
  true AS optimal, true AS fewer FROM events""")
def trend_changes(spark, folder):
    """Few trend changes by a Laplace prior: every solution is one, and a larger penalty leaves no more of them; the full
    penalty leaves none."""
    found = models.sparse_changes(hourly(spark, folder), {"n_changepoints": "20", "yearly_seasonality": "false"}, PENALTIES, HOUR)
    by_penalty = Window.partitionBy("series_id").orderBy("penalty")
    before = F.coalesce(F.lag("n_changes").over(by_penalty), F.lit(20))
    fewer = (F.col("n_changes") <= before) & ((F.col("penalty") < 1) | (F.col("n_changes") == 0))
    return found.withColumn("fewer", fewer).drop("n_changes")


@query("forecast_val_test")
def forecast_val_test(spark, folder):
    return models.forecast_val_test(arrays(spark, folder), COMPONENTS, HOUR)


LIVE_S = 900
LIVE_KEYS = ["series_id", "instance"]


def live_arrays(spark, folder):
    """The last 500 ticks of every series and instance on the live grid."""
    raw = events(spark, folder).select(
        F.col("event_type").alias("series_id"), (F.col("user_id") % 8).alias("instance"), "ts", F.col("value").alias("y"),
    )
    ticks = resample(raw, LIVE_S, LIVE_KEYS)
    return series_arrays(gap_fill(history_tail(ticks, POLICY.max_history_points, LIVE_KEYS), LIVE_S, "both", LIVE_KEYS), LIVE_KEYS)


@query("online_forecast")
def online_forecast(spark, folder):
    """One step ahead of the live history, with fallback."""
    return models.forecast_next(live_arrays(spark, folder), "ExponentialSmoothing", {"trend": "none"}, LIVE_S, LIVE_KEYS)


_DAY = lag_for_step(LIVE_S, generalize=True)


@query("online_next", f"""WITH tk AS (
  SELECT event_type AS series_id, user_id % 8 AS instance, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01') AS b,
    avg(value) AS y FROM events GROUP BY ALL),
h AS (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY series_id, instance ORDER BY b DESC) <= 500),
x AS (SELECT *, lead(b) OVER w AS nb, lead(y) OVER w AS ny, epoch(max(b) OVER k - min(b) OVER k) // {LIVE_S} + 1 AS n,
    max(b) OVER k - INTERVAL '{(_DAY - 1) * LIVE_S} seconds' AS day_ago, last_value(y) OVER (
      PARTITION BY series_id, instance ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_y
  FROM h WINDOW k AS (PARTITION BY series_id, instance), w AS (PARTITION BY series_id, instance ORDER BY b)),
s AS (SELECT series_id, instance, y + coalesce((ny - y) * (epoch(day_ago - b) / epoch(nb - b)), 0) AS then_y
  FROM x WHERE n >= {_DAY} AND b <= day_ago AND (nb > day_ago OR nb IS NULL))
SELECT series_id, instance, any_value(n)::INTEGER AS n_points, {s6("greatest(0, coalesce(any_value(then_y), any_value(last_y)))")} AS y_hat
FROM x LEFT JOIN s USING (series_id, instance) GROUP BY ALL""")
def online_next(spark, folder):
    """One step ahead by the value a day before, the lag of the live grid."""
    out = models.forecast_next(live_arrays(spark, folder), "SeasonalNaive", {}, LIVE_S, LIVE_KEYS)
    return out.select("series_id", "instance", "n_points", r6("y_hat").alias("y_hat"))


@query("tune_grid")
def tune_grid(spark, folder):
    trials = select.trial_grid(["FFT", "ExponentialSmoothing", "Prophet"], n_trials=30)
    return select.tune(arrays(spark, folder), trials, HOUR)
