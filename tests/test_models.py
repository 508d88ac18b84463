"""Models, search and ensembles against plain numpy and simple truths."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import metrics, models, select, series as ops

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
HOUR = 3600


def frame(spark, groups):
    rows = [(k, T0 + dt.timedelta(hours=i), i, len(v), float(x)) for k, v in groups.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, step_idx long, n_steps long, y double")


def daily(n, seed=0, noise=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 50 + 10 * np.sin(2 * np.pi * t / 24) + 0.02 * t + noise * rng.normal(size=n)


def test_periodic_series_has_zero_error(spark):
    y = np.tile(np.arange(24.0), 20)
    split = ops.chrono_split(frame(spark, {"s": y}))
    out = metrics.evaluate(split, models.snaive_forecast(split, 24), 24).collect()
    assert {r.split for r in out} == {"val", "test"}
    # Naive error is 0 too, so the scaled errors are undefined.
    assert all(r.MAE == 0 and r.R2 == 1.0 and r.MASE is None and r.RMSSE is None for r in out)


def test_metrics_by_numpy(spark):
    y = daily(100, 1, 3.0)
    y[90] = 0.0
    split = ops.chrono_split(frame(spark, {"s": y}))
    fc = split.filter("split = 'test'").select(
        "series_id", F.lit("m").alias("model"), "split", "step_idx", F.when(F.col("step_idx") == 90, 0.0).otherwise(40.0).alias("y_hat"))
    got = metrics.evaluate(split, fc, 24).first()
    a, train = y[85:], y[:85]
    p = np.where(np.arange(85, 100) == 90, 0.0, 40.0)
    e = a - p
    half = (np.abs(a) + np.abs(p)) / 2
    d = train[24:] - train[:-24]
    want = dict(
        MAE=np.abs(e).mean(), RMSE=np.sqrt((e**2).mean()), SMAPE=(np.abs(e) / np.where(half == 0, 1e-8, half)).mean() * 100,
        MASE=np.abs(e).mean() / np.abs(d).mean(), RMSSE=np.sqrt((e**2).mean()) / np.sqrt((d**2).mean()),
        R2=1 - (e**2).sum() / ((a - a.mean()) ** 2).sum(), NMAE=np.abs(e).mean() / a.mean(),
        NRMSE=np.sqrt((e**2).mean()) / a.mean(), STD_ERRORS=e.std(),
    )
    for k, v in want.items():
        assert np.isclose(got[k], v), k
    one = metrics.forecast_metrics(split, fc, split.filter("split != 'test'"), 24).first()
    assert np.isclose(one.MASE, want["MASE"]) and np.isclose(one.R2, want["R2"])


def test_metrics_edges(spark):
    """Constant truth, mean not positive, train not longer than the lag."""
    y = np.r_[np.arange(17.0), [-2.0] * 3]
    split = ops.chrono_split(frame(spark, {"s": y}))
    fc = split.filter("split = 'test'").select("series_id", F.lit("m").alias("model"), "split", "step_idx", F.lit(-1.0).alias("y_hat"))
    got = metrics.evaluate(split, fc, 24).first()
    assert (got.R2, got.NMAE, got.NRMSE, got.MASE) == (0.0, None, None, None)


def test_smoothing_closed_form_is_the_recursion(spark):
    y = daily(60, 2, 5.0)
    split = ops.chrono_split(frame(spark, {"s": y}))
    got = {r.alpha: r.level for r in models.ses_levels(split, [0.1, 0.5, 1.0]).collect()}
    for a in got:
        level = y[0]
        for v in y[1:42]:
            level = a * v + (1 - a) * level
        assert np.isclose(got[a], level)


@pytest.mark.parametrize("name,params,tol", [
    ("Prophet", {"daily_seasonality": "true", "weekly_seasonality": "false"}, 0.2),
    ("ExponentialSmoothing", {"trend": "additive", "seasonal": "additive", "seasonal_periods": "24"}, 0.5),
    ("SeasonalNaive", {"lag": "24"}, 1.0),
])
def test_models_follow_a_daily_wave(name, params, tol):
    y = daily(240)
    out, status = models.run_model(models.model_functions(), name, y[:216], 24, HOUR, params)
    assert status == "ok"
    assert np.abs(out - y[216:]).max() < tol


def test_spectral_is_exact_on_whole_periods():
    t = np.arange(120)
    y = 5 + np.cos(2 * np.pi * t / 12) + 2 * np.sin(2 * np.pi * t / 30)
    out = models.spectral(y[:60], 60, HOUR, {"n_freqs": 3})
    assert np.allclose(out, y[60:])


@pytest.mark.parametrize("n", [97, 120])
def test_spectral_is_the_periodic_extension_of_the_filtered_series(n):
    y = daily(n, 8, 3.0)
    t = np.arange(2 * n) / (n - 1)
    coef = np.polyfit(t[:n], y, 3)
    freq = np.fft.rfft(y - np.polyval(coef, t[:n]))
    freq[np.argsort(-np.abs(freq))[10:]] = 0
    want = np.fft.irfft(freq, n) + np.polyval(coef, t[n:])
    assert np.allclose(models.spectral(y, n, HOUR, {"trend": "poly"}), want)


def test_failures_become_a_status(spark):
    arrays = ops.series_arrays(frame(spark, {"short": [1.0, 2.0], "long": daily(100)}))
    params = {"ExponentialSmoothing": {"seasonal": "additive", "seasonal_periods": "24"}}
    rows = models.forecast(arrays, params, 3, HOUR).collect()
    by = {k: [r for r in rows if r.series_id == k] for k in ("short", "long")}
    assert all(r.y_hat is None and r.status.startswith("failed: seasonal smoothing") for r in by["short"])
    assert [r.step_idx for r in sorted(by["long"], key=lambda r: r.step_idx)] == [100, 101, 102]


def test_next_step_falls_back(spark):
    arrays = ops.series_arrays(frame(spark, {"one": [7.0], "neg": [-7.0], "few": [1.0, 4.0], "ok": daily(60)}))
    arrays = arrays.withColumn("last", F.when(F.col("series_id") == "neg", 2.5))
    params = {"seasonal": "additive", "seasonal_periods": "24", "trend": "none"}
    got = {r.series_id: r for r in models.forecast_next(arrays, "ExponentialSmoothing", params, HOUR, last_prediction="last").collect()}
    assert (got["one"].y_hat, got["one"].status, got["one"].refit_skipped) == (7.0, "short history", False)
    assert got["neg"].y_hat == 2.5
    assert (got["few"].y_hat, got["few"].refit_skipped) == (4.0, True)
    assert got["ok"].status == "ok" and not got["ok"].refit_skipped


def test_driver_models_reach_executors(spark):
    models.register_model("Twice", lambda y, h, s, p: np.full(h, 2 * y[-1]), {"x": ["1", "2"]})
    try:
        arrays = ops.series_arrays(frame(spark, {"s": [1.0, 3.0]}))
        assert [r.y_hat for r in models.forecast(arrays, {"Twice": {}}, 2, HOUR).collect()] == [6.0, 6.0]
        assert len(select.trial_params("Twice", 30)) == 2
    finally:
        del models.MODELS["Twice"]


def test_distributed_additive_equals_local(spark):
    y = daily(400, 3, 2.0)
    params = {"daily_seasonality": "true", "weekly_seasonality": "true", "n_changepoints": 5}
    split = ops.chrono_split(frame(spark, {"s": y, "t": y * 2}).repartition(6))
    got = models.additive_forecast(split, params, HOUR).orderBy("series_id", "step_idx").collect()
    n = int(400 * 0.7) + int(400 * 0.15)
    want = models.additive(y[:n], 400 - n, HOUR, params)
    assert np.allclose([r.y_hat for r in got if r.series_id == "s"], want, atol=1e-6)
    assert np.allclose([r.y_hat for r in got if r.series_id == "t"], 2 * want, atol=1e-5)
    assert all(r.y_low < r.y_hat < r.y_high for r in got)


def test_normal_equations(spark):
    y = daily(50, 4, 1.0)
    out = models.normal_equations(frame(spark, {"s": y}), {"one": F.lit(1.0), "t": F.col("step_idx")}, "y")
    got = {(r.i, r.j): r.value for r in out.collect()}
    t = np.arange(50)
    assert np.allclose([got["one", "one"], got["one", "t"], got["t", "t"], got["one", "y"], got["t", "y"]],
                       [50, t.sum(), (t * t).sum(), y.sum(), (t * y).sum()])


def test_search_counts_failures(spark):
    arrays = ops.series_arrays(frame(spark, {"s": daily(100, 5, 1.0)}))
    trials = [("FFT", 0, {"trend": "none"}), ("ExponentialSmoothing", 1, {"seasonal": "additive", "seasonal_periods": "48"}),
              ("SeasonalNaive", 2, {"lag": "24"})]
    out = select.tune(arrays, trials, HOUR)
    got = {r.trial: r for r in out.collect()}
    assert got[1].rmse == 1e9 and got[1].state == "FAIL"
    y = daily(100, 5, 1.0)
    assert np.isclose(got[2].rmse, np.sqrt(((y[70:85] - y[46:61]) ** 2).mean()))
    best = select.best_trial(out, payload=["model", "params"]).first()
    assert best.trial == min(got, key=lambda i: got[i].rmse)


def test_best_trial_ties_and_bad_values(spark):
    rows = [("s", 0, float("nan")), ("s", 1, 2.0), ("s", 2, 2.0), ("s", 3, None), ("t", 0, float("inf")), ("t", 1, None)]
    df = spark.createDataFrame(rows, "series_id string, trial int, rmse double")
    got = {r.series_id: (r.trial, r.best_rmse) for r in select.best_trial(df, payload=[]).collect()}
    assert got == {"s": (1, 2.0), "t": (0, 1e9)}


def test_trial_sampling_rules():
    for p in select.trial_params("ExponentialSmoothing", 30):
        assert ("damped" in p) == (p["trend"] != "none") and ("seasonal_periods" in p) == (p["seasonal"] != "none")
        assert 2 <= int(p.get("seasonal_periods", 2)) <= 48
    assert select.trial_params("Prophet", 5) == select.trial_params("Prophet", 5)
    assert select.trial_grid(["FFT"], fixed={"trend": "poly"})[1] == ("FFT", 1, {"trend": "poly"})
    assert [select.initial_component(x) for x in (["a", "b", "c"], ["a", "b"])] == ["c", "a"]


COMPONENTS = {"SeasonalNaive": {"lag": "24"}, "LastValue": {}, "FFT": {"trend": "none"}}


@pytest.mark.parametrize("backward,forward", [(12, 24), (30, 8)])
def test_backtest_equals_sequential_walk(spark, backward, forward):
    y = daily(200, 6, 4.0)
    arrays = ops.series_arrays(frame(spark, {"s": y}))
    choices, forecasts = select.ensemble_backtest(arrays, COMPONENTS, backward, forward, HOUR, blocks_per_unit=2)
    fns, names = models.model_functions(), list(COMPONENTS)
    prior = int(200 * 0.7) + int(200 * 0.15)
    current, want, picks = select.initial_component(names), [], []
    for idx in range(0, 200 - prior, forward):
        start = prior + idx
        if idx:
            tail = min(idx, backward)
            scores = {}
            for m in names:
                p, _ = models.run_model(fns, m, y[: start - tail], tail, HOUR, COMPONENTS[m])
                scores[m] = np.sqrt(np.mean((y[start - tail: start] - p) ** 2))
            current = min(names, key=lambda m: scores[m])
        picks.append(current)
        h = min(forward, 200 - start)
        want.append(models.run_model(fns, current, y[:start], h, HOUR, COMPONENTS[current])[0])
    assert [r.model for r in choices.orderBy("block").collect()] == picks
    rows = forecasts.orderBy("step_idx").collect()
    assert [r.step_idx for r in rows] == list(range(prior, 200))
    assert np.allclose([r.y_hat for r in rows], np.concatenate(want))


def test_no_finite_score_keeps_the_winner(spark):
    nan = float("nan")
    rows = [("s", 0, "a", nan), ("s", 0, "b", nan), ("s", 1, "a", 2.0), ("s", 1, "b", 1.0), ("s", 2, "a", nan),
            ("s", 2, "b", None), ("s", 3, "a", 1.0), ("s", 3, "b", 1.0)]
    df = spark.createDataFrame(rows, "series_id string, block long, model string, rmse double")
    got = [r.model for r in select.pick_component(df, ["a", "b"], "a").orderBy("block").collect()]
    assert got == ["a", "b", "b", "a"]


def test_online_choice_is_sticky(spark):
    fns = models.model_functions()
    flat = np.full(50, 3.0)
    assert select.select_online(fns, flat, COMPONENTS, "LastValue", 10, HOUR)[0] == "LastValue"
    assert select.select_online(fns, flat[:10], COMPONENTS, "FFT", 10, HOUR)[0] == "FFT"
    y = daily(200)
    arrays = ops.series_arrays(frame(spark, {"s": y}))
    row = select.ensemble_select_online(arrays.withColumn("now", F.lit("LastValue")), COMPONENTS, 24, HOUR, current="now").first()
    assert row.previous_model == "LastValue" and row.model == "SeasonalNaive"


def test_multiplicative_smoothing():
    t = np.arange(240)
    y = (100 + t) * (1 + 0.4 * np.sin(2 * np.pi * t / 24))
    season = {"seasonal": "multiplicative", "seasonal_periods": "24"}
    both = models.holt_winters(y[:216], 24, HOUR, {"trend": "additive", **season})
    plain = models.holt_winters(y[:216], 24, HOUR, {"trend": "additive", "seasonal": "additive", "seasonal_periods": "24"})
    assert np.abs(both - y[216:]).max() < 0.05 * y.max() and not np.allclose(both, plain)
    grown = 3.0 * 1.02 ** np.arange(80)
    # The recursion starts on the first value, so its first step misses by one growth.
    assert np.allclose(models.holt_winters(grown[:70], 10, HOUR, {"trend": "multiplicative"}), grown[70:], rtol=1e-3)
    with pytest.raises(ValueError, match="positive"):
        models.holt_winters(y - 200, 3, HOUR, {"trend": "multiplicative"})


def test_unknown_choices_are_errors():
    for fn, params in ((models.spectral, {"trend": "exp"}), (models.holt_winters, {"trend": "exp"}),
                       (models.holt_winters, {"seasonal": "weekly"})):
        with pytest.raises(ValueError, match="must be none or one of"):
            fn(daily(100), 3, HOUR, params)


def test_trials_differ():
    for model in ("ExponentialSmoothing", "FFT", "Prophet"):
        sets = [tuple(sorted(p.items())) for p in select.trial_params(model, 30)]
        assert 1 < len(sets) <= 30 and len(set(sets)) == len(sets)
