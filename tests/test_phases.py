"""Two-phase models and one-pass ensembles against the one-call functions and the fan-out back-test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import models, phases, select, series as ops, walk
from test_models import HOUR, daily, frame

CASES = [
    ("SeasonalNaive", {}), ("SeasonalNaive", {"lag": "7"}), ("LastValue", {}), ("FFT", {"trend": "none"}), ("FFT", {"trend": "poly"}),
    ("ExponentialSmoothing", {"trend": "none"}),
    ("ExponentialSmoothing", {"trend": "additive", "damped": "true", "seasonal": "additive", "seasonal_periods": "24"}),
    ("ExponentialSmoothing", {"trend": "multiplicative", "seasonal": "multiplicative", "seasonal_periods": "12"}),
    ("Prophet", {}), ("Prophet", {"daily_seasonality": "true", "weekly_seasonality": "false", "n_changepoints": "0"}),
    ("Prophet", {"yearly_seasonality": "true", "n_changepoints": "25"}),
]


@pytest.mark.parametrize("name,params", CASES)
def test_states_of_a_walk_equal_fits_of_every_prefix(name, params):
    """Also origins that are too short, repeated values, zeros that end multiplicative smoothing, and missing values."""
    model, fns = phases.phase_functions()[name], models.model_functions()
    zeros = daily(300, 2, 4.0)
    zeros[250] = 0.0
    gaps = daily(120, 4, 2.0)
    gaps[[0, 50, 51, 119]] = np.nan
    for y in (daily(700, 3, 5.0), zeros, gaps, np.full(90, 3.0)):
        origins = [o for o in (0, 1, 2, 3, 5, 23, 24, 47, 48, 49, 90, 119, 120, 200, 250, 251, 300, 500, 700) if o <= len(y)]
        for o, state in zip(origins, phases.states(model, y, origins, HOUR, params), strict=True):
            got, status = phases.predict_state(model, state, 30, HOUR, params)
            want, why = models.run_model(fns, name, y[:o], 30, HOUR, params)
            assert (got is None) == (want is None), (o, status, why)
            if want is not None:
                np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(y[np.isfinite(y)]).max())


MODELS = {"SeasonalNaive": {}, "LastValue": {}, "FFT": {"trend": "none"},
          "ExponentialSmoothing": {"trend": "none", "seasonal": "additive", "seasonal_periods": "24"}, "Prophet": {}}


@pytest.fixture(scope="module")
def arrays(spark):
    short = daily(40, 9, 1.0)
    return ops.series_arrays(frame(spark, {"a": daily(400, 1, 6.0), "b": np.tile(np.arange(24.0), 15), "c": short, "d": [1.0, 2.0, 3.0]}))


@pytest.mark.parametrize("backward,forward,part", [(36, 24, "test"), (5, 7, "val"), (10, 1, "test")])
def test_walk_equals_the_back_test(arrays, backward, forward, part):
    choices, forecasts = select.ensemble_backtest(arrays, MODELS, backward, forward, HOUR, part=part)
    got = {(r.series_id, r.step_idx): r for r in walk.ensemble_walk(arrays, MODELS, backward, forward, HOUR, part=part).collect()}
    want = {(r.series_id, r.step_idx): r for r in forecasts.collect()}
    assert set(got) == set(want) and len(got) > 50
    for key, r in want.items():
        assert got[key].model == r.model and got[key].block == r.block
        assert np.isclose(got[key].y_hat, r.y_hat, rtol=1e-9, atol=1e-9)
    best = {(r.series_id, r.block): r for r in choices.collect()}
    for r in got.values():
        own = best[r.series_id, r.block].best_rmse
        assert (r.best_rmse is None) == (own is None) and (own is None or np.isclose(r.best_rmse, own, rtol=1e-9, atol=1e-9))


def test_every_window_of_the_cube_equals_its_back_test(arrays):
    windows = [1, 4, 9, 30]
    few = {k: MODELS[k] for k in ("SeasonalNaive", "LastValue", "Prophet")}
    got = {(r.series_id, r.backward_window): r.rmse for r in walk.tune_windows(arrays, few, windows, 6, HOUR).collect()}
    want = {(r.series_id, r.backward_window): r.rmse for r in select.tune_ensemble(arrays, few, windows, 6, HOUR).collect()}
    assert set(got) == set(want)
    assert all(np.isclose(got[k], v, rtol=1e-9, atol=1e-9) for k, v in want.items())


def test_each_prefix_is_fitted_once(arrays):
    """43 windows ask for the same prefixes: the number of fits is that of different prefixes."""
    y, seen = daily(100, 1, 1.0), []

    def fit(values, step_s, params):
        seen.append(len(values))
        return {"level": values[-1:]}

    model = phases.Phases(fit, phases._constant)
    list(phases.states(model, y, [60, 70, 80], HOUR, {}))
    assert seen == [60, 70, 80]
    walked = phases.phase_functions()["ExponentialSmoothing"]
    assert walked.walk is not None and phases.phase_functions()["FFT"].walk is None


def test_a_users_model_takes_part(spark, arrays):
    models.register_model("Halves", lambda y, horizon, step_s, params: np.full(horizon, y[-1] / 2))
    phases.register_phases("Top", lambda y, step_s, params: {"level": np.array([y.max()])}, phases._constant)
    try:
        both = {"Halves": {}, "Top": {}}
        rows = walk.ensemble_walk(arrays, both, 5, 4, HOUR, initial="Top").collect()
        assert {r.model for r in rows} <= set(both) and {r.model for r in rows if r.block == 0} == {"Top"}
        fitted = phases.fit_models(arrays, both, HOUR)
        done = phases.predict_models(fitted, 2, HOUR).where("series_id = 'd'").collect()
        assert sorted((r.model, r.step_idx, r.y_hat) for r in done) == [("Halves", 3, 1.5), ("Halves", 4, 1.5), ("Top", 3, 3.0), ("Top", 4, 3.0)]
        assert models.forecast(arrays, {"Top": {}}, 1, HOUR).where("series_id = 'd'").first().y_hat == 3.0
    finally:
        del models.MODELS["Halves"], models.MODELS["Top"], phases.PHASES["Top"]


def test_stored_models_predict_like_the_one_call_functions(spark, arrays, tmp_path):
    path = str(tmp_path / "models")
    phases.write_models(phases.fit_models(arrays, MODELS, HOUR), path)
    stored = spark.read.parquet(path)
    got = {(r.series_id, r.model, r.step_idx): (r.y_hat, r.status) for r in phases.predict_models(stored, 5, HOUR).collect()}
    want = {(r.series_id, r.model, r.step_idx): (r.y_hat, r.status) for r in models.forecast(arrays, MODELS, 5, HOUR).collect()}
    ok = {k: v for k, v in want.items() if v[1] == "ok"}
    assert ok and {k for k, v in got.items() if v[1] == "ok"} == set(ok)
    assert all(np.isclose(got[k][0], v[0], rtol=1e-9, atol=1e-9) for k, v in ok.items())
    assert {(k[0], k[1]) for k, v in got.items() if v[1] != "ok"} == {(k[0], k[1]) for k, v in want.items() if v[1] != "ok"}
    assert stored.where(F.col("series_id") == "a").select("model").distinct().count() == len(MODELS)


def test_ensembles_are_timed(arrays):
    timed = {r.series_id: r for r in walk.ensemble_timings(walk.walk_blocks(arrays, MODELS, 9, 6, HOUR), len(MODELS)).collect()}
    blocks = -(-(400 - 280 - 60) // 6)
    assert timed["a"].evaluations == 1 + (blocks - 1) * (len(MODELS) + 1)
    assert timed["a"].fit_s > 0 and timed["a"].predict_s > 0


def test_separate_clocks(spark, arrays):
    log = phases.phase_timings(arrays, {"Prophet": {}, "LastValue": {}}, HOUR).collect()
    assert len(log) == 16 and all(r.fit_s >= 0 and r.predict_s >= 0 and r.evaluations == 1 for r in log)
    assert {r.split for r in log} == {"val", "test"}
