"""Continuous smoothing weights: derivatives, bounds, and errors never above a fine grid's."""

import itertools

import numpy as np
import pytest

from tidegauge.operators import models, phases, smoothing
from test_models import HOUR, daily

FORMS = [smoothing.Form(False, False, 1), smoothing.Form(True, False, 1), smoothing.Form(True, True, 12), smoothing.Form(False, False, 24)]


def rows(n=200):
    rnd = np.random.default_rng(5)
    walk = np.cumsum(rnd.normal(size=n))
    return np.stack([daily(n, 1, 3.0), 100 + walk, np.full(n, 4.0), daily(n, 2, 0.0), np.where(np.arange(n) < n // 2, 1.0, 50.0)])


@pytest.mark.parametrize("form", FORMS)
def test_derivatives(form):
    y = rows(60)[:2]
    theta = np.column_stack([np.tile([0.3, 0.2 * form.trend, 0.1 * (form.period > 1), 0.9 if form.damped else 1.0], (2, 1)),
                             smoothing.start_states(y, form)])
    sse, gradient, _, _ = smoothing.recursion(y, theta, form)
    for i in form.free():
        far = theta.copy()
        far[:, i] += 1e-6
        near = theta.copy()
        near[:, i] -= 1e-6
        slope = (smoothing.recursion(y, far, form, False)[0] - smoothing.recursion(y, near, form, False)[0]) / 2e-6
        np.testing.assert_allclose(2 * gradient[:, i], slope, rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("form", FORMS)
def test_never_worse_than_a_fine_grid(form):
    y = rows()
    theta = smoothing.fit(y, form)
    sse, _ = smoothing.recursion(y, theta, form, derive=False)
    fine = {"alpha": np.linspace(0.02, 0.98, 13), "beta": np.linspace(0.01, 0.6, 5), "gamma": np.linspace(0.01, 0.7, 5), "phi": (0.8, 0.9, 0.98)}
    states = smoothing.start_states(y, form)
    for point in itertools.product(*[fine[w] if w in form.weights else ((1.0,) if w == "phi" else (0.0,)) for w in smoothing.BOUNDS]):
        with np.errstate(all="ignore"):
            other, _ = smoothing.recursion(y, np.column_stack([np.tile(point, (len(y), 1)), states]), form, derive=False)
        assert (sse <= np.where(np.isfinite(other), other, np.inf) * (1 + 1e-6) + 1e-6).all(), point
    for i, w in enumerate(smoothing.BOUNDS):
        if w in form.weights:
            assert (theta[:, i] >= smoothing.BOUNDS[w][0]).all() and (theta[:, i] <= smoothing.BOUNDS[w][1]).all()


def test_rows_do_not_depend_on_their_neighbours():
    y, form = rows(), smoothing.Form(True, True, 12)
    together = smoothing.fit(y, form)
    for i in range(len(y)):
        alone = smoothing.fit(y[i:i + 1], form)
        a, _ = smoothing.recursion(y[i:i + 1], alone, form, False)
        b, _ = smoothing.recursion(y[i:i + 1], together[i:i + 1], form, False)
        assert np.isclose(a, b, rtol=1e-6, atol=1e-9)


def test_model_is_registered_and_exact_on_a_season():
    y = np.tile(np.arange(24.0), 10)
    out, status = models.run_model(models.model_functions(), "Smoothing", y, 48, HOUR, {"seasonal": "additive", "seasonal_periods": "24"})
    assert status == "ok" and np.allclose(out, np.tile(np.arange(24.0), 2), atol=1e-6)
    state = phases.fit_state(phases.PHASES["Smoothing"], y, HOUR, {"trend": "none"})
    assert 0 < state["weights"][0] < 1
    assert models.run_model(models.model_functions(), "Smoothing", y[:30], 2, HOUR, {"seasonal": "additive", "seasonal_periods": "24"})[0] is None


def test_sparse_trend_changes():
    """Optimality of every solution, fewer changes with a larger penalty, none at the largest, all columns at none."""
    t = np.arange(400.0)
    y = 10 + 0.05 * t + 0.3 * np.maximum(0, t - 160) - 0.4 * np.maximum(0, t - 240) + daily(400, 3, 1.0)
    params = {"n_changepoints": "25", "weekly_seasonality": "false", "yearly_seasonality": "false"}
    x, ridge = models.additive_design(t, HOUR, 399.0, params)
    changes, left = models.trend_changes(params), []
    ridge[changes] = 0.0
    for share in (1e-4, 1e-3, 0.01, 0.05, 0.3, 1.0):
        beta, weight = models.solve_sparse(x.T @ x, x.T @ y, ridge, changes, share)
        pull = x.T @ (y - x @ beta) - (ridge + 1e-9) * beta
        others = np.delete(pull, np.arange(len(pull))[changes])
        delta, own = beta[changes], pull[changes]
        assert np.abs(others).max() <= 1e-6 * np.abs(x.T @ y).max()
        assert np.allclose(own[delta != 0], weight * np.sign(delta[delta != 0]), rtol=1e-5, atol=1e-6 * weight)
        assert (np.abs(own[delta == 0]) <= weight * (1 + 1e-6)).all()
        left.append(int((delta != 0).sum()))
    assert left == sorted(left, reverse=True) and left[-1] == 0 and left[0] > left[3] >= 1
    a = models.run_model(models.model_functions(), "Prophet", y, 20, HOUR, params | {"changepoint_penalty": "0.05"})[0]
    state = phases.fit_state(phases.PHASES["Prophet"], y, HOUR, params | {"changepoint_penalty": "0.05"})
    b = phases.predict_state(phases.PHASES["Prophet"], state, 20, HOUR, params | {"changepoint_penalty": "0.05"})[0]
    assert np.allclose(a, b)
