"""Exponential smoothing with continuous weights and estimated start states.

The one-step errors and their derivatives by weights and start states are carried through one recursion, over many
series of a length at once. A damped Gauss-Newton step with bounds on the weights follows; it is only taken where it
lowers the squared error, so the result is never worse than where it starts, the best point of a grid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidegauge.functions import lag_for_step
from tidegauge.operators.models import _choice, _flag, _none

# Weights in the order of the parameter vector, with their bounds and the values a search starts from.
BOUNDS = {"alpha": (1e-4, 0.9999), "beta": (0.0, 0.9999), "gamma": (0.0, 0.9999), "phi": (0.8, 0.98)}
STARTS = {"alpha": (0.02, 0.1, 0.3, 0.6, 0.9), "beta": (0.01, 0.1, 0.4), "gamma": (0.02, 0.2, 0.6), "phi": (0.9,)}


@dataclass(frozen=True)
class Form:
    """Which parts a model has; a season of period 1 is none."""

    trend: bool
    damped: bool
    period: int

    @classmethod
    def of(cls, step_s: int, params: dict) -> Form:
        trend = _choice(params, "trend", ("additive",)) is not None
        period = 1
        if _choice(params, "seasonal", ("additive",)):
            given = params.get("seasonal_periods")
            period = lag_for_step(step_s, generalize=True) if _none(given) else int(float(given))
        return cls(trend, trend and _flag(params.get("damped", False)), period)

    @property
    def weights(self) -> list[str]:
        return ["alpha", *["beta"] * self.trend, *["gamma"] * (self.period > 1), *["phi"] * self.damped]

    def free(self) -> np.ndarray:
        """Places of the estimated parameters among (alpha, beta, gamma, phi, level, slope, season…)."""
        some = [list(BOUNDS).index(w) for w in self.weights] + [4] + [5] * self.trend
        return np.array(some + (list(range(6, 6 + self.period)) if self.period > 1 else []))


def start_states(y: np.ndarray, form: Form) -> np.ndarray:
    """Level, slope and season of every row from its first periods."""
    m = form.period
    if m > 1:
        first, second = y[:, :m].mean(1), y[:, m:2 * m].mean(1)
        season, slope = y[:, :m] - first[:, None], (second - first) / m
    else:
        first, season, slope = y[:, 0], np.zeros((len(y), 1)), y[:, 1] - y[:, 0]
    return np.column_stack([first, slope if form.trend else np.zeros(len(y)), season])


def recursion(y: np.ndarray, theta: np.ndarray, form: Form, derive: bool = True):
    """Squared error, gradient and Gauss-Newton matrix of every row at its parameters, and the last states."""
    rows, n = y.shape
    m, size = form.period, theta.shape[1]
    alpha, beta, gamma, phi, level, slope = (theta[:, i].copy() for i in range(6))
    season = theta[:, 6:].copy()
    sse = np.zeros(rows)
    if derive:
        unit = np.eye(size)
        d_level, d_slope = np.tile(unit[4], (rows, 1)), np.tile(unit[5], (rows, 1))
        d_season = np.tile(unit[6:], (rows, 1, 1))
        gradient, matrix = np.zeros((rows, size)), np.zeros((rows, size, size))
    for t in range(n):
        at = t % m
        s = season[:, at]
        ahead = level + phi * slope
        miss = y[:, t] - ahead - s
        sse += miss * miss
        step, back = alpha * miss, gamma * (1 - alpha)
        if derive:
            d_ahead = d_level + phi[:, None] * d_slope + slope[:, None] * unit[3]
            d_miss = -(d_ahead + d_season[:, at])
            gradient += d_miss * miss[:, None]
            matrix += d_miss[:, :, None] * d_miss[:, None, :]
            d_step = alpha[:, None] * d_miss + miss[:, None] * unit[0]
            d_slope = phi[:, None] * d_slope + slope[:, None] * unit[3] + step[:, None] * unit[1] + beta[:, None] * d_step
            d_season[:, at] += (back[:, None] * d_miss + ((1 - alpha) * miss)[:, None] * unit[2]
                                - (gamma * miss)[:, None] * unit[0])
            d_level = d_ahead + d_step
        level = ahead + step
        slope = phi * slope + beta * step
        season[:, at] = s + back * miss
    states = level, slope, season
    return (sse, gradient, matrix, states) if derive else (sse, states)


def fit(y: np.ndarray, form: Form, rounds: int = 60) -> np.ndarray:
    """Parameters of every row `(alpha, beta, gamma, phi, level, slope, season…)`."""
    if y.shape[1] < max(2, 2 * form.period * (form.period > 1)):
        raise ValueError("seasonal smoothing needs two full periods" if form.period > 1 else "smoothing needs two points")
    low = np.array([BOUNDS[w][0] for w in BOUNDS])
    high = np.array([BOUNDS[w][1] for w in BOUNDS])
    states = start_states(y, form)
    grid = np.array(np.meshgrid(*[STARTS[w] if w in form.weights else ((1.0,) if w == "phi" else (0.0,)) for w in BOUNDS],
                                indexing="ij")).reshape(4, -1).T
    best, least = None, np.full(len(y), np.inf)
    for point in grid:
        theta = np.column_stack([np.tile(point, (len(y), 1)), states])
        sse, _ = recursion(y, theta, form, derive=False)
        sse = np.where(np.isfinite(sse), sse, np.inf)
        best = theta if best is None else np.where((sse < least)[:, None], theta, best)
        least = np.minimum(sse, least)
    free, theta = form.free(), best
    weights = free[free < 4]
    damping = np.full(len(y), 1e-3)
    live = np.isfinite(least)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            own = np.flatnonzero(live)
            if not len(own):
                break
            _, gradient, matrix, _ = recursion(y[own], theta[own], form)
            g, a = gradient[:, free], matrix[:, free][:, :, free]
            # A weight at its bound that the error pushes outwards stays there for this step.
            at = theta[own][:, weights]
            stuck = ((at <= low[weights]) & (g[:, :len(weights)] > 0)) | ((at >= high[weights]) & (g[:, :len(weights)] < 0))
            held = np.concatenate([stuck, np.zeros((len(own), len(free) - len(weights)), bool)], axis=1)
            g = np.where(held, 0.0, g)
            a = np.where(held[:, :, None] | held[:, None, :], 0.0, a)
            diagonal = np.einsum("rii->ri", a)
            scale = np.maximum(diagonal, 1e-12 * diagonal.max(1, keepdims=True) + 1e-300)
            a = a + np.einsum("ri,ij->rij", damping[own][:, None] * scale + held, np.eye(len(free)))
            move = np.linalg.solve(a + 1e-300, -g[:, :, None])[:, :, 0]
            trial = theta[own].copy()
            trial[:, free] += move
            trial[:, weights] = np.clip(trial[:, weights], low[weights], high[weights])
            sse, _ = recursion(y[own], trial, form, derive=False)
            better = np.isfinite(sse) & (sse < least[own])
            gain = np.where(better, (least[own] - sse) / np.maximum(least[own], 1e-300), 0.0)
            theta[own[better]] = trial[better]
            least[own[better]] = sse[better]
            damping[own] = np.where(better, damping[own] / 5, damping[own] * 4).clip(1e-9, 1e12)
            live[own] = np.where(better, gain > 1e-10, damping[own] < 1e8)
    return theta


def ahead(states: tuple[np.ndarray, np.ndarray, np.ndarray], phi: np.ndarray, n: int, horizon: int) -> np.ndarray:
    """Forecast of every row from its last states."""
    level, slope, season = states
    h = np.arange(1, horizon + 1)
    damp = np.cumsum(phi[:, None] ** h, axis=1)
    return level[:, None] + damp * slope[:, None] + season[:, (n + h - 1) % season.shape[1]]


def fixed(y: np.ndarray, form: Form, params: dict) -> np.ndarray:
    """The parameter vector of given weights, with the start states of the first periods."""
    given = [float(params.get(w, 1.0 if w == "phi" else 0.0)) for w in BOUNDS]
    return np.column_stack([np.tile(given, (len(y), 1)), start_states(y, form)])


def smooth_state(y: np.ndarray, step_s: int, params: dict) -> dict[str, np.ndarray]:
    """State of one series: fitted weights and start states, or given weights if `alpha` is among the parameters."""
    form = Form.of(step_s, params)
    row = np.asarray(y, dtype=float)[None, :]
    if row.shape[1] < max(2, 2 * form.period * (form.period > 1)):
        raise ValueError("seasonal smoothing needs two full periods" if form.period > 1 else "smoothing needs two points")
    theta = fixed(row, form, params) if "alpha" in params else fit(row, form)
    sse, (level, slope, season) = recursion(row, theta, form, derive=False)
    return {"level": level, "slope": slope, "season": season[0], "phi": theta[:, 3], "weights": theta[0, :4],
            "start": theta[0, 4:], "n": np.array([float(row.shape[1])]), "sse": sse}


def smooth_ahead(state: dict, horizon: int, step_s: int, params: dict) -> np.ndarray:
    parts = tuple(np.asarray(state[k]) for k in ("level", "slope"))
    return ahead((*parts, np.asarray(state["season"])[None, :]), np.asarray(state["phi"]), int(state["n"][0]), horizon)[0]
