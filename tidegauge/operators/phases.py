"""Forecast models in two phases: a fit leaves a state, a prediction needs nothing else.

A state is a map from names to arrays of doubles, so it travels and is stored as a plain column: `fit_models` writes a
table of fitted models, `predict_models` reads it, and a fit serves any number of predictions. `walk` gives the states
after many prefixes of one series in a single pass where the model has a recursion or sums to carry on.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import lag_for_step
from tidegauge.operators.models import (
    MODELS, Model, _choice, _flag, _none, _params, additive_design, filled, solve_additive, split_sizes, spread, with_models,
)
from tidegauge.operators.smoothing import smooth_ahead, smooth_state
from tidegauge.session import fresh_path

State = dict[str, np.ndarray]
Fit = Callable[[np.ndarray, int, dict], State]
Predict = Callable[[State, int, int, dict], np.ndarray]
Walk = Callable[[np.ndarray, Sequence[int], int, dict], Iterator["State | Exception"]]


@dataclass(frozen=True)
class Phases:
    """`fit(y, step_s, params)`, `predict(state, horizon, step_s, params)`, and for models that can carry on,
    `walk(y, origins, step_s, params)`: the state, or why there is none, after the first `o` values for every origin
    `o`, in ascending order."""

    fit: Fit
    predict: Predict
    walk: Walk | None = None


PHASES: dict[str, Phases] = {}


def register_phases(name: str, fit: Fit, predict: Predict, walk: Walk | None = None, search_space: dict | None = None) -> None:
    """Makes a two-phase model known by name, to the one-call functions too."""
    from tidegauge.operators.models import register_model

    PHASES[name] = Phases(fit, predict, walk)
    if name not in MODELS:
        register_model(name, lambda y, horizon, step_s, params: predict(fit(y, step_s, params), horizon, step_s, params),
                       search_space)


def _one_call(fn: Model) -> Phases:
    """A model that fits and predicts in one call keeps its series as state."""
    return Phases(lambda y, step_s, params: {"y": y},
                  lambda state, horizon, step_s, params: fn(np.asarray(state["y"]), horizon, step_s, params))


def phase_functions() -> dict[str, Phases]:
    """Of every registered model, to travel with a task."""
    return {name: PHASES.get(name) or _one_call(r.fn) for name, r in MODELS.items()}


def fit_state(model: Phases, values, step_s: int, params: dict) -> State | Exception:
    try:
        return model.fit(filled(np.asarray(values, dtype=float)), step_s, params)
    except Exception as exc:  # noqa: BLE001
        return exc


def predict_state(model: Phases, state: State | Exception, horizon: int, step_s: int,
                  params: dict) -> tuple[np.ndarray | None, str]:
    """Forecast and status; a failed fit or prediction becomes a status."""
    if isinstance(state, Exception):
        return None, f"failed: {state}"
    try:
        return np.asarray(model.predict(state, horizon, step_s, params), dtype=float), "ok"
    except Exception as exc:  # noqa: BLE001
        return None, f"failed: {exc}"


def states(model: Phases, values, origins: Sequence[int], step_s: int, params: dict) -> Iterator[State | Exception]:
    """The state after the first `o` values for every origin `o` in ascending order.

    One pass where the model can carry on and no value is missing: filling a gap needs the value after it, so a
    prefix that ends in a gap is another series.
    """
    y = np.asarray(values, dtype=float)
    if model.walk is None or not np.isfinite(y).all():
        for o in origins:
            yield fit_state(model, y[:o], step_s, params)
        return
    walked = model.walk(y, origins, step_s, params)
    for o in origins:
        try:
            yield next(walked)
        except Exception as exc:  # noqa: BLE001
            for _ in origins[list(origins).index(o):]:
                yield exc
            return


# ---- look-ups and means -----------------------------------------------------------------------------


def _lag(step_s: int, params: dict) -> int:
    return int(params.get("lag", lag_for_step(step_s, generalize=True)))


def _season(y: np.ndarray, step_s: int, params: dict) -> State:
    if not len(y):
        raise ValueError("no observation")
    m = _lag(step_s, params)
    return {"season": y[-m:] if len(y) >= m else y[-1:]}


def _look_up(state: State, horizon: int, step_s: int, params: dict) -> np.ndarray:
    season = np.asarray(state["season"])
    return season[np.arange(horizon) % len(season)]


def _constant(state: State, horizon: int, step_s: int, params: dict) -> np.ndarray:
    return np.full(horizon, state["level"][0])


def _prefixes(one: Fit) -> Walk:
    """States that cost no more than a slice."""

    def walk(y, origins, step_s, params):
        for o in origins:
            try:
                yield one(y[:o], step_s, params)
            except ValueError as exc:
                yield exc

    return walk


def _last(y: np.ndarray, step_s: int, params: dict) -> State:
    if not len(y):
        raise ValueError("no observation")
    return {"level": y[-1:]}


def _mean(y: np.ndarray, step_s: int, params: dict) -> State:
    if not len(y):
        raise ValueError("no observation")
    return {"level": np.array([y.sum() / len(y)])}


def _mean_walk(y, origins, step_s, params):
    sums = np.concatenate([[0.0], np.cumsum(y)])
    for o in origins:
        yield {"level": np.array([sums[o] / o])} if o else ValueError("no observation")


# ---- smoothing --------------------------------------------------------------------------------------


def _smoothing_walk(y, origins, step_s, params):
    """Every weight combination of the grid runs through the recursion once; at an origin the one with the least
    error so far is the fit."""
    kinds = ("additive", "multiplicative")
    trend, seasonal = _choice(params, "trend", kinds), _choice(params, "seasonal", kinds)
    grows, scales = trend == "multiplicative", seasonal == "multiplicative"
    low = np.flatnonzero(y <= 0) if grows or scales else np.zeros(0, int)
    damped = trend is not None and _flag(params.get("damped", False))
    m = 1
    if seasonal:
        period = params.get("seasonal_periods")
        m = lag_for_step(step_s, generalize=True) if _none(period) else int(float(period))
    grid = np.array(list(itertools.product(
        (0.02, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95),
        (0.01, 0.05, 0.2, 0.5) if trend else (0.0,),
        (0.02, 0.1, 0.3, 0.6) if seasonal else (0.0,),
        (0.8, 0.9, 0.98) if damped else (1.0,),
    )))
    alpha, beta, gamma, phi = grid.T
    g, t, begun = len(grid), 0, False
    for o in origins:
        if len(low) and o > low[0]:
            yield ValueError("multiplicative smoothing needs positive values")
            continue
        if seasonal and o < 2 * m:
            yield ValueError("seasonal smoothing needs two full periods")
            continue
        if o < 2:
            yield ValueError("smoothing needs two points")
            continue
        if not begun:
            begun = True
            if seasonal:
                first, second = y[:m].mean(), y[m: 2 * m].mean()
                season = np.repeat((y[:m] / first if scales else y[:m] - first)[:, None], g, axis=1)
                growth = (second / first) ** (1 / m) if grows else (second - first) / m
            else:
                first, season = y[0], np.zeros((1, g))
                growth = y[1] / y[0] if grows else y[1] - y[0]
            level, slope = np.full(g, first), np.full(g, growth if trend else 0.0)
            sse = np.zeros(g)
        with np.errstate(all="ignore"):
            for t in range(t, o):
                value, s = y[t], season[t % m]
                ahead = level * slope**phi if grows else level + phi * slope
                miss = value - (ahead * s if scales else ahead + s)
                sse += miss * miss
                step = alpha * (miss / s if scales else miss)
                new = ahead + step
                slope = slope**phi + beta * (new / level - slope**phi) if grows else phi * slope + beta * step
                season[t % m] = s + gamma * (value / new - s if scales else (1 - alpha) * miss)
                level = new
            t = o
        score = np.where(np.isfinite(sse), sse, np.inf)
        best = int(np.argmin(score))
        if not np.isfinite(score[best]):
            yield ValueError("smoothing left the range of its values")
            continue
        yield {
            "level": level[[best]], "slope": slope[[best]], "phi": phi[[best]], "n": np.array([float(o)]),
            "season": season[:, best].copy(), "form": np.array([float(grows), float(scales), float(damped)]),
        }


def _one_state(walk: Walk) -> Fit:
    def fit(y, step_s, params):
        state = next(walk(y, [len(y)], step_s, params))
        if isinstance(state, Exception):
            raise state
        return state

    return fit


def _smoothed(state: State, horizon: int, step_s: int, params: dict) -> np.ndarray:
    grows, scales, damped = (bool(x) for x in state["form"])
    level, slope, phi, n = (float(state[k][0]) for k in ("level", "slope", "phi", "n"))
    season = np.asarray(state["season"])
    h = np.arange(1, horizon + 1)
    damp = np.cumsum(phi ** h) if damped else h
    base = level * slope ** damp if grows else level + damp * slope
    at_season = season[(int(n) + h - 1) % len(season)]
    return base * at_season if scales else base + at_season


# ---- spectrum ---------------------------------------------------------------------------------------


def _spectral_fit(y, step_s, params):
    """Trend coefficients and the strongest frequencies. Another length has other frequencies, so no pass is shared."""
    n = len(y)
    if n < 4:
        raise ValueError("spectral forecast needs at least 4 points")
    coef = np.zeros(1)
    if _choice(params, "trend", ("poly",)):
        coef = np.polyfit(np.arange(n) / max(n - 1, 1), y, int(params.get("poly_degree", 3)))
    freq = np.fft.rfft(y - np.polyval(coef, np.arange(n) / max(n - 1, 1)))
    keep = np.argsort(-np.abs(freq), kind="stable")[: int(params.get("n_freqs", 10))]
    weight = np.where((keep == 0) | ((n % 2 == 0) & (keep == n // 2)), 1.0, 2.0) / n
    wave = weight * freq[keep]
    return {"n": np.array([float(n)]), "trend": coef, "k": keep.astype(float), "re": wave.real, "im": wave.imag}


def _spectral_predict(state, horizon, step_s, params):
    n = int(state["n"][0])
    ahead = n + np.arange(horizon)
    angle = 2j * np.pi * np.outer(ahead, np.asarray(state["k"])) / n
    wave = (np.exp(angle) * (np.asarray(state["re"]) + 1j * np.asarray(state["im"]))).real.sum(axis=1)
    return wave + np.polyval(np.asarray(state["trend"]), ahead / max(n - 1, 1))


# ---- additive regression ----------------------------------------------------------------------------

SEASONS = (("daily_seasonality", 1.0, 4, 2.0), ("weekly_seasonality", 7.0, 3, 14.0), ("yearly_seasonality", 365.25, 10, 730.0))


def _additive_walk(y, origins, step_s, params):
    """Running sums of every product of columns; a design is scaled by its length, so an origin puts its XtX together
    from sums up to it and up to its trend changes."""
    last = max(origins, default=0)
    y = y[:last]
    t = np.arange(last, dtype=float)
    waves, owner = [], []
    for name, period_d, order, _ in SEASONS:
        if str(params.get(name, "auto")).lower() in ("true", "auto"):
            phase = 2 * np.pi * t * step_s / (period_d * 86400.0)
            for k in range(1, order + 1):
                waves += [np.cos(k * phase), np.sin(k * phase)]
                owner += [name, name]
    f = np.stack(waves, axis=1) if waves else np.zeros((last, 0))
    plain = np.column_stack([np.ones(last), t, y])  # what a trend column is multiplied with, next to the waves
    both = np.concatenate([plain, f], axis=1)
    sums = [np.concatenate([np.zeros((1, both.shape[1])), np.cumsum(both * w[:, None], axis=0)]) for w in (np.ones(last), t)]
    gram, done = np.zeros((f.shape[1], f.shape[1])), 0
    cross = np.zeros(f.shape[1])
    n_changes = int(params.get("n_changepoints", 10))
    shares = np.linspace(0, 0.8, n_changes + 1)[1:] if n_changes else np.zeros(0)
    for o in origins:
        gram += f[done:o].T @ f[done:o]
        cross += f[done:o].T @ y[done:o]
        done = o
        if o < 2:
            yield ValueError("additive regression needs two points")
            continue
        scale = float(max(o - 1, 1))
        days = scale * step_s / 86400.0
        use = np.array([str(params.get(name, "auto")).lower() == "true" or days >= wanted
                        for name in owner for n, _, _, wanted in SEASONS if n == name], dtype=bool)
        # Trend columns: 1, t and max(0, t - knot), each as a + b t from a first step on.
        starts = np.concatenate([[0, 0], np.floor(shares * scale) + 1]).astype(int).clip(max=o)
        a = np.concatenate([[1.0, 0.0], -shares])
        b = np.concatenate([[0.0, 1 / scale], np.full(len(shares), 1 / scale)])
        k = len(a)

        def over(start: int) -> tuple[np.ndarray, np.ndarray]:
            """Sums from `start` to the origin of both columns, plain and times t."""
            return sums[0][o] - sums[0][start], sums[1][o] - sums[1][start]

        trend, trend_y, mixed = np.zeros((k, k)), np.zeros(k), np.zeros((k, f.shape[1]))
        at = [over(s) for s in starts]
        for i in range(k):
            zero, one = at[i]
            trend_y[i] = a[i] * zero[2] + b[i] * one[2]
            mixed[i] = a[i] * zero[3:] + b[i] * one[3:]
            for j in range(i, k):
                zero, one = at[i if starts[i] >= starts[j] else j]
                trend[i, j] = trend[j, i] = a[i] * a[j] * zero[0] + (a[i] * b[j] + a[j] * b[i]) * zero[1] + b[i] * b[j] * one[1]
        mixed = mixed[:, use]
        xtx = np.block([[trend, mixed], [mixed.T, gram[np.ix_(use, use)]]])
        xty = np.concatenate([trend_y, cross[use]])
        _, ridge = additive_design(np.zeros(1), step_s, scale, params)
        yield {"beta": solve_additive(xtx, xty, ridge, params), "n": np.array([float(o)])}


def _additive_fit(y, step_s, params):
    n = len(y)
    if n < 2:
        raise ValueError("additive regression needs two points")
    x, ridge = additive_design(np.arange(n, dtype=float), step_s, float(max(n - 1, 1)), params)
    return {"beta": solve_additive(x.T @ x, x.T @ y, ridge, params), "n": np.array([float(n)])}


def _additive_predict(state, horizon, step_s, params):
    n = int(state["n"][0])
    ahead, _ = additive_design(n + np.arange(horizon, dtype=float), step_s, float(max(n - 1, 1)), params)
    return ahead @ np.asarray(state["beta"])


register_phases("SeasonalNaive", _season, _look_up, _prefixes(_season))
register_phases("LastValue", _last, _constant, _prefixes(_last))
register_phases("Mean", _mean, _constant, _mean_walk)
register_phases("ExponentialSmoothing", _one_state(_smoothing_walk), _smoothed, _smoothing_walk)
register_phases("Smoothing", smooth_state, smooth_ahead, search_space={
    "trend": ["additive", "none"], "seasonal": ["additive", "none"], "damped": ["true", "false"], "seasonal_periods": (2, 48)})
register_phases("FFT", _spectral_fit, _spectral_predict)
register_phases("Prophet", _additive_fit, _additive_predict, _additive_walk)


# ---- fitted models as a table -----------------------------------------------------------------------

STATE = "map<string,array<double>>"


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _pairs(value) -> State:
    """A state arrives as a dict or as a list of pairs, by Arrow version."""
    return {k: np.asarray(v, dtype=float) for k, v in dict(value).items()}


def fit_models(arrays: DataFrame, models: dict[str, dict] | DataFrame, step_s: int,
               keys: Sequence[str] = ("series_id",), until: str = "all") -> DataFrame:
    """One row per series and model: `(keys…, model, params, first_step, state, status, fit_s)`.

    `until` says what the fit sees: the training part, training and validation part (`val`), or all. Missing steps are
    filled before the fit; a failed fit has a status and no state.
    """
    n_train, n_val = split_sizes()
    end = {"train": n_train, "val": n_train + n_val, "all": F.size("values")}[until]
    units = with_models(arrays, models, keys).select(*keys, "model", "params", F.slice("values", F.lit(1), end).alias("values"))
    keep, fns = [*keys, "model"], phase_functions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                params, begun = _params(row["params"]), time.perf_counter()
                state = fit_state(fns[row["model"]], row["values"], step_s, params)
                spent, failed = time.perf_counter() - begun, isinstance(state, Exception)
                out.append([*[row[k] for k in keep], params, len(row["values"]),
                            None if failed else {k: np.asarray(v, dtype=float).tolist() for k, v in state.items()},
                            f"failed: {state}" if failed else "ok", spent])
            yield pd.DataFrame(out, columns=[*keep, "params", "first_step", "state", "status", "fit_s"])

    return spread(units, keep).mapInPandas(
        run, f"{_schema(units, keep)}, params map<string,string>, first_step bigint, state {STATE}, status string, fit_s double")


def write_models(fitted: DataFrame, folder: str, keys: Sequence[str] = ("series_id",)) -> None:
    """The model table, partitioned by series: a later read of some series prunes the others."""
    writer = fitted.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(folder)


def predict_models(fitted: DataFrame, horizon: int | str, step_s: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """`(keys…, model, step_idx, y_hat, status)` from stored states; `horizon` is a number or a column of `fitted`."""
    return _predictions(fitted, horizon, step_s, keys).select(
        *keys, "model", F.posexplode_outer("y_hat").alias("_h", "y_hat"), "first_step", "status"
    ).select(*keys, "model", (F.col("first_step") + F.coalesce("_h", F.lit(0))).alias("step_idx"), "y_hat", "status")


def _predictions(fitted: DataFrame, horizon: int | str, step_s: int, keys: Sequence[str]) -> DataFrame:
    """One row per fitted model with its forecast as an array and the seconds it took."""
    rows = fitted.withColumn("_n", F.lit(horizon) if isinstance(horizon, int) else F.col(horizon)).select(
        *keys, "model", "params", "first_step", "state", "status", "_n")
    keep, fns = [*keys, "model", "first_step"], phase_functions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                predicted, status, begun = None, row["status"], time.perf_counter()
                if row["state"] is not None:
                    predicted, status = predict_state(
                        fns[row["model"]], _pairs(row["state"]), int(row["_n"]), step_s, _params(row["params"]))
                spent = time.perf_counter() - begun
                out.append([*[row[k] for k in keep], None if predicted is None else predicted.tolist(), status, spent])
            yield pd.DataFrame(out, columns=[*keep, "y_hat", "status", "predict_s"])

    return rows.mapInPandas(run, f"{_schema(rows, keep)}, y_hat array<double>, status string, predict_s double")


def phase_timings(arrays: DataFrame, models: dict[str, dict] | DataFrame, step_s: int,
                  keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Log of the results stage with separate clocks: per series, model and hold-out part `(fit_s, predict_s, evaluations)`.

    The training part is fitted for the validation part, both for the test part. Fitted models are stored once, and the
    predictions read them.
    """
    spark = arrays.sparkSession
    n_train, n_val = split_sizes()
    sizes = arrays.select(*keys, n_val.alias("val"), (F.size("values") - n_train - n_val).alias("test"))
    parts = []
    for until, part in (("train", "val"), ("val", "test")):
        path = fresh_path(spark, "models")
        write_models(fit_models(arrays, models, step_s, keys, until), path, ())
        fitted = spark.read.parquet(path).join(sizes, list(keys))
        done = _predictions(fitted.withColumn("_h", F.col(part)), "_h", step_s, keys).select(*keys, "model", "predict_s")
        parts.append(fitted.select(*keys, "model", "fit_s").join(done, [*keys, "model"]).select(
            *keys, "model", F.lit(part).alias("split"), "fit_s", "predict_s", F.lit(1).cast("bigint").alias("evaluations")))
    return parts[0].unionByName(parts[1])
