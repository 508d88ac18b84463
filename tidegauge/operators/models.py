"""Forecast models as plug-ins, fitted per series inside Arrow batches.

A model is `fn(values, horizon, step_s, params) -> array of horizon floats`. Spark decides which
(series, model, split, block, trial) goes where; the functions below only hold the numeric core.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import lag_for_step

Model = Callable[[np.ndarray, int, int, dict], np.ndarray]


@dataclass(frozen=True)
class Registered:
    fn: Model
    search_space: dict = field(default_factory=dict)


MODELS: dict[str, Registered] = {}


def register_model(name: str, fn: Model, search_space: dict | None = None) -> None:
    """Makes a model known by name, with the values each parameter may take in a search."""
    MODELS[name] = Registered(fn, search_space or {})


def _flag(value) -> bool:
    return str(value).lower() == "true"


def _none(value) -> bool:
    return value is None or str(value).lower() in ("none", "null", "")


def _choice(params: dict, name: str, known: Sequence[str]) -> str | None:
    """The parameter's value, None where it is switched off; a value that is not known is an error."""
    value = params.get(name)
    if _none(value):
        return None
    if value not in known:
        raise ValueError(f"{name} must be none or one of {', '.join(known)}, got {value}")
    return value


def filled(values: np.ndarray) -> np.ndarray:
    """Missing steps by linear interpolation, edges by the nearest known value."""
    known = np.flatnonzero(np.isfinite(values))
    if len(known) == 0:
        raise ValueError("no observation")
    if len(known) == len(values):
        return values
    return np.interp(np.arange(len(values)), known, values[known])


def seasonal_naive(y: np.ndarray, horizon: int, step_s: int, params: dict) -> np.ndarray:
    m = int(params.get("lag", lag_for_step(step_s, generalize=True)))
    if len(y) < m:
        return np.full(horizon, y[-1])
    return y[len(y) - m + np.arange(horizon) % m]


def spectral(y: np.ndarray, horizon: int, step_s: int, params: dict) -> np.ndarray:
    """Trend off, the strongest frequencies kept and extended periodically, trend back on."""
    n = len(y)
    if n < 4:
        raise ValueError("spectral forecast needs at least 4 points")
    t, ahead = np.arange(n), n + np.arange(horizon)
    trend_t, trend_ahead = np.zeros(n), np.zeros(horizon)
    if _choice(params, "trend", ("poly",)):
        scale = max(n - 1, 1)
        coef = np.polyfit(t / scale, y, int(params.get("poly_degree", 3)))
        trend_t, trend_ahead = np.polyval(coef, t / scale), np.polyval(coef, ahead / scale)
    freq = np.fft.rfft(y - trend_t)
    keep = np.argsort(-np.abs(freq), kind="stable")[: int(params.get("n_freqs", 10))]
    weight = np.where((keep == 0) | ((n % 2 == 0) & (keep == n // 2)), 1.0, 2.0) / n
    angle = 2j * np.pi * np.outer(ahead, keep) / n
    return (np.exp(angle) * (weight * freq[keep])).real.sum(axis=1) + trend_ahead


def holt_winters(y: np.ndarray, horizon: int, step_s: int, params: dict) -> np.ndarray:
    """Exponential smoothing, trend and season additive or multiplicative; the weights are chosen by the one-step
    error over a grid.

    All weight combinations of the grid run through the recursion at once. Multiplicative parts need positive values.
    """
    kinds = ("additive", "multiplicative")
    trend, seasonal = _choice(params, "trend", kinds), _choice(params, "seasonal", kinds)
    grows, scales = trend == "multiplicative", seasonal == "multiplicative"
    if (grows or scales) and (y <= 0).any():
        raise ValueError("multiplicative smoothing needs positive values")
    damped = trend is not None and _flag(params.get("damped", False))
    m = 1
    if seasonal:
        period = params.get("seasonal_periods")
        m = lag_for_step(step_s, generalize=True) if _none(period) else int(float(period))
        if len(y) < 2 * m:
            raise ValueError("seasonal smoothing needs two full periods")
    if len(y) < 2:
        raise ValueError("smoothing needs two points")
    weights = np.array([0.02, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95])
    grid = np.array(list(itertools.product(
        weights,
        (0.01, 0.05, 0.2, 0.5) if trend else (0.0,),
        (0.02, 0.1, 0.3, 0.6) if seasonal else (0.0,),
        (0.8, 0.9, 0.98) if damped else (1.0,),
    )))
    alpha, beta, gamma, phi = grid.T
    g = len(grid)
    if seasonal:
        first, second = y[:m].mean(), y[m: 2 * m].mean()
        season = np.repeat((y[:m] / first if scales else y[:m] - first)[:, None], g, axis=1)
        growth = (second / first) ** (1 / m) if grows else (second - first) / m
    else:
        first, season = y[0], np.zeros((1, g))
        growth = y[1] / y[0] if grows else y[1] - y[0]
    level, slope = np.full(g, first), np.full(g, growth if trend else 0.0)
    sse = np.zeros(g)
    # A weight combination may leave the range in which powers and quotients exist; it is not chosen then.
    with np.errstate(all="ignore"):
        for t, value in enumerate(y):
            s = season[t % m]
            ahead = level * slope**phi if grows else level + phi * slope
            miss = value - (ahead * s if scales else ahead + s)
            sse += miss * miss
            step = alpha * (miss / s if scales else miss)
            new = ahead + step
            slope = slope**phi + beta * (new / level - slope**phi) if grows else phi * slope + beta * step
            season[t % m] = s + gamma * (value / new - s if scales else (1 - alpha) * miss)
            level = new
    sse[~np.isfinite(sse)] = np.inf
    best = int(np.argmin(sse))
    if not np.isfinite(sse[best]):
        raise ValueError("smoothing left the range of its values")
    h = np.arange(1, horizon + 1)
    damp = np.cumsum(phi[best] ** h) if damped else h
    base = level[best] * slope[best] ** damp if grows else level[best] + damp * slope[best]
    at_season = season[(len(y) + h - 1) % m, best]
    return base * at_season if scales else base + at_season


def additive_design(t: np.ndarray, step_s: int, scale: float, params: dict) -> tuple[np.ndarray, np.ndarray]:
    """Design matrix and ridge weights: intercept, slope, hinge trend changes, Fourier seasonality."""
    days = scale * step_s / 86400.0
    x = t / scale
    cols, ridge = [np.ones_like(x), x], [0.0, 1e-6]
    n_changes = int(params.get("n_changepoints", 10))
    for at in np.linspace(0, 0.8, n_changes + 1)[1:] if n_changes else []:
        cols.append(np.maximum(0.0, x - at))
        ridge.append(float(params.get("changepoint_ridge", 5.0)))
    for name, period_d, order, wanted_days in (
        ("daily_seasonality", 1.0, 4, 2.0), ("weekly_seasonality", 7.0, 3, 14.0), ("yearly_seasonality", 365.25, 10, 730.0)
    ):
        choice = str(params.get(name, "auto")).lower()
        use = choice == "true" or (choice == "auto" and days >= wanted_days)
        if not use:
            continue
        phase = 2 * np.pi * t * step_s / (period_d * 86400.0)
        for k in range(1, order + 1):
            cols += [np.cos(k * phase), np.sin(k * phase)]
            ridge += [0.01, 0.01]
    return np.stack(cols, axis=1), np.array(ridge)


def solve_ridge(xtx: np.ndarray, xty: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(xtx + np.diag(ridge + 1e-9), xty, rcond=None)[0]


def trend_changes(params: dict) -> slice:
    """Columns of the design that change the trend."""
    return slice(2, 2 + int(params.get("n_changepoints", 10)))


def solve_sparse(xtx: np.ndarray, xty: np.ndarray, ridge: np.ndarray, changes: slice, share: float,
                 sweeps: int = 20_000) -> tuple[np.ndarray, float]:
    """Coefficients with a Laplace prior on the trend changes, and the weight of their absolute sum.

    The weight is a share of the one at which no change is left. The other columns are solved for in closed form, so
    coordinate descent runs over the changes alone.
    """
    ridge = ridge.copy()
    ridge[changes] = 0.0
    gram = xtx + np.diag(ridge + 1e-9)
    c = np.arange(len(xty))[changes]
    f = np.setdiff1d(np.arange(len(xty)), c)
    through = np.linalg.lstsq(gram[np.ix_(f, f)], np.column_stack([gram[np.ix_(f, c)], xty[f]]), rcond=None)[0]
    a = gram[np.ix_(c, c)] - gram[np.ix_(c, f)] @ through[:, :-1]
    b = xty[c] - gram[np.ix_(c, f)] @ through[:, -1]
    weight = share * float(np.abs(b).max(initial=0.0))
    delta, pull = np.zeros(len(c)), b.copy()  # pull: b - a @ delta
    for sweep in range(sweeps):
        moved = 0.0
        for j in range(len(c)):
            if a[j, j] <= 0:
                continue
            z = pull[j] + a[j, j] * delta[j]
            new = np.sign(z) * max(abs(z) - weight, 0.0) / a[j, j]
            if new != delta[j]:
                pull -= a[:, j] * (new - delta[j])
                moved = max(moved, abs(new - delta[j]) * a[j, j])
                delta[j] = new
        if moved <= 1e-9 * max(weight, 1e-300):
            break
        if sweep % 50 == 49 and delta.any():
            # Neighbouring changes are alike and converge slowly: with the right ones and signs the rest is a solve.
            on = np.flatnonzero(delta)
            exact = np.linalg.lstsq(a[np.ix_(on, on)], b[on] - weight * np.sign(delta[on]), rcond=None)[0]
            rest = b - a[:, on] @ exact
            if (np.sign(exact) == np.sign(delta[on])).all() and (np.abs(np.delete(rest, on)) <= weight * (1 + 1e-9)).all():
                delta[on] = exact
                break
    out = np.zeros(len(xty))
    out[c], out[f] = delta, through[:, -1] - through[:, :-1] @ delta
    return out, weight


def solve_additive(xtx: np.ndarray, xty: np.ndarray, ridge: np.ndarray, params: dict) -> np.ndarray:
    """Ridge on the trend changes, or with `changepoint_penalty`, a share from 0 to 1, few changes by a Laplace prior."""
    share = params.get("changepoint_penalty")
    if _none(share):
        return solve_ridge(xtx, xty, ridge)
    return solve_sparse(xtx, xty, ridge, trend_changes(params), float(share))[0]


def additive(y: np.ndarray, horizon: int, step_s: int, params: dict) -> np.ndarray:
    n = len(y)
    if n < 2:
        raise ValueError("additive regression needs two points")
    scale = float(max(n - 1, 1))
    x, ridge = additive_design(np.arange(n, dtype=float), step_s, scale, params)
    ahead, _ = additive_design(n + np.arange(horizon, dtype=float), step_s, scale, params)
    return ahead @ solve_additive(x.T @ x, x.T @ y, ridge, params)


def last_value(y: np.ndarray, horizon: int, step_s: int, params: dict) -> np.ndarray:
    return np.full(horizon, y[-1])


# Search spaces.
register_model("ExponentialSmoothing", holt_winters, {
    "trend": ["additive", "none"], "seasonal": ["additive", "none"], "damped": ["true", "false"],
    "seasonal_periods": (2, 48),
})
register_model("Prophet", additive, {
    "daily_seasonality": ["true", "false", "auto"], "weekly_seasonality": ["true", "false", "auto"],
    "yearly_seasonality": ["true", "false", "auto"], "interval_width": (0.8, 0.95),
})
register_model("FFT", spectral, {"trend": ["poly", "none"]})
register_model("SeasonalNaive", seasonal_naive)
register_model("LastValue", last_value)


def model_functions() -> dict[str, Model]:
    """The registered functions, to travel with a task: executors do not see what the driver registered."""
    return {name: r.fn for name, r in MODELS.items()}


def run_model(fns: dict[str, Model], name: str, values, horizon: int, step_s: int,
              params: dict | None) -> tuple[np.ndarray | None, str]:
    """Forecast and status; a failing fit becomes a status, never an exception of the job."""
    try:
        y = filled(np.asarray(values, dtype=float))
        out = np.asarray(fns[name](y, horizon, step_s, dict(params or {})), dtype=float)
        return out, "ok"
    except Exception as exc:  # noqa: BLE001
        return None, f"failed: {exc}"


def spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Even out fan-out rows over tasks: the key has the unit of work, so a long series is not one task.

    The number of partitions is fixed: adaptive execution would merge partitions by their bytes, and
    fits are few bytes but much work.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def model_structs(models: dict[str, dict]) -> Column:
    """`{name: params}` as an array of structs to explode, with the position for ties."""
    items = []
    for i, (name, params) in enumerate(models.items()):
        pairs = [F.lit(x) for k, v in params.items() for x in (k, None if v is None else str(v))]
        as_map = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
        items.append(F.struct(F.lit(name).alias("model"), F.lit(i).alias("model_rank"), as_map.alias("params")))
    return F.array(*items)


def with_models(arrays: DataFrame, models: dict[str, dict] | DataFrame, keys: Sequence[str]) -> DataFrame:
    """Array rows next to each model: the same models for all (a dict), or `(keys…, model, params)` per series."""
    if isinstance(models, dict):
        paired = arrays.withColumn("_m", F.explode(model_structs(models)))
        return paired.withColumn("model", F.col("_m.model")).withColumn("params", F.col("_m.params")).drop("_m")
    return arrays.join(models.select(*keys, "model", "params"), list(keys))


def forecast_units(units: DataFrame, keys: Sequence[str], step_s: int) -> DataFrame:
    """Runs one model per unit row `(keys…, model, params, values, horizon, first_step)`.

    Returns `(keys…, model, step_idx, y_hat, status)`; a failed unit keeps its steps with null.
    """
    keep, fns = [*keys, "model"], model_functions()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                h = int(row["horizon"])
                if h <= 0:
                    continue
                out, status = run_model(fns, row["model"], row["values"], h, step_s, _params(row["params"]))
                steps = int(row["first_step"]) + np.arange(h)
                frame = pd.DataFrame({"step_idx": steps, "y_hat": out if out is not None else np.nan})
                for k in keep:
                    frame[k] = row[k]
                frame["status"] = status
                yield frame[[*keep, "step_idx", "y_hat", "status"]]

    done = units.select(*keep, "params", "values", "horizon", "first_step").mapInPandas(
        run, schema + ", step_idx bigint, y_hat double, status string"
    )
    return done.withColumn("y_hat", F.when(~F.isnan("y_hat"), F.col("y_hat")))


def _params(value) -> dict:
    """Params arrive as a dict or as a list of pairs, by Arrow version."""
    return dict(value) if value is not None else {}


def forecast(arrays: DataFrame, models: dict[str, dict] | DataFrame, horizon: int, step_s: int,
             keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Next `horizon` steps of every series by every model."""
    units = with_models(arrays, models, keys).select(
        *keys, "values", "model", "params", F.lit(horizon).alias("horizon"),
        F.size("values").cast("bigint").alias("first_step"),
    )
    return forecast_units(spread(units, [*keys, "model"]), keys, step_s)


def split_sizes(train: float = 0.70, val: float = 0.15) -> tuple[Column, Column]:
    n = F.size("values")
    return F.floor(n * F.lit(train)).cast("int"), F.floor(n * F.lit(val)).cast("int")


def forecast_val_test(arrays: DataFrame, models: dict[str, dict] | DataFrame, step_s: int,
                      keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Train predicts val, train and val predict test, for every series and model."""
    n_train, n_val = split_sizes()
    n = F.size("values")
    stages = F.array(
        F.struct(F.lit("val").alias("split"), n_train.alias("fit"), n_val.alias("horizon")),
        F.struct(F.lit("test").alias("split"), (n_train + n_val).alias("fit"), (n - n_train - n_val).alias("horizon")),
    )
    units = (
        with_models(arrays, models, keys)
        .withColumn("_s", F.explode(stages))
        .select(*keys, F.col("_s.split").alias("split"), "model", "params", F.slice("values", F.lit(1), F.col("_s.fit")).alias("values"),
                F.col("_s.horizon").alias("horizon"), F.col("_s.fit").cast("bigint").alias("first_step"))
        .filter(F.col("horizon") > 0)
    )
    return forecast_units(spread(units, [*keys, "model", "split"]), [*keys, "split"], step_s)


def forecast_next(arrays: DataFrame, model: str, params: dict, step_s: int, keys: Sequence[str] = ("series_id",),
                  last_prediction: str | None = None, min_points: int = 2) -> DataFrame:
    """One step ahead; short history or a failed fit falls back to the larger of the last prediction and value."""
    previous = F.coalesce(F.col(last_prediction), F.lit(0.0)) if last_prediction else F.lit(0.0)
    rows = arrays.withColumn("_prev", previous).withColumn(
        "_last", F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("values", F.lit(-1)), F.lit(0.0)))
    )
    long_enough = F.size("values") >= min_points
    units = rows.filter(long_enough).select(
        *keys, F.lit(model).alias("model"), model_structs({model: params})[0]["params"].alias("params"), "values",
        F.lit(1).alias("horizon"), F.size("values").cast("bigint").alias("first_step"),
    )
    done = forecast_units(spread(units, list(keys)), keys, step_s).drop("model")
    fallback = F.greatest("_prev", "_last")
    good = F.col("status") == "ok"
    return rows.join(done, list(keys), "left").select(
        *keys, F.lit(model).alias("model"), F.size("values").alias("n_points"),
        F.coalesce(F.col("step_idx"), F.size("values").cast("bigint")).alias("step_idx"),
        F.when(good & F.col("y_hat").isNotNull(), F.greatest(F.lit(0.0), F.col("y_hat"))).otherwise(fallback)
        .alias("y_hat"),
        F.coalesce("status", F.lit("short history")).alias("status"),
        (~F.coalesce(good, F.lit(False)) & long_enough).alias("refit_skipped"),
    )


# ---- models that are plain DataFrame work -----------------------------------------------------------


def snaive_forecast(split_df: DataFrame, lag: int, keys: Sequence[str] = ("series_id",),
                    predict: Sequence[str] = ("val", "test")) -> DataFrame:
    """Seasonal-naive forecast of one or both hold-out parts as one equi-join on (series, step).

    Each step looks at the same phase of the last season before its part: train for val, train and val
    for test.
    """
    prior = F.col("n_train") + F.when(F.col("split") == "test", F.col("n_val")).otherwise(0)
    source = prior - F.lit(lag) + ((F.col("step_idx") - prior) % lag)
    target = split_df.filter(F.col("split").isin(list(predict))).select(*keys, "split", "step_idx", source.alias("_src"))
    known = split_df.select(*keys, F.col("step_idx").alias("_src"), F.col("y").alias("y_hat"))
    return target.join(known, [*keys, "_src"]).select(
        *keys, F.lit("SeasonalNaive").alias("model"), "split", "step_idx", "y_hat"
    )


def ses_levels(split_df: DataFrame, alphas: Sequence[float], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Level of simple exponential smoothing after the training part, for every alpha.

    The recursion has the closed form of a weighted sum, so it is one map-side combined aggregate:
    no ordering and no row-at-a-time fold.
    """
    train = split_df.filter(F.col("split") == "train")
    age = F.col("n_train") - 1 - F.col("step_idx")
    sums = []
    for i, a in enumerate(alphas):
        keep = F.pow(F.lit(1.0 - a), age)
        weight = F.when(F.col("step_idx") == 0, keep).otherwise(F.lit(a) * keep)
        sums.append(F.struct(F.lit(float(a)).alias("alpha"), F.sum(weight * F.col("y")).alias("level")).alias(f"_{i}"))
    wide = train.groupBy(*keys).agg(*sums)
    return wide.select(*keys, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(alphas))])).alias("_s")).select(
        *keys, "_s.alpha", "_s.level"
    )


def normal_equations(df: DataFrame, design: dict[str, Column], y: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """`XtX` and `Xty` per series as one aggregate, in long form `(keys…, i, j, value)`."""
    names = list(design)
    rows = df.select(*keys, F.col(y).alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(design.values())])
    cells, aggs = [], []
    for i in range(len(names)):
        for j in range(i, len(names)):
            cells.append((names[i], names[j], f"_a{i}_{j}"))
            aggs.append(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_a{i}_{j}"))
        cells.append((names[i], "y", f"_b{i}"))
        aggs.append(F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_b{i}"))
    wide = rows.groupBy(*keys).agg(*aggs)
    long = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).alias("value")) for i, j, c in cells])
    return wide.select(*keys, F.explode(long).alias("_c")).select(*keys, "_c.i", "_c.j", "_c.value")


def _additive_blocks(rows: DataFrame, params: dict, step_s: int, keys: Sequence[str]) -> DataFrame:
    """`(keys…, step_idx, y, _n)` to one `XtX | Xty | yty | n` block per series and Arrow batch."""
    key_list = list(keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby([*key_list, "_n"], sort=False):
                n = int(key[-1])
                x, _ = additive_design(part["step_idx"].to_numpy(dtype=float), step_s, float(max(n - 1, 1)), params)
                y = part["y"].to_numpy(dtype=float)
                ok = np.isfinite(y)
                x, y = x[ok], y[ok]
                flat = np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y, len(y)]])
                out = pd.DataFrame([dict(zip(key_list, key[:-1]))])
                out["_n"], out["_block"] = n, [flat.tolist()]
                yield out

    return rows.select(*keys, "step_idx", "y", "_n").mapInPandas(blocks, key_schema + ", _n bigint, _block array<double>")


def _equations(pdf: pd.DataFrame, params: dict, step_s: int):
    """Sum of a series' blocks: XtX, Xty, yty, number of rows, and the ridge of the design."""
    total = np.sum(np.stack(pdf["_block"].map(np.asarray).to_list()), axis=0)
    n = int(pdf["_n"].iloc[0])
    _, ridge = additive_design(np.zeros(1), step_s, float(max(n - 1, 1)), params)
    k = len(ridge)
    return total[: k * k].reshape(k, k), total[k * k: k * k + k], total[-2], total[-1], ridge


def sparse_changes(df: DataFrame, params: dict, shares: Sequence[float], step_s: int,
                   keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Trend changes left at every penalty: `(keys…, penalty, n_changes, optimal)`, from one pass over the rows.

    `optimal` says that the solution is one: the error's pull on every change that is there equals the penalty, and
    none of those left out is pulled harder.
    """
    rows = df.withColumn("_n", F.col("n_steps"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        xtx, xty, _, _, ridge = _equations(pdf, params, step_s)
        out = []
        for share in shares:
            changes = trend_changes(params)
            beta, weight = solve_sparse(xtx, xty, ridge, changes, share)
            delta, pull = beta[changes], (xty - xtx @ beta)[changes] - 1e-9 * beta[changes]
            tight = 1e-5 * max(weight, 1e-12)
            good = np.where(delta != 0, np.abs(pull - weight * np.sign(delta)) <= tight, np.abs(pull) <= weight + tight)
            out.append([*pdf[list(keys)].iloc[0], float(share), int((delta != 0).sum()), bool(good.all())])
        return pd.DataFrame(out, columns=[*keys, "penalty", "n_changes", "optimal"])

    return _additive_blocks(rows, params, step_s, keys).groupBy(*keys).applyInPandas(
        solve, key_schema + ", penalty double, n_changes bigint, optimal boolean")


def additive_forecast(split_df: DataFrame, params: dict, step_s: int, predict: str = "test",
                      keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Additive regression with distributed normal equations.

    Every Arrow batch reduces its rows to one `XtX | Xty | yty` block per series; only these blocks are
    shuffled, summed and solved. Forecast steps then meet the coefficients by (series, step chunk).
    """
    fit_end = {"val": F.col("n_train"), "test": F.col("n_train") + F.col("n_val")}[predict]
    fit_splits = ["train"] if predict == "val" else ["train", "val"]
    rows = split_df.withColumn("_n", fit_end).select(*keys, "split", "step_idx", "y", "_n")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    key_list = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        xtx, xty, yty, count, ridge = _equations(pdf, params, step_s)
        beta = solve_additive(xtx, xty, ridge, params)
        residual = max(0.0, yty - 2 * beta @ xty + beta @ xtx @ beta) / max(1.0, count - 1)
        out = pdf[key_list].head(1).reset_index(drop=True)
        out["_beta"], out["_sigma"] = [beta.tolist()], float(np.sqrt(residual))
        return out

    fitted = (
        _additive_blocks(rows.filter(F.col("split").isin(fit_splits)), params, step_s, keys)
        .groupBy(*keys).applyInPandas(solve, key_schema + ", _beta array<double>, _sigma double")
    )
    target = rows.filter(F.col("split") == predict).select(*keys, "step_idx", "_n")

    def predict_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from statistics import NormalDist

        z = NormalDist().inv_cdf(0.5 + float(params.get("interval_width", 0.95)) / 2)
        for pdf in batches:
            for key, part in pdf.groupby(key_list, sort=False):
                n = int(part["_n"].iloc[0])
                x, _ = additive_design(part["step_idx"].to_numpy(dtype=float), step_s, float(max(n - 1, 1)), params)
                part = part.copy()
                part["y_hat"] = x @ np.asarray(part["_beta"].iloc[0])
                band = z * part["_sigma"].iloc[0]
                part["y_low"], part["y_high"] = part["y_hat"] - band, part["y_hat"] + band
                yield part[[*key_list, "step_idx", "y_hat", "y_low", "y_high"]]

    # Coefficients go to every step chunk of the series, so no series is one task.
    size = 8192
    bounds = target.groupBy(*keys).agg(
        F.floor(F.min("step_idx") / size).alias("_a"), F.floor(F.max("step_idx") / size).alias("_z")
    )
    placed = fitted.join(bounds, key_list).withColumn("_chunk", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
    joined = target.withColumn("_chunk", F.floor(F.col("step_idx") / size)).join(placed, [*key_list, "_chunk"])
    out = joined.mapInPandas(predict_rows, key_schema + ", step_idx bigint, y_hat double, y_low double, y_high double")
    return out.select(*keys, F.lit("Prophet").alias("model"), F.lit(predict).alias("split"), "step_idx", "y_hat",
                      "y_low", "y_high")


def spectrum(arrays: DataFrame, top_k: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The `top_k` strongest frequencies of each series with amplitude, by amplitude then frequency."""
    key_list = list(keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.select(*key_list).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                f = np.fft.rfft(filled(np.asarray(row["values"], dtype=float)))
                k = np.argsort(-np.abs(f), kind="stable")[:top_k]
                out = pd.DataFrame({"k": k, "re": f.real[k], "im": f.imag[k], "amplitude": np.abs(f[k]),
                                    "rank": np.arange(1, len(k) + 1)})
                for c in key_list:
                    out[c] = row[c]
                yield out[[*key_list, "k", "re", "im", "amplitude", "rank"]]

    return arrays.select(*key_list, "values").mapInPandas(
        run, key_schema + ", k bigint, re double, im double, amplitude double, rank int"
    )
