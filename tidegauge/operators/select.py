"""Hyper-parameter search and dynamic-selection ensembles as parallel fan-outs."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import SANITIZED_VALUE, sanitize_prediction
from tidegauge.operators.models import (
    MODELS, Model, _params, forecast_units, model_functions, model_structs, run_model, split_sizes, spread, with_models,
)
from tidegauge.operators.ordered import step_chunk, with_running_sum

FAILED_RMSE = 1e9


def sanitized(values: np.ndarray | None, n: int) -> np.ndarray:
    if values is None:
        return np.full(n, np.nan)
    return np.where(np.isfinite(values), values, SANITIZED_VALUE)


def rmse(actual: np.ndarray, predicted: np.ndarray) -> float:
    return float(np.sqrt(np.mean((actual - predicted) ** 2)))


# ---- search ------------------------------------------------------------------------------------------


def _effective(p: dict) -> dict:
    """Without parameters that another choice makes meaningless."""
    p = dict(p)
    if p.get("trend") == "none":
        p.pop("damped", None)
    if p.get("seasonal") == "none":
        p.pop("seasonal_periods", None)
    return p


def trial_params(model: str, n_trials: int, seed: int = 42) -> list[dict]:
    """Different parameter sets of a search: `n_trials` seeded random ones, or all there are if the space has fewer."""
    space = MODELS[model].search_space
    rng = random.Random(seed)
    if all(isinstance(v, list) for v in space.values()):
        sets = [_effective(dict(zip(space, c))) for c in itertools.product(*space.values())]
        distinct = list({tuple(p.items()): p for p in sets}.values())
        return rng.sample(distinct, min(n_trials, len(distinct)))
    draws: dict[tuple, dict] = {}
    for _ in range(100 * n_trials):  # equal draws are repeated, in a small space not forever
        p = {}
        for name, values in space.items():
            if isinstance(values, list):
                p[name] = rng.choice(values)
            elif isinstance(values[0], int):
                p[name] = str(rng.randint(*values))
            else:
                p[name] = str(round(rng.uniform(*values), 6))
        p = _effective(p)
        draws.setdefault(tuple(p.items()), p)
        if len(draws) == n_trials:
            break
    return list(draws.values())


def trial_grid(models: Sequence[str], n_trials: int = 30, seed: int = 42, fixed: dict | None = None) -> list[tuple]:
    """`(model, trial number, params)`; fixed parameters override sampled ones."""
    return [(m, i, {**p, **(fixed or {})}) for m in models for i, p in enumerate(trial_params(m, n_trials, seed))]


def tune(arrays: DataFrame, trials: list[tuple], step_s: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Validation RMSE of every (series, trial): all trials run in parallel, a failure counts 1e9."""
    structs = []
    for model, number, params in trials:
        s = model_structs({model: params})[0]
        structs.append(F.struct(s["model"].alias("model"), F.lit(number).alias("trial"), s["params"].alias("params")))
    n_train, n_val = split_sizes()
    units = arrays.withColumn("_t", F.explode(F.array(*structs))).select(
        *keys, F.col("_t.model").alias("model"), F.col("_t.trial").alias("trial"), F.col("_t.params").alias("params"),
        F.slice("values", F.lit(1), n_train + n_val).alias("values"), n_train.alias("fit"),
    )
    keep, fns = [*keys, "model", "trial"], model_functions()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                y, n = np.asarray(row["values"], dtype=float), int(row["fit"])
                params = _params(row["params"])
                predicted, status = run_model(fns, row["model"], y[:n], len(y) - n, step_s, params) if n else (None, "empty")
                value = rmse(y[n:], predicted) if predicted is not None and len(y) > n else np.nan
                failed = not np.isfinite(value)
                out.append([*[row[k] for k in keep], params, FAILED_RMSE if failed else value,
                            "FAIL" if failed else "COMPLETE", status])
            yield pd.DataFrame(out, columns=[*keep, "params", "rmse", "state", "status"])

    return spread(units, keep).mapInPandas(
        run, schema + ", params map<string,string>, rmse double, state string, status string"
    )


def best_trial(trials: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "rmse",
               payload: Sequence[str] = ("params",), tie: str = "trial") -> DataFrame:
    """The trial with the least error; failed, NaN and infinite values count 1e9, ties go to the lower number."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    safe = F.when(bad, F.lit(FAILED_RMSE)).otherwise(F.col(value))
    best = trials.withColumn("_v", safe).groupBy(*keys).agg(
        F.min_by(F.struct(tie, *payload, "_v"), F.struct("_v", tie)).alias("_b")
    )
    return best.select(*keys, F.col(f"_b.{tie}").alias(tie), *[F.col(f"_b.{c}").alias(c) for c in payload],
                       F.col("_b._v").alias("best_rmse"))


def component_params(runs: DataFrame, best_params: DataFrame, ensembles: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Parameters of each component of an ensemble: from the component's latest run on the same dataset."""
    parts = ensembles.select(dataset, "ensemble", F.posexplode("components").alias("position", "model"))
    latest = latest_run(runs, [dataset, "model"])
    return parts.join(latest.select(dataset, "model", "run_ts"), [dataset, "model"], "left").join(
        best_params, [dataset, "model", "run_ts"], "left"
    )


def latest_run(runs: DataFrame, keys: Sequence[str], run_ts: str = "run_ts", tie: Sequence[str] = (),
               pinned: str | None = None) -> DataFrame:
    """The run with the greatest timestamp text per key, or the pinned one."""
    if pinned is not None:
        return runs.filter(F.col(run_ts) == pinned)
    rest = [c for c in runs.columns if c not in keys]
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(run_ts, *tie)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ---- ensemble blocks ---------------------------------------------------------------------------------


def ensemble_blocks(split_df: DataFrame, backward: int, forward: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per forward block of the test part: what it trains on, what it is scored on, what it predicts."""
    n_prior = F.col("n_train") + F.col("n_val")
    sizes = split_df.groupBy(*keys).agg(
        F.max(n_prior).alias("n_prior"), (F.max("n_steps") - F.max(n_prior)).alias("n_test")
    )
    last = F.floor((F.col("n_test") - 1) / forward)
    blocks = sizes.filter(F.col("n_test") > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    offset = F.col("block") * forward
    tail = F.least(offset, F.lit(backward).cast("bigint"))
    return blocks.select(
        *keys, "block", (F.col("n_prior") + offset).alias("block_start"),
        F.least(F.lit(forward).cast("bigint"), F.col("n_test") - offset).alias("block_len"), tail.alias("tail_len"),
        (F.col("n_prior") + offset - tail).alias("tail_start"),
    )


def pick_component(scores: DataFrame, models: Sequence[str], initial: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Winner per block: strictly least RMSE, ties by component order; block 0 takes the initial model.

    A block without any finite score keeps the winner of the last block that had one.
    """
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, i)])
    bad = F.col("rmse").isNull() | F.isnan("rmse")
    scored = scores.withColumn("_r", F.try_element_at(rank, F.col("model"))).groupBy(*keys, "block").agg(
        F.min_by(F.when(~bad, F.col("model")), F.struct(F.when(bad, float("inf")).otherwise(F.col("rmse")), "_r")).alias("_w"),
        F.min(F.when(~bad, F.col("rmse"))).alias("best_rmse"),
    )
    from pyspark.sql import Window

    won = F.when(F.col("block") == 0, F.lit(initial)).otherwise(F.col("_w"))
    so_far = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("_won", won).select(
        *keys, "block", F.coalesce(F.last("_won", ignorenulls=True).over(so_far), F.lit(initial)).alias("model"),
        "best_rmse",
    )


def simple_component_scores(split_df: DataFrame, backward: int, forward: int, lag: int,
                            keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """RMSE per (series, block, component) for components that are one look-up or a running mean.

    Each actual goes to the few blocks whose tail it is in (backward / forward, rounded up); what a
    component knows at the end of its training part comes by equi-joins on (series, step).
    """
    n_prior = F.col("n_train") + F.col("n_val")
    run = with_running_sum(split_df, keys, ["step_idx"], F.col("y"), step_chunk("step_idx", 8192), "y_sum")
    idx = F.col("step_idx") - n_prior
    most = F.floor((F.col("n_steps") - n_prior - 1) / forward)
    low, high = F.floor(idx / forward) + 1, F.least(F.floor((idx + backward) / forward), most)
    tails = (
        split_df.filter(idx >= 0)
        .withColumn("block", F.explode(F.when(low <= high, F.sequence(low, high))))
        .withColumn("_start", n_prior + F.col("block") * forward
                    - F.least(F.col("block") * forward, F.lit(backward).cast("bigint")))
        .withColumn("_h", F.col("step_idx") - F.col("_start"))
    )
    key_list = list(keys)
    at_end = run.select(*keys, (F.col("step_idx") + 1).alias("_start"), F.col("y").alias("_last"), "y_sum")
    season = split_df.select(*keys, F.col("step_idx").alias("_src"), F.col("y").alias("_season"))
    first = split_df.filter(F.col("step_idx") == 0).select(*keys, F.col("y").alias("_first"))
    # One row per (series, block) carries what is constant over the tail.
    ends = (
        tails.select(*keys, "block", "_start").distinct()
        .join(at_end, [*key_list, "_start"]).join(first, key_list)
        .select(*keys, "block", "_last", "y_sum", "_first")
    )
    rows = (
        tails.withColumn("_src", F.col("_start") - lag + (F.col("_h") % lag))
        .join(season, [*key_list, "_src"], "left").join(ends, [*key_list, "block"])
    )
    slope = (F.col("_last") - F.col("_first")) / F.nullif(F.col("_start") - 1, F.lit(0))
    guess = {
        "SeasonalNaive": F.coalesce("_season", "_last"),
        "LastValue": F.col("_last"),
        "Mean": F.col("y_sum") / F.col("_start"),
        "Drift": F.col("_last") + slope * (F.col("_h") + 1),
    }
    sums = rows.groupBy(*keys, "block").agg(*[
        F.sqrt(F.avg(F.pow(F.col("y") - sanitize_prediction(g), F.lit(2.0)))).alias(name) for name, g in guess.items()
    ])
    return sums.unpivot([*key_list, "block"], list(guess), "model", "rmse")


def _score_units(units: DataFrame, keys: Sequence[str], step_s: int) -> DataFrame:
    """RMSE of one model on the tails of a run of blocks; `values` reaches to the last block start."""
    keep, fns = [*keys, "model"], model_functions()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                y, params = np.asarray(row["values"], dtype=float), _params(row["params"])
                out = []
                for b in row["blocks"]:
                    fit, end = int(b["tail_start"]), int(b["block_start"])
                    score, status = np.nan, "not scored"
                    if end > fit > 0:
                        predicted, status = run_model(fns, row["model"], y[:fit], end - fit, step_s, params)
                        score = rmse(y[fit:end], sanitized(predicted, end - fit))
                    out.append([*[row[k] for k in keep], int(b["block"]), score, status])
                yield pd.DataFrame(out, columns=[*keep, "block", "rmse", "status"])

    return units.mapInPandas(run, schema + ", block bigint, rmse double, status string")


def _block_units(arrays: DataFrame, backward: Column, forward: int, blocks_per_unit: int, part: str) -> DataFrame:
    """Array rows exploded into runs of blocks of one hold-out part; the series is cut at the end of each run."""
    n_train, n_val = split_sizes()
    prior, size = {
        "val": (n_train, n_val), "test": (n_train + n_val, F.size("values") - n_train - n_val)
    }[part]
    last = F.floor((F.col("_size") - 1) / forward).cast("int")
    runs = F.sequence(F.lit(0), last, F.lit(blocks_per_unit))

    def one(b: Column) -> Column:
        offset = b * forward
        start = F.col("_prior") + offset
        tail = F.least(offset, backward)
        return F.struct(
            b.alias("block"), (start - tail).alias("tail_start"), start.alias("block_start"),
            F.least(F.lit(forward), F.col("_size") - offset).alias("block_len"),
        )

    return (
        arrays.withColumn("_prior", prior).withColumn("_size", size).filter(F.col("_size") > 0)
        .withColumn("_last", last).withColumn("unit", F.explode(runs))
        .withColumn("blocks", F.transform(
            F.sequence(F.col("unit"), F.least(F.col("unit") + (blocks_per_unit - 1), F.col("_last"))), one))
        .withColumn("values", F.slice("values", F.lit(1), F.try_element_at("blocks", F.lit(-1))["block_start"]))
    )


def initial_component(models: Sequence[str], seed: int = 42) -> str:
    """The seeded random component that forecasts the first block."""
    return random.Random(seed).choice(list(models))


def ensemble_backtest(arrays: DataFrame, models: dict[str, dict] | DataFrame, backward: int | Column, forward: int,
                      step_s: int, keys: Sequence[str] = ("series_id",), initial: str | None = None,
                      blocks_per_unit: int = 8, part: str = "test",
                      order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Walk-forward ensemble over a hold-out part; returns `(choices, forecasts)`.

    Only actuals feed the training, so blocks do not depend on each other: all (series, block, model)
    scores are computed in parallel, then only the winners are fitted on everything before the block.
    `models` is one dict for all series or `(keys…, model, params)` per series, then with the component
    order for ties in `order`. `backward` may be a column of the keys.
    """
    names = list(models) if isinstance(models, dict) else list(order or [])
    if not names:
        raise ValueError("an ensemble needs at least one component")
    initial = initial or initial_component(names)
    key_list = list(keys)
    tail = F.lit(backward) if isinstance(backward, int) else backward
    base = _block_units(arrays.select(*keys, "values"), tail, forward, blocks_per_unit, part)
    units = with_models(base, models, key_list).select(*keys, "unit", "values", "blocks", "model", "params")
    scores = _score_units(spread(units, [*key_list, "model", "unit"]), key_list, step_s)
    choices = pick_component(scores, names, initial, keys)

    # Winners per unit (a unit holds few blocks) meet the unit's array once.
    wins = choices.withColumn("unit", (F.floor(F.col("block") / blocks_per_unit) * blocks_per_unit).cast("int"))
    if isinstance(models, dict):
        table = F.create_map(*[x for n in names for x in (F.lit(n), model_structs({n: models[n]})[0]["params"])])
        wins = wins.withColumn("params", F.try_element_at(table, F.col("model")))
    else:
        wins = wins.join(models.select(*keys, "model", "params"), [*key_list, "model"])
    grouped = wins.groupBy(*keys, "unit").agg(F.collect_list(F.struct("block", "model", "params")).alias("_wins"))
    fits = (
        base.join(grouped, [*key_list, "unit"])
        .withColumn("_b", F.explode("blocks"))
        .withColumn("_w", F.filter("_wins", lambda w: w["block"] == F.col("_b.block"))[0])
        .select(
            *keys, F.col("_b.block").cast("bigint").alias("block"), F.col("_w.model").alias("model"),
            F.col("_w.params").alias("params"), F.slice("values", F.lit(1), F.col("_b.block_start")).alias("values"),
            F.col("_b.block_len").alias("horizon"), F.col("_b.block_start").cast("bigint").alias("first_step"),
        )
    )
    done = forecast_units(spread(fits, [*key_list, "block"]), [*key_list, "block"], step_s)
    return choices, done.withColumn("y_hat", sanitize_prediction("y_hat"))


def tune_ensemble(arrays: DataFrame, models: dict[str, dict] | DataFrame, backwards: Sequence[int], forward: int,
                  step_s: int, keys: Sequence[str] = ("series_id",), order: Sequence[str] | None = None) -> DataFrame:
    """Validation RMSE of the ensemble for every backward window; the windows are one more key."""
    windows = F.explode(F.array(*[F.lit(int(b)) for b in backwards]))
    wide = arrays.select(*keys, "values").withColumn("backward_window", windows)
    all_keys = [*keys, "backward_window"]
    if not isinstance(models, dict):
        models = models.withColumn("backward_window", windows)
    _, forecasts = ensemble_backtest(wide, models, F.col("backward_window"), forward, step_s, all_keys, part="val", order=order)
    actual = arrays.select(*keys, F.posexplode("values").alias("step_idx", "y"))
    errors = forecasts.join(actual, [*keys, "step_idx"])
    miss = F.col("y") - F.col("y_hat")
    return errors.groupBy(*all_keys).agg(F.sqrt(F.avg(miss * miss)).alias("rmse"))


def select_online(fns: dict[str, Model], y: np.ndarray, models: dict[str, dict], current: str, backward: int, step_s: int) -> tuple[str, float]:
    """Sticky choice on the last `backward` points: switch only to a strictly smaller error."""
    if len(y) <= backward:
        return current, float("nan")
    fit, tail = y[:-backward], y[-backward:]
    best, best_rmse = current, float("inf")
    for name in [current, *[m for m in models if m != current]]:
        predicted, _ = run_model(fns, name, fit, backward, step_s, models[name])
        score = rmse(tail, sanitized(predicted, backward))
        if np.isfinite(score) and score < best_rmse:
            best, best_rmse = name, score
    return best, best_rmse


def ensemble_select_online(arrays: DataFrame, models: dict[str, dict], backward: int, step_s: int,
                           keys: Sequence[str] = ("series_id",), current: str | None = None) -> DataFrame:
    """Choice on the whole history of each series and the winner's next step.

    `current` names the column with the choice so far; without it the seeded random component is used.
    """
    names = list(models)
    start = F.col(current) if current else F.lit(initial_component(names))
    units = arrays.select(*keys, "values", start.alias("_current"))
    key_list, fns = list(keys), model_functions()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*key_list).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                y = np.asarray(row["values"], dtype=float)
                name, score = select_online(fns, y, models, row["_current"], backward, step_s)
                predicted, status = run_model(fns, name, y, 1, step_s, models[name])
                out.append([*[row[k] for k in key_list], row["_current"], name, score,
                            float(sanitized(predicted, 1)[0]), status])
            yield pd.DataFrame(out, columns=[*key_list, "previous_model", "model", "tail_rmse", "y_hat", "status"])

    return spread(units, key_list).mapInPandas(
        run, schema + ", previous_model string, model string, tail_rmse double, y_hat double, status string"
    )


def timed_fits(arrays: DataFrame, models: dict[str, dict] | DataFrame, step_s: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Log of one val and one test evaluation per series and model: `(fit_s, predict_s, evaluations)`.

    Models fit and predict in one call, so half of the elapsed time counts for each, as for ensembles.
    """
    import time

    n_train, n_val = split_sizes()
    units = with_models(arrays, models, keys).select(
        *keys, "values", n_train.alias("n_train"), (n_train + n_val).alias("n_prior"), "model", "params"
    )
    keep, fns = [*keys, "model"], model_functions()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                y, params = np.asarray(row["values"], dtype=float), _params(row["params"])
                for fit, end in ((row["n_train"], row["n_prior"]), (row["n_prior"], len(y))):
                    start = time.perf_counter()
                    run_model(fns, row["model"], y[:fit], int(end - fit), step_s, params)
                    half = (time.perf_counter() - start) / 2.0
                    out.append([*[row[k] for k in keep], half, half, 1])
            yield pd.DataFrame(out, columns=[*keep, "fit_s", "predict_s", "evaluations"])

    return spread(units, keep).mapInPandas(run, schema + ", fit_s double, predict_s double, evaluations bigint")
