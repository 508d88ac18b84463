"""Walk-forward ensembles in one pass per series and component.

A block of the hold-out part is forecast by the component that did best on the actuals just before it. Two fits matter
for a block: on what lies before that tail, to score, and on all before the block, to forecast. Both are prefixes of the
same series, so a component walks it once and leaves its state at every prefix that is asked for; nothing is fitted
again for a later block, and the array of a series is shipped once per component.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions import SANITIZED_VALUE
from tidegauge.operators.models import _params, split_sizes, spread, with_models
from tidegauge.operators.phases import _schema, phase_functions, predict_state, states
from tidegauge.operators.select import initial_component, rmse, sanitized


def _units(arrays: DataFrame, models: dict[str, dict] | DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """One row per series and component with where the hold-out part begins and ends."""
    n_train, n_val = split_sizes()
    low, high = {"val": (n_train, n_train + n_val), "test": (n_train + n_val, F.size("values"))}[part]
    units = with_models(arrays, models, keys).withColumn("_low", low).withColumn("_high", high)
    units = units.where(F.col("_high") > F.col("_low")).select(
        *keys, "model", "params", "_low", "_high", F.slice("values", F.lit(1), F.col("_high")).alias("values"))
    return spread(units, [*keys, "model"])


def _names(models: dict[str, dict] | DataFrame, order: Sequence[str] | None) -> list[str]:
    names = list(models) if isinstance(models, dict) else list(order or [])
    if not names:
        raise ValueError("an ensemble needs at least one component")
    return names


def _rank(names: Sequence[str]) -> Column:
    places = F.create_map(*[F.lit(x) for i, m in enumerate(names) for x in (m, i)])
    return F.try_element_at(places, F.col("model"))


def _bad(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(name) | (F.col(name) == float("inf"))


def walk_blocks(arrays: DataFrame, models: dict[str, dict] | DataFrame, backward: int, forward: int, step_s: int,
                keys: Sequence[str] = ("series_id",), part: str = "test") -> DataFrame:
    """Per series, block and component: the error on the tail before the block and the forecast of the block.

    `(keys…, model, block, block_start, rmse, status, forecast, fit_s, predict_s)`; the first block has no tail and no
    error, a failed fit no forecast. Seconds are those since the block before.
    """
    units = _units(arrays, models, keys, part)
    keep, fns = [*keys, "model"], phase_functions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                y, params, model = np.asarray(row["values"], dtype=float), _params(row["params"]), fns[row["model"]]
                low, high = int(row["_low"]), int(row["_high"])
                starts = range(low, high, forward)
                tails = {s: min(s - low, backward) for s in starts}
                wanted = sorted({*starts, *(s - tails[s] for s in starts)})
                ends: dict[int, list[int]] = {}
                for s in starts:
                    if tails[s] and s > tails[s]:
                        ends.setdefault(s - tails[s], []).append(s)
                score, out, walked, fit_s, predict_s = {}, [], states(model, y, wanted, step_s, params), 0.0, 0.0
                for origin in wanted:
                    begun = time.perf_counter()
                    state = next(walked)
                    fitted = time.perf_counter()
                    fit_s += fitted - begun
                    for s in ends.get(origin, ()):
                        predicted, status = predict_state(model, state, s - origin, step_s, params)
                        score[s] = rmse(y[origin:s], sanitized(predicted, s - origin)), status
                    if origin in tails:
                        length = min(forward, high - origin)
                        predicted, status = predict_state(model, state, length, step_s, params)
                        own, why = score.get(origin, (None, "not scored"))
                        predict_s += time.perf_counter() - fitted
                        out.append([*[row[k] for k in keep], (origin - low) // forward, origin, own, why,
                                    None if predicted is None else predicted.tolist(), fit_s, predict_s])
                        fit_s = predict_s = 0.0
                    else:
                        predict_s += time.perf_counter() - fitted
                yield pd.DataFrame(out, columns=[*keep, "block", "block_start", "rmse", "status", "forecast", "fit_s", "predict_s"]
                                   ).astype({"rmse": "float64"})

    return units.mapInPandas(run, f"{_schema(units, keep)}, block bigint, block_start bigint, rmse double, status string, "
                                  "forecast array<double>, fit_s double, predict_s double")


def ensemble_timings(blocks: DataFrame, components: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Seconds and evaluations of each ensemble, from `walk_blocks`: the first block evaluates one component, every other
    one all of them and the winner once more."""
    n = F.count_distinct("block")
    return blocks.groupBy(*keys).agg(
        F.sum("fit_s").alias("fit_s"), F.sum("predict_s").alias("predict_s"),
        (1 + (n - 1) * (components + 1)).cast("bigint").alias("evaluations"),
    )


def ensemble_walk(arrays: DataFrame, models: dict[str, dict] | DataFrame, backward: int, forward: int, step_s: int,
                  keys: Sequence[str] = ("series_id",), initial: str | None = None, part: str = "test",
                  order: Sequence[str] | None = None) -> DataFrame:
    """Winner and forecast of every block: `(keys…, block, model, best_rmse, step_idx, y_hat)`, one row per step.

    The first block takes `initial`, by default the seeded random component; ties go to the earlier component; a
    block without a finite error keeps the last winner. Infinite and missing forecasts become the large constant.
    """
    names = _names(models, order)
    blocks = walk_blocks(arrays, models, backward, forward, step_s, keys, part).withColumn("_r", _rank(names))
    won = blocks.groupBy(*keys, "block", "block_start").agg(
        F.min_by(F.when(~_bad("rmse"), F.col("model")), F.struct(F.when(_bad("rmse"), float("inf")).otherwise(F.col("rmse")), "_r"))
        .alias("_w"),
        F.min(F.when(~_bad("rmse"), F.col("rmse"))).alias("best_rmse"),
        F.map_from_entries(F.collect_list(F.struct("model", "forecast"))).alias("_all"),  # one entry per component
        F.max(F.size("forecast")).alias("_n"),
    )
    first = F.lit(initial or initial_component(names))
    so_far = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    winner = F.coalesce(F.last(F.when(F.col("block") == 0, first).otherwise(F.col("_w")), ignorenulls=True).over(so_far), first)
    chosen = won.withColumn("model", winner).withColumn("_f", F.try_element_at("_all", F.col("model")))
    # A winner whose own fit failed has no forecast: its steps get the constant.
    chosen = chosen.withColumn("_f", F.coalesce("_f", F.array_repeat(F.lit(SANITIZED_VALUE).cast("double"), F.greatest("_n", F.lit(0)))))
    rows = chosen.select(*keys, "block", "model", "best_rmse", "block_start", F.posexplode("_f").alias("_h", "_y"))
    bad = F.col("_y").isNull() | F.isnan("_y") | (F.abs("_y") == float("inf"))
    return rows.select(*keys, "block", "model", "best_rmse", (F.col("block_start") + F.col("_h")).alias("step_idx"),
                       F.when(bad, F.lit(float(SANITIZED_VALUE))).otherwise(F.col("_y")).alias("y_hat"))


def error_cube(arrays: DataFrame, models: dict[str, dict] | DataFrame, backwards: Sequence[int], forward: int, step_s: int,
               keys: Sequence[str] = ("series_id",), part: str = "val") -> DataFrame:
    """Per series, component and block: its squared error on the block, and its error on the tail of every window.

    `(keys…, model, block, n, sse, scores)` with one score per entry of `backwards`. Every prefix is fitted once, whatever
    number of windows looks at it; its errors are summed up along the steps, and a window reads its own length off.
    """
    windows = [int(b) for b in backwards]
    units = _units(arrays, models, keys, part)
    keep, fns = [*keys, "model"], phase_functions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                y, params, model = np.asarray(row["values"], dtype=float), _params(row["params"]), fns[row["model"]]
                low, high = int(row["_low"]), int(row["_high"])
                starts = range(low, high, forward)
                scores = {s: np.full(len(windows), np.nan) for s in starts}
                ends: dict[int, dict[int, list[int]]] = {}  # origin -> block start -> windows
                for s in starts:
                    for i, b in enumerate(windows):
                        tail = min(s - low, b)
                        if tail and s > tail:
                            ends.setdefault(s - tail, {}).setdefault(s, []).append(i)
                wanted, out = sorted({*starts, *ends}), []
                for origin, state in zip(wanted, states(model, y, wanted, step_s, params)):
                    far = max([*ends.get(origin, {}), min(origin + forward, high) if origin in scores else origin])
                    predicted, _ = predict_state(model, state, far - origin, step_s, params)
                    miss = y[origin:far] - sanitized(predicted, far - origin)
                    along = np.cumsum(miss * miss)
                    for s, wins in ends.get(origin, {}).items():
                        scores[s][wins] = np.sqrt(along[s - origin - 1] / (s - origin))
                    if origin in scores:
                        n = min(forward, high - origin)
                        if predicted is None:  # without a forecast the block gets the constant
                            along = np.cumsum((y[origin:origin + n] - SANITIZED_VALUE) ** 2)
                        out.append([*[row[k] for k in keep], (origin - low) // forward, n, float(along[n - 1]),
                                    scores[origin].tolist()])
                yield pd.DataFrame(out, columns=[*keep, "block", "n", "sse", "scores"])

    return units.mapInPandas(run, f"{_schema(units, keep)}, block bigint, n bigint, sse double, scores array<double>")


def tune_windows(arrays: DataFrame, models: dict[str, dict] | DataFrame, backwards: Sequence[int], forward: int, step_s: int,
                 keys: Sequence[str] = ("series_id",), initial: str | None = None, part: str = "val",
                 order: Sequence[str] | None = None) -> DataFrame:
    """Error of the ensemble on the hold-out part for every backward window: `(keys…, backward_window, rmse)`."""
    names, windows = _names(models, order), [int(b) for b in backwards]
    cube = error_cube(arrays, models, windows, forward, step_s, keys, part).withColumn("_r", _rank(names))
    score = F.when(_bad("rmse"), float("inf")).otherwise(F.col("rmse"))
    won = cube.select(*keys, "model", "_r", "block", "n", "sse", F.posexplode("scores").alias("_i", "rmse")).groupBy(
        *keys, "_i", "block").agg(
        F.min_by(F.when(~_bad("rmse"), F.col("model")), F.struct(score, "_r")).alias("_w"), F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("model", "sse"))).alias("_all"),
    )
    first = F.lit(initial or initial_component(names))
    so_far = Window.partitionBy(*keys, "_i").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    winner = F.coalesce(F.last(F.when(F.col("block") == 0, first).otherwise(F.col("_w")), ignorenulls=True).over(so_far), first)
    at = F.element_at(F.array(*[F.lit(b) for b in windows]), F.col("_i") + 1)
    return won.withColumn("_sse", F.try_element_at("_all", winner)).groupBy(*keys, "_i").agg(
        F.sqrt(F.sum("_sse") / F.sum("n")).alias("rmse")).select(*keys, at.alias("backward_window"), "rmse")
