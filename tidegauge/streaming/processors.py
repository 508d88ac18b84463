"""Keyed state processor of the live forecast: history, choice and per-component counts, warm from a bootstrap."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.models import model_functions, run_model
from tidegauge.operators.select import initial_component, sanitized, select_online

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "ts timestamp, y double, n_points int, model string, y_hat double, status string, refit_skipped bigint"


def use_processors(spark: SparkSession) -> None:
    """State with several columns of its own per key needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class LiveForecast(StatefulProcessor):
    """Per key: the last ticks in the order of their time, the component in charge, and what became of every component.

    A tick that comes late takes its place among the others, unless the history has moved past it. A component in charge
    whose refit fails skips the cycle: the larger of its last prediction and the last value stands in, and the skip is
    counted for that component.
    """

    def __init__(self, models: dict[str, dict], step_s: int, backward: int, max_points: int, min_points: int) -> None:
        self.models, self.step_s, self.backward = models, step_s, backward
        self.max_points, self.min_points = max_points, min_points
        self.fns, self.initial = model_functions(), initial_component(list(models))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "at bigint, y double")
        self.chosen = handle.getValueState("chosen", "model string, last_prediction double")
        self.counts = handle.getMapState("counts", "model string", "used bigint, skipped bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Bootstrap rows `(ts, y)` of the key become its history."""
        pairs = sorted(zip(initialState["ts"].map(_seconds), initialState["y"].astype(float)))[-self.max_points:]
        self.history.put([(int(at), float(y)) for at, y in pairs])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(at), float(y)) for at, y in self.history.get()] if self.history.exists() else []
        model, last = self.chosen.get() if self.chosen.exists() else (self.initial, 0.0)
        ticks = sorted((_seconds(ts), float(y), ts) for frame in rows for ts, y in zip(frame["ts"], frame["y"]))
        out = []
        for at, y, ts in ticks:
            place = bisect_left(held, (at, -np.inf))
            if place == 0 and len(held) >= self.max_points:
                out.append((ts, y, len(held), model, last, "before the history", self._skips()))
                continue
            if place < len(held) and held[place][0] == at:
                held[place] = (at, y)
            else:
                held.insert(place, (at, y))
                del held[:-self.max_points]
            steps = (np.array([h[0] for h in held]) - held[0][0]) // self.step_s
            series = np.interp(np.arange(steps[-1] + 1), steps, np.array([h[1] for h in held]))
            status, predicted = "short history", None
            if len(series) >= self.min_points:
                model, _ = select_online(self.fns, series, self.models, model, self.backward, self.step_s)
                predicted, status = run_model(self.fns, model, series, 1, self.step_s, self.models[model])
                used, skipped = self.counts.getValue((model,)) if self.counts.containsKey((model,)) else (0, 0)
                self.counts.updateValue((model,), (used + 1, skipped + (predicted is None)))
            if predicted is not None:
                last = max(0.0, float(sanitized(predicted, 1)[0]))
            else:
                last = max(last, max(0.0, held[-1][1]))
            out.append((ts, y, len(held), model, last, status, self._skips()))
        self.history.put(held)
        self.chosen.update((model, last))
        frame = pd.DataFrame(out, columns=["ts", "y", "n_points", "model", "y_hat", "status", "refit_skipped"])
        for i, value in enumerate(key):
            frame.insert(i, f"_k{i}", value)
        yield frame

    def _skips(self) -> int:
        return sum(skipped for _, skipped in self.counts.values())

    def close(self) -> None:
        pass


def _seconds(ts) -> int:
    return int(pd.Timestamp(ts).timestamp())


def live_forecast(ticks: DataFrame, models: dict[str, dict], step_s: int, backward: int, keys: Sequence[str],
                  bootstrap: DataFrame | None = None, max_points: int = 500, min_points: int = 2) -> DataFrame:
    """A forecast of the next step for every tick; keys of `bootstrap` (`keys…, ts, y`) start with its rows as history."""
    use_processors(ticks.sparkSession)
    kinds = ", ".join(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(ticks.select(*keys).schema))
    initial = bootstrap.select(*keys, "ts", "y").groupBy(*keys) if bootstrap is not None else None
    out = ticks.select(*keys, "ts", "y").groupBy(*keys).transformWithStateInPandas(
        LiveForecast(models, step_s, backward, max_points, min_points), f"{kinds}, {OUT}", "Append", "None", initial)
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})
