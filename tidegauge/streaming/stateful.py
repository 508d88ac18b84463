"""Stateful streams on ticks: bounded history with forecast, and scaling actions with clocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.catalog import Policy
from tidegauge.operators.models import model_functions, run_model
from tidegauge.operators.policy import _walk, finish_actions, recommend
from tidegauge.operators.select import initial_component, sanitized, select_online


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def stream_forecast(ticks: DataFrame, models: dict[str, dict], step_s: int, backward: int, keys: Sequence[str],
                    max_points: int = 500, min_points: int = 2) -> DataFrame:
    """For each tick: append to the history, choose the component, forecast the next step.

    State per key: the last `max_points` ticks, the component chosen so far, the last prediction and
    the number of skipped refits. A short history or a failed fit falls back to the larger of the last
    prediction and the last value. Gaps between ticks are interpolated before the fit.
    """
    key_list, fns, initial = list(keys), model_functions(), initial_component(list(models))
    out_schema = _schema(ticks, key_list) + (
        ", ts timestamp, y double, n_points int, model string, y_hat double, status string, refit_skipped bigint"
    )
    state_schema = "at array<bigint>, y array<double>, model string, last_prediction double, skipped bigint"

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, y, model, last, skipped = [], [], initial, 0.0, 0
        if state.exists:
            at, y, model, last, skipped = state.get
            at, y = list(at), list(y)
        pdf = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value in zip(pdf["ts"], pdf["y"]):
            seconds = int(pd.Timestamp(ts).timestamp())
            at, y = [*at, seconds][-max_points:], [*y, float(value)][-max_points:]
            steps = (np.asarray(at) - at[0]) // step_s
            series = np.interp(np.arange(steps[-1] + 1), steps, np.asarray(y))
            status, predicted = "short history", None
            if len(series) >= min_points:
                model, _ = select_online(fns, series, models, model, backward, step_s)
                predicted, status = run_model(fns, model, series, 1, step_s, models[model])
                skipped += predicted is None
            if predicted is not None:
                last = max(0.0, float(sanitized(predicted, 1)[0]))
            else:
                last = max(last, max(0.0, y[-1]))
            out.append([*key, ts, float(value), len(y), model, last, status, skipped])
        state.update((at, y, model, last, skipped))
        yield pd.DataFrame(out, columns=[*key_list, "ts", "y", "n_points", "model", "y_hat", "status", "refit_skipped"])

    return ticks.select(*key_list, "ts", "y").groupBy(*key_list).applyInPandasWithState(
        update, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


def stream_scaler(cycles: DataFrame, policy: Policy, keys: Sequence[str], order: Sequence[str] = ("timestamp",),
                  restarted: str | None = None, mode: str = "scaling_mode") -> DataFrame:
    """Scaling actions for a stream of cycles: the state holds the start of the key and three clocks."""
    ts, ties, key_list = order[0], [c for c in order if c != order[0]], list(keys)
    rows = recommend(cycles, policy)
    columns = rows.columns
    h = F.col(mode).isin("horizontal", "combined")
    v = F.col(mode).isin("vertical", "combined")
    grow = v & (F.col("want_memory_mb") > F.col("current_memory_mb"))
    rows = rows.select(
        *columns, (h & (F.col("want_replicas") > F.col("current_replicas"))).alias("_up"),
        (h & (F.col("want_replicas") < F.col("current_replicas"))).alias("_down"), grow.alias("_grow"),
        (v & (F.col("want_memory_mb") < F.col("current_memory_mb"))).alias("_shrink"),
        (F.col(restarted) & grow if restarted else F.lit(False)).alias("_forced"), F.unix_micros(ts).alias("_us"),
    )
    out_columns = [c for c in rows.columns if c not in ("_us", "_forced")]
    cooldowns = [c * 1_000_000 for c in (policy.up_cooldown_s, policy.down_cooldown_s, policy.vertical_cooldown_s)]
    grace_us = policy.startup_grace_s * 1_000_000

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["_us", *ties], kind="stable")
        us = pdf["_us"].to_numpy(dtype=np.int64)
        start, *last = state.get if state.exists else (int(us[0]), None, None, None)
        flag = {c: pdf[c].to_numpy(dtype=bool) for c in ("_up", "_down", "_grow", "_shrink", "_forced")}
        vertical = flag["_grow"] | (flag["_shrink"] & (us - start >= grace_us))
        none = np.zeros(len(us), dtype=bool)
        for i, (name, candidate, forced) in enumerate((
            ("_ok_up", flag["_up"], none), ("_ok_down", flag["_down"], none), ("_ok_v", vertical, flag["_forced"])
        )):
            done = np.zeros(len(us), dtype=bool)
            walked = _walk(us[candidate], forced[candidate], last[i], cooldowns[i])
            done[np.flatnonzero(candidate)[walked]] = True
            if done.any():
                last[i] = int(us[done][-1])
            pdf[name] = done
        state.update((int(start), *last))
        yield pdf[[*out_columns, "_ok_up", "_ok_down", "_ok_v"]]

    done = rows.groupBy(*key_list).applyInPandasWithState(
        update, _schema(rows, out_columns) + ", _ok_up boolean, _ok_down boolean, _ok_v boolean",
        "start bigint, up bigint, down bigint, vertical bigint", "append", GroupStateTimeout.NoTimeout,
    )
    return finish_actions(done, policy, columns)
