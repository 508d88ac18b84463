"""Forecast accuracy and operational metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.catalog import Policy
from tidegauge.operators.ordered import with_neighbour_within
from tidegauge.operators.series import seasonal_difference

EVENT_ID = ("namespace",)


def forecast_errors(actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Truth and forecast meet by key and step, never by row position."""
    joined = actual.select(*keys, "step_idx", "y").join(forecast, [*keys, "step_idx"])
    return joined.withColumn("error", F.col("y") - F.col("y_hat"))


def r2(y: Column, error: Column) -> Column:
    """1 - SSE/SST with SST from the centred moment; 1 or 0 for a constant truth, null below two rows."""
    n = F.count(error)
    sse = F.sum(error * error)
    sst = F.var_pop(y) * n
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0))
        .otherwise(F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0)))
    )


def naive_scale(train: DataFrame, lag: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per series: mean absolute and root mean square seasonal difference of the training part.

    No row for a series that is not longer than the lag, null where the naive error is 0.
    """
    diff = seasonal_difference(train, lag, keys)
    return diff.filter(F.col("diff").isNotNull()).groupBy(*keys).agg(*_naive(F.lit(True), ""))


def _naive(part: Column, suffix: str) -> list[Column]:
    d = F.when(part, F.col("diff"))
    mae, mse = F.avg(F.abs(d)), F.avg(d * d)
    return [F.when(mae > 0, mae).alias(f"naive_mae{suffix}"), F.when(mse > 0, F.sqrt(mse)).alias(f"naive_rmse{suffix}")]


def _score_sums(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    y, p, e = F.col("y"), F.col("y_hat"), F.col("error")
    half = (F.abs(y) + F.abs(p)) / 2.0
    return errors.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.avg(F.abs(e) / F.when(half == 0, 1e-8).otherwise(half)) * 100).alias("SMAPE"),
        r2(y, e).alias("R2"),
        F.avg(y).alias("_mean"),
        F.stddev_pop(e).alias("STD_ERRORS"),
    )


def _scores(sums: DataFrame, by: Sequence[str], naive_mae: Column, naive_rmse: Column) -> DataFrame:
    mean = F.when(F.col("_mean") > 0, F.col("_mean"))
    return sums.select(
        *by, "n", "MAE", "RMSE", "SMAPE", (F.col("MAE") / naive_mae).alias("MASE"),
        (F.col("RMSE") / naive_rmse).alias("RMSSE"), "R2", (F.col("MAE") / mean).alias("NMAE"),
        (F.col("RMSE") / mean).alias("NRMSE"), "STD_ERRORS",
    )


def forecast_metrics(actual: DataFrame, forecast: DataFrame, train: DataFrame, lag: int,
                     keys: Sequence[str] = ("series_id",), by: Sequence[str] = ("model", "split")) -> DataFrame:
    """MAE, RMSE, SMAPE, MASE, RMSSE, R2, NMAE, NRMSE and STD_ERRORS per series, model and split."""
    groups = [*keys, *by]
    sums = _score_sums(forecast_errors(actual, forecast, keys), groups)
    scaled = sums.join(naive_scale(train, lag, keys), list(keys), "left")
    return _scores(scaled, groups, F.col("naive_mae"), F.col("naive_rmse"))


def evaluate(split_df: DataFrame, forecast: DataFrame, lag: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Metrics of both hold-out parts at once: val is scaled by train, test by train and val.

    The seasonal differences are taken once; both scales are aggregates over prefixes of them.
    """
    groups = [*keys, "model", "split"]
    sums = _score_sums(forecast_errors(split_df, forecast, keys), groups)
    diff = seasonal_difference(split_df.filter(F.col("split") != "test"), lag, keys)
    scale = diff.groupBy(*keys).agg(*_naive(F.col("split") == "train", "_val"), *_naive(F.lit(True), "_test"))
    scaled = sums.join(scale, list(keys), "left")
    pick = lambda c: F.when(F.col("split") == "val", F.col(f"{c}_val")).otherwise(F.col(f"{c}_test"))
    return _scores(scaled, groups, pick("naive_mae"), pick("naive_rmse"))


def _online(actual: str, predicted: str, name: str) -> list[Column]:
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    few = F.count(e) < 2
    zero = F.lit(0.0)
    return [
        F.when(few, zero).otherwise(F.avg(F.abs(e))).alias(f"MAE_{name}"),
        F.when(few, zero).otherwise(F.sqrt(F.avg(e * e))).alias(f"RMSE_{name}"),
        F.when(few, zero).otherwise(r2(a, e)).alias(f"R2_{name}"),
        F.when(few, zero).otherwise(F.avg(e)).alias(f"BIAS_{name}"),
    ]


def online_metrics(events: DataFrame, keys: Sequence[str] = EVENT_ID) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *_online("actual_cpu_cores", "predicted_cpu_cores", "cpu"),
        *_online("actual_ram_gb", "predicted_ram_gb", "ram"),
    )


def evaluation_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("phase") == "evaluation")


def _rate(flag: str) -> Column:
    n = F.count(F.lit(1))
    return F.when(n > 0, F.count_if(F.col(flag)) / n).otherwise(0.0)


def sla_columns() -> list[Column]:
    out = []
    for m in ("cpu", "ram"):
        flag = f"sla_{m}_violation"
        out += [F.count_if(F.col(flag)).alias(f"{flag}_count"), _rate(flag).alias(f"{flag}_rate")]
    return out


def overprovision_flags(policy: Policy, ram_mode: str = "limit_vs_total") -> tuple[Column, Column]:
    """CPU: more replicas than the actual load needs. RAM: the limit exceeds the use.

    `limit_vs_total` compares the limit of one replica with the use of all; `per_replica` divides the
    use by the replicas first.
    """
    need = F.ceil(F.greatest(F.col("actual_cpu_cores"), F.lit(1e-9)) / policy.cpu_target)
    cpu = F.col("current_replicas") > need
    used = F.col("actual_ram_gb") * 1024
    if ram_mode == "per_replica":
        used = used / F.greatest(F.col("current_replicas"), F.lit(1))
    elif ram_mode != "limit_vs_total":
        raise ValueError(f"unknown ram_mode {ram_mode}")
    return cpu, F.col("current_memory_mb") > F.ceil(used)


def overprovision_columns(policy: Policy, ram_mode: str = "limit_vs_total") -> list[Column]:
    step_min = policy.scrape_s / 60.0
    n = F.count(F.lit(1))
    out = []
    for name, flag in zip(("cpu", "ram"), overprovision_flags(policy, ram_mode)):
        minutes = F.count_if(flag) * F.lit(step_min)
        out += [
            F.rint(minutes * 100.0).alias(f"_op_{name}"),
            (F.rint(minutes / (n * F.lit(step_min)) * 10000.0) / 10000.0).alias(f"waste_ratio_{name}"),
        ]
    return out


def overprovision(events: DataFrame, policy: Policy, keys: Sequence[str] = EVENT_ID,
                  ram_mode: str = "limit_vs_total") -> DataFrame:
    sums = events.groupBy(*keys).agg(*overprovision_columns(policy, ram_mode))
    return sums.select(
        *keys, *[x for m in ("cpu", "ram") for x in
                 ((F.col(f"_op_{m}") / 100.0).alias(f"overprovision_{m}_minutes"), F.col(f"waste_ratio_{m}"))]
    )


def _mtbv(flag: str, duration: Column) -> Column:
    hits = F.count_if(F.col(flag))
    return F.when(hits > 0, F.rint(duration / F.nullif(hits, F.lit(0)) * 10.0) / 10.0)


def event_span_s(policy: Policy) -> Column:
    """Seconds from the first event to the end of the last cycle, from event time."""
    micros = F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))
    return micros / 1e6 + F.lit(float(policy.scrape_s))


def mtbv(events: DataFrame, policy: Policy, keys: Sequence[str] = EVENT_ID) -> DataFrame:
    """Mean time between violations in seconds; null when there was none."""
    span = event_span_s(policy)
    return events.groupBy(*keys).agg(
        _mtbv("sla_cpu_violation", span).alias("mtbv_cpu_seconds"),
        _mtbv("sla_ram_violation", span).alias("mtbv_ram_seconds"),
    )


def _positive(col: str, what: str) -> Column:
    x = F.when(F.col(col) > 0, F.col(col))
    return F.coalesce(F.avg(x) if what == "avg" else F.max(x), F.lit(0.0)).alias(f"{what}_{col}")


TIMING_COLUMNS = [f"{what}_time_{m}_seconds" for m in ("cpu", "ram") for what in ("fit", "predict")]


def oscillations(events: DataFrame, cooldowns: dict[str, int], keys: Sequence[str] = EVENT_ID,
                 chunk_s: int = 3600, tie: Sequence[str] = ()) -> DataFrame:
    """Real actions that differ from the one before and follow it within the cooldown, per dimension.

    `cooldowns` maps a dimension (`action_<dimension>`) to seconds. All dimensions share one scan and one
    shuffle; an action before the cooldown cannot count, so rows near chunk borders are copied.
    """
    actions = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(c * 1_000_000).cast("bigint").alias("cooldown_us"), F.col(f"action_{d}").alias("action"))
        for d, c in cooldowns.items()
    ])
    real = (
        events.withColumn("_a", F.explode(actions)).filter(F.col("_a.action").isin("scale_up", "scale_down"))
        .select(*keys, "timestamp", *tie, "_a.dimension", "_a.cooldown_us", "_a.action")
    )
    paired = with_neighbour_within(real, [*keys, "dimension"], ["timestamp", *tie], ["action", "timestamp"],
                                   max(cooldowns.values()), chunk_s)
    gap_us = F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")
    hit = (F.col("action") != F.col("prev_action")) & (gap_us <= F.col("cooldown_us"))
    return paired.groupBy(*keys).agg(*[
        F.count_if(hit & (F.col("dimension") == d)).alias(f"oscillation_{d}_count") for d in cooldowns
    ])


def ops_summary(events: DataFrame, policy: Policy, keys: Sequence[str] = EVENT_ID,
                ram_mode: str = "limit_vs_total", chunk_s: int = 3600, tie: Sequence[str] = ()) -> DataFrame:
    """The run summary: accuracy, SLA, waste, oscillation, action counts, averages and timings."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    avg2 = lambda c: F.rint(F.avg(c) * 100.0) / 100.0
    span = event_span_s(policy)
    main = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cycles"),
        (F.rint(span * 10.0) / 10.0).alias("total_duration_seconds"),
        *_online("actual_cpu_cores", "predicted_cpu_cores", "cpu"),
        *_online("actual_ram_gb", "predicted_ram_gb", "ram"),
        *sla_columns(),
        *overprovision_columns(policy, ram_mode),
        _mtbv("sla_cpu_violation", span).alias("mtbv_cpu_seconds"),
        _mtbv("sla_ram_violation", span).alias("mtbv_ram_seconds"),
        count("action_horizontal", "scale_up").alias("scale_up_horizontal_count"),
        count("action_horizontal", "scale_down").alias("scale_down_horizontal_count"),
        count("action_vertical", "scale_up").alias("scale_up_vertical_count"),
        count("action_vertical", "scale_down").alias("scale_down_vertical_count"),
        F.sum("pod_restart_count").cast("bigint").alias("pod_restart_count"),
        avg2("current_replicas").alias("avg_replicas"),
        avg2("current_memory_mb").alias("avg_memory_mb"),
        F.max("refit_skipped").cast("bigint").alias("refit_skip_count"),
        *[_positive(c, what) for c in TIMING_COLUMNS for what in ("avg", "max")],
    )
    swings = oscillations(
        events, {"horizontal": policy.down_cooldown_s, "vertical": policy.vertical_cooldown_s}, keys, chunk_s, tie
    )
    out = main.join(swings, list(keys), "left")
    for m in ("cpu", "ram"):
        out = out.withColumn(f"overprovision_{m}_minutes", F.col(f"_op_{m}") / 100.0).drop(f"_op_{m}")
    return out.na.fill(0, ["oscillation_horizontal_count", "oscillation_vertical_count"])


def ops_summary_nested(summary: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The flat summary as the nested run-summary record (for a JSON sink)."""
    accuracy = lambda m: F.struct(*[F.col(f"{k}_{m}").alias(k) for k in ("MAE", "RMSE", "R2", "BIAS")])
    skip = {*identity, "total_cycles", "total_duration_seconds",
            *[f"{k}_{m}" for k in ("MAE", "RMSE", "R2", "BIAS") for m in ("cpu", "ram")]}
    rest = [c for c in summary.columns if c not in skip]
    return summary.select(
        *identity, "total_cycles", "total_duration_seconds",
        F.struct(accuracy("cpu").alias("cpu"), accuracy("ram").alias("ram")).alias("prediction_metrics"),
        F.struct(*rest).alias("operational_metrics"),
    )
