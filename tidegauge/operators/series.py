"""Raw samples to regular series: totals, resampling, gap filling, splits and history windows.

Canonical series: `(series_id, ts, step_idx, n_steps, y)`, one row per step of a complete grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions import cpu_cores, nan_to_null, ram_gb
from tidegauge.operators.ordered import CHUNK, attach_by_chunk, ends, lag_on_grid, step_chunk, time_chunk

DAY_S = 86400
HOUR_S = 3600
EXPLODE_BLOCK = 10_000


def to_usage(df: DataFrame, capacity: DataFrame) -> DataFrame:
    """Long samples `(app, metric, instance, ts, value)` in cores or GB; null for missing values.

    An app without capacity, or a metric other than CPU and RAM, is an error.
    """
    unknown = lambda what: F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(what, F.lit("null"))))
    value = (
        F.when(F.col("_known").isNull(), unknown("app"))
        .when(F.col("metric") == "CPU", cpu_cores("value", "cores"))
        .when(F.col("metric") == "RAM", ram_gb("value", "ram_already_gb"))
        .otherwise(unknown("metric"))
    )
    return (
        df.withColumn("value", nan_to_null("value"))
        .join(capacity.select("app", "cores", "ram_already_gb", F.lit(True).alias("_known")), "app", "left")
        .select("app", "metric", "instance", "ts", value.alias("value"))
    )


def total_usage(df: DataFrame, keys: Sequence[str] = ("app", "metric"), ts: str = "ts",
                value: str = "value") -> DataFrame:
    """Sum over instances per timestamp; missing values are skipped, a row with none is 0.0."""
    return df.groupBy(*keys, ts).agg(F.coalesce(F.sum(nan_to_null(value)), F.lit(0.0)).alias("y"))


def resample(df: DataFrame, step_s: int, keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "y",
             origin_chunk_s: int = HOUR_S) -> DataFrame:
    """Mean per left-closed, left-labelled bin. Combined map-side, so a hot key costs one row per bin.

    Bins start at midnight of the first day of the key. When the step divides a day this is the epoch
    grid; else the first day of each key is found first.
    """
    seconds = F.unix_seconds(F.col(ts))
    if DAY_S % step_s == 0:
        start = F.lit(0).cast("bigint")
        rows = df
    else:
        first = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
        rows = attach_by_chunk(
            df, first, keys, time_chunk(ts, origin_chunk_s), time_chunk("_first", origin_chunk_s),
            time_chunk("_last", origin_chunk_s),
        )
        start = F.floor(F.unix_seconds("_first") / DAY_S) * DAY_S
    bucket = F.timestamp_seconds(F.floor((seconds - start) / step_s) * step_s + start)
    return rows.groupBy(*keys, bucket.alias("ts")).agg(F.avg(nan_to_null(value)).alias("y"))


def gap_fill(df: DataFrame, step_s: int, direction: str = "forward", keys: Sequence[str] = ("series_id",),
             chunk_steps: int = 8192) -> DataFrame:
    """Complete grid from the first to the last bin with linear interpolation between known bins.

    `forward` leaves leading unknown bins null, `both` gives them the first known value; trailing
    unknown bins repeat the last one; a series without a known bin keeps its grid, with nulls. Each known bin emits the
    steps up to the next known bin, so no grid is joined and the work is per (key, time chunk).
    """
    if direction not in ("forward", "both"):
        raise ValueError(f"direction must be forward or both, got {direction}")
    part = [*keys, CHUNK]
    rows = df.select(*keys, F.unix_seconds("ts").alias("_b"), F.col("y").alias("_y")).withColumn(
        CHUNK, step_chunk("_b", step_s * chunk_steps)
    )
    known = F.col("_y").isNotNull()
    row = F.struct("_b", "_y")
    edges = rows.groupBy(*part).agg(
        F.min(F.when(known, row)).alias("_head"),
        F.min("_b").alias("_lo"),
        F.max("_b").alias("_hi"),
    )
    whole = Window.partitionBy(*keys)
    later = whole.orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carry = edges.select(
        *part,
        F.first("_head", ignorenulls=True).over(later).alias("_carry"),
        F.min("_lo").over(whole).alias("_start"),
        F.max("_hi").over(whole).alias("_end"),
        F.min("_head").over(whole)["_b"].alias("_first"),
    )
    within = Window.partitionBy(*part).orderBy("_b")
    near = F.coalesce(F.lead(row).over(within), F.col("_carry"))
    spans = (
        rows.join(carry, part)
        .filter(known | (F.col("_first").isNull() & (F.col("_b") == F.col("_start"))))
        .withColumn("_next", near)
        .select(
            *keys, "_b", "_y", "_start",
            F.col("_next._b").alias("_nb"),
            F.col("_next._y").alias("_ny"),
            F.when(F.col("_b") == F.col("_first"), F.col("_start")).otherwise(F.col("_b")).alias("_from"),
            F.coalesce(F.col("_next._b") - step_s, F.col("_end")).alias("_to"),
            ((F.col("_end") - F.col("_start")) / step_s + 1).cast("bigint").alias("n_steps"),
        )
    )
    block = step_s * EXPLODE_BLOCK
    blocks = spans.withColumn("_at", F.explode(F.sequence("_from", "_to", F.lit(block).cast("bigint"))))
    last_of_block = F.least(F.col("_at") + (block - step_s), F.col("_to"))
    grid = blocks.withColumn("_t", F.explode(F.sequence("_at", last_of_block, F.lit(step_s).cast("bigint"))))
    share = (F.col("_t") - F.col("_b")) / (F.col("_nb") - F.col("_b"))
    after = F.when(F.col("_nb").isNull() | (F.col("_t") == F.col("_b")), F.col("_y")).otherwise(
        F.col("_y") + (F.col("_ny") - F.col("_y")) * share
    )
    y = F.when(F.col("_t") >= F.col("_b"), after)
    if direction == "both":
        y = y.otherwise(F.col("_y"))
    return grid.select(
        *keys,
        F.timestamp_seconds("_t").alias("ts"),
        ((F.col("_t") - F.col("_start")) / step_s).cast("bigint").alias("step_idx"),
        "n_steps",
        y.alias("y"),
    )


def regular_series(df: DataFrame, step_s: int, direction: str = "forward", keys: Sequence[str] = ("series_id",),
                   value: str = "y") -> DataFrame:
    return gap_fill(resample(df, step_s, keys=keys, value=value), step_s, direction, keys)


def chrono_split(df: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds `split` by position. The grid is complete, so position and size are known per row: no shuffle."""
    n_train = F.floor(F.col("n_steps") * train)
    n_val = F.floor(F.col("n_steps") * val)
    split = (
        F.when(F.col("step_idx") < n_train, "train")
        .when(F.col("step_idx") < n_train + n_val, "val")
        .otherwise("test")
    )
    return df.withColumn("split", split).withColumn("n_train", n_train).withColumn("n_val", n_val)


def split_meta(split_df: DataFrame, target: str = "Total_Usage", step_s: int = 3600,
               keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per series: sizes of the splits and min, max, mean and sample deviation of the training part."""
    y = F.when(F.col("split") == "train", F.col("y"))
    size = lambda s: F.count_if(F.col("split") == s)
    return split_df.groupBy(*keys).agg(
        F.min(y).alias("train_min"), F.max(y).alias("train_max"), F.avg(y).alias("train_mean"),
        F.stddev_samp(y).alias("train_std"), size("train").alias("n_train"), size("val").alias("n_val"),
        size("test").alias("n_test"),
    ).select(*keys, F.lit(target).alias("target_col"), F.lit(step_s).alias("step_s"), "train_min", "train_max",
             "train_mean", "train_std", "n_train", "n_val", "n_test")


def period_split(df: DataFrame, ts: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut and rows from the cut on; both filters reach the scan."""
    at = F.lit(cut).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < at), df.filter(F.col(ts) >= at)


def missing_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    bad = F.col(value).isNull() | F.isnan(value)
    return df.groupBy(*keys).agg(
        F.count_if(bad).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("has_missing"),
    )


def seasonal_difference(df: DataFrame, lag: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """`y[t] - y[t-lag]`, null for the first `lag` steps."""
    lagged = lag_on_grid(df, keys, "step_idx", "y", lag, "_lagged")
    return lagged.withColumn("diff", F.col("y") - F.col("_lagged")).drop("_lagged")


def history_tail(df: DataFrame, n: int = 500, keys: Sequence[str] = ("series_id",),
                 order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    return ends(df, keys, order, n, time_chunk(order[0], HOUR_S) if chunk is None else chunk)


def history_sample(df: DataFrame, n: int = 3, keys: Sequence[str] = ("series_id",),
                   order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """First and last `n` rows per series with their rank from that end."""
    chunk = time_chunk(order[0], HOUR_S) if chunk is None else chunk
    head = ends(df, keys, order, n, chunk, last=False, rank="rank").withColumn("part", F.lit("head"))
    tail = ends(df, keys, order, n, chunk, last=True, rank="rank").withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def last_observed(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",),
                  value: str = "y") -> DataFrame:
    last = F.max_by(nan_to_null(value), F.struct(*order))
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.coalesce(last, F.lit(0.0))).alias("last_observed"))


def series_arrays(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series with `values` in step order: the input of the model functions.

    Called on the regular grid only: its length is time span / step, whatever the number of raw
    samples behind it (ten years of hours are 87,600 doubles).
    """
    pairs = F.array_sort(F.collect_list(F.struct("step_idx", "y")))
    return df.groupBy(*keys).agg(F.min("ts").alias("start_ts"), pairs.alias("_p")).select(
        *keys, "start_ts", F.transform("_p", lambda p: p["y"]).alias("values")
    )
