"""Metric samples: label filter, counter rate, gauge sum, instant and range evaluation, restarts.

Samples: `(metric_name, labels map, ts, value)`, narrowed by the caller to key columns plus a
source column (one counter or gauge per source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions import BYTES_PER_GB
from tidegauge.operators.ordered import CHUNK, time_chunk, with_halo, with_neighbour, with_neighbour_within

MICRO = 1_000_000
HOUR_S = 3600


def keep_label(df: DataFrame, label: str, pattern: str, labels: str = "labels", add: dict | None = None) -> DataFrame:
    """Keeps samples whose label matches; a missing label counts as empty text.

    Can add constant labels; they replace labels of the same name.
    """
    value = F.coalesce(F.try_element_at(F.col(labels), F.lit(label)), F.lit(""))
    out = df.filter(value.rlike(pattern))
    if add:
        extra = F.create_map(*[F.lit(x) for kv in add.items() for x in kv])
        others = F.map_filter(labels, lambda name, _: ~name.isin(list(add)))
        out = out.withColumn(labels, F.map_concat(others, extra))
    return out


def _growth(value: Column, before: Column) -> Column:
    """Growth of a counter; a smaller value is a reset and counts from 0. Null without a sample before."""
    return F.when(before.isNull(), None).when(value >= before, value - before).otherwise(value)


def increases(df: DataFrame, keys: Sequence[str], window_s: int, order: Sequence[str] = ("ts",),
              value: str = "value", chunk_s: int = HOUR_S) -> DataFrame:
    """Reset-aware growth since the previous sample of the source.

    Null when there is no previous sample within the window: such a pair is in no window anyway.
    """
    paired = with_neighbour_within(df, keys, order, ["ts", value], window_s, chunk_s)
    return paired.withColumn("increase", _growth(F.col(value), F.col(f"prev_{value}")))


def counter_rate(df: DataFrame, keys: Sequence[str], window_s: int = 60, order: Sequence[str] = ("ts",),
                 value: str = "value", chunk_s: int = HOUR_S) -> DataFrame:
    """Rate per second at each sample over the trailing `(ts - window, ts]`, reset-aware.

    Growth between samples that both lie in the window, divided by the window; nothing is
    extrapolated to the window edges. Null with fewer than two samples. Previous sample and window
    share one shuffle.
    """
    reach = window_s * MICRO
    haloed = with_halo(df.withColumn("_us", F.unix_micros("ts")), F.col("_us"), max(chunk_s * MICRO, 4 * reach), reach)
    part = Window.partitionBy(*keys, CHUNK)
    inside = part.orderBy(*order)
    by_time = part.orderBy("_us")
    grown = haloed.withColumn("_i", F.row_number().over(inside)).withColumn(
        "_up", F.coalesce(_growth(F.col(value), F.lag(value).over(inside)), F.lit(0.0))
    )
    # Prefix sums, not sliding frames: a sliding frame is summed anew for every row, which is quadratic
    # in the density of the samples. The rate is the growth so far less the growth up to the first row
    # of the window, which is the row after the last one outside.
    so_far = grown.withColumn("_sum", F.sum("_up").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = so_far.withColumn("_next", F.lead("_sum").over(inside))
    outside = by_time.rangeBetween(Window.unboundedPreceding, -reach)
    until = by_time.rangeBetween(Window.unboundedPreceding, 0)
    rows = (
        so_far.withColumn("_out", F.max(F.struct("_i", "_next")).over(outside))
        .withColumn("_last", F.max(F.struct("_i", "_sum")).over(until))
        .filter(~F.col("_halo"))
    )
    n = F.col("_last._i") - F.coalesce(F.col("_out._i"), F.lit(0))
    rate = (F.col("_last._sum") - F.when(F.col("_out").isNotNull(), F.col("_out._next")).otherwise(F.lit(0.0))) / window_s
    return rows.select(*df.columns, F.when(n > 1, rate).alias("rate"))


def _grid_instants(first_us: Column, before_us: Column, start_us: int, end_us: int, step_us: int) -> Column:
    """Grid instants t with first <= t < before, as an array (null when there are none)."""
    lo = F.greatest(F.ceil((first_us - start_us) / step_us), F.lit(0).cast("bigint"))
    hi = F.least(
        F.floor((before_us - 1 - start_us) / step_us), F.lit((end_us - start_us) // step_us).cast("bigint")
    )
    return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: i * step_us + start_us))


def _us(ts) -> int:
    import datetime as dt

    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=dt.timezone.utc)
    return round((ts - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def _between(df: DataFrame, first_us: int, last_us: int) -> DataFrame:
    """Time range as a plain comparison, so it reaches the scan."""
    low = F.timestamp_micros(F.lit(first_us))
    return df.filter((F.col("ts") >= low) & (F.col("ts") <= F.timestamp_micros(F.lit(last_us))))


def rate_range(df: DataFrame, source: Sequence[str], start, end, step_s: int, by: Sequence[str] = (),
               window_s: int = 60, order: Sequence[str] = ("ts",), value: str = "value",
               chunk_s: int = HOUR_S) -> DataFrame:
    """`sum(rate(counter[window]))` on a step grid.

    Each pair of neighbouring samples goes to the few grid instants whose window holds both (at most
    window / step), and a map-side combined sum does the rest: no range join, no nested loop.
    """
    s, e, w = _us(start), _us(end), window_s * MICRO
    grown = increases(_between(df, s - w + 1, e), source, window_s, order, value, chunk_s)
    instants = _grid_instants(F.unix_micros("ts"), F.unix_micros("prev_ts") + w, s, e, step_s * MICRO)
    hits = grown.filter(F.col("increase").isNotNull()).withColumn("_t", F.explode(instants))
    return hits.groupBy(*by, F.timestamp_micros("_t").alias("ts")).agg((F.sum("increase") / window_s).alias("value"))


def gauge_range(df: DataFrame, source: Sequence[str], start, end, step_s: int, by: Sequence[str] = (),
                lookback_s: int = 300, order: Sequence[str] = ("ts",), value: str = "value",
                divide_by: float = BYTES_PER_GB, chunk_s: int = HOUR_S) -> DataFrame:
    """`sum(gauge) / 2^30` on a step grid: the latest sample of each source within the look-back."""
    s, e, w = _us(start), _us(end), lookback_s * MICRO
    rows = _between(df, s - w + 1, e)
    paired = with_neighbour_within(rows, source, order, ["ts"], lookback_s, chunk_s, forward=True)
    us = F.unix_micros("ts")
    until = F.least(us + w, F.coalesce(F.unix_micros("next_ts"), us + w))
    hits = paired.withColumn("_t", F.explode(_grid_instants(us, until, s, e, step_s * MICRO)))
    return hits.groupBy(*by, F.timestamp_micros("_t").alias("ts")).agg((F.sum(value) / divide_by).alias("value"))


def bootstrap(counters: DataFrame, gauges: DataFrame, source: Sequence[str], start, end, step_s: int, by: Sequence[str],
              scales: dict[str, float], window_s: int = 60, lookback_s: int = 300, order: Sequence[str] = ("ts",),
              divide_by: float = BYTES_PER_GB) -> DataFrame:
    """History both metrics begin with: `(by…, metric, ts, value)` by range evaluation over the time before the loop,
    rescaled from the test machine to the real one. A metric without samples has no row."""
    cpu = rate_range(counters, source, start, end, step_s, by, window_s, order)
    ram = gauge_range(gauges, source, start, end, step_s, by, lookback_s, order, divide_by=divide_by)
    parts = [df.select(*by, F.lit(m).alias("metric"), "ts", (F.col("value") * F.lit(float(scales[m]))).alias("value"))
             for m, df in (("cpu", cpu), ("ram", ram))]
    return parts[0].unionByName(parts[1])


def instant_value(groups: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Value of an instant evaluation per group, 0.0 where the evaluation is empty."""
    return groups.select(*by).distinct().join(values.select(*by, "value"), list(by), "left").select(
        *by, F.coalesce("value", F.lit(0.0)).alias("value")
    )


def restart_spikes(pods: DataFrame, pod: Sequence[str], order: Sequence[str] = ("ts",),
                   restarts: str = "restart_count", chunk_s: int = HOUR_S) -> DataFrame:
    """Per pod sample: did the restart counter grow since the sample before? The first never fires."""
    paired = with_neighbour(pods, pod, order, [restarts], time_chunk("ts", chunk_s))
    grew = F.coalesce(F.col(restarts) > F.col(f"prev_{restarts}"), F.lit(False))
    return paired.select(*pods.columns, grew.alias("restarted"))


def restart_cycles(spikes: DataFrame, by: Sequence[str]) -> DataFrame:
    return spikes.groupBy(*by).agg(F.bool_or("restarted").alias("crashed"))


def crash_ram(actual_gb, crashed, max_memory_mb: int) -> Column:
    """A crash hides the real use: the limit stands in for it."""
    value = F.col(actual_gb) if isinstance(actual_gb, str) else actual_gb
    flag = F.col(crashed) if isinstance(crashed, str) else crashed
    return F.when(flag, F.lit(max_memory_mb / 1024.0)).otherwise(value)
