"""Load traces from regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import half_even, phase_tag, trace_memory_mb, trace_rps

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def cpu_trace(series: DataFrame, total_cores, peak_rps, warmup_steps: int = 0, keys=("app",)) -> DataFrame:
    return series.select(
        *keys, F.col("step_idx").alias("index"), F.date_format("ts", ISO).alias("timestamp"),
        trace_rps("y", total_cores, peak_rps).alias("rps"), half_even("y", 4).alias("cpu_actual_cores"),
        phase_tag("step_idx", warmup_steps).alias("phase"),
    )


def ram_trace(series: DataFrame, total_gb, min_mb=64, max_mb=8192, step_mb: int = 64,
              warmup_steps: int = 0, keys=("app",)) -> DataFrame:
    return series.select(
        *keys, F.col("step_idx").alias("index"), F.date_format("ts", ISO).alias("timestamp"),
        trace_memory_mb("y", total_gb, min_mb, max_mb, step_mb).alias("memory_mb"),
        half_even("y", 4).alias("ram_actual_gb"), phase_tag("step_idx", warmup_steps).alias("phase"),
    )


def trace_peak(trace: DataFrame, default: int = 27, keys=("app",)) -> DataFrame:
    return trace.groupBy(*keys).agg(F.coalesce(F.max("rps"), F.lit(default)).alias("peak_rps"))
