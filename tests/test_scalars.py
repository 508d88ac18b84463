"""Column functions against hand-made values and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import functions as fn


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, kind, f):
    return [r.o for r in column(spark, values, kind).select("i", f("v").alias("o")).orderBy("i").collect()]


def test_half_even_follows_numpy(spark):
    values = [1.015, 2.675, 0.125, 2.5, -2.5, 1.005, 0.285, 1e-9, 33.335]
    assert apply(spark, values, "double", lambda c: fn.half_even(c, 2)) == [float(np.round(v, 2)) for v in values]
    assert apply(spark, [0.5, 1.5, 2.5, -0.5], "double", fn.half_even) == [0.0, 2.0, 2.0, 0.0]


def test_memory_quantities(spark):
    texts = ["512Mi", "1.5Gi", "512Ki", "100M", "1.5G", "1048576", "", None, "2048Ki", "7", " 64Mi ", "abc", "xKi"]
    want = [512, 1536, 1, 100, 1500, 1, 0, 0, 2, 1, 64, None, None]
    assert apply(spark, texts, "string", fn.memory_mb) == want


def test_durations(spark):
    texts = ["2d", "2D", "30s", "30S", "45", " 7d ", "3h", "", "-1"]
    assert apply(spark, texts, "string", fn.duration_s) == [172800, 172800, 30, 30, 45, 604800, None, None, None]


def test_sanitize(spark):
    values = [1.5, float("nan"), float("inf"), float("-inf"), None, -3.0]
    assert apply(spark, values, "double", fn.sanitize_prediction) == [1.5, 99999999.0, 99999999.0, 99999999.0, 99999999.0, -3.0]


def test_trace_values(spark):
    # Ratios that end in .5 go to the even neighbour; the floor is one request per second.
    got = apply(spark, [0.0, 0.5, 1.5, 2.5, 48.0], "double", lambda c: fn.trace_rps(c, F.lit(48.0), 48))
    assert got == [1, 1, 2, 2, 48]
    got = apply(spark, [0.0, 8.0, 12.0, 16.0, 900.0], "double", lambda c: fn.trace_memory_mb(c, F.lit(1024.0), 4, 1024, 8))
    assert got == [0, 8, 16, 16, 896]


@pytest.mark.parametrize("name,key", [
    ("Ensemble[B+A]", "A+B"), ("Ensemble[A+B]", "A+B"), ("Ensemble[C+A+B]", "A+B+C"), ("FFT", "FFT"),
])
def test_canonical_key(spark, name, key):
    assert apply(spark, [name], "string", fn.canonical_key) == [key]


def test_slugs(spark):
    row = spark.range(1).select(
        fn.other_slug(F.lit("a-cpu")).alias("a"), fn.other_slug(F.lit("b-ram")).alias("b"),
        fn.dataset_name(F.lit("c-ram"), "usage", "hist").alias("c"), fn.dataset_name(F.lit("z-cpu"), "u", "h").alias("d"),
        fn.model_slug(F.lit("Other")).alias("e"),
        fn.model_slug(F.lit("Ensemble"), F.array(F.lit("FFT"), F.lit("Prophet"))).alias("f"),
        fn.save_name(F.lit("Ensemble"), F.array().cast("array<string>")).alias("g"),
    ).first()
    assert list(row) == ["a-ram", "b-cpu", "usage_application_C_RAM_hist", None, "other", "ens-fft-prophet", "Ensemble"]


def test_percent_changes(spark):
    rows = spark.createDataFrame([(2.0, 3.0), (0.0, 1.0), (-1.0, 1.0), (None, 1.0)], "b double, n double")
    got = rows.select(fn.worse_by_percent("b", "n").alias("w"), fn.lost_percent("b", "n").alias("l")).collect()
    assert [tuple(r) for r in got] == [(50.0, -50.0), (None, None), (None, None), (None, None)]


def test_lags():
    assert [fn.lag_for_step(s) for s in (3600, 2400, 900)] == [24, 36, 1]
    assert fn.lag_for_step(900, generalize=True) == 96
    assert math.isclose(fn.BYTES_PER_GB, 2.0**30)
