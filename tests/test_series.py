"""Ordered operators, gap filling, splits: hand-made series, pandas, and brute force over random data."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge import catalog
from tidegauge.operators import ordered, series as ops

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def hourly(spark, points, sid="s"):
    return spark.createDataFrame([(sid, at(h), None if v is None else float(v)) for h, v in points],
                                 "series_id string, ts timestamp, y double")


def values(df):
    return [r.y for r in df.orderBy("ts").collect()]


@pytest.mark.parametrize("chunk_steps", [1, 2, 3, 8192])
@pytest.mark.parametrize("direction", ["forward", "both"])
def test_gap_fill_like_pandas(spark, chunk_steps, direction):
    points = [(0, None), (1, None), (2, 1.0), (4, 3.0), (5, None), (8, 11.0), (9, 2.0), (12, None), (14, None)]
    got = values(ops.gap_fill(hourly(spark, points), 3600, direction, chunk_steps=chunk_steps))
    s = pd.Series({h: v for h, v in points}, dtype=float).reindex(range(15))
    want = s.interpolate(limit_direction=direction)
    assert [None if pd.isna(v) else round(v, 9) for v in want] == [None if v is None else round(v, 9) for v in got]


def test_gap_fill_full_grid_is_identity(spark):
    points = [(h, h * h % 7) for h in range(20)]
    out = ops.gap_fill(hourly(spark, points), 3600, chunk_steps=4)
    assert values(out) == [float(v) for _, v in points]
    assert [r.step_idx for r in out.orderBy("ts").collect()] == list(range(20))


def test_gap_fill_long_gap_and_single_row(spark, monkeypatch):
    monkeypatch.setattr(ops, "EXPLODE_BLOCK", 7)
    got = values(ops.gap_fill(hourly(spark, [(0, 0.0), (100, 100.0)]), 3600))
    assert np.allclose(got, np.arange(101))
    assert values(ops.gap_fill(hourly(spark, [(5, 3.0)]), 3600)) == [3.0]
    assert values(ops.gap_fill(hourly(spark, []), 3600)) == []


def test_resample_edges_and_nan(spark):
    df = spark.createDataFrame(
        [("s", T0, 1.0), ("s", T0 + dt.timedelta(minutes=39, seconds=59), 3.0), ("s", T0 + dt.timedelta(minutes=40), 5.0),
         ("s", T0 + dt.timedelta(minutes=41), float("nan"))], "series_id string, ts timestamp, y double")
    rows = ops.resample(df, 2400).orderBy("ts").collect()
    assert [(r.ts.minute, r.y) for r in rows] == [(0, 2.0), (40, 5.0)]


def test_total_counts_missing_row_as_zero(spark):
    df = spark.createDataFrame([("A", T0, 1.0), ("A", T0, float("nan")), ("A", at(1), None), ("A", at(2), 2.0)],
                               "app string, ts timestamp, value double")
    assert values(ops.total_usage(df, ["app"])) == [1.0, 0.0, 2.0]


def test_usage_units(spark):
    df = spark.createDataFrame(
        [("A", "CPU", "A1", T0, 25.375), ("B", "RAM", "B1", T0, 17.5), ("C", "RAM", "C1", T0, 2.0**31)],
        "app string, metric string, instance string, ts timestamp, value double")
    got = {r.app: r.value for r in ops.to_usage(df, catalog.capacity(spark)).collect()}
    assert got == {"A": float(np.round(25.375 * 4 / 100, 2)), "B": 17.5, "C": 2.0}


@pytest.mark.parametrize("n", [1, 7, 10, 720])
def test_split_sizes(spark, n):
    # Truncation of the double product: 720 * 0.70 is just below 504.
    train, val = int(n * 0.70), int(n * 0.15)
    out = ops.chrono_split(ops.gap_fill(hourly(spark, [(h, h) for h in range(n)]), 3600))
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(sizes.get(s, 0) for s in ("train", "val", "test")) == (train, val, n - train - val)


def random_rows(n=400, seed=3):
    rng = random.Random(seed)
    # Key "hot" holds most rows; times repeat, and there are long gaps.
    return [(rng.choice(["hot"] * 8 + ["a", "b"]), T0 + dt.timedelta(seconds=rng.choice([rng.randint(0, 600), rng.randint(0, 500000)])),
             i, rng.randint(-5, 20)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, v long")
    pdf = pd.DataFrame(rows, columns=["k", "ts", "id", "v"]).sort_values(["k", "ts", "id"])
    return df, pdf


@pytest.mark.parametrize("chunk_s", [60, 3600, 10**7])
def test_chunked_operators_equal_whole_key(frame, chunk_s):
    df, pdf = frame
    chunk = ordered.time_chunk("ts", chunk_s)
    g = pdf.groupby("k")
    want = pd.DataFrame({
        "id": pdf.id, "prev": g.v.shift(1), "next": g.v.shift(-1), "pos": g.cumcount(), "run": g.v.cumsum(),
        "n": g.v.transform("size"),
    }).set_index("id")
    keys, order = ["k"], ["ts", "id"]
    got = ordered.with_neighbour(df, keys, order, ["v"], chunk)
    assert {r.id: r.prev_v for r in got.collect()} == {i: None if pd.isna(v) else int(v) for i, v in want.prev.items()}
    got = ordered.with_neighbour(df, keys, order, ["v"], chunk, forward=True)
    assert {r.id: r.next_v for r in got.collect()} == {i: None if pd.isna(v) else int(v) for i, v in want.next.items()}
    got = ordered.with_position(df, keys, order, chunk, "pos", "n")
    assert {r.id: (r.pos, r.n) for r in got.collect()} == {i: (p, n) for i, p, n in zip(want.index, want.pos, want.n)}
    got = ordered.with_running_sum(df, keys, order, F.col("v"), chunk, "run")
    assert {r.id: r.run for r in got.collect()} == want.run.to_dict()
    for last in (True, False):
        got = {r.id for r in ordered.ends(df, keys, order, 5, chunk, last).collect()}
        assert got == set((g.tail(5) if last else g.head(5)).id)


@pytest.mark.parametrize("forward", [False, True])
def test_neighbour_within_reach(frame, forward):
    df, pdf = frame
    reach = 300
    got = ordered.with_neighbour_within(df, ["k"], ["ts", "id"], ["id"], reach, 600, forward)
    shift = -1 if forward else 1
    near_id, near_ts = pdf.groupby("k").id.shift(shift), pdf.groupby("k").ts.shift(shift)
    close = (pdf.ts - near_ts).abs() <= pd.Timedelta(seconds=reach)
    want = {i: int(n) if ok else None for i, n, ok in zip(pdf.id, near_id, close)}
    assert {r.id: r[("next_" if forward else "prev_") + "id"] for r in got.collect()} == want


def test_lag_on_grid_over_chunks(spark):
    df = spark.range(1000).select(F.lit("s").alias("k"), F.col("id").alias("i"), (F.col("id") * 3).alias("v"))
    out = ordered.lag_on_grid(df, ["k"], "i", "v", 24, "p", chunk_rows=100)
    got = {r.i: r.p for r in out.collect()}
    assert got == {i: (i - 24) * 3 if i >= 24 else None for i in range(1000)}


def test_chunk_seconds(spark):
    df = spark.range(6000).select(F.lit("k").alias("k"), F.timestamp_seconds((F.col("id") / 100).cast("bigint")).alias("ts"))
    assert ordered.chunk_seconds(df, ["k"], "ts", rows_per_chunk=600) == 6
    assert ordered.chunk_seconds(df, ["k"], "ts", rows_per_chunk=10**12) == 86400


def test_history_sample_and_last(spark):
    df = hourly(spark, [(0, 5), (1, 6), (2, -7)])
    sample = ops.history_sample(df, 2)
    assert sorted((r.part, r["rank"], r.y) for r in sample.collect()) == [
        ("head", 1, 5.0), ("head", 2, 6.0), ("tail", 1, -7.0), ("tail", 2, 6.0)]
    assert ops.last_observed(df).first().last_observed == 0.0


def test_split_meta_and_missing(spark):
    split = ops.chrono_split(ops.gap_fill(hourly(spark, [(h, h) for h in range(10)]), 3600))
    m = ops.split_meta(split).first()
    assert (m.train_min, m.train_max, m.train_mean, m.n_train, m.n_val, m.n_test) == (0.0, 6.0, 3.0, 7, 1, 2)
    assert np.isclose(m.train_std, np.std(np.arange(7), ddof=1))
    r = ops.missing_report(hourly(spark, [(0, 1), (1, None), (2, float("nan"))]), ["series_id"], "y").first()
    assert (r.n_missing, r.n_rows, r.has_missing) == (2, 3, True)


@pytest.mark.parametrize("app,metric", [("Z", "CPU"), (None, "RAM"), ("A", "DISK"), ("A", None)])
def test_unknown_usage_is_an_error(spark, app, metric):
    df = spark.createDataFrame([(app, metric, "A1", T0, 1.0)],
                               "app string, metric string, instance string, ts timestamp, value double")
    with pytest.raises(Exception, match="unknown"):
        ops.to_usage(df, catalog.capacity(spark)).collect()


@pytest.mark.parametrize("direction", ["forward", "both"])
def test_series_without_a_known_bin_keeps_its_grid(spark, direction):
    rows = [("none", T0 + dt.timedelta(hours=h), None) for h in (0, 3)] + [("some", T0, 1.0), ("some", T0 + dt.timedelta(hours=2), None)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, y double")
    got = {(r.series_id, r.step_idx): (r.y, r.n_steps) for r in ops.gap_fill(df, 3600, direction, chunk_steps=2).collect()}
    assert got == {**{("none", i): (None, 4) for i in range(4)}, **{("some", i): (1.0, 3) for i in range(3)}}
