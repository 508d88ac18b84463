"""Streams: late rows, restart from a checkpoint, state caps, and equality with the batch result."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import Policy
from tidegauge.operators import policy as ops, select
from tidegauge.operators.models import MODELS, model_functions, register_model, run_model
from tidegauge.streaming import commits, io, processors, rates, stateful, windows
from test_policy import SCHEMA, random_cycles

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SAMPLES = "k string, ts timestamp, value double"


def add_file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    add_file(spark, src, [("a", at(0), 1.0), ("a", at(5), 3.0), ("a", at(100), 7.0)], SAMPLES)
    schema = spark.read.parquet(str(src)).schema

    def run():
        stream = io.read_files(spark, str(src), schema, files_per_trigger=1)
        ticks = windows.stream_ticks(stream, "15 seconds", "30 seconds", ["k"], [F.avg("value").alias("y")])
        q = io.start_table(ticks, out, ck)
        q.awaitTermination()
        return q

    assert io.late_rows(run()) == 0
    # Restart: the watermark is at 70 s, so a row at 6 s is late, one at 80 s is not.
    add_file(spark, src, [("a", at(6), 99.0), ("a", at(80), 5.0), ("a", at(300), 1.0)], SAMPLES)
    assert io.late_rows(run()) == 1
    got = {int((r.ts.replace(tzinfo=dt.timezone.utc) - T0).total_seconds()): r.y for r in spark.read.parquet(out).collect()}
    assert got == {0: 2.0, 75: 5.0, 90: 7.0}


@pytest.mark.parametrize("files", [1, 4])
def test_stream_actions_equal_batch(spark, tmp_path, files):
    rows = random_cycles(200, 7, 400)
    src = tmp_path / "src"
    size = len(rows) // files
    for i in range(files):
        add_file(spark, src, rows[i * size: (i + 1) * size], SCHEMA)
    df = spark.read.parquet(str(src))
    stream = io.read_files(spark, str(src), df.schema, files_per_trigger=1)
    p = Policy()
    done = stateful.stream_scaler(stream, p, ["namespace"], ["timestamp", "id"], "restarted")
    got = io.run_to_table(done, str(tmp_path / "out"))
    want = ops.scale_actions(df, p, order=["timestamp", "id"], restarted="restarted")
    cols = ["id", "desired_replicas", "desired_memory_mb", "action_horizontal", "action_vertical", "pod_restart_count"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_history_is_capped_and_survives_a_restart(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    models = {"LastValue": {}, "SeasonalNaive": {"lag": "4"}}

    def run():
        schema = spark.read.parquet(str(src)).schema
        ticks = io.read_files(spark, str(src), schema, files_per_trigger=1)
        q = io.start_table(stateful.stream_forecast(ticks, models, 15, 3, ["k"], max_points=10), out, ck)
        q.awaitTermination()

    schema = "k string, ts timestamp, y double"
    add_file(spark, src, [("a", at(15 * i), float(i % 4)) for i in range(12)], schema)
    run()
    add_file(spark, src, [("a", at(15 * i), float(i % 4)) for i in range(12, 24)], schema)
    run()
    rows = spark.read.parquet(out).orderBy("ts").collect()
    assert [r.n_points for r in rows] == [min(i + 1, 10) for i in range(24)]
    assert rows[0].status == "short history" and rows[0].y_hat == 0.0
    # The seasonal component wins once there is enough history, and then it is exact.
    assert rows[-1].model == "SeasonalNaive" and [r.y_hat for r in rows[-6:]] == [float((i + 1) % 4) for i in range(18, 24)]


COUNTS = [("p", at(10 * i), float(v)) for i, v in enumerate([1, 4, 9, 2, 5, 5, 8, 20, 21, 1, 3, 4, 4, 9, 2])]


def plain_rates(rows, window, slide):
    """Reset-aware growth of every window `[start, start + window)` with two samples."""
    out, seconds = {}, [(int((t - T0).total_seconds()), v) for _, t, v in rows]
    for start in range(-window, max(s for s, _ in seconds) + window, slide):
        own = [v for s, v in sorted(seconds) if start <= s < start + window]
        if len(own) > 1:
            out[start + window] = sum(b - a if b >= a else b for a, b in zip(own, own[1:])) / window
    return out


@pytest.mark.parametrize("order", ["in order", "late", "interleaved"])
def test_sliding_rate_from_partials(spark, tmp_path, order):
    """Batches in order, one that comes late, and batches whose samples alternate in time."""
    parts = {"in order": [COUNTS[:4], COUNTS[4:9], COUNTS[9:]], "late": [COUNTS[:4], COUNTS[9:], COUNTS[4:9]],
             "interleaved": [COUNTS[0::2], COUNTS[1::2]]}[order]
    src, path = tmp_path / "src", str(tmp_path / "out")
    for part in parts:
        add_file(spark, src, part, SAMPLES)
    df = spark.read.parquet(str(src))
    stream = io.read_files(spark, str(src), df.schema, files_per_trigger=1)
    commits.finished(rates.start_partials(stream, path, str(tmp_path / "ck"), ["k"], 30))
    partials = commits.committed(spark, path, rates.slide_partials(df.limit(0), ["k"], 30).schema)
    assert partials.count() <= 5 * len(parts)
    mixed = rates.interleaved(partials, ["k"]).count()
    assert (mixed > 0) == (order == "interleaved")
    done = rates.window_rates(rates.mended(partials, df, ["k"], 30), ["k"], 60, 30).collect()
    got = {int((r.ts.replace(tzinfo=dt.timezone.utc) - T0).total_seconds()): r.rate for r in done}
    want = plain_rates(COUNTS, 60, 30)
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_partials_of_a_hot_source_stay_few(spark):
    """Ten thousand samples of one pod in one slide are one partial."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                      F.timestamp_millis(F.col("id") * 3).alias("ts"), (F.col("id") % 700).cast("double").alias("value"))
    partials = rates.slide_partials(rows, ["k"], 60)
    hot = partials.where("k = 'hot'").collect()
    assert len(hot) == 1 and hot[0].n == 10_000
    own = [float(i % 700) for i in range(0, 20_000, 2)]
    assert hot[0].growth == sum(b - a if b >= a else b for a, b in zip(own, own[1:]))


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """The stream dies after writing a batch and before noting it: the batch runs again."""
    src, path, ck = tmp_path / "src", str(tmp_path / "out"), tmp_path / "ck"
    add_file(spark, src, [("a", at(0), 1.0), ("b", at(5), 2.0)], SAMPLES)
    schema = spark.read.parquet(str(src)).schema

    def run():
        stream = io.read_files(spark, str(src), schema, files_per_trigger=1).withColumn("phase", F.col("k"))
        return commits.finished(commits.start_commits(stream, path, str(ck), ("phase",)))

    run()
    add_file(spark, src, [("a", at(9), 3.0)], SAMPLES)
    run()
    written = spark.read.parquet(str(src)).withColumn("phase", F.col("k")).schema
    assert commits.committed(spark, path, written).count() == 3
    for name in ("1", ".1.crc"):
        (ck / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted(r.value for r in commits.committed(spark, path, written).collect()) == [1.0, 2.0, 3.0]


def test_open_windows_are_closed_at_the_end_and_replaced_when_the_stream_goes_on(spark, tmp_path):
    src, path, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    ticks = lambda df: windows.stream_ticks(df, "15 seconds", "30 seconds", ["k"], [F.sum("value").alias("y")])

    def run():
        stream = ticks(io.read_files(spark, str(src), spark.read.parquet(str(src)).schema, files_per_trigger=1))
        query = commits.finished(commits.start_commits(stream, path, ck))
        opened = commits.close_windows(query, spark.read.parquet(str(src)), ticks, path, "ts", "15 seconds")
        rows = commits.committed(spark, path, stream.schema).collect()
        return opened.count(), sorted((int((r.ts.replace(tzinfo=dt.timezone.utc) - T0).total_seconds()), r.y) for r in rows)

    add_file(spark, src, [("a", at(0), 1.0), ("a", at(20), 2.0), ("a", at(70), 4.0)], SAMPLES)
    opened, rows = run()
    assert opened == 1 and rows == [(0, 1.0), (15, 2.0), (60, 4.0)]
    add_file(spark, src, [("a", at(65), 8.0), ("a", at(200), 16.0)], SAMPLES)
    opened, rows = run()
    assert rows == [(0, 1.0), (15, 2.0), (60, 12.0), (195, 16.0)]


def test_late_rows_are_counted_over_many_batches(spark, tmp_path):
    """More batches than the recent progress of a stream holds."""
    src = tmp_path / "src"
    schema = "k string, ts timestamp, value double"
    for i in range(120):
        add_file(spark, src, [("a", at(1000 + 100 * i), 1.0), *([("a", at(5), 9.0)] if i % 3 == 2 else [])], schema)
    account = commits.LateRows()
    spark.streams.addListener(account)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = io.read_files(spark, str(src), spark.read.parquet(str(src)).schema, files_per_trigger=1)
        ticks = windows.stream_ticks(stream, "15 seconds", "30 seconds", ["k"], [F.count("*").alias("n")])
        query = io.start_table(ticks, str(tmp_path / "out"), str(tmp_path / "ck"))
        commits.finished(query)
        for _ in range(100):
            if account.total >= 40:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(account)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert account.total == 40
    assert account.batches[str(query.id)] > 100


@pytest.mark.parametrize("files", [1, 5])
def test_warm_forecast_crosses_batches(spark, tmp_path, files):
    """Whatever the batches, each tick sees the bootstrap and the ticks before it; a late one takes its place."""
    src, schema = tmp_path / "src", "k string, ts timestamp, y double"
    value = lambda i: float(i % 4 + (i > 30))
    boot = spark.createDataFrame([("a", at(15 * i), value(i)) for i in range(8)] + [("c", at(0), 5.0)], schema)
    rows = [("a", at(15 * i), value(i)) for i in range(8, 40)] + [("b", at(15 * i), 2.0) for i in range(3)]
    size = -(-len(rows) // files)
    for i in range(files):
        add_file(spark, src, rows[i * size:(i + 1) * size], schema)
    stream = io.read_files(spark, str(src), boot.schema, files_per_trigger=1)
    models = {"SeasonalNaive": {"lag": "4"}, "LastValue": {}}
    out = processors.live_forecast(stream, models, 15, 6, ["k"], boot, max_points=20)
    commits.finished(commits.start_commits(out, str(tmp_path / "out"), str(tmp_path / "ck")))
    done = commits.committed(spark, str(tmp_path / "out"), out.schema).orderBy("k", "ts").collect()
    a = [r for r in done if r.k == "a"]
    assert [r.n_points for r in a] == [min(i + 1, 20) for i in range(8, 40)]
    # The first forecast already knows the season from the bootstrap.
    assert a[0].model == "SeasonalNaive" and a[0].y_hat == value(5)
    batch, chosen, fns = [value(i) for i in range(8)], select.initial_component(list(models)), model_functions()
    for i, r in zip(range(8, 40), a):
        batch = [*batch, value(i)][-20:]
        series = np.array(batch)
        chosen, _ = select.select_online(fns, series, models, chosen, 6, 15)
        want = run_model(fns, chosen, series, 1, 15, models[chosen])[0][0]
        assert (r.model, r.y_hat) == (chosen, want)
    assert [r.n_points for r in done if r.k == "b"] == [1, 2, 3]


def test_late_tick_is_inserted_and_failures_are_counted(spark, tmp_path):
    src, schema = tmp_path / "src", "k string, ts timestamp, y double"
    add_file(spark, src, [("a", at(0), 1.0), ("a", at(30), 3.0)], schema)
    add_file(spark, src, [("a", at(15), 7.0)], schema)
    add_file(spark, src, [("a", at(45), 5.0), ("a", at(45), 6.0)], schema)
    register_model("Broken", lambda y, horizon, step_s, params: 1 / 0)
    try:
        ticks = io.read_files(spark, str(src), spark.read.parquet(str(src)).schema, files_per_trigger=1)
        out = processors.live_forecast(ticks, {"Broken": {}}, 15, 50, ["k"], max_points=3)
        commits.finished(commits.start_commits(out, str(tmp_path / "out"), str(tmp_path / "ck")))
    finally:
        del MODELS["Broken"]
    done = commits.committed(spark, str(tmp_path / "out"), out.schema).orderBy("refit_skipped", "ts", "y").collect()
    assert [(r.n_points, r.refit_skipped, r.status.split(":")[0]) for r in done] == [
        (1, 0, "short history"), (2, 1, "failed"), (3, 2, "failed"), (3, 3, "failed"), (3, 4, "failed")]
    assert [r.y_hat for r in done] == [1.0, 3.0, 3.0, 5.0, 6.0]


def test_event_routing(spark, tmp_path):
    src = tmp_path / "src"
    add_file(spark, src, [("w", "warmup"), ("e", "evaluation"), ("f", "evaluation")], "id string, phase string")
    stream = io.read_files(spark, str(src), spark.read.parquet(str(src)).schema)
    table = io.run_to_table(stream, str(tmp_path / "out"), ("phase",))
    assert {(r.id, r.phase) for r in table.collect()} == {("w", "warmup"), ("e", "evaluation"), ("f", "evaluation")}
    assert (tmp_path / "out" / "phase=warmup").is_dir()
