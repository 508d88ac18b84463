"""Scaling policy and samples: a plain loop over rows as the brute-force check."""

import datetime as dt
import math
import random

import pytest

from tidegauge.catalog import Policy
from tidegauge.operators import metrics, policy as ops, samples

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = ("namespace string, id long, timestamp timestamp, scaling_mode string, current_replicas int, current_memory_mb int,"
          " actual_cpu_cores double, predicted_cpu_cores double, actual_ram_gb double, predicted_ram_gb double, restarted boolean")


def brute(rows, p):
    """Row by row with plain clocks."""
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        ns, i, ts, mode, cur_r, cur_m, _, pc, _, pr, restarted = r
        s = state.setdefault(ns, {"start": ts, "up": None, "down": None, "v": None})

        def open_(clock, seconds):
            return s[clock] is None or (ts - s[clock]).total_seconds() >= seconds

        want_r = max(p.min_replicas, min(p.max_replicas, math.ceil(pc / p.cpu_target)))
        des_r, act_h = cur_r, "no_change"
        if mode in ("horizontal", "combined") and want_r != cur_r:
            name, clock, cd = ("scale_up", "up", p.up_cooldown_s) if want_r > cur_r else ("scale_down", "down", p.down_cooldown_s)
            act_h = "cooldown"
            if open_(clock, cd):
                des_r, act_h, s[clock] = want_r, name, ts
        need = math.ceil(math.ceil(pr * 1024 / max(cur_r, 1)) / p.memory_step_mb) * p.memory_step_mb
        want_m = max(p.min_memory_mb, min(int(p.max_memory_mb / max(cur_r, 1)), need))
        des_m, act_v = cur_m, "no_change"
        if mode in ("vertical", "combined") and want_m != cur_m:
            act_v = "cooldown"
            if want_m > cur_m and (restarted or open_("v", p.vertical_cooldown_s)):
                des_m, act_v, s["v"] = want_m, "scale_up", ts
            elif want_m < cur_m and open_("v", p.vertical_cooldown_s) and (ts - s["start"]).total_seconds() >= p.startup_grace_s:
                bounded = max(want_m, cur_m - cur_m // 2)
                des_m = max(p.min_memory_mb, round(bounded / p.memory_step_mb) * p.memory_step_mb)
                act_v, s["v"] = "scale_down", ts
        out[i] = (des_r, des_m, act_h, act_v, cur_r if des_m != cur_m else 0)
    return out


def random_cycles(n, seed, gap):
    rng = random.Random(seed)
    t, rows = T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 15, 15, 15, gap]))
        rows.append((rng.choice(["hot", "hot", "hot", "x"]), i, t, rng.choice(["combined", "horizontal", "vertical"]),
                     rng.randint(1, 10), rng.randint(1, 16) * 256, rng.random() * 5, rng.random() * 6, rng.random() * 8,
                     rng.random() * 20, rng.random() < 0.1))
    return rows


@pytest.mark.parametrize("seed,gap,chunk_s", [(1, 200, 300), (2, 15, 300), (3, 4000, 3600), (4, 30, 100000)])
def test_actions_equal_plain_loop(spark, seed, gap, chunk_s):
    p = Policy()
    rows = random_cycles(300, seed, gap)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ops.scale_actions(df, p, order=["timestamp", "id"], restarted="restarted", chunk_s=chunk_s)
    have = {r.id: (r.desired_replicas, r.desired_memory_mb, r.action_horizontal, r.action_vertical, r.pod_restart_count)
            for r in got.collect()}
    assert have == brute(rows, p)


def test_cooldown_edges(spark):
    """Exactly the cooldown later is allowed, one second before is not."""
    p = Policy()
    rows = [("a", i, T0 + dt.timedelta(seconds=s), "horizontal", 1, 256, 0.0, 2.0, 0.0, 0.0, False)
            for i, s in enumerate([0, 59, 60, 119, 121])]
    got = ops.scale_actions(spark.createDataFrame(rows, SCHEMA), p, order=["timestamp", "id"])
    assert [r.action_horizontal for r in got.orderBy("id").collect()] == [
        "scale_up", "cooldown", "scale_up", "cooldown", "scale_up"]


EVENT = ("namespace string, timestamp timestamp, action_horizontal string, action_vertical string")


def test_oscillations_edges(spark):
    acts = [(0, "scale_up"), (10, "no_change"), (180, "scale_down"), (361, "scale_up"), (400, "scale_up"), (500, "scale_down")]
    df = spark.createDataFrame([("n", T0 + dt.timedelta(seconds=s), a, "no_change") for s, a in acts], EVENT)
    got = metrics.oscillations(df, {"horizontal": 180, "vertical": 300}, chunk_s=200).first()
    assert got.oscillation_horizontal_count == 2
    assert got.oscillation_vertical_count == 0


def full_events(spark, rows):
    cols = ("namespace string, timestamp timestamp, current_replicas int, current_memory_mb int, actual_cpu_cores double,"
            " predicted_cpu_cores double, actual_ram_gb double, predicted_ram_gb double, action_horizontal string,"
            " action_vertical string, sla_cpu_violation boolean, sla_ram_violation boolean, pod_restart_count int,"
            " refit_skipped int, fit_time_cpu_seconds double, predict_time_cpu_seconds double, fit_time_ram_seconds double,"
            " predict_time_ram_seconds double")
    return spark.createDataFrame(rows, cols)


def test_summary_without_violations(spark):
    row = ("n", T0, 1, 1024, 0.4, 0.5, 1.0, 1.0, "no_change", "no_change", False, False, 0, 0, 0.0, 0.0, 0.0, 0.0)
    s = metrics.ops_summary(full_events(spark, [row]), Policy()).first()
    assert s.mtbv_cpu_seconds is None and s.sla_cpu_violation_rate == 0.0
    assert (s.MAE_cpu, s.R2_cpu) == (0.0, 0.0)  # fewer than two rows
    assert (s.avg_fit_time_cpu_seconds, s.total_cycles, s.overprovision_cpu_minutes) == (0.0, 1, 0.0)


def test_summary_nested_shape(spark):
    row = ("n", T0, 3, 4096, 0.4, 0.5, 1.0, 1.5, "scale_up", "no_change", True, False, 2, 4, 0.5, 0.0, 0.25, 0.0)
    rows = [row, (*row[:1], T0 + dt.timedelta(seconds=60), *row[2:])]
    nested = metrics.ops_summary_nested(metrics.ops_summary(full_events(spark, rows), Policy()), ["namespace"]).first()
    assert nested.operational_metrics.mtbv_cpu_seconds == 60.0
    assert nested.operational_metrics.overprovision_cpu_minutes == 2.0
    assert nested.operational_metrics.waste_ratio_ram == 1.0
    assert abs(nested.prediction_metrics.ram.BIAS - 0.5) < 1e-12


def test_counter_rate_and_range_by_brute_force(spark):
    rng = random.Random(5)
    rows, t, v = [], 0.0, 0.0
    for i in range(200):
        t += rng.choice([5, 15, 15, 40, 300])
        v = rng.random() if rng.random() < 0.1 else v + rng.random() * 10
        rows.append(("ns", f"p{rng.randint(0, 2)}", i, T0 + dt.timedelta(seconds=t), v))
    df = spark.createDataFrame(rows, "ns string, pod string, id long, ts timestamp, value double")

    def rate(pod_rows, end, w):
        inside = [r for r in pod_rows if end - dt.timedelta(seconds=w) < r[3] <= end]
        grown = sum(b[4] - a[4] if b[4] >= a[4] else b[4] for a, b in zip(inside, inside[1:]))
        return len(inside), grown / w

    pods = {p: [r for r in rows if r[1] == p] for p in {r[1] for r in rows}}
    got = {r.id: r.rate for r in samples.counter_rate(df, ["ns", "pod"], 60, ["ts", "id"], chunk_s=120).collect()}
    for r in rows:
        n, want = rate(pods[r[1]], r[3], 60)
        assert (got[r[2]] is None) if n < 2 else abs(got[r[2]] - want) < 1e-9
    start, end = T0 + dt.timedelta(seconds=600), T0 + dt.timedelta(seconds=3000)
    ranged = samples.rate_range(df, ["ns", "pod"], start, end, 15, ["ns"], 60, ["ts", "id"], chunk_s=120)
    have = {r.ts.replace(tzinfo=dt.timezone.utc): r.value for r in ranged.collect()}
    t = start
    while t <= end:
        parts = [rate(p, t, 60) for p in pods.values()]
        if any(n > 1 for n, _ in parts):
            assert abs(have.pop(t) - sum(v for n, v in parts if n > 1)) < 1e-9
        t += dt.timedelta(seconds=15)
    assert have == {}


def test_restarts_first_sight_never_fires(spark):
    rows = [("p", T0, 3), ("p", T0 + dt.timedelta(days=2), 3), ("p", T0 + dt.timedelta(days=9), 4), ("q", T0, 1)]
    df = spark.createDataFrame(rows, "pod string, ts timestamp, restart_count int")
    got = samples.restart_spikes(df, ["pod"]).orderBy("pod", "ts").collect()
    assert [r.restarted for r in got] == [False, False, True, False]


def test_label_filter(spark):
    rows = [({"scope": "run-a"}, 1.0), ({"scope": "other"}, 2.0), ({"x": "y"}, 3.0)]
    df = spark.createDataFrame(rows, "labels map<string,string>, value double")
    assert [r.value for r in samples.keep_label(df, "scope", "^(run-.*|)$").orderBy("value").collect()] == [1.0, 3.0]
    both = samples.keep_label(df, "scope", "^run-", add={"scope": "all", "node": "n"}).first()
    assert both.labels == {"scope": "all", "node": "n"}


HOT = """
from pyspark.sql import functions as F
from tidegauge.catalog import Policy
from tidegauge.operators.policy import scale_actions
from tidegauge.session import get_session

spark = get_session("hot", "local[4]", 8, spark__driver__memory="1g", spark__ui__enabled="false")
k = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
rows = spark.range(2_000_000).select(
    F.lit("hot").alias("namespace"), "id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 10_000).alias("timestamp"),
    F.lit("combined").alias("scaling_mode"), F.lit(4).alias("current_replicas"), F.lit(1024).alias("current_memory_mb"),
    k.alias("actual_cpu_cores"), (6 * k).alias("predicted_cpu_cores"), k.alias("actual_ram_gb"), (20 * k).alias("predicted_ram_gb"))
done = scale_actions(rows, Policy(), order=["timestamp", "id"])
print("COUNTS", *done.agg(F.count("*"), F.count_if(F.col('action_horizontal') == 'scale_up')).first())
"""


def test_hot_key_in_a_small_heap(spark):
    """Two million rows of one key, ten milliseconds apart, in a heap of 1 GB."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    said = subprocess.run([sys.executable, "-c", HOT], env=env, cwd=root, capture_output=True, text=True, timeout=600)
    counts = [x for x in said.stdout.splitlines() if x.startswith("COUNTS")]
    assert counts, said.stderr[-2000:]
    rows, ups = map(int, counts[0].split()[1:])
    assert rows == 2_000_000
    assert 300 <= ups <= 334  # one a minute over 20,000 s, as soon as a candidate comes
