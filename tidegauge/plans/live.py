"""Metric samples: rates, gauges, instant and range evaluation, restarts, live histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import analysis, samples
from tidegauge.operators.ordered import time_chunk, with_running_sum
from tidegauge.operators.series import resample
from tidegauge.plans.registry import POLICY, events, out_ts, query, r6, s6

# The counter of a pod (a user) is the running sum of its values; every 50th event of a pod restarts it.
START, END = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
WINDOW_S, STEP_S = 7200, 3600
LOOKBACK_START = "2024-01-09 22:00:00"


def counters(spark, folder):
    """`(namespace, pod, ts, event_id, value)`: a growing counter per pod that falls back now and then."""
    rows = events(spark, folder).select(
        (F.col("user_id") % 5).alias("namespace"), F.col("user_id").alias("pod"), "ts", "event_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    grown = with_running_sum(rows, ["pod"], ["ts", "event_id"], (F.col("value") * 100).cast("bigint"),
                             time_chunk("ts", 86400), "total")
    # A sample with a small k reads as a counter that has just restarted.
    value = F.when(F.col("k") < 5, F.col("k").cast("double")).otherwise(F.col("total") / 100.0)
    return grown.select("namespace", "pod", "ts", "event_id", value.alias("value"))


COUNTERS = """base AS (
  SELECT user_id % 5 AS namespace, user_id AS pod, ts, event_id, value, json_extract(props, '$.k')::INTEGER AS k,
    sum(trunc(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total
  FROM events),
cnt AS (SELECT namespace, pod, ts, event_id, CASE WHEN k < 5 THEN k::DOUBLE ELSE total / 100.0::DOUBLE END AS value FROM base)"""


@query("counter_rate", f"""WITH {COUNTERS}, d AS (
  SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN NULL WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w
    ELSE value END AS inc
  FROM cnt WINDOW w AS (PARTITION BY pod ORDER BY ts, event_id)),
f AS (
  SELECT *, count(*) OVER r AS n, sum(coalesce(inc, 0)) OVER r AS total, first_value(coalesce(inc, 0)) OVER r AS edge
  FROM d WINDOW r AS (PARTITION BY pod ORDER BY ts RANGE BETWEEN INTERVAL '{WINDOW_S - 1}.999999 seconds' PRECEDING
    AND CURRENT ROW))
SELECT namespace, pod, ts, event_id, {s6(f"CASE WHEN n > 1 THEN (total - edge) / {WINDOW_S} * 3600 END")} AS per_hour FROM f""")
def counter_rate(spark, folder):
    rated = samples.counter_rate(counters(spark, folder), ["namespace", "pod"], WINDOW_S, ["ts", "event_id"])
    return rated.select("namespace", "pod", out_ts("ts").alias("ts"), "event_id",
                        r6(F.col("rate") * 3600).alias("per_hour"))


_RANGE = f"""WITH {COUNTERS}, win AS (
  SELECT * FROM cnt WHERE ts > TIMESTAMP '{START}' - INTERVAL '{WINDOW_S} seconds' AND ts <= TIMESTAMP '{END}'),
p AS (
  SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM win
  WINDOW w AS (PARTITION BY pod ORDER BY ts, event_id)),
g AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL '{STEP_S} seconds')) AS t)
SELECT namespace, t AS ts, {s6(f"sum(CASE WHEN value >= pv THEN value - pv ELSE value END) / {WINDOW_S} * 3600")} AS per_hour
FROM p JOIN g ON p.ts <= t AND p.pts > t - INTERVAL '{WINDOW_S} seconds'
GROUP BY ALL"""


@query("metric_range", _RANGE)
def metric_range(spark, folder):
    out = samples.rate_range(counters(spark, folder), ["namespace", "pod"], START, END, STEP_S, ["namespace"],
                             WINDOW_S, ["ts", "event_id"])
    return out.select("namespace", out_ts("ts").alias("ts"), r6(F.col("value") * 3600).alias("per_hour"))


@query("gauge_sum", f"""WITH n AS (
  SELECT event_type AS namespace, user_id AS pod, ts, value * 1000000 AS v,
    lead(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS nts
  FROM events WHERE ts > TIMESTAMP '{START}' - INTERVAL '{WINDOW_S} seconds' AND ts <= TIMESTAMP '{END}'),
g AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL '{STEP_S} seconds')) AS t)
SELECT namespace, t AS ts, {s6("sum(v) / 1073741824.0::DOUBLE")} AS value
FROM n JOIN g ON n.ts <= t AND n.ts > t - INTERVAL '{WINDOW_S} seconds' AND (nts IS NULL OR nts > t)
GROUP BY ALL""")
def gauge_sum(spark, folder):
    rows = events(spark, folder, LOOKBACK_START, END).select(
        F.col("event_type").alias("namespace"), F.col("user_id").alias("pod"), "ts", "event_id",
        (F.col("value") * 1000000).alias("value"),
    )
    out = samples.gauge_range(rows, ["namespace", "pod"], START, END, STEP_S, ["namespace"], WINDOW_S,
                              ["ts", "event_id"])
    return out.select("namespace", out_ts("ts").alias("ts"), r6("value").alias("value"))


@query("bootstrap_range", f"""{_RANGE.split("SELECT namespace, t AS ts")[0].rstrip()},
n AS (SELECT user_id % 5 AS namespace, user_id AS pod, ts, value * 1000000 AS v, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nts
  FROM events WHERE ts > TIMESTAMP '{START}' - INTERVAL '{WINDOW_S} seconds' AND ts <= TIMESTAMP '{END}')
SELECT namespace, 'cpu' AS metric, t AS ts, {s6(f"sum(CASE WHEN value >= pv THEN value - pv ELSE value END) / {WINDOW_S} * 9.6::DOUBLE")} AS value
FROM p JOIN g ON p.ts <= t AND p.pts > t - INTERVAL '{WINDOW_S} seconds' GROUP BY ALL
UNION ALL
SELECT namespace, 'ram', t, {s6("sum(v) / 1073741824.0::DOUBLE * 48.0::DOUBLE")}
FROM n JOIN g ON n.ts <= t AND n.ts > t - INTERVAL '{WINDOW_S} seconds' AND (nts IS NULL OR nts > t) GROUP BY ALL""")
def bootstrap_range(spark, folder):
    """Warm start of both metrics of every namespace by range evaluation, rescaled to the capacity of the real system."""
    source, order = ["namespace", "pod"], ["ts", "event_id"]
    gauges = events(spark, folder, LOOKBACK_START, END).select(
        (F.col("user_id") % 5).alias("namespace"), F.col("user_id").alias("pod"), "ts", "event_id",
        (F.col("value") * 1000000).alias("value"),
    )
    out = samples.bootstrap(counters(spark, folder), gauges, source, START, END, STEP_S, ["namespace"],
                            {"cpu": 48 / 5, "ram": 384 / 8}, WINDOW_S, WINDOW_S, order)
    return out.select("namespace", "metric", out_ts("ts").alias("ts"), r6("value").alias("value"))


@query("metric_instant", f"""WITH {COUNTERS}, win AS (
  SELECT * FROM cnt WHERE ts > TIMESTAMP '{END}' - INTERVAL '{WINDOW_S} seconds' AND ts <= TIMESTAMP '{END}'),
p AS (
  SELECT *, lag(value) OVER w AS pv FROM win WINDOW w AS (PARTITION BY pod ORDER BY ts, event_id)),
v AS (SELECT namespace, sum(CASE WHEN value >= pv THEN value - pv ELSE value END) / {WINDOW_S} AS value FROM p
  WHERE pv IS NOT NULL GROUP BY 1)
SELECT DISTINCT namespace, {s6("coalesce(v.value, 0.0::DOUBLE) * 3600")} AS per_hour FROM cnt LEFT JOIN v USING (namespace)""")
def metric_instant(spark, folder):
    rows = counters(spark, folder)
    at = samples.rate_range(rows, ["namespace", "pod"], END, END, STEP_S, ["namespace"], WINDOW_S, ["ts", "event_id"])
    # Namespaces come from the narrow table, not from the counters, so the sums run once.
    names = events(spark, folder).select((F.col("user_id") % 5).alias("namespace"))
    return samples.instant_value(names, at, ["namespace"]).select(
        "namespace", r6(F.col("value") * 3600).alias("per_hour")
    )


@query("label_keep", """SELECT event_id, event_type AS namespace, 'node-1' AS node, value FROM events
WHERE event_type LIKE 's%' OR user_id % 10 = 0""")
def label_keep(spark, folder):
    named = F.create_map(F.lit("namespace"), F.col("event_type"), F.lit("scope"), F.concat(F.lit("run-"), F.col("event_type")))
    system = F.create_map(F.lit("namespace"), F.col("event_type"))
    keep = F.col("event_type").startswith("s") | (F.col("user_id") % 10 == 0)
    # No scope label at all passes the pattern, a foreign scope does not.
    other = F.create_map(F.lit("namespace"), F.col("event_type"), F.lit("scope"), F.lit("kube-system"))
    labels = F.when(F.col("event_type").startswith("s"), named).when(keep, system).otherwise(other)
    rows = events(spark, folder).select("event_id", labels.alias("labels"), "value")
    kept = samples.keep_label(rows, "scope", "^(run-.*|)$", add={"node": "node-1"})
    return kept.select("event_id", F.col("labels")["namespace"].alias("namespace"), F.col("labels")["node"].alias("node"), "value")


@query("restart_spike", f"""WITH p AS (
  SELECT event_type AS namespace, user_id AS pod, event_id, ts, json_extract(props, '$.k')::INTEGER // 30 AS restart_count,
    value FROM events),
l AS (SELECT *, coalesce(restart_count > lag(restart_count) OVER (PARTITION BY namespace, pod ORDER BY ts, event_id), false)
  AS restarted FROM p)
SELECT namespace, date_trunc('hour', ts) AS cycle, bool_or(restarted) AS crashed,
  {s6("CASE WHEN bool_or(restarted) THEN 8.0::DOUBLE ELSE avg(value) END")} AS actual_ram_gb
FROM l GROUP BY ALL""")
def restart_spike(spark, folder):
    pods = events(spark, folder).select(
        F.col("event_type").alias("namespace"), F.col("user_id").alias("pod"), "event_id", "ts",
        F.floor(F.get_json_object("props", "$.k").cast("int") / 30).alias("restart_count"), "value",
    )
    spikes = samples.restart_spikes(pods, ["namespace", "pod"], ["ts", "event_id"])
    hour = F.date_trunc("hour", "ts")
    per_cycle = spikes.groupBy("namespace", hour.alias("cycle")).agg(
        F.bool_or("restarted").alias("crashed"), F.avg("value").alias("mean_gb")
    )
    return per_cycle.select(
        "namespace", out_ts("cycle").alias("cycle"), "crashed",
        r6(samples.crash_ram("mean_gb", "crashed", POLICY.max_memory_mb)).alias("actual_ram_gb"),
    )


@query("cpu_ram_align", f"""WITH c AS (
  SELECT user_id % 3 AS app_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS ts, avg(value) AS cpu
  FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL),
r AS (
  SELECT user_id % 3 AS app_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS ts, avg(value) AS ram
  FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL)
SELECT app_id, ts, {s6("cpu")} AS cpu, {s6("ram")} AS ram FROM c FULL JOIN r USING (app_id, ts)""")
def cpu_ram_align(spark, folder):
    rows = events(spark, folder).select(
        (F.col("user_id") % 3).alias("app_id"), "ts", F.col("value").alias("y"), "event_type"
    )
    cpu = resample(rows.filter(F.col("event_type").isin("click", "view", "purchase")), 3600, ["app_id"])
    ram = resample(rows.filter(F.col("event_type").isin("error", "signup")), 3600, ["app_id"])
    return analysis.align_metrics(cpu, ram, ["app_id"]).select(
        "app_id", out_ts("ts").alias("ts"), r6("cpu").alias("cpu"), r6("ram").alias("ram")
    )
