"""Scaling recommendations, actions with cooldowns, and the run summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import analysis, metrics, policy as ops
from tidegauge.plans.registry import CYCLES, POLICY, WANT, cycles, out_ts, query, r6, s6


def evaluated(spark, folder):
    """Evaluation cycles with SLA flags and recorded actions, all row-local."""
    rows = ops.recommend(cycles(spark, folder), POLICY)
    act = lambda want, cur: (
        F.when(F.col(want) > F.col(cur), "scale_up").when(F.col(want) < F.col(cur), "scale_down").otherwise("no_change")
    )
    rows = rows.withColumn("action_horizontal", act("want_replicas", "current_replicas")).withColumn(
        "action_vertical", act("want_memory_mb", "current_memory_mb")
    ).withColumn("pod_restart_count", F.when(F.col("restarted"), F.col("current_replicas")).otherwise(0))
    return metrics.evaluation_only(rows)


EVAL = WANT + """,
ev AS (
  SELECT *,
    CASE WHEN want_replicas > current_replicas THEN 'scale_up' WHEN want_replicas < current_replicas THEN 'scale_down'
      ELSE 'no_change' END AS action_horizontal,
    CASE WHEN want_memory_mb > current_memory_mb THEN 'scale_up' WHEN want_memory_mb < current_memory_mb THEN 'scale_down'
      ELSE 'no_change' END AS action_vertical,
    CASE WHEN restarted THEN current_replicas ELSE 0 END AS pod_restart_count
  FROM want WHERE phase = 'evaluation')"""


@query("desired_replicas", f"WITH {WANT} SELECT event_id, current_replicas, want_replicas FROM want")
def desired_replicas(spark, folder):
    return ops.recommend(cycles(spark, folder), POLICY).select("event_id", "current_replicas", "want_replicas")


@query("desired_memory", f"WITH {WANT} SELECT event_id, current_memory_mb, want_memory_mb FROM want")
def desired_memory(spark, folder):
    return ops.recommend(cycles(spark, folder), POLICY).select("event_id", "current_memory_mb", "want_memory_mb")


@query("sla_flags", f"WITH {WANT} SELECT event_id, sla_cpu_violation, sla_ram_violation FROM want")
def sla_flags(spark, folder):
    return ops.recommend(cycles(spark, folder), POLICY).select("event_id", "sla_cpu_violation", "sla_ram_violation")


@query("scale_event", f"""WITH {WANT}
SELECT event_id, scaling_mode,
  CASE WHEN scaling_mode IN ('horizontal', 'combined') THEN want_replicas ELSE current_replicas END AS desired_replicas,
  CASE WHEN scaling_mode IN ('vertical', 'combined') THEN want_memory_mb ELSE current_memory_mb END AS desired_memory_mb,
  CASE WHEN scaling_mode IN ('vertical', 'combined') AND want_memory_mb <> current_memory_mb THEN current_replicas
    ELSE 0 END AS pod_restart_count,
  {s6("CASE WHEN scaling_mode = 'vertical' THEN actual_cpu_cores ELSE predicted_cpu_cores END")} AS used_cpu
FROM want""")
def scale_event(spark, folder):
    # Vertical runs do not predict CPU: the actual value passes through.
    predicted = F.when(F.col("scaling_mode") != "vertical", F.col("predicted_cpu_cores"))
    rows = ops.route_by_mode(ops.recommend(cycles(spark, folder), POLICY))
    return rows.select("event_id", "scaling_mode", "desired_replicas", "desired_memory_mb", "pod_restart_count",
                       r6(ops.pass_through(predicted, "actual_cpu_cores")).alias("used_cpu"))


def clocks_sql(cycles_sql: str, row_id: str) -> str:
    """Scaling actions as a recursive walk over the cycles `cyc`, carrying the three clocks."""
    want = WANT.split("want AS (")[1]
    return f"""WITH RECURSIVE {cycles_sql},
want AS ({want},
num AS (
  SELECT *, row_number() OVER w AS rn, epoch_us(timestamp) AS us, min(epoch_us(timestamp)) OVER (PARTITION BY namespace)
    AS start_us, scaling_mode IN ('horizontal', 'combined') AS h, scaling_mode IN ('vertical', 'combined') AS v
  FROM want WINDOW w AS (PARTITION BY namespace ORDER BY timestamp, event_id)),
flag AS (
  SELECT *, h AND want_replicas > current_replicas AS up, h AND want_replicas < current_replicas AS down,
    v AND want_memory_mb > current_memory_mb AS grow, v AND want_memory_mb < current_memory_mb AS shrink,
    us - start_us < 7200000000 AS grace
  FROM num),
clock AS (
  SELECT namespace, 0::BIGINT AS rn, false AS ok_up, false AS ok_down, false AS ok_v,
    NULL::BIGINT AS t_up, NULL::BIGINT AS t_down, NULL::BIGINT AS t_v
  FROM (SELECT DISTINCT namespace FROM num)
  UNION ALL
  SELECT namespace, rn, ok_up, ok_down, ok_v, CASE WHEN ok_up THEN us ELSE t_up END,
    CASE WHEN ok_down THEN us ELSE t_down END, CASE WHEN ok_v THEN us ELSE t_v END
  FROM (
    SELECT f.namespace, f.rn, f.us, c.t_up, c.t_down, c.t_v,
      f.up AND (c.t_up IS NULL OR f.us - c.t_up >= 3600000000) AS ok_up,
      f.down AND (c.t_down IS NULL OR f.us - c.t_down >= 10800000000) AS ok_down,
      (f.grow AND f.restarted) OR ((f.grow OR (f.shrink AND NOT f.grace))
        AND (c.t_v IS NULL OR f.us - c.t_v >= 7200000000)) AS ok_v
    FROM clock c JOIN flag f ON f.namespace = c.namespace AND f.rn = c.rn + 1)),
act AS (
  SELECT f.*, ok_up, ok_down, ok_v,
    greatest(512, round_even(greatest(want_memory_mb, current_memory_mb - current_memory_mb // 2) / 256::DOUBLE, 0) * 256)::INTEGER
      AS bounded
  FROM flag f JOIN clock c ON c.namespace = f.namespace AND c.rn = f.rn)
SELECT namespace, {row_id},
  CASE WHEN ok_up OR ok_down THEN want_replicas ELSE current_replicas END AS desired_replicas,
  CASE WHEN ok_v AND grow THEN want_memory_mb WHEN ok_v THEN bounded ELSE current_memory_mb END AS desired_memory_mb,
  CASE WHEN ok_up THEN 'scale_up' WHEN ok_down THEN 'scale_down' WHEN up OR down THEN 'cooldown' ELSE 'no_change' END
    AS action_horizontal,
  CASE WHEN ok_v AND grow THEN 'scale_up' WHEN ok_v THEN 'scale_down' WHEN grow OR shrink THEN 'cooldown'
    ELSE 'no_change' END AS action_vertical,
  CASE WHEN (CASE WHEN ok_v AND grow THEN want_memory_mb WHEN ok_v THEN bounded ELSE current_memory_mb END)
    <> current_memory_mb THEN current_replicas ELSE 0 END AS pod_restart_count
FROM act"""


@query("scale_actions", clocks_sql(CYCLES, "event_id"))
def scale_actions(spark, folder):
    rows = cycles(spark, folder).select(
        "namespace", "event_id", "timestamp", "scaling_mode", "current_replicas", "current_memory_mb",
        "actual_cpu_cores", "predicted_cpu_cores", "actual_ram_gb", "predicted_ram_gb", "restarted",
    )
    done = ops.scale_actions(rows, POLICY, order=["timestamp", "event_id"], restarted="restarted", chunk_s=6 * 3600)
    return done.select("namespace", "event_id", "desired_replicas", "desired_memory_mb", "action_horizontal",
                       "action_vertical", "pod_restart_count")


DENSE = f"""{CYCLES.replace("cyc AS (", "sparse AS (")},
cyc AS (SELECT * REPLACE ('all' AS namespace, TIMESTAMP '2024-03-01' + to_seconds(event_id) AS timestamp) FROM sparse)"""


@query("scale_actions_dense", clocks_sql(DENSE, "event_id"))
def scale_actions_dense(spark, folder):
    """All cycles as one key, a second apart."""
    rows = cycles(spark, folder).select(
        "event_id", "scaling_mode", "current_replicas", "current_memory_mb",
        "actual_cpu_cores", "predicted_cpu_cores", "actual_ram_gb", "predicted_ram_gb", "restarted",
        F.lit("all").alias("namespace"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + F.col("event_id")).alias("timestamp"),
    )
    done = ops.scale_actions(rows, POLICY, order=["timestamp", "event_id"], restarted="restarted", chunk_s=6 * 3600)
    return done.select("namespace", "event_id", "desired_replicas", "desired_memory_mb", "action_horizontal",
                       "action_vertical", "pod_restart_count")


@query("eval_only", f"""WITH {CYCLES}
SELECT namespace, count(*) AS n_rows, min(timestamp) AS first_ts, {s6("avg(actual_cpu_cores)")} AS mean_cpu
FROM cyc WHERE phase = 'evaluation' GROUP BY 1""")
def eval_only(spark, folder):
    return metrics.evaluation_only(cycles(spark, folder)).groupBy("namespace").agg(
        F.count(F.lit(1)).alias("n_rows"), out_ts(F.min("timestamp")).alias("first_ts"),
        r6(F.avg("actual_cpu_cores")).alias("mean_cpu"),
    )


def online_sql(m: str, unit: str) -> str:
    a, e = f"actual_{m}_{unit}", f"(predicted_{m}_{unit} - actual_{m}_{unit})"
    few = "CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE %s END"
    return ", ".join(
        f"{s6(few % x)} AS \"{n}_{m}\"" for n, x in (
            ("MAE", f"avg(abs({e}))"), ("RMSE", f"sqrt(avg({e} * {e}))"),
            ("R2", f"1 - sum({e} * {e}) / (var_pop({a}) * count(*))"), ("BIAS", f"avg({e})"),
        )
    )


ONLINE = f"{online_sql('cpu', 'cores')}, {online_sql('ram', 'gb')}"


@query("online_metrics", f"""WITH {EVAL} SELECT namespace, model_name, count(*) AS n, {ONLINE} FROM ev GROUP BY ALL""")
def online_metrics(spark, folder):
    out = metrics.online_metrics(evaluated(spark, folder), ["namespace", "model_name"])
    return out.select("namespace", "model_name", "n", *[r6(c).alias(c) for c in out.columns[3:]])


@query("sla_rate", f"""WITH {EVAL}
SELECT namespace, count(*) FILTER (sla_cpu_violation) AS sla_cpu_violation_count,
  {s6("count(*) FILTER (sla_cpu_violation) / count(*)")} AS sla_cpu_violation_rate,
  count(*) FILTER (sla_ram_violation) AS sla_ram_violation_count,
  {s6("count(*) FILTER (sla_ram_violation) / count(*)")} AS sla_ram_violation_rate
FROM ev GROUP BY 1""")
def sla_rate(spark, folder):
    out = evaluated(spark, folder).groupBy("namespace").agg(*metrics.sla_columns())
    for m in ("cpu", "ram"):
        out = out.withColumn(f"sla_{m}_violation_rate", r6(f"sla_{m}_violation_rate"))
    return out


_OVER = {
    "cpu": "count(*) FILTER (current_replicas > ceil(greatest(actual_cpu_cores, 1e-9::DOUBLE) / 0.5::DOUBLE))",
    "ram": "count(*) FILTER (current_memory_mb > ceil(actual_ram_gb * 1024))",
    "ram_per": "count(*) FILTER (current_memory_mb > ceil(actual_ram_gb * 1024 / greatest(current_replicas, 1)))",
}


def over_sql(m: str, key: str | None = None) -> str:
    x = _OVER[key or m]
    return (f"round_even({x} * 1.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS overprovision_{m}_minutes, "
            f"round_even({x} * 1.0::DOUBLE / (count(*) * 1.0::DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS waste_ratio_{m}")


@query("overprovision", f"WITH {EVAL} SELECT namespace, {over_sql('cpu')}, {over_sql('ram')} FROM ev GROUP BY 1")
def overprovision(spark, folder):
    return metrics.overprovision(evaluated(spark, folder), POLICY)


@query("overprovision_per_replica", f"""WITH {EVAL}
SELECT namespace, {over_sql('cpu')}, {over_sql('ram', 'ram_per')} FROM ev GROUP BY 1""")
def overprovision_per_replica(spark, folder):
    return metrics.overprovision(evaluated(spark, folder), POLICY, ram_mode="per_replica")


_SPAN = "((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE + 60.0::DOUBLE)"


def mtbv_sql(m: str) -> str:
    hits = f"count(*) FILTER (sla_{m}_violation)"
    return (f"CASE WHEN {hits} > 0 THEN round_even({_SPAN} / {hits} * 10.0::DOUBLE, 0) / 10.0::DOUBLE END "
            f"AS mtbv_{m}_seconds")


@query("mtbv", f"WITH {EVAL} SELECT namespace, {mtbv_sql('cpu')}, {mtbv_sql('ram')} FROM ev GROUP BY 1")
def mtbv(spark, folder):
    return metrics.mtbv(evaluated(spark, folder), POLICY)


def osc_sql(kind: str, cooldown_s: int, name: str) -> str:
    return f"""a_{kind} AS (
  SELECT namespace, action_{kind} AS a, lag(action_{kind}) OVER w AS pa,
    epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) AS gap
  FROM ev WHERE action_{kind} IN ('scale_up', 'scale_down')
  WINDOW w AS (PARTITION BY namespace ORDER BY timestamp, event_id)),
o_{kind} AS (SELECT namespace, count(*) FILTER (a <> pa AND gap <= {cooldown_s} * 1000000::BIGINT) AS {name}
  FROM a_{kind} GROUP BY 1)"""


OSC = f"""{osc_sql("horizontal", 10800, "oscillation_horizontal_count")},
{osc_sql("vertical", 7200, "oscillation_vertical_count")}"""


@query("oscillations", f"WITH {EVAL}, {OSC} SELECT * FROM o_horizontal JOIN o_vertical USING (namespace)")
def oscillations(spark, folder):
    cooldowns = {"horizontal": POLICY.down_cooldown_s, "vertical": POLICY.vertical_cooldown_s}
    return metrics.oscillations(evaluated(spark, folder), cooldowns, tie=["event_id"])


def _timing_sql() -> str:
    parts = []
    for c in metrics.TIMING_COLUMNS:
        for what in ("avg", "max"):
            parts.append(f"{s6(f'coalesce({what}({c}) FILTER ({c} > 0), 0.0::DOUBLE)')} AS {what}_{c}")
    return ", ".join(parts)


OPS = f"""{EVAL}, {OSC}, main AS (
  SELECT namespace, count(*) AS total_cycles, round_even({_SPAN} * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS total_duration_seconds,
    {ONLINE},
    count(*) FILTER (sla_cpu_violation) AS sla_cpu_violation_count,
    {s6("count(*) FILTER (sla_cpu_violation) / count(*)")} AS sla_cpu_violation_rate,
    count(*) FILTER (sla_ram_violation) AS sla_ram_violation_count,
    {s6("count(*) FILTER (sla_ram_violation) / count(*)")} AS sla_ram_violation_rate,
    {over_sql("cpu")}, {over_sql("ram")}, {mtbv_sql("cpu")}, {mtbv_sql("ram")},
    count(*) FILTER (action_horizontal = 'scale_up') AS scale_up_horizontal_count,
    count(*) FILTER (action_horizontal = 'scale_down') AS scale_down_horizontal_count,
    count(*) FILTER (action_vertical = 'scale_up') AS scale_up_vertical_count,
    count(*) FILTER (action_vertical = 'scale_down') AS scale_down_vertical_count,
    sum(pod_restart_count)::BIGINT AS pod_restart_count,
    round_even(avg(current_replicas) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_replicas,
    round_even(avg(current_memory_mb) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_memory_mb,
    max(refit_skipped)::BIGINT AS refit_skip_count, {_timing_sql()}
  FROM ev GROUP BY 1)"""


@query("ops_summary", f"""WITH {OPS}
SELECT main.*, coalesce(oscillation_horizontal_count, 0) AS oscillation_horizontal_count,
  coalesce(oscillation_vertical_count, 0) AS oscillation_vertical_count
FROM main LEFT JOIN o_horizontal USING (namespace) LEFT JOIN o_vertical USING (namespace)""")
def ops_summary(spark, folder):
    out = metrics.ops_summary(evaluated(spark, folder), POLICY, tie=["event_id"])
    rounded = {c for c in out.columns if c[:3] in ("MAE", "RMS", "R2_", "BIA") or c.endswith("_rate") or "_time_" in c}
    return out.select(*[r6(c).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query("timeline_replicas", f"""WITH {CYCLES}
SELECT namespace, timestamp, event_id, current_replicas, {s6("actual_cpu_cores")} AS actual_cpu_cores,
  {s6("predicted_cpu_cores")} AS predicted_cpu_cores FROM cyc WHERE scaling_mode IN ('horizontal', 'combined')""")
def timeline_replicas(spark, folder):
    return analysis.timeline(cycles(spark, folder), "replicas", ["namespace", "event_id"]).select(
        "namespace", out_ts("timestamp").alias("timestamp"), "event_id", "current_replicas",
        r6("actual_cpu_cores").alias("actual_cpu_cores"), r6("predicted_cpu_cores").alias("predicted_cpu_cores"),
    )


@query("timeline_memory", f"""WITH {CYCLES}
SELECT namespace, timestamp, event_id, current_memory_mb, {s6("actual_ram_gb * 1024")} AS actual_ram_mb,
  {s6("predicted_ram_gb * 1024")} AS predicted_ram_mb FROM cyc WHERE scaling_mode IN ('vertical', 'combined')""")
def timeline_memory(spark, folder):
    return analysis.timeline(cycles(spark, folder), "memory", ["namespace", "event_id"]).select(
        "namespace", out_ts("timestamp").alias("timestamp"), "event_id", "current_memory_mb",
        r6("actual_ram_mb").alias("actual_ram_mb"), r6("predicted_ram_mb").alias("predicted_ram_mb"),
    )


@query("resume_index", f"""WITH {CYCLES}, runs AS (SELECT DISTINCT app, model_name, namespace FROM cyc),
c AS (SELECT app, model_name, namespace, count(*) FILTER (phase = 'evaluation') AS e,
  count(*) FILTER (phase = 'warmup') AS w FROM cyc GROUP BY ALL)
SELECT app, model_name, namespace, CASE WHEN e > 0 THEN CASE WHEN app = 'A' THEN 168 ELSE 252 END + e ELSE w END::BIGINT
  AS start_index, e + w > 0 AS valid FROM runs JOIN c USING (app, model_name, namespace)""")
def resume_index(spark, folder):
    keys = ["app", "model_name", "namespace"]
    rows = cycles(spark, folder).select(*keys, "phase", "event_id")
    warmup = F.when(F.col("app") == "A", 168).otherwise(252)
    return analysis.resume_index(rows, rows.select(*keys).distinct(), warmup, keys)
