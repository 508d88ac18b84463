"""Resampling, gap filling, splits and history windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import series as ops
from tidegauge.plans.registry import (
    HOURLY, LAG, SPLIT, TELE, events, hourly, hourly_split, out_ts, query, r6, s6, telemetry,
)
from tidegauge.sources.tables import read_table


def raw_series(spark, folder):
    return events(spark, folder).select(
        F.col("event_type").alias("series_id"), "ts", "event_id", F.col("value").alias("y")
    )


@query("resample_mean", f"""SELECT event_type AS series_id,
  time_bucket(INTERVAL '40 minutes', ts, TIMESTAMP '2024-01-01') AS ts, {s6("avg(value)")} AS y
FROM events GROUP BY ALL""")
def resample_mean(spark, folder):
    return ops.resample(raw_series(spark, folder), 2400).select("series_id", out_ts("ts").alias("ts"), r6("y").alias("y"))


@query("resample_day_anchor", f"""WITH o AS (SELECT event_type, date_trunc('day', min(ts)) AS origin FROM events GROUP BY 1)
SELECT event_type AS series_id,
  origin + to_seconds((epoch_us(ts) - epoch_us(origin)) // 25200000000 * 25200) AS ts, {s6("avg(value)")} AS y
FROM events JOIN o USING (event_type) GROUP BY ALL""")
def resample_day_anchor(spark, folder):
    # Seven hours do not divide a day: bins start at midnight of the first day of each series.
    return ops.resample(raw_series(spark, folder), 25200).select(
        "series_id", out_ts("ts").alias("ts"), r6("y").alias("y")
    )


@query("bucket_mean", f"""SELECT event_type AS series_id, user_id % 8 AS instance,
  time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01') AS ts, {s6("avg(value)")} AS y
FROM events GROUP BY ALL""")
def bucket_mean(spark, folder):
    raw = events(spark, folder).select(
        F.col("event_type").alias("series_id"), (F.col("user_id") % 8).alias("instance"), "ts", F.col("value").alias("y")
    )
    return ops.resample(raw, 900, keys=["series_id", "instance"]).select(
        "series_id", "instance", out_ts("ts").alias("ts"), r6("y").alias("y")
    )


@query("gap_fill_linear", f"""WITH {HOURLY}
SELECT series_id, ts, step_idx, n_steps, {s6("y")} AS y FROM series""")
def gap_fill_linear(spark, folder):
    return hourly(spark, folder).select("series_id", out_ts("ts").alias("ts"), "step_idx", "n_steps", r6("y").alias("y"))


_LIVE = f"""WITH b0 AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL '20 minutes', ts, TIMESTAMP '2024-01-01') AS b,
    avg(CASE WHEN json_extract(props, '$.k')::INTEGER % 3 > 0 THEN value END) AS y
  FROM events GROUP BY ALL),
lim AS (SELECT series_id, min(b) AS lo, max(b) AS hi FROM b0 GROUP BY 1),
g AS (SELECT series_id, lo, hi, unnest(generate_series(lo, hi, INTERVAL '20 minutes')) AS ts FROM lim),
kn AS (SELECT series_id, b, y FROM b0 WHERE y IS NOT NULL),
pv AS (SELECT g.series_id, g.ts, lo, hi, kn.b AS pb, kn.y AS py FROM g ASOF LEFT JOIN kn
  ON g.series_id = kn.series_id AND g.ts >= kn.b),
nv AS (SELECT pv.*, kn.b AS nb, kn.y AS ny FROM pv ASOF LEFT JOIN kn ON pv.series_id = kn.series_id AND pv.ts <= kn.b)
SELECT series_id, ts, (epoch_us(ts) - epoch_us(lo)) // 1200000000 AS step_idx,
  {s6('''CASE WHEN pb IS NULL THEN %s WHEN nb IS NULL OR nb = pb THEN py
    ELSE py + (ny - py) * ((epoch_us(ts) - epoch_us(pb)) / (epoch_us(nb) - epoch_us(pb))::DOUBLE) END''')} AS y
FROM nv"""


def _with_nulls(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = events(spark, folder).select(
        F.col("event_type").alias("series_id"), "ts", F.when(k % 3 > 0, F.col("value")).alias("y")
    )
    return raw


@query("gap_fill_forward", _LIVE.replace("%s", "NULL"))
def gap_fill_forward(spark, folder):
    return ops.regular_series(_with_nulls(spark, folder), 1200, "forward").select(
        "series_id", out_ts("ts").alias("ts"), "step_idx", r6("y").alias("y")
    )


@query("gap_fill_both", _LIVE.replace("%s", "ny"))
def gap_fill_both(spark, folder):
    return ops.regular_series(_with_nulls(spark, folder), 1200, "both").select(
        "series_id", out_ts("ts").alias("ts"), "step_idx", r6("y").alias("y")
    )


@query("chrono_split", f"WITH {SPLIT} SELECT series_id, step_idx, n_train, n_val, split, {s6('y')} AS y FROM split")
def chrono_split(spark, folder):
    return hourly_split(spark, folder).select("series_id", "step_idx", "n_train", "n_val", "split", r6("y").alias("y"))


@query("split_meta", f"""WITH {SPLIT}
SELECT series_id, 'Total_Usage' AS target_col, 3600 AS step_s,
  {s6("min(y) FILTER (split = 'train')")} AS train_min, {s6("max(y) FILTER (split = 'train')")} AS train_max,
  {s6("avg(y) FILTER (split = 'train')")} AS train_mean, {s6("stddev_samp(y) FILTER (split = 'train')")} AS train_std,
  count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
  count(*) FILTER (split = 'test') AS n_test
FROM split GROUP BY series_id""")
def split_meta(spark, folder):
    meta = ops.split_meta(hourly_split(spark, folder))
    for c in ("train_min", "train_max", "train_mean", "train_std"):
        meta = meta.withColumn(c, r6(c))
    return meta


@query("train_val", f"WITH {SPLIT} SELECT series_id, step_idx, {s6('y')} AS y FROM split WHERE split IN ('train', 'val')")
def train_val(spark, folder):
    # Train and val are one filter on the split column, not a union of two tables.
    return hourly_split(spark, folder).filter(F.col("split").isin("train", "val")).select(
        "series_id", "step_idx", r6("y").alias("y")
    )


@query("period_split", f"""SELECT l_returnflag, CASE WHEN l_shipdate < TIMESTAMP '1998-04-10' THEN 1 ELSE 2 END AS period,
  count(*) AS n_rows, {s6("sum(l_quantity)")} AS quantity, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts
FROM lineitem GROUP BY ALL""")
def period_split(spark, folder):
    parts = ops.period_split(read_table(spark, folder, "lineitem"), "l_shipdate", "1998-04-10 00:00:00")
    out = None
    for i, part in enumerate(parts, start=1):
        agg = part.groupBy("l_returnflag").agg(
            F.lit(i).alias("period"), F.count(F.lit(1)).alias("n_rows"), r6(F.sum("l_quantity")).alias("quantity"),
            F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"),
        )
        out = agg if out is None else out.unionByName(agg)
    return out


@query("missing_report", f"""WITH {TELE}
SELECT app, instance, count(*) FILTER (k % 7 IN (0, 1)) AS n_missing, count(*) AS n_rows,
  bool_or(k % 7 IN (0, 1)) AS has_missing FROM tele GROUP BY ALL""")
def missing_report(spark, folder):
    rows = telemetry(spark, folder).withColumn(
        "value", F.when(F.col("k") % 7 == 0, F.lit(float("nan"))).when(F.col("k") % 7 > 1, F.col("value"))
    )
    return ops.missing_report(rows, ["app", "instance"], "value")


@query("seasonal_naive_error", f"""WITH {SPLIT}, d AS (
  SELECT *, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY step_idx) AS diff FROM split WHERE split = 'train')
SELECT series_id, step_idx, {s6("diff")} AS diff FROM d""")
def seasonal_naive_error(spark, folder):
    train = hourly_split(spark, folder).filter(F.col("split") == "train")
    return ops.seasonal_difference(train, LAG).select("series_id", "step_idx", r6("diff").alias("diff"))


@query("history_tail", """SELECT event_type AS series_id, event_id, ts, value AS y FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500""")
def history_tail(spark, folder):
    return ops.history_tail(raw_series(spark, folder), 500, order=["ts", "event_id"]).select(
        "series_id", "event_id", out_ts("ts").alias("ts"), "y"
    )


@query("history_sample", """WITH r AS (SELECT event_type AS series_id, event_id, ts, value AS y,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS up,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS down FROM events)
SELECT series_id, event_id, ts, y, up AS rank, 'head' AS part FROM r WHERE up <= 3
UNION ALL SELECT series_id, event_id, ts, y, down AS rank, 'tail' AS part FROM r WHERE down <= 3""")
def history_sample(spark, folder):
    return ops.history_sample(raw_series(spark, folder), 3, order=["ts", "event_id"]).select(
        "series_id", "event_id", out_ts("ts").alias("ts"), "y", F.col("rank").cast("bigint").alias("rank"), "part"
    )


@query("last_observed", """SELECT event_type AS series_id, user_id % 8 AS instance,
  greatest(0.0::DOUBLE, max_by(value - 20, (ts, event_id))) AS last_observed FROM events GROUP BY ALL""")
def last_observed(spark, folder):
    rows = events(spark, folder).select(
        F.col("event_type").alias("series_id"), (F.col("user_id") % 8).alias("instance"), "ts", "event_id",
        (F.col("value") - 20).alias("y"),
    )
    return ops.last_observed(rows, ["series_id", "instance"], ["ts", "event_id"])
