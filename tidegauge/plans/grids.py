"""Run grids and their state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import dataset_slug
from tidegauge.operators import analysis, grid
from tidegauge.plans.registry import CYCLES, TELE, cycles, query, telemetry

MODELS = ["ExponentialSmoothing", "Prophet", "FFT", "Ensemble"]

_ENS = "['ExponentialSmoothing', 'FFT', 'Prophet']"
GRID = TELE + f""",
ds AS (SELECT DISTINCT lower(app) || CASE WHEN k % 2 = 0 THEN '-cpu' ELSE '-ram' END AS dataset_slug FROM tele),
m(model_name, model_slug) AS (VALUES ('ExponentialSmoothing', 'expsm'), ('Prophet', 'prophet'), ('FFT', 'fft'),
  ('Ensemble', 'ens-expsm-fft-prophet')),
md(scaling_mode, suffix) AS (VALUES ('horizontal', 'honly'), ('vertical', 'vonly'), ('combined', 'hv')),
grid AS (
  SELECT dataset_slug, model_name, scaling_mode, model_slug, 'run-' || model_slug || '-' || dataset_slug || '-' || suffix
    AS namespace, CASE WHEN model_name = 'Ensemble' THEN {_ENS} ELSE []::VARCHAR[] END AS components
  FROM ds, m, md WHERE NOT (scaling_mode = 'combined' AND dataset_slug LIKE '%-ram'))"""


def run_grid(spark, folder):
    metric = F.when(F.col("k") % 2 == 0, "cpu").otherwise("ram")
    slugs = telemetry(spark, folder).select(dataset_slug("app", metric).alias("dataset_slug")).distinct()
    return grid.run_grid(slugs, MODELS)


@query("experiment_grid", f"WITH {GRID} SELECT * FROM grid")
def experiment_grid(spark, folder):
    return run_grid(spark, folder)


@query("ensemble_combos", f"""WITH {CYCLES}, have AS (
  SELECT namespace AS dataset, list_sort(list(DISTINCT model_name)) AS models FROM cyc GROUP BY 1),
mask AS (SELECT *, unnest(generate_series(1, (1 << len(models)) - 1)) AS mask FROM have)
SELECT dataset, list_filter(list_transform(models, lambda x, i: CASE WHEN (mask >> (i - 1)::BIGINT) & 1 = 1 THEN x END),
  lambda x: x IS NOT NULL) AS components FROM mask WHERE bit_count(mask) >= 2""")
def ensemble_combos(spark, folder):
    have = cycles(spark, folder).groupBy(F.col("namespace").alias("dataset")).agg(
        F.array_sort(F.collect_set("model_name")).alias("models")
    )
    return grid.combos(have, "models").select("dataset", "components")


_STATUS = """st AS (
  SELECT DISTINCT 'run-' || CASE model_name WHEN 'ExponentialSmoothing' THEN 'expsm' WHEN 'Prophet' THEN 'prophet' ELSE 'fft' END
    || '-' || dataset_slug || CASE scaling_mode WHEN 'horizontal' THEN '-honly' WHEN 'vertical' THEN '-vonly' ELSE '-hv' END
    AS namespace FROM cyc WHERE namespace IN ('click', 'error'))"""


def status(spark, folder):
    """A run with recorded click cycles is completed, one with error cycles failed, others are pending."""
    from tidegauge.functions import model_slug, namespace_name

    name = namespace_name("run", model_slug("model_name"), "dataset_slug", "scaling_mode")
    state = F.when(F.col("namespace") == "click", "completed").when(F.col("namespace") == "error", "failed").otherwise("pending")
    return cycles(spark, folder).select(name.alias("namespace"), state.alias("state")).distinct()


@query("pending_runs", f"""WITH {GRID}, {CYCLES.split(TELE + ",")[1]}, {_STATUS}
SELECT namespace, model_name, dataset_slug, scaling_mode FROM grid WHERE namespace NOT IN (SELECT namespace FROM st)""")
def pending_runs(spark, folder):
    todo = grid.pending(run_grid(spark, folder), status(spark, folder))
    return todo.select("namespace", "model_name", "dataset_slug", "scaling_mode")


@query("missing_stage", f"""WITH {CYCLES}, r AS (SELECT DISTINCT app, namespace FROM cyc),
need(artifact, stage) AS (VALUES ('splits', 'data'), ('trials', 'tuning'), ('forecasts', 'results')),
have AS (SELECT app, namespace, CASE model_name WHEN 'ExponentialSmoothing' THEN 'splits' WHEN 'Prophet' THEN 'trials'
  ELSE 'forecasts' END AS artifact FROM cyc GROUP BY ALL HAVING max(event_id) % 3 <> 0)
SELECT app, namespace, artifact, stage FROM r, need WHERE (app, namespace, artifact) NOT IN (SELECT app, namespace, artifact FROM have)""")
def missing_stage(spark, folder):
    rows = cycles(spark, folder)
    artifact = F.when(F.col("model_name") == "ExponentialSmoothing", "splits").when(
        F.col("model_name") == "Prophet", "trials").otherwise("forecasts")
    last = rows.groupBy("app", "namespace", artifact.alias("artifact")).agg(F.max("event_id").alias("last"))
    have = last.filter(F.col("last") % 3 != 0)
    required = {"splits": "data", "trials": "tuning", "forecasts": "results"}
    return analysis.missing_stages(rows.select("app", "namespace").distinct(), have, required, ["app", "namespace"])
