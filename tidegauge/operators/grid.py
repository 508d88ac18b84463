"""Run grids: combinations of models, products of models, datasets and modes, and what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import model_slug, namespace_name

MODES = ("horizontal", "vertical", "combined")
DEFAULT_COMPONENTS = ("ExponentialSmoothing", "Prophet", "FFT")


def combos(df: DataFrame, models: str, min_size: int = 2, name: str = "components") -> DataFrame:
    """All subsets of the array column with at least `min_size` members, in the order of the array.

    The subsets of k models are the output itself (2^k); each is a bit mask, so there is no join.
    """
    one = F.lit(1).cast("bigint")
    masks = F.sequence(one, F.call_function("shiftleft", one, F.size(models)) - 1)
    picked = F.filter(
        F.transform(models, lambda m, i: F.when(_bit(F.col("_mask"), i), m)), lambda m: m.isNotNull()
    )
    return df.withColumn("_mask", F.explode(masks)).filter(F.bit_count("_mask") >= min_size).withColumn(
        name, picked
    ).drop("_mask")


def _bit(mask: Column, i: Column) -> Column:
    return F.getbit(mask, i) == 1


def run_grid(datasets: DataFrame, models: Sequence[str], modes: Sequence[str] = MODES,
             components: Sequence[str] | None = None, prefix: str = "run") -> DataFrame:
    """Models x datasets x modes for a table of `dataset_slug`; RAM datasets have no combined mode.

    Models and modes are parameters, so they are exploded next to each dataset instead of joined.
    """
    parts = sorted(components or [m for m in models if m != "Ensemble"] or DEFAULT_COMPONENTS)
    parts_col = F.array(*[F.lit(p) for p in parts])
    lit_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    grid = (
        datasets.withColumn("model_name", F.explode(lit_array(models)))
        .withColumn("scaling_mode", F.explode(lit_array(modes)))
        .filter(~((F.col("scaling_mode") == "combined") & F.col("dataset_slug").endswith("-ram")))
        .withColumn("components", F.when(F.col("model_name") == "Ensemble", parts_col).otherwise(none))
        .withColumn("model_slug", model_slug("model_name", "components"))
    )
    return grid.withColumn("namespace", namespace_name(prefix, "model_slug", "dataset_slug", "scaling_mode"))


def pending(grid: DataFrame, status: DataFrame, key: str = "namespace") -> DataFrame:
    """Runs that are neither completed nor failed."""
    done = status.filter(F.col("state").isin("completed", "failed"))
    return grid.join(done, key, "left_anti")
