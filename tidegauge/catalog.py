"""Capacity catalog, scaling policy and calibration: small fixed dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# App -> (instances, cores per instance, GB per instance, RAM column already in GB).
CAPACITY = {"A": (12, 4, 32, False), "B": (8, 4, 128, True), "C": (2, 2, 4, False)}

# Metric -> step of the regular grid in seconds.
METRIC_STEPS = {"CPU": 3600, "RAM": 2400}

# App -> calibration of the load trace.
CALIBRATION = {
    app: {"peak_cpu_cores": 10.0, "peak_rps": 297, "min_memory_mb": 1024, "max_memory_mb": 8192} for app in "ABC"
}


def _inline(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """Literal rows as an inline table: Catalyst knows the size and broadcasts it without being told."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else ("true" if v is True else "false" if v is False else str(v))
    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def capacity(spark: SparkSession) -> DataFrame:
    """One row per app with per-instance and total capacity."""
    rows = [(a, i, c, r, gb, i * c, i * r) for a, (i, c, r, gb) in CAPACITY.items()]
    return _inline(spark, "app, instances, cores, ram_gb, ram_already_gb, total_cores, total_ram_gb", rows)


def calibration(spark: SparkSession) -> DataFrame:
    table = _inline(spark, "app, peak_cpu_cores, peak_rps, min_memory_mb, max_memory_mb",
                    [(a, *v.values()) for a, v in CALIBRATION.items()])
    return table.withColumn("peak_cpu_cores", F.col("peak_cpu_cores").cast("double"))


def lookup(column, position: int, default=None):
    """Catalog value by app as a literal map: no join at all when the key set is fixed."""
    pairs = [F.lit(x) for app, row in CAPACITY.items() for x in (app, row[position])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


@dataclass(frozen=True)
class Policy:
    """Scaling parameters; SLA thresholds default to 0.9 of target and of maximum memory."""

    min_replicas: int = 1
    max_replicas: int = 10
    cpu_target: float = 0.5
    min_memory_mb: int = 64
    max_memory_mb: int = 4096
    memory_step_mb: int = 64
    up_cooldown_s: int = 60
    down_cooldown_s: int = 180
    vertical_cooldown_s: int = 300
    startup_grace_s: int = 120
    sla_cpu: float | None = None
    sla_ram_mb: float | None = None
    scrape_s: int = 60
    warmup_cycles: int = 0
    max_history_points: int = 500
    bootstrap_minutes: int = 30

    @property
    def sla_cpu_threshold(self) -> float:
        return self.sla_cpu or 0.9 * self.cpu_target

    @property
    def sla_ram_threshold_mb(self) -> float:
        return self.sla_ram_mb or 0.9 * self.max_memory_mb

    @property
    def vm_cpu_cap(self) -> float:
        return self.max_replicas * self.cpu_target

    @property
    def vm_ram_cap(self) -> float:
        return self.max_memory_mb / 1024.0
