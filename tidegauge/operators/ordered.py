"""Ordered operators that never put one whole key into one task.

A window over `partitionBy(key)` sends every row of a key to one task, which fails when one key holds
a large share of the data. Here every key is cut into chunks by a deterministic column (time range,
step range, value range). The ordered work runs per (key, chunk); what a chunk needs from the chunks
before or after it is one small edge row per chunk, combined map-side, and comes back by an equi-join
on (key, chunk), the same partitioning the window uses.

Where only neighbours within a known distance matter, the rows near a chunk border are copied to the
next chunk instead (`with_halo`): one scan, one shuffle, no edge rows.

Keys and order columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"


def _never_null(chunk: Column) -> Column:
    """Keeps inner joins on the chunk from adding a null filter below one branch only.

    Such a filter makes two equal scans differ, and Spark would run both instead of reusing one.
    """
    return F.coalesce(chunk, F.lit(0).cast("bigint"))


def time_chunk(ts: str, chunk_s: int) -> Column:
    return _never_null(F.floor(F.unix_seconds(F.col(ts)) / chunk_s))


def step_chunk(step: str, rows: int) -> Column:
    return _never_null(F.floor(F.col(step) / rows))


def magnitude_chunk(value: str, per_e: int = 1000) -> Column:
    """Order-keeping buckets of a positive double, each 0.1 % wide by default."""
    return _never_null(F.floor(F.log(F.col(value)) * per_e))


def _parts(keys: Sequence[str]) -> list[str]:
    return [*keys, CHUNK]


def chunk_seconds(df: DataFrame, keys: Sequence[str], ts: str, rows_per_chunk: int = 1_000_000,
                  coarsest_s: int = 86400, finest_s: int = 1) -> int:
    """Chunk length for which the densest chunk of any key has about `rows_per_chunk` rows.

    One map-side combined count per (key, minute) and a single number to the driver; the key and the
    time column are all it reads. Pass the result as `chunk_s` where the density is not known.
    """
    minute = F.floor(F.unix_seconds(F.col(ts)) / 60)
    peak = df.groupBy(*keys, minute.alias("_m")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    fit = int(60 * rows_per_chunk / max(peak or 1, 1))
    return max(finest_s, min(coarsest_s, fit))


def with_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], chunk: Column,
                   forward: bool = False, prefix: str | None = None) -> DataFrame:
    """Adds `prev_<col>` (or `next_<col>`) of the row before (after) in the order within the key."""
    prefix = prefix or ("next_" if forward else "prev_")
    shift, edge = (F.lead, F.min) if forward else (F.lag, F.max)
    part = _parts(keys)
    fields = list(dict.fromkeys([*order, *cols]))
    row = F.struct(*fields)
    rows = df.withColumn(CHUNK, chunk)
    edges = rows.groupBy(*part).agg(edge(row).alias("_edge"))
    carry = edges.select(*part, shift("_edge").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carry"))
    within = Window.partitionBy(*part).orderBy(*order)
    out = rows.withColumn("_near", shift(row).over(within)).join(carry, part)
    near = F.coalesce("_near", "_carry")
    return out.select(*df.columns, *[near[c].alias(f"{prefix}{c}") for c in cols])


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, position: str = "pos",
                  total: str | None = None) -> DataFrame:
    """Adds the 0-based position in the order within the key and, on request, the key's row count."""
    part = _parts(keys)
    rows = df.withColumn(CHUNK, chunk)
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = (F.sum("_n").over(by_chunk) - F.col("_n")).alias("_before")
    offsets = counts.select(*part, before, F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    within = Window.partitionBy(*part).orderBy(*order)
    out = rows.withColumn("_i", F.row_number().over(within)).join(offsets, part)
    extra = [F.col("_total").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_before") + F.col("_i") - 1).alias(position), *extra)


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, chunk: Column,
                     name: str) -> DataFrame:
    """Adds the sum of `value` from the first row of the key up to and with this row."""
    part = _parts(keys)
    rows = df.withColumn(CHUNK, chunk).withColumn("_v", value)
    sums = rows.groupBy(*part).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_i", F.sum("_v").over(within)).join(offsets, part)
    return out.select(*df.columns, (F.col("_before") + F.col("_i")).alias(name))


def ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, chunk: Column,
         last: bool = True, rank: str | None = None) -> DataFrame:
    """The last (or first) `n` rows of every key, without sorting whole keys.

    No more than `n` rows of a chunk can be among them, and Spark applies that limit before the shuffle.
    The counts of the chunks nearer to the end then tell which of these rows are.
    """
    part = _parts(keys)
    rows = df.withColumn(CHUNK, chunk)
    order_cols = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order_cols))
    top = rows.withColumn("_rank", within).filter(F.col("_rank") <= n)
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    by_chunk = F.col(CHUNK).desc() if last else F.col(CHUNK).asc()
    seen = F.sum("_n").over(Window.partitionBy(*keys).orderBy(by_chunk)) - F.col("_n")
    needed = counts.withColumn("_seen", seen).filter(F.col("_seen") < n).select(*part, "_seen")
    kept = top.join(needed, part).withColumn("_rank", F.col("_rank") + F.col("_seen")).filter(F.col("_rank") <= n)
    extra = [F.col("_rank").alias(rank)] if rank else []
    return kept.select(*df.columns, *extra)


def with_halo(df: DataFrame, position: Column, size, reach, forward: bool = False) -> DataFrame:
    """Adds the chunk of `position` (chunks of `size`) and copies the rows that a neighbour chunk looks at.

    Rows look back by `reach` (or ahead, with `forward`), which must not exceed `size`. `_halo` marks the
    copies, which the caller drops after its window.
    """
    if reach > size:
        raise ValueError("a chunk must be at least as long as the reach")
    chunk = F.floor(position / size)
    if forward:
        near, neighbour = position - chunk * size <= reach, chunk - 1
    else:
        near, neighbour = (chunk + 1) * size - position <= reach, chunk + 1
    homes = F.when(near, F.array(chunk, neighbour)).otherwise(F.array(chunk))
    return df.withColumn(CHUNK, F.explode(homes)).withColumn("_halo", F.col(CHUNK) != chunk)


def with_neighbour_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                          reach_s: int, chunk_s: int, forward: bool = False) -> DataFrame:
    """Like `with_neighbour` by time, but null when the neighbour is more than `reach_s` seconds away."""
    ts, us = order[0], F.unix_micros(F.col(order[0]))
    prefix, shift = ("next_", F.lead) if forward else ("prev_", F.lag)
    fields = list(dict.fromkeys([ts, *cols]))
    within = Window.partitionBy(*_parts(keys)).orderBy(*order)
    # Chunks of at least four reaches: at most a quarter of the rows is copied.
    size = max(chunk_s, 4 * reach_s) * 1_000_000
    rows = with_halo(df, us, size, reach_s * 1_000_000, forward).withColumn(
        "_near", shift(F.struct(*fields)).over(within)
    ).filter(~F.col("_halo"))
    close = F.abs(us - F.unix_micros(F.col("_near")[ts])) <= reach_s * 1_000_000
    return rows.select(*df.columns, *[F.when(close, F.col("_near")[c]).alias(f"{prefix}{c}") for c in cols])


def lag_on_grid(df: DataFrame, keys: Sequence[str], step: str, value: str, lag: int, name: str,
                chunk_rows: int = 8192) -> DataFrame:
    """`value` of `lag` steps earlier on a complete grid: one shuffle, no key in one task."""
    size = max(chunk_rows, 4 * lag)
    within = Window.partitionBy(*_parts(keys)).orderBy(step)
    haloed = with_halo(df, F.col(step), size, lag)
    out = haloed.withColumn(name, F.lag(value, lag).over(within)).filter(~F.col("_halo"))
    return out.select(*df.columns, name)


def attach_by_chunk(df: DataFrame, per_key: DataFrame, keys: Sequence[str], chunk: Column, low: Column,
                    high: Column) -> DataFrame:
    """Joins one row per key to all rows of the key, spread over the key's chunks `low..high`.

    A plain equi-join on the key would put a hot key into one task; a broadcast would need a bound on
    the number of keys.
    """
    spread = per_key.withColumn(CHUNK, F.explode(F.sequence(low, high)))
    return df.withColumn(CHUNK, chunk).join(spread, _parts(keys)).drop(CHUNK)
