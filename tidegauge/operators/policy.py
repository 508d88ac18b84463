"""Scaling recommendations: stateless columns, and the cooldown clocks as an exact parallel scan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.catalog import Policy
from tidegauge.operators.ordered import CHUNK, time_chunk
from tidegauge.session import fresh_path


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sla_flags(policy: Policy, cpu="actual_cpu_cores", ram="actual_ram_gb", replicas="current_replicas"):
    share = F.greatest(_c(replicas), F.lit(1))
    return (
        (_c(cpu) / share > policy.sla_cpu_threshold).alias("sla_cpu_violation"),
        (_c(ram) * 1024 / share > policy.sla_ram_threshold_mb).alias("sla_ram_violation"),
    )


def desired_replicas(predicted_cpu, policy: Policy) -> Column:
    need = F.ceil(_c(predicted_cpu) / policy.cpu_target)
    return F.greatest(F.lit(policy.min_replicas), F.least(F.lit(policy.max_replicas), need)).cast("int")


def desired_memory(predicted_gb, replicas, policy: Policy) -> Column:
    share = F.greatest(_c(replicas), F.lit(1))
    step = policy.memory_step_mb
    need = F.ceil(F.ceil(_c(predicted_gb) * 1024 / share) / step) * step
    most = F.floor(F.lit(policy.max_memory_mb) / share)
    return F.greatest(F.lit(policy.min_memory_mb), F.least(most, need)).cast("int")


def bounded_down(desired, current, policy: Policy) -> Column:
    """A scale-down gives up at most half of the current memory, rounded to the step."""
    step = policy.memory_step_mb
    cur = _c(current)
    floor_mb = cur - F.floor(cur / 2)
    stepped = F.rint(F.greatest(_c(desired), floor_mb) / step) * step
    return F.greatest(F.lit(policy.min_memory_mb), stepped).cast("int")


def pass_through(predicted, actual) -> Column:
    """A metric that is not predicted passes its actual value on."""
    return F.coalesce(_c(predicted), _c(actual))


def recommend(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds SLA flags and the desired replicas and memory before any cooldown."""
    return df.select(
        "*",
        *sla_flags(policy),
        desired_replicas("predicted_cpu_cores", policy).alias("want_replicas"),
        desired_memory("predicted_ram_gb", "current_replicas", policy).alias("want_memory_mb"),
    )


def route_by_mode(df: DataFrame, mode="scaling_mode") -> DataFrame:
    """Keeps the wanted values only for the dimensions the mode scales; counts the restarts it causes."""
    h = _c(mode).isin("horizontal", "combined")
    v = _c(mode).isin("vertical", "combined")
    desired_m = F.when(v, F.col("want_memory_mb")).otherwise(F.col("current_memory_mb"))
    return (
        df.withColumn("desired_replicas", F.when(h, F.col("want_replicas")).otherwise(F.col("current_replicas")))
        .withColumn("desired_memory_mb", desired_m)
        .withColumn(
            "pod_restart_count",
            F.when(v & (F.col("desired_memory_mb") != F.col("current_memory_mb")), F.col("current_replicas"))
            .otherwise(F.lit(0)).cast("int"),
        )
    )


# ---- cooldown clocks -------------------------------------------------------------------------------
#
# A candidate is accepted when the clock's last accepted event is at least the cooldown away (or when it
# is forced). Of the candidates at one instant only the first can open a clock, so the clocks run over
# distinct instants: these are combined map-side, and no row of the input ever enters an array. What a
# time chunk needs from the past is one number per clock: the time of the last accepted event. So a chunk
# can be summed up without knowing that number, as a step function "first accepted instant -> last
# accepted instant"; the functions of all chunks of a key compose in order; and then every chunk replays
# its instants alone. The few instants at which a clock opens go back to the rows by key and time.


def _next_index(ts: np.ndarray, forced: np.ndarray, cooldown_us: int) -> np.ndarray:
    """For each instant: index of the instant accepted after it (len when none)."""
    n = len(ts)
    later = np.searchsorted(ts, ts + cooldown_us, side="left")
    later = np.maximum(later, np.arange(1, n + 1))
    hits = np.flatnonzero(forced)
    where = np.searchsorted(hits, np.arange(n), side="right")
    next_forced = np.append(hits, n)[where]
    return np.minimum(later, next_forced)


def _first_index(ts: np.ndarray, forced: np.ndarray, last_us: int | None, cooldown_us: int) -> int:
    if last_us is None:
        return 0
    timed = int(np.searchsorted(ts, last_us + cooldown_us, side="left"))
    hits = np.flatnonzero(forced)
    return min(timed, int(hits[0])) if len(hits) else timed


def _entry_exit(ts: np.ndarray, forced: np.ndarray, cooldown_us: int) -> tuple[list[int], list[int], int]:
    """Step function of a chunk: entry times with the exit time of the chain that starts there.

    Neighbouring entries with the same exit are merged (the last one is kept). The third value is the
    time of the first forced instant, or -1.
    """
    n = len(ts)
    if n == 0:
        return [], [], -1
    nxt = _next_index(ts, forced, cooldown_us)
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:  # every round doubles the steps a pointer stands for
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    hits = np.flatnonzero(forced)
    reach = int(np.searchsorted(ts, ts[0] + cooldown_us, side="left"))
    top = min(reach, n - 1, int(hits[0]) if len(hits) else n)
    exits = ts[last[: top + 1]]
    keep = np.append(exits[1:] != exits[:-1], True)
    return ts[: top + 1][keep].tolist(), exits[keep].tolist(), int(ts[hits[0]]) if len(hits) else -1


def _walk(ts: np.ndarray, forced: np.ndarray, last_us: int | None, cooldown_us: int) -> np.ndarray:
    accepted = np.zeros(len(ts), dtype=bool)
    if len(ts) == 0:
        return accepted
    nxt = _next_index(ts, forced, cooldown_us)
    i = _first_index(ts, forced, last_us, cooldown_us)
    while i < len(ts):
        accepted[i] = True
        i = int(nxt[i])
    return accepted


def _opened(ts: np.ndarray, forced: np.ndarray, last_us: int | None, cooldown_us: int) -> np.ndarray:
    """Which instants find the clock open; forced ones move it as well, open or not."""
    opened = _walk(ts, forced, last_us, cooldown_us)
    at = ts[opened]
    if len(at):
        since_first = cooldown_us if last_us is None else at[0] - last_us
        opened[opened] = np.append(since_first, np.diff(at)) >= cooldown_us
    return opened


# What the candidates of an instant can be, per clock: (early, forced) -> bit.
KINDS = {(False, False): 1, (False, True): 2, (True, False): 4, (True, True): 8}


def cooldown_accept(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], clocks: dict,
                    chunk_s: int = 3600, grace_s: int = 0) -> DataFrame:
    """Adds one boolean per clock: was the candidate accepted?

    `clocks` maps the new column to `(candidate column, forced column or None, cooldown in seconds)`, and
    optionally a fourth column that marks candidates which do not count within `grace_s` of the first
    row of the key. Candidates of one instant come in `order`, then in the order of their columns.
    A unit of work is the distinct instants of a key's chunk of `chunk_s`, which must be at least the longest
    cooldown. Per key, the chunks meet as step functions: each has at most the distinct candidate instants of
    one cooldown as entries.
    """
    part = [*keys, CHUNK]
    specs = [(c, forced, seconds * 1_000_000, early[0] if early else None) for c, forced, seconds, *early in clocks.values()]
    cooldowns = [cd for _, _, cd, _ in specs]
    if max(cooldowns) > chunk_s * 1_000_000:
        raise ValueError("chunk_s must be at least the longest cooldown")
    n, grace_us, us = len(specs), grace_s * 1_000_000, F.unix_micros(ts)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name else F.lit(False)
    bits = F.lit(0).cast("bigint")
    for i, (candidate, forced, _, early) in enumerate(specs):
        for (is_early, is_forced), bit in KINDS.items():
            if (early or not is_early) and (forced or not is_forced):
                hit = flag(candidate) & (flag(early) == is_early) & (flag(forced) == is_forced)
                bits = bits + F.when(hit, bit << (4 * i)).otherwise(0)
    # The first row of a key matters in the chunks its grace period reaches, nowhere else.
    starts = df.groupBy(*keys).agg(F.min(us).alias("_start")).withColumn(CHUNK, F.explode(F.sequence(
        F.floor(F.col("_start") / (chunk_s * 1_000_000)), F.floor((F.col("_start") + grace_us) / (chunk_s * 1_000_000))
    )))
    instants = df.select(*keys, time_chunk(ts, chunk_s).alias(CHUNK), us.alias("_us"), bits.alias("_bits")).where(
        "_bits <> 0").groupBy(*part, "_us").agg(F.bit_or("_bits").alias("_bits"))
    packed = (
        instants.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("_us", "_bits"))).alias("_i"))
        .join(starts, part, "left")
        .select(*part, F.col("_i._us").alias("_at"), F.col("_i._bits").alias("_flags"),
                F.coalesce("_start", F.lit(-1).cast("bigint")).alias("_start"))
    )

    def in_grace(at, start):
        return at - start < grace_us if start >= 0 else np.zeros(len(at), bool)

    def clock(at, flags, grace, i: int):
        own = (flags >> (4 * i)) & 15
        own = np.where(grace, own & 3, own)
        mask = own != 0
        return mask, at[mask], (own[mask] & 10) != 0

    summary_type = "array<struct<enter:array<bigint>,leave:array<bigint>,hard:bigint>>"

    @F.pandas_udf(summary_type)
    def summarize(at: pd.Series, flags: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for u, f, s in zip(at, flags, start):
            grace = in_grace(u, s)
            cells = [_entry_exit(*clock(u, f, grace, i)[1:], cd) for i, cd in enumerate(cooldowns)]
            out.append([{"enter": a, "leave": b, "hard": c} for a, b, c in cells])
        return pd.Series(out)

    @F.pandas_udf("array<struct<chunk:bigint,last:array<bigint>>>")
    def compose(chunks: pd.Series) -> pd.Series:
        out = []
        for items in chunks:
            last: list = [None] * n
            carried = []
            for item in items:
                carried.append({"chunk": int(item["chunk"]), "last": list(last)})
                for i, cell in enumerate(item["cells"]):
                    last[i] = _through(cell["enter"], cell["leave"], int(cell["hard"]), last[i], cooldowns[i])
            out.append(carried)
        return pd.Series(out)

    @F.pandas_udf("array<struct<us:bigint,open:int,grace:boolean>>")
    def replay(at: pd.Series, flags: pd.Series, start: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for u, f, s, before in zip(at, flags, start, last):
            grace = in_grace(u, s)
            opened = np.zeros(len(u), dtype=np.int32)
            barred = np.zeros(len(u), dtype=bool)  # early candidates within the grace period
            for i, cd in enumerate(cooldowns):
                mask, own, hard = clock(u, f, grace, i)
                since = None if pd.isna(before[i]) else int(before[i])
                opened[np.flatnonzero(mask)[_opened(own, hard, since, cd)]] |= 1 << i
                barred |= grace & (((f >> (4 * i)) & 12) != 0)
            told = np.flatnonzero((opened != 0) | barred)
            out.append([{"us": int(u[j]), "open": int(opened[j]), "grace": bool(grace[j])} for j in told])
        return pd.Series(out)

    # Only the step functions of the chunks of a key meet in one place.
    cells = F.struct(F.col(CHUNK).alias("chunk"), summarize("_at", "_flags", "_start").alias("cells"))
    per_key = packed.select(*keys, cells.alias("_s")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_s"), lambda a, b: (a["chunk"] - b["chunk"]).cast("int")).alias("_s")
    )
    carry = per_key.select(*keys, F.explode(compose("_s")).alias("_c")).select(
        *keys, F.col("_c.chunk").alias(CHUNK), F.col("_c.last").alias("_last")
    )
    told = packed.join(carry, part).select(*keys, F.explode(replay("_at", "_flags", "_start", "_last")).alias("_o")).select(
        *keys, F.col("_o.us").alias("_us"), F.col("_o.open").alias("_open"), F.col("_o.grace").alias("_grace"))
    # Rows of one instant meet by (key, time), as many groups as there are instants.
    rows = df.withColumn("_us", us).join(told, [*keys, "_us"], "left")
    turn = Window.partitionBy(*keys, "_us").orderBy(*[c for c in order if c != ts], *df.columns).rowsBetween(
        Window.unboundedPreceding, 0)
    late = ~F.coalesce("_grace", F.lit(False))
    counts = {name: flag(spec[0]) & (late | ~flag(spec[3])) for name, spec in zip(clocks, specs)}
    rows = rows.select("*", *[F.sum(c.cast("int")).over(turn).alias(f"_n{i}") for i, c in enumerate(counts.values())])
    accepted = []
    for i, ((name, counted), (_, forced, cd, _)) in enumerate(zip(counts.items(), specs)):
        opens = F.coalesce(F.col("_open").bitwiseAND(1 << i) > 0, F.lit(False))
        first = F.col(f"_n{i}") == 1
        accepted.append((counted if cd == 0 else counted & (flag(forced) | (opens & first))).alias(name))
    return rows.select(*df.columns, *accepted)


def _through(enter, leave, first_forced: int, last: int | None, cooldown_us: int) -> int | None:
    """Time of the last accepted instant after a chunk, given the one before it."""
    if len(enter) == 0:
        return last
    at = 0 if last is None else int(np.searchsorted(enter, last + cooldown_us, side="left"))
    if first_forced >= 0:
        at = min(at, len(enter) - 1)
    return int(leave[at]) if at < len(enter) else last


def scale_actions(events: DataFrame, policy: Policy, keys: Sequence[str] = ("namespace",),
                  order: Sequence[str] = ("timestamp",), restarted: str | None = None,
                  mode="scaling_mode", chunk_s: int = 3600) -> DataFrame:
    """Actions with cooldowns over recorded cycles (current replicas and memory are observations).

    Up and down of replicas have separate clocks, memory has one; a restart lets a scale-up pass the
    clock; memory never shrinks in the grace period after the first cycle of the key.
    """
    ts = order[0]
    h = _c(mode).isin("horizontal", "combined")
    v = _c(mode).isin("vertical", "combined")
    rows = recommend(events, policy)
    columns = rows.columns
    more_r = h & (F.col("want_replicas") > F.col("current_replicas"))
    less_r = h & (F.col("want_replicas") < F.col("current_replicas"))
    more_m = v & (F.col("want_memory_mb") > F.col("current_memory_mb"))
    less_m = v & (F.col("want_memory_mb") < F.col("current_memory_mb"))
    forced = F.col(restarted) & more_m if restarted else F.lit(False)
    rows = rows.select(
        *columns, more_r.alias("_up"), less_r.alias("_down"), more_m.alias("_grow"), less_m.alias("_shrink"),
        (more_m | less_m).alias("_vertical"), forced.alias("_forced"),
    )
    # The clocks, the first rows of the keys and the rows themselves are read one by one: what they are computed from is
    # evaluated once, and each reads its columns.
    path = fresh_path(events.sparkSession, "recommended")
    rows.write.parquet(path)
    rows = events.sparkSession.read.schema(rows.schema).parquet(path)
    done = cooldown_accept(
        rows, keys, ts, order,
        {
            "_ok_up": ("_up", None, policy.up_cooldown_s),
            "_ok_down": ("_down", None, policy.down_cooldown_s),
            "_ok_v": ("_vertical", "_forced", policy.vertical_cooldown_s, "_shrink"),
        },
        max(chunk_s, policy.up_cooldown_s, policy.down_cooldown_s, policy.vertical_cooldown_s),
        policy.startup_grace_s,
    )
    return finish_actions(done, policy, columns)


def finish_actions(done: DataFrame, policy: Policy, columns: Sequence[str]) -> DataFrame:
    """Accepted flags to action names and desired values."""
    action_h = (
        F.when(F.col("_ok_up"), "scale_up").when(F.col("_ok_down"), "scale_down")
        .when(F.col("_up") | F.col("_down"), "cooldown").otherwise("no_change")
    )
    action_v = (
        F.when(F.col("_ok_v"), F.when(F.col("_grow"), "scale_up").otherwise("scale_down"))
        .when(F.col("_grow") | F.col("_shrink"), "cooldown").otherwise("no_change")
    )
    replicas = F.when(F.col("_ok_up") | F.col("_ok_down"), F.col("want_replicas")).otherwise(F.col("current_replicas"))
    memory = (
        F.when(F.col("_ok_v") & F.col("_grow"), F.col("want_memory_mb"))
        .when(F.col("_ok_v"), bounded_down("want_memory_mb", "current_memory_mb", policy))
        .otherwise(F.col("current_memory_mb"))
    )
    keep = [c for c in columns if c not in ("want_replicas", "want_memory_mb")]
    return done.withColumn("desired_memory_mb", memory.cast("int")).select(
        *keep, replicas.cast("int").alias("desired_replicas"), "desired_memory_mb",
        action_h.alias("action_horizontal"), action_v.alias("action_vertical"),
        F.when(F.col("desired_memory_mb") != F.col("current_memory_mb"), F.col("current_replicas"))
        .otherwise(0).cast("int").alias("pod_restart_count"),
    )
