"""Side-by-side check of a Spark query and its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from tidegauge.sources.tables import TABLES

# Spark type text -> acceptable DuckDB type texts.
SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"}, "date": {"DATE"}, "array<string>": {"VARCHAR[]"}, "array<bigint>": {"BIGINT[]"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(spark_df, con, sql: str, limit: int = 5) -> list[str]:
    """Differences as text; empty when rows, names, types and values agree."""
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    theirs_cols = list(types)
    theirs_raw = con.execute(sql).fetchall()
    ours_cols = spark_df.columns
    out = []
    if sorted(ours_cols) != sorted(theirs_cols):
        return [f"columns {sorted(ours_cols)} != {sorted(theirs_cols)}"]
    for f in spark_df.schema:
        name = f.dataType.simpleString()
        if types[f.name] not in SAME_TYPE.get(name, {name}):
            out.append(f"type of {f.name}: {name} != {types[f.name]}")
    order = sorted(ours_cols)
    ours = sorted((tuple(_cell(r[c]) for c in order) for r in spark_df.collect()), key=_key)
    at = [theirs_cols.index(c) for c in order]
    theirs = sorted((tuple(_cell(r[i]) for i in at) for r in theirs_raw), key=_key)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    a, b = set(ours), set(theirs)
    if a != b or ours != theirs:
        out.append(f"{len(a - b)} rows only here, {len(b - a)} only in SQL; columns {order}")
        out += [f"  here {x}" for x in sorted(a - b, key=_key)[:limit]]
        out += [f"  sql  {x}" for x in sorted(b - a, key=_key)[:limit]]
    if not ours:
        out.append("no rows")
    return out
