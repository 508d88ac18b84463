"""Column functions. All are Catalyst built-ins, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
BYTES_PER_GB = 1073741824.0
SANITIZED_VALUE = 99999999.0
SEASONAL_LAGS = {3600: 24, 2400: 36}
MODEL_SLUGS = {
    "ExponentialSmoothing": "expsm",
    "Prophet": "prophet",
    "FFT": "fft",
    "GRU": "gru",
    "Transformer": "transformer",
    "BlockRNNGRU": "blockrnngru",
}
MODE_SUFFIXES = {"horizontal": "honly", "vertical": "vonly", "combined": "hv"}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def half_even(col, digits: int = 0) -> Column:
    """Round half to even on the scaled double (numpy's rule), not on the decimal text."""
    if digits == 0:
        return F.rint(_c(col))
    scale = F.lit(float(10**digits))
    return F.rint(_c(col) * scale) / scale


def nan_to_null(col) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


def cpu_cores(percent, cores) -> Column:
    """Percent of one instance to cores, two digits, rounded per instance before any sum."""
    return half_even(_c(percent) * _c(cores) / F.lit(100.0), 2)


def ram_gb(value, already_gb) -> Column:
    """Bytes to GB unless the catalog says the column is GB already."""
    return F.when(_c(already_gb), _c(value)).otherwise(_c(value) / F.lit(BYTES_PER_GB))


def rescale(value, to_capacity, from_capacity) -> Column:
    return _c(value) * (_c(to_capacity) / _c(from_capacity))


def sanitize_prediction(col) -> Column:
    """Infinite or missing predictions become a large constant that never wins a comparison."""
    c = _c(col)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(SANITIZED_VALUE)).otherwise(c)


def non_negative(col) -> Column:
    return F.greatest(F.lit(0.0), _c(col))


def memory_mb(col) -> Column:
    """Memory quantity text to MB; null for text that is no quantity, 0 for empty."""
    text = F.trim(_c(col))

    def number(suffix: str) -> Column:
        return F.regexp_extract(text, rf"^([0-9.]+){suffix}$", 1)

    whole = lambda s: number(s).try_cast("bigint")
    real = lambda s: number(s).try_cast("double")

    def at_least_one(c: Column) -> Column:
        return F.when(c < 1, F.lit(1).cast("bigint")).otherwise(c)

    return (
        F.when(_c(col).isNull() | (text == ""), F.lit(0).cast("bigint"))
        .when(text.endswith("Mi"), whole("Mi"))
        .when(text.endswith("Gi"), (real("Gi") * 1024).cast("bigint"))
        .when(text.endswith("Ki"), at_least_one(F.floor(whole("Ki") / 1024)))
        .when(text.endswith("M"), whole("M"))
        .when(text.endswith("G"), (real("G") * 1000).cast("bigint"))
        .otherwise(at_least_one(F.floor(text.try_cast("bigint") / 1048576)))
    )


def duration_s(col) -> Column:
    """`<n>d` to seconds, `<n>s` and `<n>` as they are; null for anything else."""
    text = F.trim(_c(col))
    value = F.regexp_extract(text, r"^(\d+)[dDsS]?$", 1).try_cast("bigint")
    return F.when(F.lower(text).endswith("d"), value * 86400).otherwise(value)


def model_slug(model, components=None) -> Column:
    """Short model name; an ensemble joins the short names of its components."""
    table = F.create_map(*[F.lit(x) for kv in MODEL_SLUGS.items() for x in kv])

    def one(c: Column) -> Column:
        return F.coalesce(F.try_element_at(table, c), F.lower(c))

    plain = one(_c(model))
    if components is None:
        return plain
    joined = F.concat(F.lit("ens-"), F.array_join(F.transform(_c(components), one), "-"))
    return F.when(_c(model) == "Ensemble", joined).otherwise(plain)


def namespace_name(prefix: str, slug, dataset_slug, mode) -> Column:
    suffix = F.create_map(*[F.lit(x) for kv in MODE_SUFFIXES.items() for x in kv])
    return F.concat_ws("-", F.lit(prefix), _c(slug), _c(dataset_slug), F.try_element_at(suffix, _c(mode)))


def dataset_slug(app, metric) -> Column:
    return F.lower(F.concat_ws("-", _c(app), _c(metric)))


def dataset_name(slug, provider: str, kind: str) -> Column:
    """`a-cpu` to `<provider>_application_A_CPU_<kind>`; null when the slug is unknown."""
    s = _c(slug)
    name = F.concat(
        F.lit(f"{provider}_application_"), F.upper(F.split_part(s, F.lit("-"), F.lit(1))), F.lit("_"),
        F.upper(F.split_part(s, F.lit("-"), F.lit(2))), F.lit(f"_{kind}"),
    )
    return F.when(s.rlike("^[abc]-(cpu|ram)$"), name)


def other_slug(slug) -> Column:
    s = _c(slug)
    return F.concat(
        F.split_part(s, F.lit("-"), F.lit(1)),
        F.when(F.split_part(s, F.lit("-"), F.lit(2)) == "cpu", F.lit("-ram")).otherwise(F.lit("-cpu")),
    )


def save_name(model, components) -> Column:
    joined = F.concat(F.lit("Ensemble["), F.array_join(_c(components), "+"), F.lit("]"))
    has_parts = F.coalesce(F.size(_c(components)), F.lit(0)) > 0
    return F.when((_c(model) == "Ensemble") & has_parts, joined).otherwise(_c(model))


def components_of(name) -> Column:
    """Component names of `Ensemble[a+b]`, in name order; a single model is its own component."""
    inner = F.regexp_extract(_c(name), r"^Ensemble\[(.*)\]$", 1)
    return F.array_sort(F.split(F.when(inner != "", inner).otherwise(_c(name)), r"\+"))


def canonical_key(name) -> Column:
    """The same text for every order of the components, so runs meet in an equi-join."""
    return F.array_join(components_of(name), "+")


def seasonal_lag(step_s, generalize: bool = False) -> Column:
    """Steps per day for the two known grids, else 1 (or 86400/step when generalized)."""
    s = _c(step_s)
    out = F.when(s == 3600, F.lit(24)).when(s == 2400, F.lit(36))
    return out.otherwise((F.lit(86400) / s).cast("int") if generalize else F.lit(1))


def lag_for_step(step_s: int, generalize: bool = False) -> int:
    return SEASONAL_LAGS.get(step_s, 86400 // step_s if generalize else 1)


def floor_ts(ts, step_s: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(_c(ts)) / step_s) * step_s)


def next_ts(ts, step_s: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(_c(ts)) + step_s)


def phase_tag(index, warmup_steps) -> Column:
    return F.when(_c(index) < warmup_steps, F.lit("warmup")).otherwise(F.lit("evaluation"))


def json_number(json, *paths: str, default: float | None = None) -> Column:
    """First path that is present, else the default."""
    found = [F.get_json_object(_c(json), p).try_cast("double") for p in paths]
    return F.coalesce(*found, F.lit(default).cast("double"))


def worse_by_percent(base, now) -> Column:
    """Growth of an error over a positive base, in percent; null when the base is not positive."""
    b = _c(base)
    return F.when(b > 0, (_c(now) - b) / b * 100)


def lost_percent(base, now) -> Column:
    """Loss of a score against a positive base, in percent."""
    b = _c(base)
    return F.when(b > 0, (b - _c(now)) / b * 100)


def trace_rps(cores, total_cores, peak_rps) -> Column:
    return F.greatest(F.lit(1.0), F.rint(_c(cores) / _c(total_cores) * peak_rps)).cast("int")


def trace_memory_mb(gb, total_gb, min_mb, max_mb, step_mb: int) -> Column:
    """Share of the maximum, clamped, then rounded to the step; bounds are numbers or columns."""
    low, high = [(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in (min_mb, max_mb)]
    mb = F.greatest(low, F.least(F.rint(_c(gb) / _c(total_gb) * high), high))
    return (F.rint(mb / step_mb) * step_mb).cast("int")
