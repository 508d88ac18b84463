"""Pairs with a missing metric take no part in cross-run tests."""

from tidegauge.operators import analysis


def test_signed_ranks_skip_nan_and_null(spark):
    nan = float("nan")
    rows = [("g", 3.0, 1.0), ("g", nan, 1.0), ("g", 2.0, 5.0), ("g", None, 1.0), ("g", 9.0, 4.0), ("g", 1.0, nan)]
    pairs = spark.createDataFrame(rows, "g string, a double, b double")
    got = analysis.signed_ranks(pairs, ["g"], "a", "b").first()
    assert (got.n_samples, got.n_nonzero, got.r_plus, got.r_minus) == (3, 3, 4.0, 2.0)
