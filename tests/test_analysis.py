"""Cross-run analysis, grids, files."""

import datetime as dt
import itertools
import json
import os
import random

import numpy as np
import pytest

from tidegauge.operators import analysis, grid, select
from tidegauge.sources import documents, tables, usage


def pair_frame(spark, a, b):
    return spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)], "g string, a double, b double")


def brute_ranks(d):
    d = [x for x in d if x]
    size = sorted(abs(x) for x in d)
    rank = {v: np.mean([i + 1 for i, s in enumerate(size) if s == v]) for v in size}
    return sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_signed_ranks_by_brute_force(spark, seed):
    rng = random.Random(seed)
    a = [rng.choice([rng.randint(0, 9), rng.random() * 1e-6, rng.random() * 1e6]) for _ in range(200)]
    b = [rng.randint(0, 9) for _ in a]
    got = analysis.signed_ranks(pair_frame(spark, a, b), ["g"], "a", "b").first()
    assert np.allclose((got.r_plus, got.r_minus), brute_ranks([float(x) - float(y) for x, y in zip(a, b)]))
    assert got.n_nonzero == sum(x != y for x, y in zip(a, b))


def test_wilcoxon_edges(spark):
    zero = analysis.wilcoxon(pair_frame(spark, [1, 2, 3], [1, 2, 3]), ["g"], "a", "b").first()
    assert (zero.p_value, zero.significant, zero.w) == (1.0, False, 0.0)
    assert analysis.wilcoxon(pair_frame(spark, [1, 2], [0, 0]), ["g"], "a", "b").count() == 0
    three = analysis.wilcoxon(pair_frame(spark, [1, 2, 3], [0, 0, 0]), ["g"], "a", "b").first()
    assert three.p_value == 0.25


def test_exact_p_by_enumeration():
    for n in range(1, 10):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            want = min(1.0, 2 * sum(s <= w for s in sums) / len(sums))
            assert abs(analysis.signed_rank_p(w, n, 0.0, 0) - want) < 1e-12
    # The normal limit is close to the exact value for a larger sample.
    assert abs(analysis.signed_rank_p(400, 50, 0.0, 0) - analysis.signed_rank_p(400, 50, 1e-9, 0)) < 0.01


def test_pairs_take_the_first_individual(spark):
    rows = [(1, "Ensemble[FFT+Prophet]", 1.0), (2, "FFT", 2.0), (3, "FFT", 9.0), (4, "Prophet", None), (5, "Other", 4.0)]
    df = spark.createDataFrame([("d", "m", *r) for r in rows],
                               "dataset_slug string, scaling_mode string, run_id int, model string, MAE double")
    got = analysis.ensemble_pairs(df, ["MAE"]).collect()
    assert [(r.model_individual, r.val_ensemble, r.val_individual) for r in got] == [("FFT", 1.0, 2.0)]


def test_combinations_in_given_order(spark):
    names = ["c", "a", "b", "d"]
    got = {tuple(r.components) for r in grid.combos(spark.createDataFrame([(names,)], "m array<string>"), "m").collect()}
    assert got == {c for k in range(2, 5) for c in itertools.combinations(names, k)}


def test_grid_and_pending(spark):
    slugs = spark.createDataFrame([("a-cpu",), ("a-ram",)], "dataset_slug string")
    rows = grid.run_grid(slugs, ["FFT", "Ensemble"], components=["Prophet", "FFT"])
    names = {r.namespace for r in rows.collect()}
    assert names == {f"run-{m}-{d}" for m in ("fft", "ens-fft-prophet") for d in
                     ("a-cpu-honly", "a-cpu-vonly", "a-cpu-hv", "a-ram-honly", "a-ram-vonly")}
    status = spark.createDataFrame([("run-fft-a-cpu-hv", "completed"), ("run-fft-a-ram-vonly", "failed"),
                                    ("run-fft-a-cpu-honly", "pending")], "namespace string, state string")
    assert {r.namespace for r in grid.pending(rows, status).collect()} == names - {"run-fft-a-cpu-hv", "run-fft-a-ram-vonly"}


def test_latest_and_pinned(spark):
    df = spark.createDataFrame([("d", "20240101_000000", 1), ("d", "20240102_000000", 2)], "k string, run_ts string, v int")
    assert select.latest_run(df, ["k"]).first().v == 2
    assert select.latest_run(df, ["k"], pinned="20240101_000000").first().v == 1


def test_usage_files(spark, tmp_path):
    folder = tmp_path / "usage" / "application_B" / "RAM"
    folder.mkdir(parents=True)
    (folder / "b_jul.csv").write_text(
        "timestamp,timestamp_date_format,B1,B2\n1625097600000,7/1/21 0:00,1,2.5\n1625119200000,7/1/21 6:00,,3\n")
    (folder / "b_aug.csv").write_text(
        "timestamp,timestamp_date_format,B1,B2,B3\r\n1627776000000,8/1/21 0:00,4,5,6\r\n")
    (folder / "notes.txt").write_text("timestamp,x\n")
    long = usage.read_usage(spark, str(tmp_path / "usage"))
    got = {(r.instance, r.ts.month, r.ts.hour): r.value for r in long.collect()}
    assert got == {("B1", 7, 0): 1.0, ("B2", 7, 0): 2.5, ("B1", 7, 6): None, ("B2", 7, 6): 3.0,
                   ("B1", 8, 0): 4.0, ("B2", 8, 0): 5.0, ("B3", 8, 0): 6.0}
    wide = usage.read_usage_wide(spark, str(folder / "b_jul.csv"), ["B1", "B2"])
    later = usage.read_usage_wide(spark, str(folder / "b_aug.csv"), ["B1", "B2", "B3"])
    rows = usage.unify([wide, later]).orderBy("timestamp_date_format").collect()
    assert [r.B3 for r in rows] == [None, None, 6.0] and rows[2].timestamp_date_format == dt.datetime(2021, 8, 1)


def test_identity(spark):
    paths = ["/x/p_application_A_CPU_exp1.csv", "/x/p_application_D_CPU_exp1.csv", "/x/p_application_A_GPU_e.csv", "/x/readme.md"]
    known, rejected = usage.parse_identity(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert [tuple(r) for r in known.collect()] == [(paths[0], "p", "A", "CPU", "exp1")]
    assert rejected.count() == 3


def test_run_documents(spark, tmp_path):
    summary = {"namespace": "n", "model_name": "FFT", "dataset_slug": "a-cpu", "scaling_mode": "combined", "total_cycles": 3,
               "prediction_metrics": {"cpu": {"MAE": 1.5}, "ram": {"R2": -2.0}},
               "operational_metrics": {"avg_replicas": 2.5, "mtbv_cpu_seconds": None}}
    for run, name, text in (("r1", "n1", json.dumps(summary, indent=2)), ("r2", "n2", "{broken"), ("r3", "n3", json.dumps(summary))):
        d = tmp_path / "live" / run / name
        d.mkdir(parents=True)
        (d / "summary.json").write_text(text)
    skipped = tmp_path / "live" / "analysis" / "x"
    skipped.mkdir(parents=True)
    (skipped / "summary.json").write_text(json.dumps(summary))
    got = tables.read_run_summaries(spark, str(tmp_path / "live")).orderBy("run_id").collect()
    assert [(r.run_id, r.MAE_cpu, r.R2_ram, r.avg_replicas, r.MAE_ram) for r in got] == [
        ("r1", 1.5, -2.0, 2.5, None), ("r3", 1.5, -2.0, 2.5, None)]

    for model, ts, metrics in (("Ensemble[FFT+Prophet]", "20240101_000000", {"test": {"MAE": 1.0}, "validation": {"MAE": 9.0}}),
                               ("FFT", "20230101_000000", {"MAE": 2.0})):
        d = tmp_path / "off" / "d_A" / model / ts
        d.mkdir(parents=True)
        (d / "metadata.json").write_text(json.dumps({"dataset": "d_A", "target_col": "t", "model_type": model.split("[")[0],
                                                     "best_params": {"trend": None, "n": 3}, "metrics": metrics}, indent=4))
    meta = tables.read_run_metadata(spark, str(tmp_path / "off"))
    assert {(r.model, r.run_ts) for r in meta.collect()} == {("Ensemble[FFT+Prophet]", "20240101_000000"), ("FFT", "20230101_000000")}
    assert {r.Model: r.MAE for r in analysis.results_summary(meta).collect()} == {"Ensemble": 1.0, "FFT": 2.0}
    assert tables.read_run_metadata(spark, str(tmp_path / "off"), "2023").count() == 1


def test_scanned_documents_keep_their_rejects(spark, tmp_path):
    """A broken, an empty and a good summary; the quarantine takes each version once; a pinned run reads its files alone."""
    good = json.dumps({"namespace": "n", "model_name": "FFT", "operational_metrics": {"avg_replicas": 2.0}})
    for run, text in (("r1", good), ("r2", "{broken"), ("r3", " \n")):
        (tmp_path / "live" / run / "ns").mkdir(parents=True)
        (tmp_path / "live" / run / "ns" / "summary.json").write_text(text)
    flat, bad = documents.scan_run_summaries(spark, str(tmp_path / "live"))
    assert [(r.run_id, r.avg_replicas) for r in flat.collect()] == [("r1", 2.0)]
    assert sorted((r.state, r.text) for r in bad.collect()) == [("corrupt", "{broken"), ("empty", " \n")]
    held = str(tmp_path / "quarantine")
    assert documents.quarantine(bad, held).count() == 2
    assert documents.quarantine(bad, held).count() == 2
    later = tmp_path / "live" / "r2" / "ns" / "summary.json"
    later.write_text("{still broken")
    os.utime(later, (2_000_000_000, 2_000_000_000))
    assert documents.quarantine(documents.scan_run_summaries(spark, str(tmp_path / "live"))[1], held).count() == 3
    for ts in ("20240101_000000", "20240102_000000"):
        (tmp_path / "off" / "A+B" / ts).mkdir(parents=True)
        (tmp_path / "off" / "A+B" / ts / "metadata.json").write_text(json.dumps({"dataset": ts, "metrics": {"MAE": 1.0}}))
    meta, bad = documents.scan_run_metadata(spark, str(tmp_path / "off"), "20240102_000000")
    assert [(r.model, r.run_ts, r.dataset) for r in meta.collect()] == [("A+B", "20240102_000000", "20240102_000000")]
    assert bad.count() == 0 and documents.scan_run_metadata(spark, str(tmp_path / "off"))[0].count() == 2


def test_missing_stage_is_named(spark, tmp_path):
    with pytest.raises(tables.MissingStage, match="run the data stage first"):
        tables.read_splits(spark, str(tmp_path))


def test_batch_state(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"version": 1, "config": {"x": 1}, "completed": ["a"], "failed": [], "pending": ["b", "c"]}, indent=2))
    got = {(r.namespace, r.state) for r in tables.read_batch_state(spark, str(path)).collect()}
    assert got == {("a", "completed"), ("b", "pending"), ("c", "pending")}


def test_p_value_method_is_an_argument(spark):
    rows = pair_frame(spark, [1, 2, 3, 4], [0, 0, 0, 0])
    exact = analysis.wilcoxon(rows, ["g"], "a", "b").first()
    normal = analysis.wilcoxon(rows, ["g"], "a", "b", method="normal").first()
    assert (exact.p_method, exact.p_value) == ("exact", 0.125)
    assert normal.p_method == "normal" and abs(normal.p_value - 0.0679) < 1e-4  # z = -5 / sqrt(7.5)
    tied = analysis.wilcoxon(pair_frame(spark, [1, 1, 3], [0, 0, 0]), ["g"], "a", "b").first()
    assert tied.p_method == "normal"
    assert abs(analysis.signed_rank_p(700, 60, 0.0, 0) - analysis.signed_rank_p(700, 60, 0.0, 0, "normal")) < 0.01
    with pytest.raises(ValueError):
        analysis.wilcoxon(rows, ["g"], "a", "b", method="auto")


def test_unparsable_documents_are_returned(spark):
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": '), (3, None), (4, '{"b": 2}')], "id int, doc string")
    assert [r.id for r in analysis.parse_json(docs, "doc", "a int").orderBy("id").collect()] == [1, 4]
    rejects = analysis.rejected_json(docs, "doc", "a int").orderBy("id").collect()
    assert [(r.id, r.doc) for r in rejects] == [(2, '{"a": '), (3, None)]
