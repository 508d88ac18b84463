"""The study end to end on hand-made usage: files, series, search, results, ensemble, metrics, traces."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidegauge import catalog, study
from tidegauge.operators import select
from tidegauge.sources import tables, usage as usage_files

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def usage(spark, days=12):
    rng = np.random.default_rng(1)
    rows = []
    for app in "AC":
        for h in range(24 * days):
            if h % 50 == 13:
                continue  # a missing hour
            for i in (1, 2):
                load = 40 + 20 * np.sin(2 * np.pi * h / 24) + rng.normal()
                rows.append((app, "CPU", f"{app}{i}", T0 + dt.timedelta(hours=h), float(load)))
                rows.append((app, "RAM", f"{app}{i}", T0 + dt.timedelta(hours=h), float(load * 1e8)))
    return spark.createDataFrame(rows, "app string, metric string, instance string, ts timestamp, value double")


def test_study_stages(spark, tmp_path):
    folder, ens = str(tmp_path / "study"), str(tmp_path / "ens")
    cpu = study.usage_series(spark, usage(spark), "CPU")
    study.data_stage(cpu, 3600, folder)
    study.tuning_stage(spark, folder, ["FFT", "SeasonalNaive", "Prophet"], 3600, n_trials=3)
    best = study.best_params(spark, folder)
    assert best.count() == 6
    study.results_stage(spark, folder, 3600)
    got = study.evaluate_stage(spark, folder, 3600)
    rows = got.collect()
    assert {(r.series_id, r.model, r.split) for r in rows} == {
        (s, m, p) for s in ("A_CPU", "C_CPU") for m in ("FFT", "SeasonalNaive", "Prophet") for p in ("val", "test")}
    assert all(r.MASE < 3 for r in rows if r.model != "FFT")
    assert study.training_stage(spark, folder, 3600).count() == 6

    study.ensemble_stage(spark, folder, ["FFT", "SeasonalNaive", "Prophet"], 3600, 12, [6, 12], ens)
    done = tables.read_forecasts(spark, ens)
    n = 24 * 12
    assert done.count() == 2 * (n - int(n * 0.7))
    assert {r.model for r in done.select("model").distinct().collect()} == {"Ensemble[FFT+SeasonalNaive+Prophet]"}
    scores = study.evaluate_stage(spark, folder, 3600, ens).filter("split = 'test'").collect()
    worst = max(r.RMSE for r in rows if r.split == "test")
    assert len(scores) == 2 and all(r.RMSE < worst for r in scores)


def test_ensemble_search_agrees_with_fixed_windows(spark):
    y = 10 + np.sin(np.arange(150) / 4.0) * 3
    arrays = spark.createDataFrame([("s", [float(v) for v in y])], "series_id string, values array<double>")
    comps = {"SeasonalNaive": {"lag": "25"}, "LastValue": {}}
    tuned = {r.backward_window: r.rmse for r in select.tune_ensemble(arrays, comps, [4, 9], 5, 3600).collect()}
    for b, got in tuned.items():
        _, done = select.ensemble_backtest(arrays, comps, b, 5, 3600, part="val")
        p = {r.step_idx: r.y_hat for r in done.collect()}
        assert sorted(p) == list(range(105, 127))
        assert np.isclose(got, np.sqrt(np.mean([(y[i] - v) ** 2 for i, v in p.items()])))
    per_series = spark.createDataFrame([("s", m, p) for m, p in comps.items()],
                                       "series_id string, model string, params map<string,string>")
    _, one = select.ensemble_backtest(arrays, per_series, 9, 5, 3600, part="val", order=list(comps))
    _, two = select.ensemble_backtest(arrays, comps, 9, 5, 3600, part="val")
    pick = lambda d: [(r.step_idx, r.model, r.y_hat) for r in d.orderBy("step_idx").collect()]
    assert pick(one) == pick(two)


def test_traces(spark, tmp_path):
    study.load_traces(spark, usage(spark, 3), str(tmp_path / "traces"))
    cpu = spark.read.json(str(tmp_path / "traces" / "cpu")).orderBy("app", "index").collect()
    assert [r["index"] for r in cpu] == list(range(72)) * 2
    series = {(r.series_id, r.step_idx): r.y for r in study.usage_series(spark, usage(spark, 3), "CPU").collect()}
    cores = {a: c[0] * c[1] for a, c in catalog.CAPACITY.items()}
    for r in cpu:
        assert r.rps == max(1, round(series[f"{r.app}_CPU", r["index"]] / cores[r.app] * 297))
    ram = spark.read.json(str(tmp_path / "traces" / "ram"))
    assert ram.filter((F.col("memory_mb") % 64 != 0) | (F.col("memory_mb") < 1024) | (F.col("memory_mb") > 8192)).count() == 0


def test_analysis_tables(spark):
    rows = []
    for i, slug in enumerate(["a-cpu", "b-cpu", "c-cpu", "a-ram"]):
        for model, mae in (("FFT", 2.0 + i), ("Prophet", 1.5), ("Ensemble[FFT+Prophet]", 1.0)):
            rows.append((f"r{i}{model}", model, slug, "combined", mae, mae * 2, mae * 3, mae * 4, 0.5, 0.6, 0.1, 0.2, 3.0, 4.0, 5.0, 6.0))
    online = spark.createDataFrame(rows, "run_id string, model string, dataset_slug string, scaling_mode string, MAE_cpu double,"
                                   " MAE_ram double, RMSE_cpu double, RMSE_ram double, R2_cpu double, R2_ram double,"
                                   " sla_cpu_violation_rate double, sla_ram_violation_rate double, overprovision_cpu_minutes double,"
                                   " overprovision_ram_minutes double, oscillation_horizontal_count double,"
                                   " oscillation_vertical_count double")
    offline = spark.createDataFrame([("a-cpu", "Ensemble[Prophet+FFT]", "2", 0.5, 1.0, 0.8), ("a-cpu", "Ensemble[FFT+Prophet]", "1", 9.0, 9.0, 0.0),
                                     ("a-ram", "FFT", "1", 0.0, 1.0, -1.0)],
                                    "dataset_slug string, model string, run_ts string, MAE double, RMSE double, R2 double")
    out = study.analyze(online, offline)
    comparison = {(r.dataset_slug, r.model): (r.mae_degradation_pct, r.r2_degradation_pct) for r in out["comparison"].collect()}
    assert comparison.pop(("a-ram", "FFT")) == (None, None)
    mae, lost = comparison.pop(("a-cpu", "Ensemble[FFT+Prophet]"))
    assert mae == 100.0 and np.isclose(lost, (0.8 - 0.5) / 0.8 * 100) and comparison == {}
    tests = {(r.model_individual, r.metric): r for r in out["statistical_tests"].collect()}
    assert len(tests) == 12 and tests["FFT", "MAE_cpu"].p_value == 0.125
    assert tests["FFT", "sla_cpu_violation_rate"].p_value == 1.0
    assert out["oscillations"].count() == 3 and out["overprovision"].count() == 3


def test_usage_files_whatever_their_headers(spark, tmp_path):
    """Quoted and capital headers, a byte-order mark, other columns per file, short and long lines, bad dates and numbers."""
    files = {
        "a.csv": '﻿"TIMESTAMP","Date, local","I 1",I2\n1,1/1/21 0:00,1.5,2\n2,1/1/21 1:00,,4\n3,1/1/21 2:00\n4,1/1/21 3:00,1,2,3\n',
        "sub/b.csv": "Timestamp,when,i3\n1,1/1/21 0:00,7\n2,not a date,8\n3,1/1/21 2:00,many\n",
        "sub/c.csv": "Timestamp,when,i3\n1,2/1/21 0:00,9\n",
        "d.csv": "", "e.csv": "timestamp,date,i3\n", "f.csv": "one\n1\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    long, rejects = usage_files.scan_usage(spark, str(tmp_path))
    got = [(r.path.rsplit("/", 1)[1], r.instance, r.ts.strftime("%d %H"), r.value) for r in long.collect()]
    assert sorted(got, key=str) == sorted([
        ("a.csv", "I 1", "01 00", 1.5), ("a.csv", "I2", "01 00", 2.0), ("a.csv", "I 1", "01 01", None), ("a.csv", "I2", "01 01", 4.0),
        ("b.csv", "i3", "01 00", 7.0), ("c.csv", "i3", "01 00", 9.0)], key=str)
    assert sorted(r.line for r in rejects.collect()) == ["1", "2,not a date,8", "3,1/1/21 2:00", "3,1/1/21 2:00,many", "4,1/1/21 3:00,1,2,3"]
    assert usage_files.read_usage(spark, str(tmp_path), ["i3"]).count() == 2
