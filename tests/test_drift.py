from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import DriftConfig
from plumbline.functions.columns import local_table
from plumbline.operators.drift import (
    categorical_chi2,
    contract_colour,
    numeric_psi,
    output_psi,
    overall_severity,
    psi_severity,
    top_metrics,
)
from plumbline.operators.profile import ReferenceProfile, build_profile
from plumbline.plans.drift_check import check_drift, check_window, recent_reports
from plumbline.sources.tables import as_of

CFG = DriftConfig()


def numbers(spark, values, name="age"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"`{name}` double")


def shift_profile(spark, categories=None, output=None):
    """Reference ages 1..5, each a fifth of the rows, with open edges 1,2,3,4,5,15."""
    shares = [0.2, 0.2, 0.2, 0.2, 0.2]
    table = local_table(spark, categories, "feature string, category string, n bigint, ref_share double") if categories else None
    names = tuple(dict.fromkeys(c[0] for c in categories or []))
    return ReferenceProfile({"age": [1.0, 2.0, 3.0, 4.0, 5.0, 15.0]}, {}, {"age": shares}, names, table, output)


def test_psi_of_a_full_shift(spark):
    current = numbers(spark, [10, 11, 12, 13, 14] * 20)
    row = numeric_psi(current, shift_profile(spark), CFG).first()
    assert row["value"] == pytest.approx(11.052359622, abs=1e-8)
    assert row["severity"] == "high"


def test_psi_matches_numpy_histogram(spark):
    rng = np.random.default_rng(1)
    ref, cur = rng.normal(size=1500), rng.normal(0.3, 1.2, size=700)
    profile = build_profile(numbers(spark, ref, "emp.var.rate"), ["emp.var.rate"], [])
    row = numeric_psi(numbers(spark, cur, "emp.var.rate"), profile, CFG).first()
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    p = np.clip(np.histogram(ref, edges)[0] / len(ref), 1e-6, 1)
    q = np.clip(np.histogram(cur, edges)[0] / len(cur), 1e-6, 1)
    assert row["value"] == pytest.approx(float(((q - p) * np.log(q / p)).sum()), abs=1e-12)


def test_psi_edge_cases(spark):
    ref = spark.createDataFrame([(5.0, float(i % 3 == 0), float(i)) for i in range(50)], "c double, flag double, x double")
    profile = build_profile(ref, ["c", "flag", "x"], [])
    assert profile.edges["c"] == [5.0, 6.0]
    cur = spark.createDataFrame([(99.0, 1.0, None)] * 10, "c double, flag double, x double")
    rows = {r["feature"]: r for r in numeric_psi(cur, profile, CFG).collect()}
    # One bin cannot drift; an all-null column scores zero.
    assert (rows["c"]["value"], rows["c"]["n_bins"]) == (0.0, 1)
    assert (rows["flag"]["value"], rows["flag"]["n_bins"]) == (0.0, 1)
    assert (rows["x"]["value"], rows["x"]["severity"]) == (0.0, "none")
    same = {r["feature"]: r["value"] for r in numeric_psi(ref, profile, CFG).collect()}
    assert same["x"] == pytest.approx(0.0, abs=1e-12)
    assert [r["feature"] for r in numeric_psi(cur.drop("x", "flag"), profile, CFG).collect()] == ["c"]


def categories(spark, counts):
    return spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "job string")


def test_chi2(spark):
    profile = shift_profile(spark, [("job", "a", 50, 0.5), ("job", "b", 30, 0.3), ("job", "c", 20, 0.2)])
    row = categorical_chi2(categories(spark, {"a": 20, "b": 20, "c": 10}), profile, CFG).first()
    assert row["value"] == pytest.approx(2.6666667, abs=1e-7)
    assert row["pvalue"] == pytest.approx(0.2635971, abs=1e-7)
    assert row["drifted"] is False


def test_chi2_unseen_and_missing_categories(spark):
    profile = shift_profile(spark, [("job", "a", 50, 0.5), ("job", "b", 50, 0.5)])
    row = categorical_chi2(categories(spark, {"a": 25, "b": 24, "z": 1}), profile, CFG).first()
    assert row["value"] == pytest.approx(999998.06006, rel=1e-9)
    assert (row["pvalue"], row["drifted"]) == (0.0, True)
    nulls = categorical_chi2(categories(spark, {"a": 25, "b": 24, None: 1}), profile, CFG).first()
    assert nulls["value"] == pytest.approx(row["value"])


def test_chi2_single_category(spark):
    profile = shift_profile(spark, [("job", "a", 50, 1.0)])
    row = categorical_chi2(categories(spark, {"a": 25}), profile, CFG).first()
    assert (row["pvalue"], row["drifted"], row["n_bins"]) == (None, False, 1)


def test_output_psi_is_capped_at_medium(spark):
    profile = shift_profile(spark, output={0: 0.9, 1: 0.1})
    row = output_psi(spark.createDataFrame([(1,)] * 3, "prediction int"), profile, CFG).first()
    assert row["value"] == pytest.approx(14.411447912, abs=1e-8)
    assert row["severity"] == "medium"


def test_severity_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.3,), (0.2,), (0.1,), (0.0999,)], "v double")
    assert [r[0] for r in df.select(psi_severity(F.col("v"), CFG)).collect()] == ["high", "medium", "low", "none"]
    colours = spark.createDataFrame([("critical",), ("medium",), ("low",), (None,), ("odd",)], "s string")
    assert [r[0] for r in colours.select(contract_colour(F.col("s"))).collect()] == ["red", "yellow", "green", "green", "green"]


@pytest.mark.parametrize("drifted, expected", [(0, "none"), (1, "low"), (2, "medium"), (3, "medium"), (4, "high")])
def test_category_count_rule(spark, drifted, expected):
    rows = [(f"f{i}", "chi2", 1.0, None, i < drifted) for i in range(5)]
    df = spark.createDataFrame(rows, "feature string, metric string, value double, severity string, drifted boolean")
    assert overall_severity(df).first()["severity"] == expected


def test_top_metrics_tie_order(spark):
    rows = [("o", "output_dist", 1.0, 0.2, 0), ("c", "chi2", 1.0, 0.05, 0), ("n2", "psi", 1.0, 0.2, 1), ("n1", "psi", 1.0, 0.2, 0), ("x", "psi", 0.5, 0.2, 2), ("y", "psi", 0.4, 0.2, 3)]
    df = spark.createDataFrame(rows, "feature string, metric string, value double, threshold double, position int")
    got = [r["feature"] for r in top_metrics(df).orderBy("rank").collect()]
    assert got == ["n1", "n2", "c", "o", "x"]


def log(spark, n, start=0):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), 10.0 + i % 3, 1, "v7") for i in range(start, start + n)]
    return spark.createDataFrame(rows, "id bigint, created_at timestamp, age double, prediction int, model_version string")


def test_small_window_stores_nothing(spark, tmp_path):
    cfg = DriftConfig(min_window_size=3)
    check = check_drift(spark, log(spark, 1), shift_profile(spark), str(tmp_path), cfg, as_of("2024-02-01"))
    assert check.severity == "insufficient_data"
    assert check.metrics is None and check.alert is None
    assert check.report.first()["window_size"] == 1
    assert not list(tmp_path.iterdir())


def test_alert_fires_once(spark, tmp_path):
    cfg = DriftConfig(min_window_size=3)
    profile = shift_profile(spark, output={0: 0.9, 1: 0.1})
    first = check_drift(spark, log(spark, 3), profile, str(tmp_path), cfg, as_of("2024-02-01"))
    values = {r["metric"]: (r["value"], r["severity"]) for r in first.metrics.collect()}
    assert values["psi"][0] == pytest.approx(11.052359622, abs=1e-8) and values["psi"][1] == "high"
    assert values["output_dist"][0] == pytest.approx(14.411447912, abs=1e-8) and values["output_dist"][1] == "medium"
    assert first.severity == "high"
    alert = spark.read.parquet(f"{tmp_path}/alerts").collect()
    assert len(alert) == 1 and '"current_severity":"red"' in alert[0]["payload"] and '"model_version":7' in alert[0]["payload"]
    check_drift(spark, log(spark, 3), profile, str(tmp_path), cfg, as_of("2024-02-02"))
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 1
    reports = recent_reports(spark.read.parquet(f"{tmp_path}/reports")).collect()
    assert [r["previous_severity"] for r in reports] == ["high", None]


def test_window_is_the_newest_rows(spark):
    check = check_window(log(spark, 60).persist(), shift_profile(spark), CFG, "low", as_of("2024-02-01"))
    row = check.report.first()
    assert (row["window_size"], row["model_version"], row["previous_severity"]) == (60, "v7", "low")
    assert row["window_end"] == dt.datetime(2024, 1, 1, 0, 59)


def test_a_stored_log_is_read_from_its_newest_days(spark, tmp_path):
    """Days are taken newest first until the window is full; the plan reads no other folder."""
    from plumbline.plans.drift_check import newest_days, newest_rows
    from plumbline.sources.tables import append

    rows = spark.range(1000).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("created_at"))
    append(rows.coalesce(1), str(tmp_path / "log"), day_of="created_at")
    log = spark.read.parquet(str(tmp_path / "log"))
    for size in (1, 16, 17, 100, 999, 1000, 2000):
        got = newest_rows(log.select("id", "created_at", "dt"), size)
        assert sorted(r["id"] for r in got.collect()) == list(range(max(0, 1000 - size), 1000))
    few = newest_days(log, 40)
    assert {f.split("/dt=")[1][:10] for f in few.where("id >= 0").inputFiles()} >= {"2024-02-11"}
    pruned = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in pruned and few.select("dt").distinct().count() == 3
    assert newest_days(log, 5000).count() == 1000 and newest_days(log.where("false"), 5).count() == 0
