from __future__ import annotations

import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import DriftConfig
from plumbline.operators.contract import Contract, Field
from plumbline.operators.drift import drift_metrics, last_window
from plumbline.operators.eventlog import accept_jobs
from plumbline.operators.profile import build_profile
from plumbline.plans.drift_check import period_reports
from plumbline.streaming.drift import check_each_batch, check_windows, severity_alerts
from plumbline.streaming.events import accept_jobs_each_batch, drop_repeated_events, rows_past_watermark
from plumbline.streaming.runtime import drain, stream_table, to_files
from plumbline.streaming.scoring import score_stream

SCHEMA = "id bigint, created_at timestamp, age double, job string, prediction int, model_version string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=float(minutes))


def arrivals(spark, path, *batches):
    """One file per micro-batch, in arrival order."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if f.endswith(".parquet") and not f.startswith("seen"):
                os.utime(full, (time.time() - 1000 + i * 10,) * 2) if f not in arrivals.known else None
                arrivals.known.add(f)
    return stream_table(spark, path, files_per_batch=1)


arrivals.known = set()


@pytest.fixture
def log(spark):
    rng = np.random.default_rng(8)
    rows = [
        (i, at(i * 30), float(rng.normal(40 + (i > 200) * 8, 5)), ["a", "b", "c"][int(rng.integers(0, 3))], int(rng.random() < 0.3), "v2")
        for i in range(400)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def profile(log):
    return build_profile(log.where("id < 200"), ["age"], ["job"], "prediction")


def values(rows, *keys):
    return {tuple(r[k] for k in (*keys, "feature", "metric")): round(r["value"], 9) for r in rows}


def test_batches_equal_one_check(spark, log, profile, tmp_path):
    cfg = DriftConfig(window_size=120, min_window_size=50)
    parts = [log.where(f"id >= {a} and id < {b}") for a, b in ((0, 30), (30, 150), (150, 290), (290, 400))]
    stream = arrivals(spark, str(tmp_path / "in"), *parts)
    root = str(tmp_path / "out")
    drain(check_each_batch(stream, profile, cfg, root, str(tmp_path / "cp")))
    reports = {r["batch"]: r for r in spark.read.parquet(f"{root}/reports").collect()}
    assert sorted(reports) == [1, 2, 3]  # the first batch is below the minimum
    assert reports[1]["previous_severity"] is None and reports[2]["previous_severity"] == reports[1]["severity"]
    last = spark.read.parquet(f"{root}/report_metrics").where("batch = 3").collect()
    assert values(last) == values(drift_metrics(last_window(log, 120), profile, cfg).collect())


def test_windows_equal_batch_reports(spark, log, profile, tmp_path):
    cfg = DriftConfig(min_window_size=40)
    stream = arrivals(spark, str(tmp_path / "in"), log.where("id < 180"), log.where("id >= 180"))
    root = str(tmp_path / "out")
    drain(check_windows(stream, profile, cfg, root, str(tmp_path / "cp")))
    got = spark.read.parquet(f"{root}/reports").collect()
    days = log.withColumn("day", F.window("created_at", "1 day").start)
    reports, metrics = period_reports(days, profile, cfg, "day")
    final = [r for r in reports.collect() if r["day"] + dt.timedelta(days=1, hours=1) <= at(399 * 30)]
    assert final
    assert {(r["window_start"], r["severity"], r["window_size"]) for r in got} == {(r["day"], r["severity"], r["window_size"]) for r in final}
    kept = {r["day"] for r in final}
    assert values(spark.read.parquet(f"{root}/report_metrics").collect(), "window_start") == values(
        [r for r in metrics.collect() if r["day"] in kept], "day"
    )


def test_alert_state_spans_batches(spark, tmp_path):
    schema = "model_name string, created_at timestamp, severity string"
    make = lambda rows: spark.createDataFrame([(m, at(t), s) for m, t, s in rows], schema)
    stream = arrivals(
        spark,
        str(tmp_path / "in"),
        make([("m", 2, "high"), ("m", 1, "low"), ("n", 1, "medium")]),
        make([("m", 3, "high"), ("m", 4, "insufficient_data"), ("m", 5, "high"), ("n", 2, "none"), ("n", 3, "medium")]),
    )
    drain(to_files(severity_alerts(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {(r["model_name"], r["created_at"], r["severity"], r["previous_severity"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("m", at(2), "high", "low"), ("n", at(1), "medium", None), ("n", at(3), "medium", "none")}


def test_jobs_across_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = sorted((float(h), f"k{int(k)}") for h, k in zip(rng.random(300) * 24 * 12, rng.integers(0, 4, 300)))
    df = spark.createDataFrame([(k, at(h * 60), i) for i, (h, k) in enumerate(rows)], "job_id string, created_at timestamp, id bigint")
    stream = arrivals(spark, str(tmp_path / "in"), *[df.where(f"id >= {a} and id < {a + 75}") for a in range(0, 300, 75)])
    root = str(tmp_path / "out")
    drain(accept_jobs_each_batch(stream, root, str(tmp_path / "cp")))
    got = sorted((r["job_id"], r["id"]) for r in spark.read.parquet(f"{root}/accepted").collect())
    assert got == sorted((r["job_id"], r["id"]) for r in accept_jobs(df, "job_id", "created_at", "id").collect())


def test_jobs_out_of_time_order(spark, tmp_path):
    # One job per batch and key: what comes late is judged by the accepted jobs on both sides of it.
    make = lambda rows: spark.createDataFrame([(k, at(h * 60), i) for k, h, i in rows], "job_id string, created_at timestamp, id bigint")
    stream = arrivals(
        spark,
        str(tmp_path / "in"),
        make([("a", 100, 1), ("b", 100, 2), (None, 100, 3)]),
        make([("a", 80, 4), ("b", 70, 5), (None, 124, 6)]),  # 20 hours before: refused; 30 hours before: accepted; 24 after: refused
        make([("b", 94, 7), ("a", 124.5, 8), ("b", 125, 9), (None, 124.1, 10)]),  # 7: 24 hours behind 70, 6 before 100
        make([("a", 20, 11), ("b", 60, 12)]),  # 11 is older than the watermark
        make([("c", 400, 13)]),
        make([("a", 401, 14), ("c", 424, 15)]),
    )
    root = str(tmp_path / "out")
    query = drain(accept_jobs_each_batch(stream, root, str(tmp_path / "cp"), delay="3 days"))
    got = sorted(r["id"] for r in spark.read.parquet(f"{root}/accepted").collect())
    assert got == [1, 2, 3, 5, 8, 9, 10, 13, 14]
    assert rows_past_watermark(query) == 1


def test_check_of_late_batches(spark, log, profile, tmp_path):
    cfg = DriftConfig(window_size=120, min_window_size=50)
    parts = [log.where("id >= 200 and id < 350"), log.where("id < 100"), log.where("id >= 350")]
    stream = arrivals(spark, str(tmp_path / "in"), *parts)
    root = str(tmp_path / "out")
    drain(check_each_batch(stream, profile, cfg, root, str(tmp_path / "cp")))
    metrics = lambda b: values(spark.read.parquet(f"{root}/report_metrics").where(f"batch = {b}").collect())
    assert metrics(1) == metrics(0) == values(drift_metrics(last_window(log.where("id < 350"), 120), profile, cfg).collect())
    assert metrics(2) == values(drift_metrics(last_window(log, 120), profile, cfg).collect())


def test_a_batch_reads_the_folder_before_only(spark, log, profile, tmp_path, monkeypatch):
    from plumbline.streaming import runtime

    read = []
    monkeypatch.setattr(runtime, "read_or_none", lambda spark, path, f=runtime.read_or_none: (read.append(path), f(spark, path))[1])
    stream = arrivals(spark, str(tmp_path / "in"), *[log.where(f"id >= {a} and id < {a + 100}") for a in range(0, 400, 100)])
    root = str(tmp_path / "out")
    drain(check_each_batch(stream, profile, DriftConfig(window_size=80), root, str(tmp_path / "cp")))
    assert {p.rsplit("/", 1)[1] for p in read if "/window/" in p} == {f"batch={i}" for i in (-1, 0, 1, 2)}
    assert all("/batch=" in p for p in read)


def test_repeated_and_late_events(spark, tmp_path):
    make = lambda ids, start: spark.createDataFrame([(i, at(start)) for i in ids], "event_id int, created_at timestamp")
    stream = arrivals(spark, str(tmp_path / "in"), make([1, 2, 2], 5000), make([2, 3], 5001), make([4, 5, 6], 10))
    done = drain(to_files(drop_repeated_events(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    assert rows_past_watermark(done) == 3


def test_scoring_with_quarantine(spark, tmp_path):
    contract = Contract((Field("age", "int64"),))
    rows = spark.createDataFrame([(1, '{"age": 80}'), (2, '{"age": 10}'), (3, '{"age": "x"}'), (4, "{}")], "id int, payload string")
    stream = arrivals(spark, str(tmp_path / "in"), rows.where("id < 3"), rows.where("id >= 3"))
    root = str(tmp_path / "out")
    drain(score_stream(stream, contract, lambda df: df.withColumn("probability", F.col("age") / 100.0), 0.5, root, str(tmp_path / "cp")))
    got = {r["id"]: (r["prediction"], r["decision"]) for r in spark.read.parquet(f"{root}/scored").collect()}
    assert got == {1: (1, "yes"), 2: (0, "no")}
    assert {r["id"] for r in spark.read.parquet(f"{root}/quarantine").collect()} == {3, 4}
