from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import eventlog


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=float(hours))


@pytest.mark.parametrize(
    "node, action, step",
    [
        ("triage", None, "triage"), ("triage", "no_action", "comms"), ("triage", "replay", "action"), ("triage", "retrain", "action"),
        ("triage", "rollback", "action"), ("awaiting_hil", "rollback", "end"), ("stale", None, "comms"), ("comms", "retrain", "comms"), ("done", "retrain", "end"),
    ],
)
def test_routing(spark, node, action, step):
    df = spark.createDataFrame([(node, action)], "n string, a string")
    assert df.select(eventlog.next_step(F.col("n"), F.col("a"))).first()[0] == step


def test_surfaced_node(spark):
    df = spark.createDataFrame([("action", True), ("action", False), ("done", True)], "n string, p boolean")
    assert [r[0] for r in df.select(eventlog.surfaced_node(F.col("n"), F.col("p"))).collect()] == ["awaiting_hil", "action", "done"]


def test_dead_letters(spark):
    rows = [
        ("inv-1:replay:3", "replay", False, "2024-01-01 00:00:00", "2", "boom"),
        ("inv-2:retrain:4", None, False, None, None, "late"),
        ("inv-3:replay:3", "replay", True, "2024-01-02 00:00:00", "1", None),
        ("inv-4:replay:3", "replay", None, "x", "1", "corrupt"),
        ("inv-5:replay:3", "replay", False, "2024-01-03 00:00:00", "bad", "boom"),
    ]
    df = spark.createDataFrame(rows, "job_id string, function string, success boolean, finish_time string, job_try string, result string")
    got = eventlog.dead_letters(df).collect()
    assert [r["investigation_id"] for r in got] == ["inv-5", "inv-1", "inv-2"]
    assert [(r["function"], r["attempts"]) for r in got] == [("replay", 0), ("replay", 2), ("unknown", 0)]
    assert eventlog.dead_letters(df.where("false")).count() == 0


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id string, created_at timestamp, id bigint")


def accepted(df, **kw):
    return sorted((r["job_id"], r["id"]) for r in eventlog.accept_jobs(df, "job_id", "created_at", "id", **kw).collect())


def test_repeats_are_refused_for_a_day(spark):
    # The third job is 24 h after a refused one but not after the accepted one.
    df = jobs(spark, [("a", at(0), 1), ("a", at(10), 2), ("a", at(24), 3), ("a", at(24.1), 4), ("b", at(1), 5), ("a", at(49), 6), ("b", at(1), 7)])
    assert accepted(df) == [("a", 1), ("a", 4), ("a", 6), ("b", 5)]


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_jobs_without_a_key_are_one_key(spark, most):
    df = jobs(spark, [(None, at(0), 1), (None, at(2), 2), (None, at(25), 3), ("none", at(1), 4), ("none", at(1), 5)])
    got = eventlog.accept_jobs(df, "job_id", "created_at", "id", max_rows_in_task=most).collect()
    assert sorted((str(r["job_id"]), r["id"]) for r in got) == [("None", 1), ("None", 3), ("none", 4)]


def test_large_keys_take_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", at(h), i) for i, h in enumerate(rng.random(600) * 24 * 20)]
    df = jobs(spark, rows)
    assert accepted(df, max_rows_in_task=50) == accepted(df)


def test_a_long_chain_takes_few_rounds(spark, caplog):
    # A job every 10 hours: 10,000 accepted ones among 30,000, by pointers that double.
    df = spark.range(30_000).select(
        F.lit("hot").alias("job_id"), (F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id") * 10)).alias("created_at"), "id"
    )
    with caplog.at_level("INFO", "plumbline.operators.chains"):
        got = accepted(df, max_rows_in_task=1000)
    assert got == [("hot", i) for i in range(0, 30_000, 3)]
    assert [int(r.message.split()[0]) for r in caplog.records] == [14]


def test_state_merge_and_cursor(spark):
    log = spark.createDataFrame(
        [(1, "drift_event", "a", at(0)), (1, "replay_result", "x", at(1)), (1, "replay_result", "y", at(2)), (2, "other", "z", at(0))],
        "id int, key string, payload string, ts timestamp",
    )
    state = eventlog.merged_state(log, ["drift_event", "replay_result"]).collect()
    assert [(r["id"], r["state"]) for r in state] == [(1, {"drift_event": "a", "replay_result": "y"})]
    events = log.withColumn("emitted_at", F.col("ts"))
    seen = eventlog.cursor(log.where("key = 'drift_event'"), F.col("ts"))
    assert eventlog.events_since(events, seen).count() == 2
    nothing = eventlog.cursor(log.where("false"), F.col("ts"))
    assert eventlog.events_since(events, nothing).count() == 4


def test_read_models(spark):
    event = "struct<model_name:string,model_version:int,previous_severity:string,current_severity:string,window_size:int>"
    rows = [
        ("i1", "awaiting_hil", ("m", 3, "green", "red", 200), None, "rollback", None, at(0), at(1)),
        ("i2", "done", ("m", 4, "green", "yellow", 50), "retrain", None, "ok", at(2), at(3)),
    ]
    df = spark.createDataFrame(
        rows,
        f"id string, current_node string, drift_event {event}, recommended_action string, triage_action string, comms_summary string, created_at timestamp, updated_at timestamp",
    )
    lines = eventlog.summaries(df).collect()
    assert [r["investigation_id"] for r in lines] == ["i2", "i1"]
    assert lines[1]["drift_event_summary"] == "m v3: green -> red (200 predictions)"
    assert tuple(eventlog.node_counts(df).first()) == (2, 1, 1)
    assert eventlog.review_inbox(df, ("recommended_action", "triage_action")).first()["action"] == "ROLLBACK"
    opened = eventlog.open_investigations(spark.createDataFrame([("e1",), ("e2",)], "event_id string"), F.lit(at(0))).collect()
    assert len({r["id"] for r in opened}) == 2 and opened[0]["current_node"] == "triage"
