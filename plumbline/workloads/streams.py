"""Streaming queries: the given tables are replayed as streams until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import DriftConfig
from plumbline.sources.folders import fresh_folder
from plumbline.streaming.drift import check_each_batch, check_windows, severity_alerts
from plumbline.streaming.events import accept_jobs_each_batch, drop_repeated_events, rows_past_watermark
from plumbline.streaming.runtime import drain, stream_table, to_files
from plumbline.streaming.scoring import score_stream
from plumbline.workloads.adapters import LOG_SQL, current_part, prediction_log, stamp
from plumbline.workloads.drift import (
    METRICS_SQL,
    PERIOD_SQL,
    SHIFTED_PERIOD_SQL,
    daily,
    event_profile,
    shifted,
)
from plumbline.workloads.operations import job_dedupe  # noqa: F401
from plumbline.workloads.quality import CHECKED_SQL, EVENT_CONTRACT, event_payloads
from plumbline.workloads.registry import ORACLES, Tables, query

CFG = DriftConfig()


@query(
    "stream_scored_payloads",
    f"""WITH {CHECKED_SQL}, ok AS (
  SELECT event_id, malformed = false AND missing || unknown || excluded || invalid_types || invalid_values = '' AS good,
         (doc->>'$.k')::DOUBLE / 100 AS p FROM checked)
SELECT CASE WHEN NOT good THEN 'quarantine' WHEN p >= 0.5 THEN 'yes' ELSE 'no' END AS outcome, count(*) AS n FROM ok GROUP BY 1""",
)
def stream_scored_payloads(t: Tables) -> DataFrame:
    """Payloads validated and scored as a stream, with quarantine."""
    root = fresh_folder(t.spark)
    payloads = event_payloads(stream_table(t.spark, t.path("events")))
    scorer = lambda df: df.withColumn("probability", F.col("k") / 100.0)
    drain(score_stream(payloads, EVENT_CONTRACT, scorer, 0.5, root, f"{root}/checkpoint"))
    scored = t.spark.read.parquet(f"{root}/scored").select(F.col("decision").alias("outcome"))
    bad = t.spark.read.parquet(f"{root}/quarantine").select(F.lit("quarantine").alias("outcome"))
    return scored.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_drift_check",
    f"""{METRICS_SQL} SELECT feature, metric, round(value, 5) AS value, severity, drifted FROM metrics""",
)
def stream_drift_check(t: Tables) -> DataFrame:
    """The newest-200 check after the last micro-batch."""
    root = fresh_folder(t.spark)
    log = prediction_log(stream_table(t.spark, t.path("events")))
    drain(check_each_batch(log, event_profile(t), CFG, root, f"{root}/checkpoint"))
    rows = t.spark.read.parquet(f"{root}/report_metrics")
    newest = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == newest).select("feature", "metric", F.round("value", 5).alias("value"), "severity", "drifted")


# A day is final once the watermark (newest event less the delay) has passed its end.
FINAL_SQL = "day IN (SELECT day FROM days GROUP BY day HAVING max(CAST(day AS TIMESTAMP)) + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM cur))"


@query(
    "stream_window_drift",
    f"""{PERIOD_SQL} SELECT day, feature, metric, round(value, 5) AS value, severity, drifted FROM metrics JOIN facts USING (day) WHERE {FINAL_SQL}""",
)
def stream_window_drift(t: Tables) -> DataFrame:
    """Drift per event-time day, for the days the watermark has passed."""
    root = fresh_folder(t.spark)
    log = current_part(prediction_log(stream_table(t.spark, t.path("events"))))
    drain(check_windows(log, event_profile(t), CFG, root, f"{root}/checkpoint"))
    rows = t.spark.read.parquet(f"{root}/report_metrics")
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "feature", "metric", F.round("value", 5).alias("value"), "severity", "drifted"
    )


@query("stream_window_reports", f"""{PERIOD_SQL} SELECT day, f.window_size, severity FROM facts f JOIN overall USING (day) WHERE {FINAL_SQL}""")
def stream_window_reports(t: Tables) -> DataFrame:
    """Overall severity per event-time day."""
    root = fresh_folder(t.spark)
    log = current_part(prediction_log(stream_table(t.spark, t.path("events"))))
    drain(check_windows(log, event_profile(t), CFG, root, f"{root}/checkpoint"))
    rows = t.spark.read.parquet(f"{root}/reports")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "window_size", "severity")


@query("stream_severity_alerts", f"{PERIOD_SQL} SELECT day, severity, previous_severity FROM alerts")
def stream_severity_alerts(t: Tables) -> DataFrame:
    """Alerts of the daily report stream, with the previous severity kept as state."""
    return severity_alerts_of(t, daily(t)[0])


@query("stream_severity_alerts_shifted", f"{SHIFTED_PERIOD_SQL} SELECT day, severity, previous_severity FROM alerts")
def stream_severity_alerts_shifted(t: Tables) -> DataFrame:
    """The same over periods that were shifted, so that there are alerts."""
    return severity_alerts_of(t, shifted(t)[0])


def severity_alerts_of(t: Tables, reports: DataFrame) -> DataFrame:
    root = fresh_folder(t.spark)
    reports.select(
        F.lit(CFG.model_name).alias("model_name"), F.to_timestamp("day", "yyyy-MM-dd").alias("created_at"), "severity"
    ).write.parquet(f"{root}/in")
    alerts = severity_alerts(stream_table(t.spark, f"{root}/in"))
    drain(to_files(alerts, f"{root}/out", f"{root}/checkpoint"))
    rows = t.spark.read.schema(alerts.schema).parquet(f"{root}/out")
    return rows.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "severity", "previous_severity")


@query("stream_event_dedupe", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_event_dedupe(t: Tables) -> DataFrame:
    """Every event delivered twice, kept once."""
    root = fresh_folder(t.spark)
    once = stream_table(t.spark, t.path("events")).withColumn("created_at", F.col("ts").cast("timestamp"))
    twice = once.unionByName(stream_table(t.spark, t.path("events")).withColumn("created_at", F.col("ts").cast("timestamp")))
    drain(to_files(drop_repeated_events(twice).select("event_id", "event_type"), f"{root}/out", f"{root}/checkpoint"))
    return t.spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_late_rows",
    f"""WITH {LOG_SQL}, m AS (SELECT max(created_at) - INTERVAL 1 DAY AS w FROM cur)
SELECT (SELECT count(*) FROM log) AS arrived, (SELECT count(*) FROM cur) + (SELECT count(*) FROM ref, m WHERE created_at > w) AS kept,
(SELECT count(*) FROM ref, m WHERE created_at <= w) AS late""",
)
def stream_late_rows(t: Tables) -> DataFrame:
    """Events of the second half arrive first; what comes after the watermark is dropped and counted."""
    root = fresh_folder(t.spark)
    log = prediction_log(t.events).select("id", "created_at")
    # Two arrivals: the newer half of the log, then the older one.
    current_part(log).write.parquet(f"{root}/in/arrival=1")
    stream = stream_table(t.spark, f"{root}/in/arrival=1").withColumn("event_id", F.col("id"))
    drain(to_files(drop_repeated_events(stream).select("event_id"), f"{root}/out", f"{root}/checkpoint"))
    log.where(F.col("created_at") < F.lit("2024-01-16").cast("timestamp")).write.mode("append").parquet(f"{root}/in/arrival=1")
    again = stream_table(t.spark, f"{root}/in/arrival=1").withColumn("event_id", F.col("id"))
    done = drain(to_files(drop_repeated_events(again).select("event_id"), f"{root}/out", f"{root}/checkpoint"))
    kept = t.spark.read.parquet(f"{root}/out").agg(F.count(F.lit(1)).alias("kept"))
    return kept.select(
        log.agg(F.count(F.lit(1))).scalar().alias("arrived"), "kept", F.lit(rows_past_watermark(done)).cast("long").alias("late")
    )


@query("stream_job_dedupe_24h", ORACLES["job_dedupe_24h"])
def stream_job_dedupe(t: Tables) -> DataFrame:
    """The 24-hour job rule batch by batch, with the last accepted jobs carried along."""
    root = fresh_folder(t.spark)
    jobs = stream_table(t.spark, t.path("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    drain(accept_jobs_each_batch(jobs, root, f"{root}/checkpoint", "user_id", "ts", "event_id", 24))
    rows = t.spark.read.parquet(f"{root}/accepted")
    return rows.select("user_id", "event_id", stamp("ts").alias("ts"))
