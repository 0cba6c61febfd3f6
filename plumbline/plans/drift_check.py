"""A whole drift check: window, metrics, report, alert."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import DriftConfig
from plumbline.functions.columns import col
from plumbline.operators.drift import (
    drift_metrics,
    event_payload,
    last_window,
    overall_severity,
    raises_alert,
    top_metrics,
    top_metrics_array,
    window_facts,
    with_previous_severity,
)
from plumbline.operators.profile import ReferenceProfile
from plumbline.sources.tables import DAY, append, read_or_none

REPORTS = "reports"
METRICS = "report_metrics"
ALERTS = "alerts"


@dataclass
class DriftCheck:
    """``report`` is one row; ``metrics`` and ``alert`` are empty when there is too little data."""

    severity: str
    report: DataFrame
    metrics: DataFrame | None
    alert: DataFrame | None


def previous_severity(reports: DataFrame | None) -> str | None:
    """Severity of the newest stored report."""
    if reports is None:
        return None
    newest = reports.agg(F.max_by("severity", F.struct("created_at", "report_id")).alias("s")).first()
    return newest["s"]


def newest_days(log: DataFrame, size: int, day: str = DAY) -> DataFrame:
    """The rows of the newest day partitions that hold ``size`` rows together; all rows while they are fewer.

    Days are known from the folders of the log. They are gone through newest
    first, one, two, four, ... at a time, and only counted (from the files'
    footers) until enough rows are held; what is older is never read.
    """
    names = {unquote(part[len(day) + 1 :]) for f in log.inputFiles() for part in f.split("/") if part.startswith(f"{day}=")}
    days = sorted((d for d in names if d != "__HIVE_DEFAULT_PARTITION__"), reverse=True)
    held, at, step = 0, 0, 1
    while at < len(days) and held < size:
        held += log.where(col(day).isin(days[at : at + step])).count()
        at, step = at + step, step * 2
    return log.where(col(day) >= F.lit(days[min(at, len(days)) - 1])) if held >= size else log


def newest_rows(log: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` rows as a table of their own.

    A window is a few hundred rows. Taken out once, all parts of a check see the
    same rows, no cache stays behind, and the next check reads the log anew. Of
    a log stored by day only the newest days are read.
    """
    window = last_window(newest_days(log, size) if DAY in log.columns and not log.isStreaming else log, size)
    return log.sparkSession.createDataFrame(window.collect(), window.schema)


def check_window(
    window: DataFrame,
    profile: ReferenceProfile,
    cfg: DriftConfig,
    previous: str | None,
    as_of: Column,
) -> DriftCheck:
    """Check one window of scored rows (a few hundred of them, already held in memory)."""
    facts = window_facts(window).select(
        F.lit(cfg.model_name).alias("model_name"),
        "model_version",
        "window_start",
        "window_end",
        "window_size",
        F.lit(previous).cast("string").alias("previous_severity"),
        as_of.alias("created_at"),
    )
    if window.count() < cfg.min_window_size:
        report = facts.withColumn("severity", F.lit("insufficient_data"))
        return DriftCheck("insufficient_data", report, None, None)
    metrics = drift_metrics(window, profile, cfg)
    severity = overall_severity(metrics).first()["severity"]
    report_id = F.sha2(F.concat_ws("|", "model_name", "window_end", "created_at"), 256).substr(1, 32)
    report = facts.withColumn("severity", F.lit(severity)).withColumn("report_id", report_id)
    metrics_of_report = metrics.select(report.select("report_id").scalar().alias("report_id"), "*")
    top = top_metrics_array(top_metrics(metrics)).scalar()
    event_id = F.concat(F.lit("drift_"), F.col("report_id"))
    alert = (
        report.where(raises_alert(F.col("severity"), F.col("previous_severity")))
        .withColumn("top_metrics", top)
        .select(
            "report_id",
            event_id.alias("event_id"),
            "severity",
            F.lit("pending").alias("status"),
            event_payload(event_id, F.col("created_at"), F.col("previous_severity"), F.col("severity")).alias("payload"),
            "created_at",
        )
    )
    return DriftCheck(severity, report, metrics_of_report, alert)


def store_check(check: DriftCheck, root: str) -> None:
    """Append report, metrics and alert; a check without enough data leaves nothing behind."""
    if check.metrics is None:
        return
    append(check.metrics, f"{root}/{METRICS}")
    append(check.alert, f"{root}/{ALERTS}")
    append(check.report, f"{root}/{REPORTS}")


def check_drift(
    spark: SparkSession,
    log: DataFrame,
    profile: ReferenceProfile,
    root: str,
    cfg: DriftConfig,
    as_of: Column,
) -> DriftCheck:
    """Check the newest predictions of the log and store the outcome."""
    window = newest_rows(log, cfg.window_size)
    previous = previous_severity(read_or_none(spark, f"{root}/{REPORTS}"))
    check = check_window(window, profile, cfg, previous, as_of)
    store_check(check, root)
    return check


def period_reports(
    log: DataFrame,
    profile: ReferenceProfile,
    cfg: DriftConfig,
    period: str,
    scope: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(reports, metrics) for every period of the log in one scan each.

    The size guard applies per period; too small periods give no report.
    ``scope`` adds keys such as the model name.
    """
    keys = (*scope, period)
    facts = window_facts(log, keys).where(F.col("window_size") >= cfg.min_window_size)
    metrics = drift_metrics(log, profile, cfg, keys)
    reports = facts.join(overall_severity(metrics, keys), list(keys))
    return with_previous_severity(reports, scope, period), metrics


def period_alerts(reports: DataFrame, metrics: DataFrame, period: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Alert rows with their top metrics for period reports."""
    keys = (*scope, period)
    raised = reports.where(raises_alert(F.col("severity"), F.col("previous_severity")))
    top = top_metrics_array(top_metrics(metrics, keys), keys)
    return raised.join(top, list(keys))


def alerts_with_reports(alerts: DataFrame, reports: DataFrame) -> DataFrame:
    """Alerts joined to the report they belong to."""
    kept = reports.select("report_id", "model_name", "model_version", "window_start", "window_end", "window_size", "previous_severity")
    return alerts.join(kept, "report_id")


def recent_reports(reports: DataFrame, limit: int = 25) -> DataFrame:
    """Newest reports first, in compact form."""
    names = ("report_id", "model_name", "model_version", "window_size", "severity", "previous_severity", "created_at")
    newest = reports.orderBy(F.col("created_at").desc(), F.col("report_id").desc()).limit(limit)
    return newest.select(*[col(n) for n in names])


def result_tables(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numeric by PSI descending, categorical) for display."""
    numeric = metrics.where(F.col("metric") == "psi").select("feature", F.col("value").alias("psi"), "severity")
    categorical = metrics.where(F.col("metric") == "chi2").select("feature", F.col("pvalue").alias("p_value"), "drifted")
    return numeric.orderBy(F.col("psi").desc(), "feature"), categorical
