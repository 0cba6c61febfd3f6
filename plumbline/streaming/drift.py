"""Drift checks on streams of scored records."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.config import ALERTING, DriftConfig
from plumbline.functions.columns import col
from plumbline.operators.drift import (
    CATEGORICAL,
    OUTPUT,
    categorical_chi2_of,
    categorical_labels,
    overall_severity,
    psi_labels,
    psi_of,
)
from plumbline.operators.profile import Binned, ReferenceProfile, feature_of, long_labels
from plumbline.plans.drift_check import ALERTS, METRICS, REPORTS, check_window, newest_rows, previous_severity
from plumbline.streaming.runtime import for_each_batch, read_batch, write_batch

WINDOW, LAST = "window", "last"


def check_each_batch(
    scored: DataFrame, profile: ReferenceProfile, cfg: DriftConfig, root: str, checkpoint: str
) -> DataStreamWriter:
    """After every micro-batch, check the newest ``cfg.window_size`` records of the whole stream.

    Carried from batch to batch are only the window itself (a few hundred rows in
    ``root/window``) and the last severity (one row in ``root/last``). A batch
    reads them from the folder of the batch before it and looks at no other, so
    a check costs what the batch costs, not what the log or the number of
    batches costs. The newest records are those of the latest ``created_at``,
    whatever the order in which batches arrive: records older than the whole
    window change nothing, and the check of such a batch repeats the last one.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_batch(spark, f"{root}/{WINDOW}", batch_id - 1)
        rows = batch if before is None else batch.unionByName(before)
        window = newest_rows(rows, cfg.window_size)
        as_of = F.lit(window.agg(F.max("created_at")).first()[0])
        last = read_batch(spark, f"{root}/{LAST}", batch_id - 1)
        check = check_window(window, profile, cfg, previous_severity(last), as_of)
        write_batch(window, f"{root}/{WINDOW}", batch_id)
        if check.metrics is not None:
            write_batch(check.metrics, f"{root}/{METRICS}", batch_id)
            write_batch(check.alert, f"{root}/{ALERTS}", batch_id)
            write_batch(check.report, f"{root}/{REPORTS}", batch_id)
            last = read_batch(spark, f"{root}/{REPORTS}", batch_id)
        if last is not None:
            write_batch(last, f"{root}/{LAST}", batch_id)

    return for_each_batch(scored, handle, checkpoint)


def window_label_counts(
    scored: DataFrame,
    labels: dict[str, Column | Binned],
    time: str,
    delay: str,
    length: str,
    slide: str | None = None,
) -> DataFrame:
    """(window_start, window_end, feature, label, n) per event-time window, emitted once final."""
    long = long_labels(scored.withWatermark(time, delay), labels, (time,))
    counted = long.groupBy(F.window(col(time), length, slide), "series", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        feature_of(labels).alias("feature"),
        "label",
        "n",
    )


def _categories(counts: DataFrame) -> DataFrame:
    own = counts.where(F.col("feature").startswith(CATEGORICAL))
    return own.withColumn("feature", F.expr(f"substring(feature, {len(CATEGORICAL) + 1})"))


def check_windows(
    scored: DataFrame,
    profile: ReferenceProfile,
    cfg: DriftConfig,
    root: str,
    checkpoint: str,
    time: str = "created_at",
    delay: str = "1 hour",
    length: str = "1 day",
    slide: str | None = None,
) -> DataStreamWriter:
    """Drift per tumbling or sliding event-time window.

    This is a time-based result; it differs from the newest-N check by design. A
    window is judged once, when the watermark has passed it, and only if it holds
    ``cfg.min_window_size`` records. Output: ``root/report_metrics`` and ``root/reports``.
    """
    labels = {
        **psi_labels(scored, profile),
        **{CATEGORICAL + n: v for n, v in categorical_labels(scored, profile).items()},
    }
    counts = window_label_counts(scored, labels, time, delay, length, slide)
    keys = ("window_start",)

    def handle(batch: DataFrame, batch_id: int) -> None:
        final = batch.persist()
        predictions = final.where(F.col("feature").startswith(OUTPUT))
        sizes = predictions.groupBy("window_start", "window_end").agg(F.sum("n").alias("window_size"))
        sizes = sizes.where(F.col("window_size") >= cfg.min_window_size)
        metrics = psi_of(final.where(~F.col("feature").startswith(CATEGORICAL)), profile, cfg, keys)
        if profile.categories is not None:
            metrics = metrics.unionByName(categorical_chi2_of(_categories(final), profile, cfg, keys))
        metrics = metrics.join(sizes.select("window_start"), "window_start", "left_semi").persist()
        write_batch(metrics, f"{root}/{METRICS}", batch_id)
        write_batch(sizes.join(overall_severity(metrics, keys), "window_start"), f"{root}/{REPORTS}", batch_id)
        metrics.unpersist()
        final.unpersist()

    return for_each_batch(counts, handle, checkpoint)


ALERT_COLUMNS = "model_name string, created_at timestamp, severity string, previous_severity string"


def severity_alerts(reports: DataFrame) -> DataFrame:
    """Alerts of a report stream (model_name, created_at, severity), one per change into an alerting level.

    The previous severity of each model is kept as state. Reports are few per
    model, so a model's reports of one batch fit in a task.
    """

    def transitions(
        key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        rows = pd.concat(list(chunks)).sort_values("created_at", kind="stable")
        out = []
        for at, severity in zip(rows["created_at"], rows["severity"]):
            if severity == "insufficient_data":
                continue
            if severity in ALERTING and severity != previous:
                out.append((key[0], at, severity, previous))
            previous = severity
        if previous is not None:
            state.update((previous,))
        yield pd.DataFrame(out, columns=["model_name", "created_at", "severity", "previous_severity"])

    return (
        reports.select("model_name", "created_at", "severity")
        .groupBy("model_name")
        .applyInPandasWithState(
            transitions, ALERT_COLUMNS, "previous string", "append", GroupStateTimeout.NoTimeout
        )
    )
