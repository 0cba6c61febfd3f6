"""Duplicate, late and repeated events on streams."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.functions.columns import col, quoted
from plumbline.streaming.runtime import to_files, use_rocksdb


def drop_repeated_events(events: DataFrame, key: str = "event_id", time: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Each event id once; ids are remembered for at least ``delay`` of event time."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def rows_past_watermark(query: StreamingQuery) -> int:
    """Rows a finished query dropped because they came after the watermark."""
    return sum(
        int(op["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


class JobRule(StatefulProcessor):
    """Accepted jobs of a key, kept until no row can come that they still bear on."""

    def __init__(self, key: str, time: str, tie_break: str, gap_ms: int) -> None:
        self.names, self.gap = (key, time, tie_break), gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        _, time, tie_break = self.names
        known = sorted(t for (t,) in self.accepted.get()) if self.accepted.exists() else []
        # Time and id of each row; a batch's rows of one key stay in one task.
        parts = [pd.DataFrame({"t": to_micros(chunk[time]), "id": chunk[tie_break]}) for chunk in rows]
        new = pd.concat(parts).sort_values(["t", "id"], kind="stable").drop_duplicates("t")
        times, kept, i = new["t"].to_numpy(), [], 0
        while i < len(times):
            t = int(times[i])
            at = bisect.bisect_right(known, t + self.gap)
            if at and known[at - 1] >= t - self.gap:  # refused up to the gap behind the last one that bears on it
                i = int(times.searchsorted(known[at - 1] + self.gap, side="right")) if known[at - 1] <= t else i + 1
                continue
            bisect.insort(known, t)
            kept.append(i)
            i += 1
        if kept:
            self.accepted.put([(t,) for t in known])
            for i in kept:
                self.handle.registerTimer((int(times[i]) + self.gap) // 1000 + 1)
            out = new.iloc[kept]
            made = {self.names[0]: [key[0]] * len(out), time: pd.to_datetime(out["t"].to_numpy(), unit="us"), tie_break: out["id"].to_numpy()}
            yield pd.DataFrame(made)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        still = [(t,) for (t,) in self.accepted.get() if t + self.gap >= mark] if self.accepted.exists() else []
        if still:
            self.accepted.put(still)
        else:
            self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def to_micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def accepted_jobs(
    jobs: DataFrame, key: str = "job_id", time: str = "created_at", tie_break: str = "id", hours: int = 24, delay: str = "1 day"
) -> DataFrame:
    """A stream of the jobs accepted when a key is refused until ``hours`` after its last accepted job.

    The accepted jobs of a key are its state; an event-time timer drops each one
    once the watermark says that no row can come within its ``hours``. Rows may
    come in any order up to the watermark: a job is refused if an accepted one
    lies within ``hours`` before it or, for a job that comes late, after it.
    Rows older than the watermark are dropped. In time order this is the batch
    rule. Jobs without a key are one key.
    """
    use_rocksdb(jobs.sparkSession)
    rows = jobs.select(col(key).cast("string").alias(key), col(time), col(tie_break)).withWatermark(time, delay)
    rule = JobRule(key, time, tie_break, hours * 3_600_000)
    return rows.groupBy(key).transformWithStateInPandas(rule, ddl(rows), "append", "eventtime")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)


def accept_jobs_each_batch(
    jobs: DataFrame,
    root: str,
    checkpoint: str,
    key: str = "job_id",
    time: str = "created_at",
    tie_break: str = "id",
    hours: int = 24,
    delay: str = "1 day",
) -> DataStreamWriter:
    """The stream of ``accepted_jobs``, appended to ``root/accepted``."""
    return to_files(accepted_jobs(jobs, key, time, tie_break, hours, delay), f"{root}/accepted", checkpoint)
