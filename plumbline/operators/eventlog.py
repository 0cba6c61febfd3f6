"""Investigation states, job results and their read models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.chains import first_beyond, reachable
from plumbline.sources.folders import ensure_checkpoint_folder

# A key with at most this many rows is handled inside one task.
MAX_ROWS_IN_TASK = 1_000_000


def latest_state(log: DataFrame, id_: str = "id", key: str = "key", payload: str = "payload", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(id, key, payload): last write wins per state key, which is what a shallow merge does."""
    newest = F.max_by(col(payload), F.struct(*[col(o) for o in order]))
    return log.groupBy(col(id_).alias("id"), col(key).alias("key")).agg(newest.alias("payload"))


def merged_state(log: DataFrame, keys: list[str], **names) -> DataFrame:
    """(id, state map) over a known list of state keys."""
    state = latest_state(log, **names).where(F.col("key").isin(*keys))
    # One entry per listed key.
    return state.groupBy("id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "payload")))).alias("state")
    )


def states_by_id(states: DataFrame, ids: DataFrame) -> DataFrame:
    """The states of the listed ids; unknown ids give no row."""
    return states.join(ids.select("id"), "id", "left_semi")


def drift_line(event: Column) -> Column:
    """'model v3: green -> red (200 predictions)'."""
    return F.format_string(
        "%s v%d: %s -> %s (%d predictions)",
        event["model_name"],
        event["model_version"],
        event["previous_severity"],
        event["current_severity"],
        event["window_size"],
    )


def summaries(investigations: DataFrame) -> DataFrame:
    """One line per investigation, newest first.

    Input: id, current_node, drift_event struct, recommended_action, comms_summary,
    created_at, updated_at.
    """
    return investigations.select(
        F.col("id").alias("investigation_id"),
        "current_node",
        drift_line(F.col("drift_event")).alias("drift_event_summary"),
        "recommended_action",
        "comms_summary",
        "created_at",
        "updated_at",
    ).orderBy(F.col("created_at").desc(), F.col("investigation_id").desc())


def node_counts(investigations: DataFrame) -> DataFrame:
    node = F.col("current_node")
    return investigations.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(node == "awaiting_hil").alias("awaiting_hil"),
        F.count_if(node == "done").alias("done"),
    )


def review_inbox(investigations: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Pending reviews; the action is the first of ``sources`` that is set."""
    action = F.upper(F.coalesce(*[F.nullif(col(s), F.lit("")) for s in sources], F.lit("unknown")))
    return investigations.where(F.col("current_node") == "awaiting_hil").withColumn("action", action)


def next_step(node: Column, triage_action: Column, triaged: Column | None = None) -> Column:
    """Where an investigation goes next."""
    done = triage_action.isNotNull() if triaged is None else triaged
    return (
        F.when(node == "stale", "comms")
        .when(node.isin("done", "awaiting_hil"), "end")
        .when(node == "comms", "comms")
        .when(~done, "triage")
        .when(triage_action == "no_action", "comms")
        .when(triage_action.isin("replay", "retrain", "rollback"), "action")
        .otherwise("end")
    )


def open_investigations(events: DataFrame, as_of: Column) -> DataFrame:
    """One fresh state row per accepted drift event; the id is derived from the event id."""
    return events.select(
        F.sha2(F.col("event_id"), 256).substr(1, 32).alias("id"),
        F.struct(*[col(c) for c in events.columns]).alias("drift_event"),
        F.lit("triage").alias("current_node"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def surfaced_node(node: Column, work_pending: Column) -> Column:
    """A paused investigation shows as awaiting review."""
    return F.when(work_pending & ~node.isin("awaiting_hil", "done", "stale"), F.lit("awaiting_hil")).otherwise(node)


def dead_letters(results: DataFrame) -> DataFrame:
    """Failed jobs, newest first and undated ones last; rows that cannot be read are skipped.

    Input: job_id, function, success, finish_time (text or timestamp), job_try, result.
    """
    readable = F.col("job_id").isNotNull() & F.col("success").isNotNull()
    return (
        results.where(readable & ~F.col("success"))
        .select(
            "job_id",
            F.coalesce("function", F.lit("unknown")).alias("function"),
            F.split("job_id", ":").getItem(0).alias("investigation_id"),
            F.col("result").alias("last_error"),
            F.col("finish_time").try_cast("timestamp").alias("failed_at"),
            F.coalesce(F.col("job_try").try_cast("int"), F.lit(0)).alias("attempts"),
        )
        .orderBy(F.col("failed_at").desc_nulls_last(), F.col("job_id").desc())
    )


def cursor(log: DataFrame, emitted_at: Column) -> Column:
    """Newest emitted_at already seen, as a scalar subquery."""
    return log.agg(F.max(emitted_at).alias("cursor")).scalar()


def events_since(events: DataFrame, since: Column, emitted_at: str = "emitted_at") -> DataFrame:
    """Events newer than the cursor; with no cursor every event is new."""
    return events.where(since.isNull() | (col(emitted_at) > since))


def accept_jobs(
    jobs: DataFrame, key: str, time: str, tie_break: str, hours: int = 24, max_rows_in_task: int = MAX_ROWS_IN_TASK
) -> DataFrame:
    """Jobs accepted when a key is refused until ``hours`` after its last accepted job.

    The rule looks at the last *accepted* job, so it is a chain from job to job
    within a key. Keys of ordinary size are followed inside one task each. For
    the others each job points to the first one beyond its ``hours``; pointers
    are doubled until they lead nowhere, and the accepted jobs are those that
    can be reached from the first. Rounds grow with the logarithm of the
    accepted jobs, and no task ever holds such a key.
    """
    ensure_checkpoint_folder(jobs.sparkSession)
    gap = hours * 3_600_000_000
    rows = jobs.select(
        # Jobs without a key are one key of their own; the prefix keeps them apart and lets joins find them.
        F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit("none")).alias("k"), F.unix_micros(col(time).cast("timestamp")).alias("t"), col(tie_break).alias("id")
    )
    # Of jobs at the very same instant only the first can be accepted.
    instants = rows.groupBy("k", "t").agg(F.min("id").alias("id")).checkpoint()
    sizes = instants.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # At most rows / max_rows_in_task keys are large, so their list is small
    # enough to broadcast, which also keeps their rows from being moved by key.
    large = sizes.where(F.col("n") > max_rows_in_task).select("k")
    id_type = dict(rows.dtypes)["id"]

    def chain(groups: pd.DataFrame) -> pd.DataFrame:
        ordered = groups.sort_values("t", kind="stable")
        times, keep, i = ordered["t"].to_numpy(), [], 0
        while i < len(times):
            keep.append(i)
            i = int(times.searchsorted(times[i] + gap, side="right"))
        return ordered.iloc[keep]

    has_large = not large.isEmpty()
    ordinary = instants.join(F.broadcast(large), "k", "left_anti") if has_large else instants
    kept = ordinary.groupBy("k").applyInPandas(chain, schema=f"k string, t bigint, id {id_type}")
    if has_large:
        hot = instants.join(F.broadcast(large), "k", "left_semi")
        kept = kept.unionByName(_accept_large(hot, gap))
    name = F.when(F.col("k") != "none", F.expr("substring(k, 2)"))
    return kept.select(F.col("id").alias(tie_break), name.alias(key), F.timestamp_micros("t").alias(time))


def _accept_large(instants: DataFrame, gap: int) -> DataFrame:
    node = F.struct("k", "t").alias("node")
    links = first_beyond(instants.select("k", "t"), gap)
    links = links.select(node, F.when(F.col("next").isNotNull(), F.struct("k", F.col("next").alias("t"))).alias("next"))
    starts = instants.groupBy("k").agg(F.min("t").alias("t")).select(node)
    accepted = reachable(links, starts).select("node.k", "node.t")
    return instants.join(accepted, ["k", "t"])
