"""One promotion round over all open requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import MIN_RECALL
from plumbline.operators.registry import (
    audit_rows,
    current_production,
    first_requests,
    gate,
    judged_alone,
    metric_columns,
    mirror_rows,
    missing_artifacts,
    production_in_order,
    promotions,
    version_metadata,
)
from plumbline.sources.folders import ensure_checkpoint_folder


def promote(
    requests: DataFrame,
    versions: DataFrame,
    aliases: DataFrame,
    runs: DataFrame,
    artifacts: DataFrame,
    mirror: DataFrame | None = None,
    audit: DataFrame | None = None,
    min_recall: float = MIN_RECALL,
    order: tuple[str, ...] = ("created_at",),
) -> dict[str, DataFrame]:
    """Judge every new request and return the rows to append to each table.

    Requests are judged in order; each is compared with the version live at its
    turn, which the accepted request before it may have put there. What does not
    depend on that (checklist, version, artifacts, recall floor) is judged first,
    so that only requests that may pass are gone through in order.
    """
    production = current_production(versions, aliases, mirror)
    metadata = version_metadata(versions, runs)
    metrics, lacking = metric_columns(metadata), missing_artifacts(versions, artifacts)
    asked = first_requests(requests, audit, order)
    ensure_checkpoint_folder(requests.sparkSession)
    alone = judged_alone(asked, versions, metrics, lacking, min_recall).checkpoint()
    turns = production_in_order(alone.where(F.col("error_message").isNull()), production, metrics, order)
    judged = gate(alone, turns, metrics)
    return {
        "judged": judged,
        "audit": audit_rows(judged),
        "lifecycle": promotions(judged),
        "mirror": mirror_rows(judged, metadata),
    }
