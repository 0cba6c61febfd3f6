"""Display and message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(value: Column, width: int) -> Column:
    """Text cut at ``width`` with an ellipsis; a dash for null."""
    text = value.cast("string")
    return F.coalesce(
        F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width), F.lit("..."))),
        F.lit("—"),
    )


def version_number(version: Column) -> Column:
    """'v12' -> 12; 0 when missing or not a number."""
    return F.coalesce(F.regexp_replace(version, "^[vV]+", "").try_cast("int"), F.lit(0))


def metrics_block(metrics: Column) -> Column:
    """One line per metric of an array<struct<feature,metric,value,threshold>>."""
    lines = F.transform(
        metrics,
        lambda m: F.format_string(
            "  - %s (%s): %.4f (threshold %.4f)", m["feature"], m["metric"], m["value"], m["threshold"]
        ),
    )
    return F.when(F.size(metrics) > 0, F.array_join(lines, "\n")).otherwise(F.lit("  (none)"))
