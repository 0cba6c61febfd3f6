"""Profiles of growing tables from stored sketches: a day is read once, any range of days is merged from what was stored.

For each day and column a row keeps exact counts, least and greatest value, a KLL sketch of the values and an HLL sketch of the distinct
ones. Sketches merge in any order with the same error bound as one over all rows. Quantiles of a range are then approximate: the share of
rows below an answer lies within ``rank_error`` of the one asked for (with a probability of 99 %), and the number of distinct values within
``distinct_error``. The exact profile stays the default; this is for tables whose older days are not to be read again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.profile import numeric_columns

#: Size of a KLL sketch, and binary logarithm of the buckets of an HLL sketch.
K, LG_K = 2048, 14


def rank_error(k: int = K) -> float:
    """Greatest difference, as a share of the rows, between the rank of an answer and the rank asked for (99 % of the time)."""
    return 2.446 / k**0.9433


def distinct_error(lg_k: int = LG_K) -> float:
    """Greatest relative error of a distinct count (three standard errors)."""
    return 3 * 1.04 / math.sqrt(2**lg_k)


def daily_sketches(df: DataFrame, day: Column, numeric: list[str], text: list[str] = (), k: int = K, lg_k: int = LG_K) -> DataFrame:
    """(day, column, rows, nulls, low, high, values, distinct): one row per day and column, in one pass over ``df``.

    ``low``, ``high`` and ``values`` (the KLL sketch) are null for text columns.
    """
    numbers = numeric_columns(df, numeric)
    cells = [F.struct(F.lit(n).alias("column"), v.alias("v"), v.cast("string").alias("t")) for n, v in numbers.items()]
    cells += [F.struct(F.lit(n).alias("column"), F.lit(None).cast("double").alias("v"), col(n).cast("string").alias("t")) for n in text]
    long = df.select(day.alias("day"), F.inline(F.array(*cells)))
    return long.groupBy("day", "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("t").isNull()).alias("nulls"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.kll_sketch_agg_double("v", k).alias("values"),
        F.hll_sketch_agg("t", lg_k).alias("distinct"),
    )


def merged(sketches: DataFrame, days: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows of the wanted ``days`` put together: one row per column (and key), of the same form."""
    chosen = sketches if days is None else sketches.where(days)
    return chosen.groupBy(*[col(c) for c in keys], "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("values").alias("values"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def approximate_quantiles(merged_rows: DataFrame, fractions: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., column, fraction, value, rank_error) for numeric columns that have values."""
    some = merged_rows.where(F.col("low").isNotNull())
    asked = F.array(*[F.lit(float(f)) for f in fractions])
    read = F.kll_sketch_get_quantile_double("values", asked)
    pairs = F.explode(F.arrays_zip(asked.alias("fraction"), read.alias("value"))).alias("q")
    out = some.select(*[col(c) for c in keys], "column", pairs)
    return out.select(*[col(c) for c in keys], "column", "q.fraction", "q.value", F.lit(rank_error()).alias("rank_error"))


def approximate_overview(merged_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., column, rows, missing_count, missing_percent, unique_count): distinct values, a missing one included, are approximate."""
    unique = F.hll_sketch_estimate("distinct") + (F.col("nulls") > 0).cast("long")
    percent = F.round(F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows") * 100), 2)
    return merged_rows.select(*[col(c) for c in keys], "column", "rows", F.col("nulls").alias("missing_count"), percent.alias("missing_percent"), unique.alias("unique_count"))
