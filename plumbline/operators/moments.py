"""Correlations of many columns from mergeable blocks of co-moments.

Each task turns its rows into a few matrix products: for every pair of columns the number of rows that have both, the means, the squared
deviations and the co-deviations over just these rows. Blocks merge pairwise whatever the order, so the plan has one aggregate however many
columns there are. A block is sent in rows, one for each column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics of a pair (i, j): rows with both, means of i and j, squared deviations of i and j, co-deviations.
STATISTICS = ("n", "mi", "mj", "qi", "qj", "c")
#: Blocks that one task merges at a time.
FAN_IN = 64
_SCHEMA = "i int, part long, stats binary"


def block(values: np.ndarray) -> np.ndarray:
    """Statistics (6, d, d) of rows (n, d); NaN is missing."""
    there = ~np.isnan(values)
    mask = there.astype(float)
    # Around a mean of these very rows, so that squares stay small.
    center = np.where(there.any(axis=0), np.nansum(np.where(there, values, 0), axis=0) / np.maximum(there.sum(axis=0), 1), 0)
    x = np.where(there, values - center, 0)
    n = mask.T @ mask
    si, sj = x.T @ mask, mask.T @ x
    some = np.maximum(n, 1)
    square = x * x
    qi, qj = square.T @ mask - si * si / some, mask.T @ square - sj * sj / some
    return np.stack([n, center[:, None] + si / some, center[None, :] + sj / some, np.maximum(qi, 0), np.maximum(qj, 0), x.T @ x - si * sj / some])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Statistics of two disjoint sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    di, dj = b[1] - a[1], b[2] - a[2]
    both = a[0] * b[0] / some
    share = b[0] / some
    return np.stack([n, a[1] + di * share, a[2] + dj * share, a[3] + b[3] + di * di * both, a[4] + b[4] + dj * dj * both, a[5] + b[5] + di * dj * both])


def co_moments(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(i, part, stats): one row per column, with its statistics against every column; see ``STATISTICS``."""
    d = len(values)
    wide = df.select(*[v.cast("double").alias(f"c{i}") for i, v in enumerate(values.values())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(STATISTICS), d, d))
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            total = merged(total, block(rows))
        made = [np.ascontiguousarray(total[:, i]).tobytes() for i in range(d)]
        yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "part": pa.array([0] * d, pa.int64()), "stats": pa.array(made, pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((len(STATISTICS), d))
        for raw in pdf["stats"]:
            total = merged(total, np.frombuffer(raw).reshape(len(STATISTICS), d))
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "part": 0, "stats": [total.tobytes()]})

    blocks = wide.mapInArrow(reduce, _SCHEMA).withColumn("part", F.spark_partition_id().cast("long"))
    # Two steps, so that no group holds a row of every task.
    some = blocks.groupBy("i", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, _SCHEMA)
    return some.groupBy("i").applyInPandas(add, _SCHEMA)


def correlations(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(left, right, correlation) for all ordered pairs; null where fewer than two rows have both or one of them doesn't vary."""
    names = list(values)

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, raw in zip(batch["i"], batch["stats"]):
                n, _, _, qi, qj, c = np.frombuffer(raw).reshape(len(STATISTICS), len(names))
                good = (n >= 2) & (qi > 0) & (qj > 0)
                r = np.where(good, c / np.sqrt(np.where(good, qi * qj, 1)), np.nan)
                yield pd.DataFrame({"left": names[i], "right": names, "correlation": pd.array(np.clip(r, -1, 1), "Float64")})

    out = co_moments(df, values).mapInPandas(table, "left string, right string, correlation double")
    return out.withColumn("correlation", F.nanvl("correlation", F.lit(None).cast("double")))
