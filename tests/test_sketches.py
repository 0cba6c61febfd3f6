from __future__ import annotations

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.sketches import (
    approximate_overview,
    approximate_quantiles,
    daily_sketches,
    distinct_error,
    merged,
    rank_error,
)
from plumbline.sources.tables import append


@pytest.fixture(scope="module")
def table(spark):
    value = F.when(F.col("id") % 50 == 0, None).otherwise(F.exp(F.randn(5)) * (1 + F.col("id") % 10))
    return spark.range(120_000).select((F.col("id") % 12).cast("int").alias("day"), value.alias("a.b"), (F.col("id") % 7000).alias("k"), F.concat(F.lit("t"), F.col("id") % 300).alias("t"))


def test_merged_days_keep_the_bound(spark, table, tmp_path):
    """Quantiles of any range of stored days lie within the bound of the exact ranks, though no old day is read again."""
    path = str(tmp_path / "sketches")
    for days in (range(0, 5), range(5, 6), range(6, 12)):
        append(daily_sketches(table.where(F.col("day").isin(*days)), F.col("day"), ["a.b", "k"], ["t"]), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 36
    fractions = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    for first, last in ((0, 11), (3, 3), (2, 9)):
        some = table.where(F.col("day").between(first, last)).toPandas()
        rows = merged(stored, F.col("day").between(first, last)).persist()
        for r in approximate_quantiles(rows, fractions).collect():
            values = np.sort(some[r["column"]].dropna().to_numpy(float))
            low, high = bisect.bisect_left(values, r["value"]) / len(values), bisect.bisect_right(values, r["value"]) / len(values)
            assert low - rank_error() <= r["fraction"] <= high + rank_error()
        facts = {r["column"]: r for r in approximate_overview(rows).collect()}
        assert facts["a.b"]["missing_count"] == int(some["a.b"].isna().sum()) and facts["t"]["rows"] == len(some)
        for c in ("a.b", "k", "t"):
            exact = some[c].nunique(dropna=False)
            assert abs(facts[c]["unique_count"] - exact) <= max(1, distinct_error() * exact)
        plan = rows._jdf.queryExecution().toString()
        assert "Range" not in plan
        rows.unpersist()


def test_sketches_of_nothing(spark, table):
    none = daily_sketches(table.where("false"), F.col("day"), ["k"], ["t"])
    assert none.count() == 0 and approximate_quantiles(merged(none), [0.5]).count() == 0
    nulls = daily_sketches(table.select("day", F.lit(None).cast("double").alias("k"), "t"), F.col("day"), ["k"], ["t"])
    assert approximate_quantiles(merged(nulls), [0.5]).count() == 0
    assert {r["column"]: r["unique_count"] for r in approximate_overview(merged(nulls)).collect()}["k"] == 1
