from __future__ import annotations

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.chains import first_beyond, numbered, reachable


@pytest.mark.parametrize("keys, partitions", [(1, 8), (3, 8), (40, 3), (1, 1)])
def test_first_beyond(spark, keys, partitions):
    rng = np.random.default_rng(keys)
    points = sorted({(f"k{rng.integers(keys)}", int(t)) for t in rng.integers(0, 3000, 800)})
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["t"]): r["next"] for r in first_beyond(spark.createDataFrame(points, "k string, t long"), 50).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for k, t in points:
        own = [x for key, x in points if key == k]
        i = bisect.bisect_right(own, t + 50)
        want[k, t] = own[i] if i < len(own) else None
    assert got == want


def test_first_beyond_is_strict_and_takes_nothing(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 50), ("a", 51), ("b", 10)], "k string, t long")
    assert {(r["k"], r["t"]): r["next"] for r in first_beyond(rows, 50).collect()} == {("a", 0): 51, ("a", 50): None, ("a", 51): None, ("b", 10): None}
    assert first_beyond(rows.where("false"), 50).count() == 0


def test_reachable(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 7), (4, 5), (5, 7), (7, None), (9, 4)], "node int, next int")
    starts = spark.createDataFrame([(1,), (8,)], "node int")
    assert sorted(r[0] for r in reachable(links, starts).collect()) == [1, 2, 3, 7, 8]
    assert reachable(links, starts.where("false")).count() == 0


@pytest.mark.parametrize("keys", [1, 2, 7, 500])
def test_numbered(spark, keys):
    rng = np.random.default_rng(keys)
    rows = [(None if not k else f"m{k}", int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, keys, 900), rng.integers(0, 99, 900)))]
    df = spark.createDataFrame(rows, "`a key` string, t int, id long")
    got = {r["id"]: r["position"] for r in numbered(df, "a key", ("t", "id")).collect()}
    want, counts = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        counts[k] = want[i] = counts.get(k, 0) + 1
    assert got == want
    assert numbered(df.where(F.lit(False)), "a key", ("t",)).count() == 0
