from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranks
from plumbline.operators.ranks import exact_quantiles, values_at_ranks

FRACTIONS = [k / 10 for k in range(11)]


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in columns.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def check(spark, **columns):
    df = frame(spark, **columns)
    found = exact_quantiles(df, {n: F.col(n) for n in columns}, FRACTIONS)
    for name, values in columns.items():
        known = [v for v in values if v is not None]
        expected = np.quantile(known, FRACTIONS)
        assert [found[name].values[i] for i in range(11)] == pytest.approx(list(expected), rel=0, abs=0)
        assert found[name].n == len(known)


def test_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 3000
    check(
        spark,
        smooth=rng.normal(size=n),
        hot=np.where(rng.random(n) < 0.4, 7.0, rng.random(n) * 100),
        few=rng.integers(0, 3, n).astype(float),
        constant=np.full(n, 2.5),
        tail=rng.pareto(1.0, n),
        gaps=[None if i % 3 == 0 else v for i, v in enumerate(rng.random(n))],
    )


def test_exact_with_a_poor_sketch(spark, monkeypatch):
    """Exactness must not hang on the sketch: a tiny one only reads more rows."""
    monkeypatch.setattr(ranks, "SKETCH_K", 8)
    monkeypatch.setattr(ranks, "PAD", 0.0)
    rng = np.random.default_rng(4)
    check(spark, a=rng.normal(size=2000), b=np.round(rng.random(2000), 2))


def test_wide_intervals_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MAX_PINPOINT_ROWS", 20)
    monkeypatch.setattr(ranks, "PAD", 0.05)
    rng = np.random.default_rng(6)
    n = 3000
    check(spark, a=rng.normal(size=n), hot=np.where(rng.random(n) < 0.4, 7.0, rng.random(n) * 10), few=rng.integers(0, 40, n))


@pytest.mark.parametrize("rows_in_task", [2_000_000, 30])
def test_ranks_of_whole_numbers(spark, monkeypatch, rows_in_task):
    monkeypatch.setattr(ranks, "MAX_PINPOINT_ROWS", rows_in_task)
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(-(2**62), 2**62, 2000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    wanted = [0, 1, 777, 1999]
    found = values_at_ranks(df, {"v": F.col("v")}, [0.0, 0.4, 1.0], lambda *_: wanted, dtype="bigint")["v"]
    ordered = sorted(values)
    assert found.values == {r: ordered[r] for r in wanted}
    assert found.below == {r: ordered.index(ordered[r]) for r in wanted}


def test_empty_and_single(spark):
    empty = exact_quantiles(spark.createDataFrame([], "v double"), {"v": F.col("v")}, FRACTIONS)["v"]
    assert (empty.n, empty.values) == (0, {})
    single = exact_quantiles(frame(spark, v=[4.0]), {"v": F.col("v")}, FRACTIONS)["v"]
    assert set(single.values.values()) == {4.0}
