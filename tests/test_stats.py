from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.stat import Statistics
from pyspark.sql import functions as F

from plumbline.functions.stats import adjusted_skewness, chi2_sf, erfc
from plumbline.functions.text import metrics_block, truncated, version_number


def tail(spark, pairs):
    df = spark.createDataFrame(pairs, "x double, df int")
    return [r[0] for r in df.select(chi2_sf(F.col("x"), F.col("df"))).collect()]


def test_chi2_known_values(spark):
    got = tail(spark, [(7.814727903, 3), (10.0, 2), (2.6666667, 2), (0.0, 4), (5.0, 0), (999998.0, 2)])
    assert got[0] == pytest.approx(0.05, abs=1e-9)
    assert got[1] == pytest.approx(0.006737946999, abs=1e-11)
    assert got[2] == pytest.approx(0.2635971, abs=1e-7)
    assert got[3] == 1.0
    assert got[4] is None
    assert got[5] == 0.0


def test_chi2_critical_points(spark):
    # Upper 5 % points of chi-square for df 1..12.
    points = [3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313, 16.918978, 18.307038, 19.675138, 21.026070]
    got = tail(spark, [(x, i + 1) for i, x in enumerate(points)])
    assert got == pytest.approx([0.05] * 12, abs=1e-7)


def poisson_tail(half, terms):
    """Upper chi-square tail for 2 * terms degrees of freedom: a sum of Poisson terms, in 40 digits."""
    with localcontext() as context:
        context.prec = 40
        x, k = Decimal(half), Decimal(terms - 1)
        b = k + 1  # ln k! = ln Gamma(k + 1), the argument raised by 30
        log = Decimal(0)
        for i in range(30):
            log -= (b + i).ln()
        b += 30
        log += (b - Decimal("0.5")) * b.ln() - b + (2 * Decimal("3.14159265358979323846264338327950288419716939937511")).ln() / 2
        for i, (p, q) in enumerate(((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188))):
            log += Decimal(p) / Decimal(q) / b ** (2 * i + 1)
        term, total = (k * x.ln() - x - log).exp(), Decimal(0)
        while k >= 0 and (term > total * Decimal("1e-25") or k > x):
            total += term
            term, k = term * k / x, k - 1
        return float(total)


@pytest.mark.parametrize("df", [2, 4, 10, 200, 20_000, 199_998, 200_002, 2_000_000, 10_000_000])
def test_chi2_of_any_df(spark, df):
    """One rule on both sides of every size: within 1e-10 of exact sums, below, at and above the mean."""
    points = [max(df + z * (2 * df) ** 0.5, 0.5) for z in (-6, -2, -0.5, 0, 0.5, 1, 2, 6)]
    got = tail(spark, [(x, df) for x in points])
    assert got == pytest.approx([poisson_tail(x / 2, df // 2) for x in points], abs=1e-10)


def test_chi2_of_odd_df(spark):
    # Q(1/2, x) = erfc(sqrt x), and Q(a + 1, x) = Q(a, x) + x^a e^-x / Gamma(a + 1).
    for df in (1, 3, 7, 21):
        for x in (0.01, 0.4, 1.0, 3.0, 12.0, 40.0):
            want, a = math.erfc((x / 2) ** 0.5), 0.5
            while a < df / 2:
                want += math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1))
                a += 1
            assert tail(spark, [(x, df)])[0] == pytest.approx(want, abs=1e-12)


def test_chi2_agrees_with_mllib(spark):
    observed = OldVectors.dense([20, 20, 10])
    expected = OldVectors.dense([25, 15, 10])
    test = Statistics.chiSqTest(observed, expected)
    assert tail(spark, [(float(test.statistic), int(test.degreesOfFreedom))])[0] == pytest.approx(test.pValue, abs=1e-9)
    assert Vectors.dense([1.0]).size == 1


def test_erfc(spark):
    z = [0.0, 0.1, 0.7, 1.5, 1.999, 2.0, 3.5, 8.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(erfc(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in z], rel=1e-10)


def test_skewness_is_bias_adjusted(spark):
    values = [1.0, 2.0, 2.0, 3.0, 9.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(adjusted_skewness(F.col("v"))).first()[0]
    assert got == pytest.approx(pd.Series(values).skew())
    assert spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(adjusted_skewness(F.col("v"))).first()[0] is None
    assert not np.isnan(got)


def test_text(spark):
    df = spark.createDataFrame([("v12", "abcdefgh"), (None, None), ("x1", "abc")], "v string, s string")
    rows = df.select(version_number(F.col("v")).alias("n"), truncated(F.col("s"), 5).alias("t")).collect()
    assert [r["n"] for r in rows] == [12, 0, 0]
    assert [r["t"] for r in rows] == ["abcde...", "—", "abc"]
    metric = "array<struct<feature:string,metric:string,value:double,threshold:double>>"
    block = spark.createDataFrame([([("age", "psi", 1.5, 0.2)],), ([],)], f"m {metric}").select(metrics_block(F.col("m"))).collect()
    assert block[0][0] == "  - age (psi): 1.5000 (threshold 0.2000)"
    assert block[1][0] == "  (none)"
