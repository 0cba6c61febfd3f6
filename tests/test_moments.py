from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.eda import correlation_matrix, token_summary
from plumbline.operators.moments import block, merged


def test_blocks_merge_in_any_order():
    rng = np.random.default_rng(4)
    values = rng.normal(1e6, 3, (300, 5))
    values[rng.random(values.shape) < 0.2] = np.nan
    whole, parts = block(values), [block(v) for v in np.split(values, [1, 40, 41, 200])]
    for order in ((0, 1, 2, 3, 4), (4, 2, 0, 3, 1)):
        total = np.zeros_like(whole)
        for i in order:
            total = merged(total, parts[i])
        assert np.allclose(total, whole, rtol=1e-9, atol=1e-6)


def test_pairs_have_their_own_rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(500, 4)) + [0, 1e7, -5, 0], columns=["a", "b", "c", "d.e"])
    pdf["c"] += pdf["a"]
    pdf = pdf.mask(rng.random(pdf.shape) < 0.3)
    pdf["one"], pdf["none"] = 7.0, np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    got = {(r["left"], r["right"]): r["correlation"] for r in correlation_matrix(df).collect()}
    want = pdf.corr()
    assert len(got) == 36
    for (x, y), r in got.items():
        assert (r is None and math.isnan(want.loc[x, y])) or r == pytest.approx(want.loc[x, y], abs=1e-9)
    assert {r[0] for r in correlation_matrix(df.where(F.lit(False))).select("correlation").collect()} <= {None}


def test_many_columns(spark):
    """500 columns: 250,000 pairs out of one aggregate."""
    n = 500
    df = spark.range(400).select(*[(F.hash(F.col("id") % (i + 3), F.lit(i)) % 1000).alias(f"c{i}") for i in range(n)])
    matrix = correlation_matrix(df)
    plan = matrix._jdf.queryExecution().toString()
    assert "corr(" not in plan
    rows = matrix.toPandas()
    want = np.corrcoef(df.toPandas().to_numpy(float).T)
    got = rows.pivot(index="left", columns="right", values="correlation").loc[[f"c{i}" for i in range(n)], [f"c{i}" for i in range(n)]].to_numpy(float)
    assert np.allclose(got, want, atol=1e-9)


def test_token_summary_of_long_texts(spark):
    long = "x" * 100
    rows = [("unknown", long), ("a", long + "1"), (None, long), ("unknown", None), ("", "unknown")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = {tuple(r) for r in token_summary(df).collect()}
    assert got == {("s", 2, 40.0, 4), ("t", 1, 20.0, 4)}
    assert token_summary(df, long).collect()[0]["token_count"] == 2
