from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import SplitConfig
from plumbline.operators import eda, sampling
from plumbline.operators.sampling import (
    first_rows,
    full_shift,
    partial_shift,
    sample_slices,
    seeded_sample,
    split_summary,
    stratified_folds,
    stratified_split,
    train_test_split,
)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, int(i % 5 == 0), float(i), "a") for i in range(100)], "id bigint, y int, v double, job string")


def test_split_keeps_class_counts(rows):
    split = stratified_split(rows, "y", "id")
    got = {r["split"]: (r["rows"], r["positives"]) for r in split_summary(split, "y").collect()}
    assert got == {"train": (60, 12), "validation": (20, 4), "test": (20, 4)}
    again = {r["id"]: r["split"] for r in stratified_split(rows.repartition(7), "y", "id").collect()}
    assert again == {r["id"]: r["split"] for r in split.collect()}
    other = {r["id"]: r["split"] for r in stratified_split(rows, "y", "id", SplitConfig(seed=7)).collect()}
    assert other != again
    with pytest.raises(ValueError):
        stratified_split(rows, "y", "id", SplitConfig(0.5, 0.2, 0.2))


def test_two_way_split_and_folds(rows):
    split = train_test_split(rows, "y", "id", test=0.30)
    assert {r["split"]: r["rows"] for r in split_summary(split, "y").collect()} == {"train": 70, "test": 30}
    folds = stratified_folds(rows, "y", "id", 3).groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in folds if r["y"] == 1) == [6, 7, 7]
    assert sorted(r["count"] for r in folds if r["y"] == 0) == [26, 27, 27]


@pytest.mark.parametrize("classes, per_class", [(32, 2), (33, 2), (50, 20), (40, 1)])
def test_many_classes(spark, classes, per_class):
    """Exact totals and shares within one row of every class, whatever the number of classes."""
    n = classes * per_class
    df = spark.createDataFrame([(i, i % classes) for i in range(n)], "id bigint, y int")
    split = stratified_split(df, "y", "id").groupBy("split").count().collect()
    train = int(n * 0.6)
    test = -(-(n - train) // 2)
    assert {r["split"]: r["count"] for r in split} == {"train": train, "validation": n - train - test, "test": test}
    each = stratified_split(df, "y", "id").where("split = 'train'").groupBy("y").count().collect()
    assert all(abs(r["count"] - per_class * 0.6) < 1 for r in each)
    two = {r["split"]: r["count"] for r in train_test_split(df, "y", "id", test=0.3).groupBy("split").count().collect()}
    assert two["test"] == -(-n * 3 // 10)


def test_missing_labels_are_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "null") for i in range(40)], "id bigint, y string")
    got = {(r["y"], r["split"]): r["count"] for r in stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert got == {(y, s): c for y in (None, "null") for s, c in (("train", 12), ("validation", 4), ("test", 4))}


def test_tiny_classes(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id bigint, y int")
    split = stratified_split(df, "y", "id").collect()
    assert len(split) == 3 and all(r["split"] in ("train", "validation", "test") for r in split)
    assert stratified_folds(df, "y", "id", 5).where("fold is null").count() == 0


def test_samples(rows):
    sample = [r["id"] for r in seeded_sample(rows, "id", 30).collect()]
    assert len(set(sample)) == 30
    assert sorted(sample) == sorted(r["id"] for r in seeded_sample(rows.repartition(5), "id", 30).collect())
    assert seeded_sample(rows, "id", 500).count() == 100
    a, b = sample_slices(rows, "id", [40, 60])
    ids = [r["id"] for r in a.collect()] + [r["id"] for r in b.collect()]
    assert sorted(ids) == list(range(100))
    assert [r["id"] for r in first_rows(rows, F.col("id"), 3, 10).orderBy("id").collect()] == [10, 11, 12]


@pytest.mark.parametrize("strength, n, delta", [("Mild", 35, 0.8), ("Medium", 65, 1.6), ("Strong", 100, 3.0), ("?", 65, 1.6)])
def test_partial_shift(rows, strength, n, delta):
    out = partial_shift(rows, F.col("id"), "v", "job", "student", strength).orderBy("id").collect()
    assert sum(r["job"] == "student" for r in out) == n
    assert out[0]["v"] == pytest.approx(delta)
    assert all(r["v"] == pytest.approx(r["id"] + (delta if r["id"] < n else 0)) for r in out)


def test_full_shift(rows):
    out = full_shift(rows, {"v": 3.0, "absent": 1.0}, {"job": "student"}).collect()
    assert all(r["v"] == r["id"] + 3.0 and r["job"] == "student" for r in out)


def test_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(9)
    data = [(None if a == 0 else int(a), None if b == 0 else str(b)) for a, b in rng.integers(0, 6, (200, 2))]
    df = spark.createDataFrame(data, "a int, b string")
    got = eda.duplicate_summary(df).first()
    assert got["duplicate_count"] == int(pd.DataFrame(data).duplicated().sum())
    assert eda.duplicate_summary(df.limit(0)).first()["duplicate_percent"] == 0.0
    unique = spark.createDataFrame([(i, str(i)) for i in range(10)], "a int, b string")
    assert eda.duplicate_summary(unique).first()["duplicate_count"] == 0
    assert eda.quality_summary(df).first()["missing_cells"] == sum(v is None for r in data for v in r)


def test_duplicates_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(eda, "MAX_BROADCAST_HASHES", 0)
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert eda.duplicate_summary(df).first()["duplicate_count"] == 1


def test_bands_match_qcut(spark):
    n = 137
    df = spark.createDataFrame([(i // 20, i, float(i)) for i in range(n)], "k bigint, t bigint, v double")
    got = {r["band"]: r["rows"] for r in eda.order_bands(df, F.col("k"), F.col("t"), {"v": F.col("v")}).collect()}
    bands = pd.qcut(np.arange(n), q=10, labels=range(1, 11))
    assert got == pd.Series(bands).value_counts().to_dict()


def test_overview_counts_null_once(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "a int, b string")
    rows = {r["column"]: r for r in eda.column_overview(df).collect()}
    assert (rows["b"]["missing_count"], rows["b"]["unique_count"], rows["b"]["missing_percent"]) == (2, 2, 66.67)
    assert rows["a"]["unique_count"] == 2


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    row = eda.histogram(df, ["v"], 10).collect()
    assert len(row) == 1 and row[0]["n"] == 4


@pytest.mark.parametrize("n", [1, 2, 149, 150, 151, 999, 1000, 2000])
def test_samples_of_repeated_keys_are_exact(spark, n):
    """Keys repeat, and so do whole rows: a third of the table is one row."""
    rng = np.random.default_rng(3)
    rows = [(7, "x", None)] * 333 + [(int(k), "y", float(v)) for k, v in zip(rng.integers(0, 6, 400), rng.integers(0, 3, 400))]
    rows += [(int(k), "z", i * 1.0) for i, k in enumerate(rng.integers(0, 3, 267))]
    df = spark.createDataFrame(rows, "k int, s string, v double").repartition(5)
    sample = [tuple(r) for r in sampling.seeded_sample(df, "k", n).collect()]
    assert len(sample) == min(n, 1000)
    assert not Counter(sample) - Counter(rows)
    assert Counter(sample) == Counter(tuple(r) for r in sampling.seeded_sample(df.repartition(3), "k", n).collect())


def test_slices_of_repeated_keys_are_disjoint(spark):
    rows = [(1, "same")] * 500 + [(i % 4, f"r{i % 30}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(4)
    sizes = [10, 200, 0, 250, 100, 400]
    slices = [Counter(tuple(r) for r in part.collect()) for part in sampling.sample_slices(df, "k", sizes)]
    assert [sum(c.values()) for c in slices] == [10, 200, 0, 250, 100, 240]
    assert sum(slices, Counter()) == Counter(rows)
    # The first slices together are the sample of that size.
    assert slices[0] + slices[1] == Counter(tuple(r) for r in sampling.seeded_sample(df, "k", 210).collect())


def test_columns_of_any_name_survive_a_split(spark):
    names = ["_class", "_h", "_row", "_part", "_bucket", "_limits", "_offset", "_rank", "_cut", "n", "size", "train", "test"]
    df = spark.range(60).select((F.col("id") % 3).alias("y"), "id", *[F.concat(F.lit(f"{c}-"), F.col("id")).alias(c) for c in names])
    want = {r["id"]: r for r in df.collect()}
    for made in (sampling.stratified_split(df, "y", "id"), sampling.stratified_folds(df, "y", "id", 3), sampling.train_test_split(df, "y", "id")):
        got = made.collect()
        assert len(got) == 60 and all(r[c] == want[r["id"]][c] for r in got for c in df.columns)
    # A column of the name to be made is replaced.
    again = sampling.stratified_split(df.withColumn("split", F.lit("old")), "y", "id")
    assert again.columns.count("split") == 1 and again.where("split = 'old'").count() == 0
