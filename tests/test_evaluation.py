from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from plumbline.operators.evaluation import (
    classification_metrics,
    find_threshold,
    recall_thresholds,
    roc_auc,
    select_best,
)


def scored(spark, labels, scores):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores)], "y int, s double")


EXAMPLE = ([1, 1, 1, 1, 0, 0], [0.95, 0.80, 0.60, 0.20, 0.70, 0.10])


def brute_threshold(y, s, floor):
    y, s = np.array(y), np.array(s)
    for t in sorted({0.0, 1.0, *s}, reverse=True):
        if (y[s >= t].sum() / y.sum()) >= floor:
            return t
    return None


def test_threshold_example(spark):
    got = find_threshold(scored(spark, *EXAMPLE), "y", "s", 0.75)
    assert got == pytest.approx({"threshold": 0.60, "precision": 0.75, "recall": 0.75, "f1": 0.75})


@pytest.mark.parametrize("floor", [0.0, 0.01, 0.3, 0.75, 1.0])
@pytest.mark.parametrize("digits", [1, 6])
def test_threshold_against_brute_force(spark, floor, digits):
    rng = np.random.default_rng(11)
    s = np.round(rng.random(800), digits)
    y = (rng.random(800) < s * 0.5).astype(int)
    row = recall_thresholds(scored(spark, y, s), "y", "s", floor, ranges=16).first()
    t = brute_threshold(y, s, floor)
    assert row["threshold"] == t
    hit = s >= t
    assert row["recall"] == pytest.approx(y[hit].sum() / y.sum())
    assert row["precision"] == pytest.approx(y[hit].mean() if hit.any() else 0.0)


def test_threshold_errors(spark):
    with pytest.raises(ValueError, match="no_positive_examples"):
        find_threshold(scored(spark, [0, 0], [0.2, 0.9]), "y", "s")
    with pytest.raises(ValueError, match="invalid min_recall"):
        find_threshold(scored(spark, *EXAMPLE), "y", "s", 1.5)


def test_auc_against_mllib_and_ties(spark):
    rng = np.random.default_rng(12)
    s = np.where(rng.random(1500) < 0.35, 0.5, np.round(rng.random(1500), 4))
    y = (rng.random(1500) < s).astype(int)
    df = scored(spark, y, s)
    exact = roc_auc(df, "y", "s", ranges=64).first()["auc"]
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert exact == pytest.approx(evaluator.evaluate(df), abs=1e-12)
    assert roc_auc(scored(spark, [1, 1], [0.1, 0.2]), "y", "s").first()["auc"] is None


def test_metrics_at_threshold(spark):
    row = classification_metrics(scored(spark, *EXAMPLE), "y", "s", 0.6).first().asDict()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 3)
    assert row["accuracy"] == pytest.approx(4 / 6)
    empty = classification_metrics(scored(spark, *EXAMPLE), "y", "s", 2.0).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)


def test_published_confusion_matrix(spark):
    """Counts and ratios published for the bank model."""
    groups = [(0, 0.0, 5238), (0, 1.0, 2072), (1, 0.0, 239), (1, 1.0, 689)]
    df = spark.createDataFrame(groups, "y int, s double, n int").selectExpr("y", "s", "explode(sequence(1, n)) AS i")
    row = classification_metrics(df, "y", "s", 0.3897478991)
    got = row.first()
    assert got["f1"] == pytest.approx(0.3735430, abs=1e-7)
    assert got["recall"] == pytest.approx(0.7424569, abs=1e-7)
    assert got["accuracy"] == pytest.approx(0.7194707, abs=1e-7)


def test_selection(spark):
    schema = "name string, threshold double, cv_auc double, validation_f1 double"
    first = spark.createDataFrame([("random_forest", 0.31, 0.93, 0.5), ("logistic_regression", 0.45, 0.91, 0.5)], schema)
    assert select_best(first).first()["name"] == "logistic_regression"
    tie = spark.createDataFrame([("random_forest", 0.4, 0.9, 0.5), ("hist_gradient_boosting", 0.4, 0.9, 0.5), ("x", None, 1.0, 1.0)], schema)
    assert select_best(tie).first()["name"] == "hist_gradient_boosting"
    assert select_best(tie.where("threshold is null")).first() is None
