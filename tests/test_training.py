from __future__ import annotations

import threading
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plumbline.operators.sampling import stratified_folds, stratified_split, train_test_split
from plumbline.plans.training import (
    TrainingConfig,
    balanced,
    candidate_table,
    category_modes,
    estimator,
    flat_test_metrics,
    grid,
    mean_fold_auc,
    mean_fold_aucs,
    positive_predictions,
    prepare,
    replay,
    retrain,
    score,
    score_with_artifacts,
    train,
    with_probability,
)

SMALL = TrainingConfig(folds=2, families=("logistic_regression", "hist_gradient_boosting"), logistic_iterations=30, boosting_rounds=3, boosting_depth=2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    out = []
    for i in range(400):
        rate, job = float(rng.normal()), ["admin.", "student", "services", None][int(rng.integers(0, 4))]
        y = int(rng.random() < 1 / (1 + np.exp(-(2 * rate + (job == "student") - 1))))
        out.append((i, rate if i % 17 else None, int(rng.integers(18, 80)), job, y))
    return spark.createDataFrame(out, "id bigint, `emp.var.rate` double, age bigint, job string, y int").persist()


def test_grids():
    assert len(grid("logistic_regression", SMALL)) == 3
    assert len(grid("random_forest", SMALL)) == 5 and grid("random_forest", SMALL) == grid("random_forest", SMALL)
    assert len(grid("hist_gradient_boosting", SMALL)) == 8
    with pytest.raises(ValueError):
        grid("svm", SMALL)


def test_balanced_weights(spark):
    df = balanced(spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int"))
    assert {(r["label"], r["class_weight"]) for r in df.collect()} == {(1, 2.0), (0, 4 / 6)}


def test_folds_of_candidates_overlap(spark, rows):
    """Models are fitted side by side, with the numbers of one after another, and rank in one job."""
    ready, numeric, categorical = prepare(rows.drop("id"), "y")
    train = balanced(stratified_folds(prepare(rows, "y")[0], "label", "id", 3)).persist()
    fits = [estimator("logistic_regression", numeric, categorical, 400, SMALL, C=c).fit for c in (0.01, 1.0)]
    spans, lock = [], threading.Lock()

    def timed(fit):
        def run(df):
            begin = time.time()
            model = fit(df)
            with lock:
                spans.append((begin, time.time()))
            return model

        return run

    together = mean_fold_aucs(train, [timed(f) for f in fits], 3, parallelism=3)
    assert any(a < d and c < b for i, (a, b) in enumerate(spans) for c, d in spans[:i])
    spans.clear()
    alone = mean_fold_aucs(train, [timed(f) for f in fits], 3, parallelism=1)
    assert not any(a < d and c < b for i, (a, b) in enumerate(spans) for c, d in spans[:i])
    assert together == pytest.approx(alone, abs=1e-12)
    assert together == pytest.approx([mean_fold_auc(train, f, 3) for f in fits], abs=1e-12)
    train.unpersist()


def test_unseen_category_and_forest(spark, rows):
    ready, numeric, categorical = prepare(rows, "y")
    assert "emp_var_rate" in numeric and "job" in categorical
    assert category_modes(ready, categorical)["job"] in ("admin.", "student", "services")
    numeric.remove("id")
    cfg = TrainingConfig(trees=5)
    model = estimator("random_forest", numeric, categorical, 400, cfg, depth=4).fit(balanced(ready))
    odd = ready.limit(3).withColumn("job", F.lit("never seen"))
    scored = score(model, odd, 0.5).collect()
    assert all(0 <= r["probability"] <= 1 and r["decision"] == ("yes" if r["prediction"] else "no") for r in scored)
    assert positive_predictions(score(model, ready, 0.0)).first()["positives"] == 400


def test_train_end_to_end(spark, rows, tmp_path):
    result = train(rows, "y", "id", SMALL, str(tmp_path / "art"))
    assert len(result.candidates) == 3 and result.candidates[-1].group == "tuned"
    assert all(c.validation["recall"] >= 0.75 for c in result.candidates)
    best = max(result.candidates, key=lambda c: c.threshold["threshold"])
    assert result.best.threshold["threshold"] == best.threshold["threshold"]
    assert result.test_metrics["auc"] > 0.70
    assert set(flat_test_metrics(result)) == {"test_auc", "test_f1", "test_precision", "test_recall", "test_accuracy", "operating_threshold"}
    assert candidate_table(spark, result.candidates).count() == 3
    runs = spark.read.parquet(str(tmp_path / "art" / "runs")).collect()
    assert len(runs) == 3 and runs[0]["params"]["stratified"] == "true" and "validation_auc" in runs[0]["metrics"]
    model = PipelineModel.load(str(tmp_path / "art" / "model"))
    line = replay(model, rows, "y", "id").first()
    assert line["n_test_rows"] == 120 and line["summary"].startswith(f"AUC={line['auc']:.4f}, F1={line['f1']:.4f}")
    fresh = {r["id"]: r["probability"] for r in with_probability(result.best.model, prepare(rows, "y")[0]).collect()}
    loaded = {r["id"]: r["probability"] for r in with_probability(model, prepare(rows, "y")[0]).collect()}
    assert loaded == fresh and None not in loaded.values()
    # A missing category counts as the most frequent one of the training part, here and in the stored artifacts.
    part = stratified_split(prepare(rows, "y")[0], "label", "id", SMALL.split).where("split = 'train'")
    filled = rows.fillna({"job": category_modes(part, ["job"])["job"]})
    assert {r["id"]: r["probability"] for r in with_probability(model, prepare(filled, "y")[0]).collect()} == fresh
    stored = score_with_artifacts(spark, str(tmp_path / "art"), rows.drop("y").withColumn("more", F.lit(1))).collect()
    assert {r["id"]: r["probability"] for r in stored} == fresh
    assert all(r["prediction"] == int(r["probability"] >= result.best.threshold["threshold"]) for r in stored)
    assert score_with_artifacts(spark, str(tmp_path / "art"), rows.drop("job")).where("probability is null").count() == 0


def test_retrain_numbers_the_version(spark, rows, tmp_path):
    versions = spark.createDataFrame([("m", "3"), ("m", "x"), ("other", "9")], "model_name string, version string")
    cfg = TrainingConfig(folds=2, families=("logistic_regression",), logistic_iterations=10)
    _, row = retrain(rows, "y", "id", versions, "m", cfg, str(tmp_path))
    got = row.first()
    assert got["version"] == "4" and float(got["tags"]["test_auc"]) > 0.7
    split = train_test_split(prepare(rows, "y")[0], "label", "id", 0.30)
    assert split.where("split = 'test'").count() == 120
