"""Training, tuning, selection, scoring and replay with MLlib."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from random import Random

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from plumbline.config import MIN_RECALL, SplitConfig
from plumbline.functions.columns import col, flat_name, local_table, with_flat_names
from plumbline.operators.evaluation import (
    classification_metrics,
    find_threshold,
    roc_auc,
    select_best,
)
from plumbline.operators.profile import split_by_type
from plumbline.operators.sampling import stratified_folds, stratified_split, train_test_split

WEIGHT = "class_weight"
FAMILIES = ("logistic_regression", "random_forest", "hist_gradient_boosting")
# Models of folds and candidates that are fitted at a time.
PARALLELISM = 4


@dataclass(frozen=True)
class TrainingConfig:
    """Model sizes; the defaults are those of a production run."""

    split: SplitConfig = SplitConfig()
    folds: int = 5
    min_recall: float = MIN_RECALL
    families: tuple[str, ...] = FAMILIES
    logistic_iterations: int = 1000
    trees: int = 200
    min_leaf: int = 5
    boosting_rounds: int = 100
    boosting_depth: int = 5
    random_draws: int = 5


@dataclass
class Candidate:
    name: str
    params: dict
    model: PipelineModel
    cv_auc: float
    threshold: dict = field(default_factory=dict)
    validation: dict = field(default_factory=dict)
    group: str = "baseline"


# Tuning grids per family.
GRIDS = {
    "logistic_regression": {"C": (0.1, 1.0, 3.0)},
    "random_forest": {"trees": (150, 250, 350), "depth": (None, 8, 16), "min_leaf": (3, 5, 10)},
    "hist_gradient_boosting": {"step": (0.03, 0.06), "leaves": (15, 31), "rounds": (100, 200)},
}
# Deepest tree MLlib grows; stands for "no limit".
MAX_TREE_DEPTH = 30


def grid(name: str, cfg: TrainingConfig) -> list[dict]:
    """Parameter settings to try; the forest draws some of its grid at random."""
    if name not in GRIDS:
        raise ValueError(f"unsupported model for tuning: {name}")
    names = list(GRIDS[name])
    settings = [dict(zip(names, values)) for values in itertools.product(*GRIDS[name].values())]
    if name == "random_forest":
        return Random(cfg.split.seed).sample(settings, min(cfg.random_draws, len(settings)))
    return settings


class ModeImputer(Estimator):
    """Fits to a stage that writes each category column, missing values replaced by the most frequent one, as ``<name>__known``.

    What it fits to is a plain ``SQLTransformer``, so the fill values are saved
    and loaded with the model and every fold has its own.
    """

    def __init__(self, columns: list[str]) -> None:
        super().__init__()
        self.columns = columns

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        modes = category_modes(dataset, self.columns)
        known = [f"coalesce(CAST(`{n}` AS STRING), {_quoted(modes.get(n) or '')}) AS `{n}__known`" for n in self.columns]
        return SQLTransformer(statement=f"SELECT *, {', '.join(known)} FROM __THIS__")


def _quoted(text: str) -> str:
    inner = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{inner}'"


def preprocessing(numeric: list[str], categorical: list[str], scale: bool) -> list:
    """Median-impute (and optionally standardise) numbers; mode-impute and one-hot encode categories.

    A category not seen in training is encoded as all zeros.
    """
    stages, inputs = [], []
    if numeric:
        filled = [f"{n}__filled" for n in numeric]
        stages += [
            Imputer(strategy="median", inputCols=numeric, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="numbers"),
        ]
        if scale:
            stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
        inputs.append("scaled" if scale else "numbers")
    if categorical:
        index = [f"{n}__index" for n in categorical]
        onehot = [f"{n}__onehot" for n in categorical]
        stages += [
            ModeImputer(categorical),
            StringIndexer(inputCols=[f"{n}__known" for n in categorical], outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True, handleInvalid="error"),
        ]
        inputs += onehot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def estimator(name: str, numeric: list[str], categorical: list[str], rows: int, cfg: TrainingConfig, **params) -> Pipeline:
    """Preprocessing plus classifier of one family.

    C follows the usual meaning (inverse of the penalty on the summed loss), so
    the penalty on the mean loss is 1 / (C n).
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    seed = cfg.split.seed
    if name == "logistic_regression":
        model = LogisticRegression(
            maxIter=cfg.logistic_iterations,
            regParam=1.0 / (params.get("C", 1.0) * max(rows, 1)),
            standardization=False,
            weightCol=WEIGHT,
            **common,
        )
    elif name == "random_forest":
        model = RandomForestClassifier(
            numTrees=params.get("trees", cfg.trees),
            maxDepth=params.get("depth") or MAX_TREE_DEPTH,
            minInstancesPerNode=params.get("min_leaf", cfg.min_leaf),
            weightCol=WEIGHT,
            seed=seed,
            **common,
        )
    elif name == "hist_gradient_boosting":
        leaves = params.get("leaves")
        model = GBTClassifier(
            maxIter=params.get("rounds", cfg.boosting_rounds),
            maxDepth=cfg.boosting_depth if leaves is None else max(1, (leaves + 1).bit_length() - 1),
            stepSize=params.get("step", 0.1),
            seed=seed,
            **common,
        )
    else:
        raise ValueError(f"unknown model family: {name}")
    return Pipeline(stages=[*preprocessing(numeric, categorical, name == "logistic_regression"), model])


def category_modes(df: DataFrame, categorical: list[str]) -> dict[str, str]:
    """Most frequent value of each categorical column (smallest on a tie)."""
    if not categorical:
        return {}
    names = {f"m{i}": n for i, n in enumerate(categorical)}
    long = df.select(*[col(n).cast("string").alias(m) for m, n in names.items()]).unpivot([], list(names), "series", "value")
    counts = long.where("value IS NOT NULL").groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"))
    # Counts and the choice are combined before each shuffle; one row per column remains.
    best = counts.groupBy("series").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")).collect()
    return {n: None for n in categorical} | {names[r["series"]]: r["value"] for r in best}


def prepare(df: DataFrame, target: str) -> tuple[DataFrame, list[str], list[str]]:
    """Flat column names, double features, an integer ``label``."""
    flat, _ = with_flat_names(df)
    target = flat_name(target)
    numeric, categorical = split_by_type(flat, (target,))
    out = flat.withColumns({n: col(n).cast("double") for n in numeric})
    if target in flat.columns:
        out = out.withColumn("label", col(target).cast("int"))
    return out, numeric, categorical


def balanced(df: DataFrame) -> DataFrame:
    """Class weights n / (2 n_class)."""
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, size in counts.items():
        weight = F.when(F.col("label") == label, F.lit(n / (len(counts) * size))).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


def with_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``probability`` of the positive class."""
    scored = model.transform(df.drop("probability", "prediction"))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(
        *[col(c) for c in df.columns if c not in ("probability", "prediction")], "probability"
    )


def score(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    """Add probability, prediction (probability >= threshold) and the yes / no label."""
    hit = F.col("probability") >= threshold
    return with_probability(model, df).withColumns(
        {
            "prediction": hit.cast("int"),
            "threshold": F.lit(threshold),
            "decision": F.when(hit, "yes").otherwise("no"),
        }
    )


def positive_predictions(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") == 1).alias("positives"))


def held_out(train: DataFrame, fits: list, folds: int, parallelism: int = PARALLELISM) -> DataFrame:
    """(candidate, fold, label, probability): every row scored for every candidate by a model that has not seen its fold.

    ``fits`` has a fitting function per candidate. Models of all candidates and
    folds are fitted side by side, ``parallelism`` at a time, so that their
    small jobs overlap; the result is one plan over all of them.
    """
    jobs = [(i, k) for i in range(len(fits)) for k in range(folds)]

    def run(job: tuple[int, int]) -> DataFrame:
        i, k = job
        model = fits[i](train.where(F.col("fold") != k))
        held = with_probability(model, train.where(F.col("fold") == k))
        return held.select(F.lit(i).alias("candidate"), "fold", "label", "probability")

    pool = ThreadPool(max(1, min(parallelism, len(jobs))))
    try:
        parts = pool.map(inheritable_thread_target(train.sparkSession)(run), jobs)
    finally:
        pool.close()
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(train: DataFrame, fit, folds: int) -> DataFrame:
    """(label, probability) of every row, scored by a model that has not seen its fold."""
    return held_out(train, [fit], folds).select("label", "probability")


def cross_validated_auc(train: DataFrame, fit, folds: int) -> float:
    return roc_auc(out_of_fold(train, fit, folds), "label", "probability").first()["auc"]


def mean_fold_aucs(train: DataFrame, fits: list, folds: int, parallelism: int = PARALLELISM) -> list[float]:
    """Mean of the per-fold AUCs of each candidate, the score a grid search ranks by; one job for all of them."""
    by_fold = roc_auc(held_out(train, fits, folds, parallelism), "label", "probability", ("candidate", "fold"))
    means = {r["candidate"]: r["auc"] for r in by_fold.groupBy("candidate").agg(F.avg("auc").alias("auc")).collect()}
    return [means.get(i) for i in range(len(fits))]


def mean_fold_auc(train: DataFrame, fit, folds: int) -> float:
    return mean_fold_aucs(train, [fit], folds)[0]


def evaluate(model: PipelineModel, df: DataFrame, threshold: float) -> dict:
    """AUC, precision, recall, F1, accuracy and confusion counts on a table."""
    scored = with_probability(model, df).select("label", "probability")
    at = classification_metrics(scored, "label", "probability", threshold).first().asDict()
    return {"auc": roc_auc(scored, "label", "probability").first()["auc"], **at}


def _candidate(name, params, train, validation, numeric, categorical, rows, cfg, group, cv_auc=None) -> Candidate:
    est = estimator(name, numeric, categorical, rows, cfg, **params)
    if cv_auc is None:
        cv_auc = cross_validated_auc(train, est.fit, cfg.folds)
    model = est.fit(train)
    scored = with_probability(model, validation).select("label", "probability").persist()
    found = find_threshold(scored, "label", "probability", cfg.min_recall)
    auc = roc_auc(scored, "label", "probability").first()["auc"]
    scored.unpersist()
    validation_metrics = {"auc": auc, **{k: found[k] for k in ("f1", "precision", "recall")}}
    return Candidate(name, params, model, cv_auc, found, validation_metrics, group)


def tune(best: Candidate, train, validation, numeric, categorical, rows, cfg: TrainingConfig) -> Candidate:
    """Grid search over the selected family only, ranked by mean fold AUC."""
    tried = list(grid(best.name, cfg))
    fits = [estimator(best.name, numeric, categorical, rows, cfg, **p).fit for p in tried]
    aucs = mean_fold_aucs(train, fits, cfg.folds)
    first = max(range(len(tried)), key=lambda i: (aucs[i], -i))
    auc, params = aucs[first], tried[first]
    return _candidate(best.name, params, train, validation, numeric, categorical, rows, cfg, "tuned", auc)


def candidate_table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    rows = [
        (i, c.name, c.group, c.threshold.get("threshold"), c.cv_auc, c.validation.get("f1"))
        for i, c in enumerate(candidates)
    ]
    return local_table(
        spark, rows, "position int, name string, run_group string, threshold double, cv_auc double, validation_f1 double"
    )


def pick(spark: SparkSession, candidates: list[Candidate]) -> Candidate:
    row = select_best(candidate_table(spark, candidates)).first()
    if row is None:
        raise ValueError("no_model_met_min_recall")
    return candidates[row["position"]]


def run_records(spark: SparkSession, candidates: list[Candidate], cfg: TrainingConfig) -> DataFrame:
    """One run-log row per candidate: params and metrics as maps."""
    rows = []
    for c in candidates:
        params = {
            "model_class": c.name,
            "hyperparameters": json.dumps(c.params, sort_keys=True),
            "random_state": str(cfg.split.seed),
            "stratified": "true",
            "train_size": str(cfg.split.train),
            "validation_size": str(cfg.split.validation),
            "test_size": str(cfg.split.test),
            "numeric_imputation": "median",
            "scaling": str(c.name == "logistic_regression").lower(),
            "min_recall": str(cfg.min_recall),
        }
        metrics = {
            "cv_auc": c.cv_auc,
            **{f"validation_{k}": v for k, v in c.validation.items()},
            "operating_threshold": c.threshold["threshold"],
        }
        rows.append((f"{c.group}_{c.name}", c.group, list(params.items()), list(metrics.items())))
    schema = "run_name string, run_group string, params map<string,string>, metrics map<string,double>"
    return local_table(spark, rows, schema)


@dataclass
class TrainingResult:
    best: Candidate
    candidates: list[Candidate]
    test_metrics: dict
    runs: DataFrame
    numeric: list[str]
    categorical: list[str]


def train(
    df: DataFrame,
    target: str,
    key: str,
    cfg: TrainingConfig = TrainingConfig(),
    artifact_root: str | None = None,
) -> TrainingResult:
    """Split, fit the baselines, choose, tune the chosen family, choose again, test once.

    ``key`` identifies a row; it is not a feature.
    """
    spark = df.sparkSession
    ready, numeric, categorical = prepare(df, target)
    numeric = [n for n in numeric if n != flat_name(key)]
    categorical = [n for n in categorical if n != flat_name(key)]
    placed = stratified_split(ready, "label", flat_name(key), cfg.split)
    keep = [*numeric, *categorical, "label", flat_name(key), "split"]
    placed = placed.select(*[col(c) for c in dict.fromkeys(keep)]).persist()
    training = balanced(stratified_folds(placed.where(F.col("split") == "train"), "label", flat_name(key), cfg.folds, cfg.split.seed)).persist()
    validation = placed.where(F.col("split") == "validation")
    rows = training.count()
    candidates = [
        _candidate(n, {}, training, validation, numeric, categorical, rows, cfg, "baseline") for n in cfg.families
    ]
    candidates.append(tune(pick(spark, candidates), training, validation, numeric, categorical, rows, cfg))
    best = pick(spark, candidates)
    test_metrics = evaluate(best.model, placed.where(F.col("split") == "test"), best.threshold["threshold"])
    result = TrainingResult(best, candidates, test_metrics, run_records(spark, candidates, cfg), numeric, categorical)
    if artifact_root:
        save_artifacts(spark, result, artifact_root)
    training.unpersist()
    placed.unpersist()
    return result


def flat_test_metrics(result: TrainingResult) -> dict[str, float]:
    names = ("auc", "f1", "precision", "recall", "accuracy")
    return {
        **{f"test_{n}": float(result.test_metrics[n]) for n in names},
        "operating_threshold": result.best.threshold["threshold"],
    }


def save_artifacts(spark: SparkSession, result: TrainingResult, root: str) -> None:
    """Model, metrics, threshold, serving schema and run log under one folder."""
    result.best.model.write().overwrite().save(f"{root}/model")
    flat = {"cv_auc": result.best.cv_auc, **flat_test_metrics(result)}
    local_table(spark, list(flat.items()), "metric string, value double").write.mode("overwrite").json(f"{root}/metrics")
    threshold = list(result.best.threshold.items())
    local_table(spark, threshold, "name string, value double").write.mode("overwrite").json(f"{root}/threshold")
    schema = [(n, "double") for n in result.numeric] + [(n, "string") for n in result.categorical]
    local_table(spark, schema, "feature string, kind string").coalesce(1).write.mode("overwrite").json(f"{root}/schema")
    result.runs.write.mode("append").parquet(f"{root}/runs")


def score_with_artifacts(spark: SparkSession, root: str, df: DataFrame) -> DataFrame:
    """Score ``df`` with a stored model at its stored threshold.

    The stored schema says which features to read and how: a feature that
    ``df`` lacks is missing in every row (and imputed by the model), other
    columns are handed through.
    """
    model = PipelineModel.load(f"{root}/model")
    stored = {r["name"]: r["value"] for r in spark.read.schema("name string, value double").json(f"{root}/threshold").collect()}
    flat, _ = with_flat_names(df)
    features = spark.read.schema("feature string, kind string").json(f"{root}/schema").collect()
    typed = {r["feature"]: (col(r["feature"]) if r["feature"] in flat.columns else F.lit(None)).try_cast(r["kind"]) for r in features}
    return score(model, flat.withColumns(typed), stored["threshold"])


# The cut a classifier uses by itself, as opposed to the tuned threshold.
DEFAULT_CUT = 0.5


def replay(model: PipelineModel, df: DataFrame, target: str, key: str, test: float = 0.30, seed: int = 42) -> DataFrame:
    """Rescore the held-out part of a 70/30 split: AUC, F1 at the default cut, and a summary line."""
    ready, _, _ = prepare(df, target)
    held = train_test_split(ready, "label", flat_name(key), test, seed).where(F.col("split") == "test")
    scored = with_probability(model, held).select("label", "probability")
    at = classification_metrics(scored, "label", "probability", DEFAULT_CUT)
    return at.select(
        roc_auc(scored, "label", "probability").scalar().alias("auc"),
        "f1",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test_rows"),
    ).withColumn(
        "summary",
        F.format_string("AUC=%.4f, F1=%.4f on deterministic test split (n=%d)", "auc", "f1", "n_test_rows"),
    )


def retrain(
    df: DataFrame, target: str, key: str, versions: DataFrame, model_name: str, cfg: TrainingConfig, artifact_root: str
) -> tuple[TrainingResult, DataFrame]:
    """Train on the full data and return the row of the new version."""
    result = train(df, target, key, cfg, artifact_root)
    newest = versions.where(F.col("model_name") == model_name).agg(F.max(F.col("version").try_cast("int"))).first()[0]
    version = str((newest or 0) + 1)
    flat = [(k, str(v)) for k, v in flat_test_metrics(result).items()]
    row = local_table(
        df.sparkSession,
        [(model_name, version, f"{artifact_root}/model", flat)],
        "model_name string, version string, source string, tags map<string,string>",
    )
    return result, row
