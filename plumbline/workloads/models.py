"""Scoring, evaluation, selection and training queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import SplitConfig
from plumbline.functions.columns import local_table
from plumbline.operators.contract import Contract, Field
from plumbline.operators.evaluation import (
    classification_metrics,
    recall_thresholds,
    roc_auc,
    select_best,
)
from plumbline.plans.training import TrainingConfig, balanced, estimator, positive_predictions, score_with_artifacts, with_probability
from plumbline.sources.folders import fresh_folder
from plumbline.streaming.runtime import drain, stream_table
from plumbline.streaming.scoring import score_stream
from plumbline.workloads.adapters import LABELLED_SQL, labelled_documents
from plumbline.workloads.registry import Tables, query


def scored_events(t: Tables) -> DataFrame:
    """Events as scored records: label = click, score = k / 100 (few distinct scores)."""
    k = F.get_json_object("props", "$.k").cast("double")
    y = (F.col("event_type") == "click").cast("int")
    return t.events.select("event_id", F.weekday("ts").alias("weekday"), y.alias("y"), (k / 100).alias("score"))


SCORED_SQL = """
scored AS (SELECT event_id, (isodow(ts) - 1)::INT AS weekday, (event_type = 'click')::INT AS y, json_extract_string(props, '$.k')::DOUBLE / 100 AS score FROM events)"""


def scored_lines(t: Tables) -> DataFrame:
    """Lines as scored records: label = returned, score = price share (almost all scores distinct)."""
    return t.lineitem.select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") / 200000.0).alias("score")
    )


LINES_SQL = """
scored AS (SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, l_extendedprice / 200000.0::DOUBLE AS score FROM lineitem)"""


def auc_sql(source: str, y: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
auc_d AS (SELECT {k}score, sum({y})::DOUBLE AS p, sum(1 - {y})::DOUBLE AS n FROM {source} GROUP BY {k}score),
auc_c AS (SELECT *, sum(n) OVER ({part} ORDER BY score) - n AS below FROM auc_d),
auc AS (SELECT {k}sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM auc_c {group})"""


def threshold_sql(source: str, y: str, floor: float, key: str = "") -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    same = f"PARTITION BY {key}" if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
th_d AS (SELECT {k}score, sum({y})::DOUBLE AS p, sum(1 - {y})::DOUBLE AS n FROM {source} GROUP BY {k}score),
th_c AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS fp, sum(p) OVER ({same}) AS pos FROM th_d),
th_b AS (SELECT {k}max_by({{'s': score, 'tp': tp, 'fp': fp, 'pos': pos}}, score) AS b FROM th_c WHERE pos > 0 AND tp / pos >= {floor} {group}),
th AS (
  SELECT {k}b.s AS threshold, b.tp / (b.tp + b.fp) AS precision, b.tp / b.pos AS recall,
         2 * (b.tp / (b.tp + b.fp)) * (b.tp / b.pos) / (b.tp / (b.tp + b.fp) + b.tp / b.pos) AS f1 FROM th_b)"""


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query("roc_auc", f"WITH {LABELLED_SQL}, {auc_sql('labelled', 'quality')} SELECT round(auc, 6) AS auc FROM auc")
def document_auc(t: Tables) -> DataFrame:
    return rounded(roc_auc(labelled_documents(t), "quality", "score"), "auc")


@query("roc_auc_large", f"WITH {LINES_SQL}, {auc_sql('scored', 'y')} SELECT round(auc, 6) AS auc FROM auc")
def line_auc(t: Tables) -> DataFrame:
    return rounded(roc_auc(scored_lines(t), "y", "score"), "auc")


@query(
    "roc_auc_by_group",
    f"WITH {SCORED_SQL}, {auc_sql('scored', 'y', 'weekday')} SELECT weekday, round(auc, 6) AS auc FROM auc",
)
def event_auc_by_group(t: Tables) -> DataFrame:
    """One AUC per candidate model; here the weekday stands for the model that scored a row."""
    return rounded(roc_auc(scored_events(t), "y", "score", ("weekday",)), "auc")


@query(
    "confusion_metrics",
    f"""WITH {LABELLED_SQL}, c AS (SELECT count(*) FILTER (quality = 0 AND score < 0.5) AS tn, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp,
count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp FROM labelled)
SELECT tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy FROM c""",
)
def document_confusion(t: Tables) -> DataFrame:
    out = classification_metrics(labelled_documents(t), "quality", "score", 0.5)
    return rounded(out, "precision", "recall", "f1", "accuracy")


@query(
    "recall_threshold",
    f"""WITH {LABELLED_SQL}, {threshold_sql('labelled', 'quality', 0.75)}
SELECT round(threshold, 9) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM th""",
)
def document_threshold(t: Tables) -> DataFrame:
    out = recall_thresholds(labelled_documents(t), "quality", "score", 0.75)
    return rounded(rounded(out, "threshold", places=9), "precision", "recall", "f1")


@query(
    "recall_threshold_large",
    f"""WITH {LINES_SQL}, {threshold_sql('scored', 'y', 0.75)}
SELECT round(threshold, 9) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM th""",
)
def line_threshold(t: Tables) -> DataFrame:
    out = recall_thresholds(scored_lines(t), "y", "score", 0.75)
    return rounded(rounded(out, "threshold", places=9), "precision", "recall", "f1")


CANDIDATES_SQL = f"""{LABELLED_SQL},
{threshold_sql('labelled', 'quality', 0.75, 'lang')}, {auc_sql('labelled', 'quality', 'lang')}"""


@query(
    "recall_threshold_by_group",
    f"""WITH {CANDIDATES_SQL} SELECT lang, round(threshold, 9) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(f1, 6) AS f1, round(auc, 6) AS auc FROM th JOIN auc USING (lang)""",
)
def candidate_metrics(t: Tables) -> DataFrame:
    """Validation metrics at the chosen threshold, one row per candidate (here, per language)."""
    rows = labelled_documents(t)
    found = recall_thresholds(rows, "quality", "score", 0.75, ("lang",)).join(roc_auc(rows, "quality", "score", ("lang",)), "lang")
    return rounded(rounded(found, "threshold", places=9), "precision", "recall", "f1", "auc")


@query(
    "model_selection",
    f"""WITH {CANDIDATES_SQL} SELECT lang AS name, round(threshold, 9) AS threshold, round(auc, 6) AS cv_auc, round(f1, 6) AS validation_f1
FROM th JOIN auc USING (lang) ORDER BY threshold DESC, cv_auc DESC, validation_f1 DESC, name LIMIT 1""",
)
def best_candidate(t: Tables) -> DataFrame:
    rows = candidate_metrics(t)
    return select_best(
        rows.select(F.col("lang").alias("name"), "threshold", F.col("auc").alias("cv_auc"), F.col("f1").alias("validation_f1"))
    )


@query(
    "scored_decisions",
    f"""WITH {SCORED_SQL} SELECT event_id, score AS probability, (score >= 0.3897478991)::INT AS prediction,
CASE WHEN score >= 0.3897478991 THEN 'yes' ELSE 'no' END AS decision FROM scored""",
)
def scored_decisions(t: Tables) -> DataFrame:
    """Probability, prediction at a threshold, and label text."""
    rows = scored_events(t).select("event_id", F.col("score").alias("probability"))
    hit = F.col("probability") >= 0.3897478991
    return rows.withColumns({"prediction": hit.cast("int"), "decision": F.when(hit, "yes").otherwise("no")})


@query("positive_predictions", f"WITH {SCORED_SQL} SELECT count(*) AS rows, count(*) FILTER (score >= 0.5) AS positives FROM scored")
def positive_count(t: Tables) -> DataFrame:
    return positive_predictions(scored_events(t).select((F.col("score") >= 0.5).cast("int").alias("prediction")))


@query("train_score_replay")
def train_score_replay(t: Tables) -> DataFrame:
    """Train a logistic model on a stratified split of the labelled documents and replay the held-out part."""
    from plumbline.plans.training import TrainingConfig, balanced, estimator, prepare, replay
    from plumbline.operators.sampling import train_test_split

    rows = labelled_documents(t).select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    ready, numeric, categorical = prepare(rows, "quality")
    numeric = [n for n in numeric if n != "doc_id"]
    split = train_test_split(ready, "label", "doc_id", test=0.30).where(F.col("split") == "train")
    training = balanced(split).persist()
    cfg = TrainingConfig(split=SplitConfig())
    model = estimator("logistic_regression", numeric, categorical, training.count(), cfg).fit(training)
    training.unpersist()
    return replay(model, rows, "quality", "doc_id")


@query(
    "stored_model_scores",
    """WITH e AS (SELECT (value >= 50)::INT AS high, CASE WHEN event_type = 'click' OR value >= 80 THEN 1 ELSE 0 END AS y FROM events),
n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM e),
g AS (SELECT high, count(*) AS rows, sum(y) / any_value(p) AS pos, (count(*) - sum(y)) / any_value(n - p) AS neg FROM e, n GROUP BY high)
SELECT how, high, rows, round(pos / (pos + neg), 2) AS probability, CASE WHEN pos / (pos + neg) >= 0.5 THEN 'yes' ELSE 'no' END AS decision
FROM g, (VALUES ('batch'), ('stream')) h(how)""",
)
def stored_model_scores(t: Tables) -> DataFrame:
    """A classifier fitted, stored and loaded again; scored as a table by its artifacts and as a stream of validated payloads.

    With one yes-or-no feature and hardly any penalty its probabilities are the weighted shares of each group, which SQL can tell.
    """
    root = fresh_folder(t.spark)
    y = ((F.col("event_type") == "click") | (F.col("value") >= 80)).cast("int").alias("label")
    high = (F.col("value") >= 50).cast("double").alias("high")
    rows = t.events.select("event_id", high, y)
    cfg = TrainingConfig(logistic_iterations=100)
    model = estimator("logistic_regression", ["high"], [], rows.count(), cfg, C=1e6).fit(balanced(rows))
    model.write().save(f"{root}/model")
    local_table(t.spark, [("threshold", 0.5)], "name string, value double").write.json(f"{root}/threshold")
    local_table(t.spark, [("high", "double")], "feature string, kind string").write.json(f"{root}/schema")

    batch = score_with_artifacts(t.spark, root, rows.drop("label")).select(F.lit("batch").alias("how"), "high", "probability", "decision")
    loaded = PipelineModel.load(f"{root}/model")
    payloads = stream_table(t.spark, t.path("events")).select("event_id", F.to_json(F.struct(high)).alias("payload"))
    contract = Contract((Field("high", "float64"),))
    drain(score_stream(payloads, contract, lambda df: with_probability(loaded, df), 0.5, f"{root}/out", f"{root}/checkpoint"))
    stream = t.spark.read.parquet(f"{root}/out/scored").select(F.lit("stream").alias("how"), "high", "probability", "decision")
    both = batch.unionByName(stream).groupBy("how", F.col("high").cast("int").alias("high"), "decision")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("probability"), 2).alias("probability"))
