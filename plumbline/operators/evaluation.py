"""Classifier metrics over scored tables.

Curve metrics (ROC AUC, recall-constrained threshold) need running counts in
score order. Scores are first collapsed to (score, positives, negatives), then
placed in about a thousand equally filled score ranges of 64 even steps each;
running counts are taken inside each step and the steps are chained by their
totals. No task ever sees the whole curve, and a score shared by a third of the
rows is a single row.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import MIN_RECALL
from plumbline.functions.columns import col, literal
from plumbline.functions.stats import f1_score, safe_ratio

RANGES = 1024
STEPS = 64
# Up to this many keys the score ranges to look at are broadcast.
MAX_BROADCAST_KEYS = 100_000


def _in_ranges(df: DataFrame, label: str, score: str, keys: tuple[str, ...], ranges: int) -> DataFrame:
    """(keys..., score, y, range) with range numbers that grow with the score."""
    rows = df.select(*[col(k) for k in keys], col(score).cast("double").alias("score"), col(label).cast("int").alias("y"))
    probes = F.expr(f"array({', '.join(literal(i / ranges) for i in range(ranges + 1))})")
    sketch = rows.agg(F.count("score").alias("n"), F.kll_sketch_agg_double("score", 4096).alias("s"))
    cuts = sketch.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", probes))).first()[0] or [0.5]
    cuts = sorted(set(cuts))
    placed = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="score", outputCol="range", handleInvalid="keep"
    ).transform(rows)
    # Range i > 0 starts at cuts[i - 1]; its inside is divided evenly.
    starts = F.expr(f"array({', '.join(literal(c) for c in cuts)})")
    low, high = F.get(starts, F.col("range") - 1), F.get(starts, F.col("range"))
    step = F.floor(STEPS * F.try_divide(F.col("score") - low, high - low))
    step = F.greatest(F.least(F.coalesce(step, F.lit(0)), F.lit(STEPS - 1)), F.lit(0))
    placed = placed.withColumn("range", F.col("range").cast("int"))
    return placed.withColumn("range", (F.col("range") * STEPS + step).cast("int"))


def _by_score(placed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return placed.groupBy(*[col(k) for k in keys], "range", "score").agg(
        F.count_if(F.col("y") == 1).cast("double").alias("pos"),
        F.count_if(F.col("y") == 0).cast("double").alias("neg"),
    )


def roc_auc(
    df: DataFrame, label: str, score: str, keys: tuple[str, ...] = (), ranges: int = RANGES
) -> DataFrame:
    """(keys..., auc): exact area under the ROC curve; null when a class is absent."""
    key_cols = [col(k) for k in keys]
    curve = _by_score(_in_ranges(df, label, score, keys, ranges), keys)
    inside = Window.partitionBy(*key_cols, "range").orderBy("score")
    parts = (
        curve.withColumn("below", F.sum("neg").over(inside) - F.col("neg"))
        .groupBy(*key_cols, "range")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("pairs"),
        )
    )
    # At most ranges x STEPS rows per key from here on.
    chained = parts.withColumn(
        "below", F.sum("neg").over(Window.partitionBy(*key_cols).orderBy("range")) - F.col("neg")
    )
    return chained.groupBy(*key_cols).agg(
        F.try_divide(
            F.sum(F.col("pairs") + F.col("pos") * F.col("below")), F.sum("pos") * F.sum("neg")
        ).alias("auc")
    )


def classification_metrics(
    df: DataFrame, label: str, score: str, threshold: float | Column, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Confusion counts, precision, recall, F1 (0 on a zero division) and accuracy at a threshold."""
    y, hit = col(label) == 1, col(score) >= threshold
    counts = df.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(~y & ~hit).alias("tn"),
        F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"),
        F.count_if(y & hit).alias("tp"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return counts.select(
        *[col(k) for k in keys],
        "tn",
        "fp",
        "fn",
        "tp",
        precision.alias("precision"),
        recall.alias("recall"),
        f1_score(precision, recall).alias("f1"),
        safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )


def _metrics_at(tp: Column, fp: Column, positives: Column) -> list[Column]:
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, positives)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        f1_score(precision, recall).alias("f1"),
    ]


def recall_thresholds(
    df: DataFrame,
    label: str,
    score: str,
    min_recall: float = MIN_RECALL,
    keys: tuple[str, ...] = (),
    ranges: int = RANGES,
) -> DataFrame:
    """(keys..., threshold, precision, recall, f1): highest threshold with recall >= min_recall.

    Candidates are the scores plus 0.0 and 1.0. A key without positives gives no
    row. Only the one score range where recall crosses the floor is looked at
    score by score.
    """
    if not 0 <= min_recall <= 1:
        raise ValueError(f"invalid min_recall: {min_recall}")
    key_cols = [col(k) for k in keys]
    if min_recall == 0:
        # Every candidate qualifies, so the largest one wins.
        best = _by_score(df.select(*key_cols, col(score).cast("double").alias("score"), col(label).alias("y"), F.lit(0).alias("range")), keys)
        top = best.groupBy(*key_cols).agg(
            F.max_by(F.struct("pos", "neg"), F.col("score")).alias("at"),
            F.max("score").alias("top"),
            F.sum("pos").alias("positives"),
        ).where(F.col("positives") > 0)
        reached = F.col("top") >= 1.0
        tp = F.when(reached, F.col("at.pos")).otherwise(0.0)
        fp = F.when(reached, F.col("at.neg")).otherwise(0.0)
        return top.select(
            *key_cols, F.greatest("top", F.lit(1.0)).alias("threshold"), *_metrics_at(tp, fp, F.col("positives"))
        )
    placed = _in_ranges(df, label, score, keys, ranges)
    totals = placed.groupBy(*key_cols, "range").agg(
        F.count_if(F.col("y") == 1).cast("double").alias("pos"),
        F.count_if(F.col("y") == 0).cast("double").alias("neg"),
    )
    # At most ranges x STEPS rows per key.
    down = Window.partitionBy(*key_cols).orderBy(F.col("range").desc())
    everything = Window.partitionBy(*key_cols)
    crossing = (
        totals.withColumn("positives", F.sum("pos").over(everything))
        .withColumn("tp_above", F.sum("pos").over(down) - F.col("pos"))
        .withColumn("fp_above", F.sum("neg").over(down) - F.col("neg"))
        .where(F.col("positives") > 0)
        .where(F.col("tp_above") / F.col("positives") < min_recall)
        .where((F.col("tp_above") + F.col("pos")) / F.col("positives") >= min_recall)
        .select(*key_cols, "range", "positives", "tp_above", "fp_above")
    )
    if not keys:
        crossing = F.broadcast(crossing)  # one row
    rest = ("positives", "tp_above", "fp_above")
    within = placed.join(crossing, [*keys, "range"]).groupBy(*key_cols, "score", *rest).agg(
        F.count_if(F.col("y") == 1).cast("double").alias("pos"),
        F.count_if(F.col("y") == 0).cast("double").alias("neg"),
    )
    inside = Window.partitionBy(*key_cols).orderBy(F.col("score").desc())
    passed = (
        within.withColumn("tp", F.col("tp_above") + F.sum("pos").over(inside))
        .withColumn("fp", F.col("fp_above") + F.sum("neg").over(inside))
        .where(F.col("tp") / F.col("positives") >= min_recall)
    )
    best = passed.groupBy(*key_cols).agg(
        F.max_by(F.struct("score", "tp", "fp", "positives"), F.col("score")).alias("b")
    ).where(F.col("b").isNotNull())
    return best.select(
        *key_cols, F.col("b.score").alias("threshold"), *_metrics_at(F.col("b.tp"), F.col("b.fp"), F.col("b.positives"))
    )


def find_threshold(df: DataFrame, label: str, score: str, min_recall: float = MIN_RECALL) -> dict[str, float]:
    """The threshold as numbers; raises when the table has no positive row."""
    row = recall_thresholds(df, label, score, min_recall).first()
    if row is None:
        raise ValueError("no_positive_examples")
    return row.asDict()


# Simpler families win ties.
COMPLEXITY = {"logistic_regression": 0, "hist_gradient_boosting": 1, "random_forest": 2}


def select_best(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest threshold, then CV AUC, then F1, then the simpler family.

    ``candidates`` has (name, threshold, cv_auc, validation_f1); a null threshold
    means that the recall floor was not met.
    """
    rank = F.create_map(*[F.lit(x) for pair in COMPLEXITY.items() for x in pair])
    return (
        candidates.where(F.col("threshold").isNotNull())
        .orderBy(
            F.col("threshold").desc(),
            F.col("cv_auc").desc(),
            F.coalesce("validation_f1", F.lit(0.0)).desc(),
            F.coalesce(F.try_element_at(rank, F.col("name")), F.lit(99)),
            F.col("name"),
        )
        .limit(1)
    )
