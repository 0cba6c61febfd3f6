"""Drift metrics of current traffic against a reference profile.

Every function takes optional ``keys`` (for example a report period or a model
name). Without keys the whole frame is one window; with keys one report per key
comes out of the same scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import ALERTING, CLIP, CONTRACT_COLOUR, SEVERITY_RANK, DriftConfig
from plumbline.functions.columns import col, literal
from plumbline.functions.stats import chi2_sf, psi_term
from plumbline.functions.text import version_number
from plumbline.operators.profile import (
    OUTPUT_EDGES,
    Binned,
    ReferenceProfile,
    category_label,
    label_counts,
    numeric_columns,
)

METRIC_COLUMNS = (
    "feature",
    "metric",
    "value",
    "pvalue",
    "n_bins",
    "threshold",
    "severity",
    "drifted",
    "position",
)


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in mapping.items() for x in pair])


def severity_rank(severity: Column) -> Column:
    return F.try_element_at(_lookup(SEVERITY_RANK), severity)


def severity_name(rank: Column) -> Column:
    return F.try_element_at(_lookup({v: k for k, v in SEVERITY_RANK.items()}), rank)


def contract_colour(severity: Column) -> Column:
    """Internal level to green / yellow / red; unknown or missing is green."""
    return F.coalesce(F.try_element_at(_lookup(CONTRACT_COLOUR), F.coalesce(severity, F.lit("none"))), F.lit("green"))


def psi_severity(value: Column, cfg: DriftConfig, output: bool = False) -> Column:
    """Severity of a stability index; the output signal stops at medium."""
    high = F.when(value >= cfg.output_psi, "medium") if output else F.when(value >= cfg.psi_high, "high")
    if output:
        high = high.when(value >= cfg.psi_high, "high")
    return high.when(value >= cfg.psi_medium, "medium").when(value >= cfg.psi_low, "low").otherwise("none")


def last_window(
    log: DataFrame, size: int, time: str = "created_at", tie_break: str = "id"
) -> DataFrame:
    """The newest ``size`` rows of the log, by a top-k over it.

    Lazy: every action reads the log as it is then. A job that reads the window
    several times keeps it itself and lets go of it afterwards.
    """
    return log.orderBy(col(time).desc(), col(tie_break).desc()).limit(size)


def _psi_rows(
    counts: DataFrame, shares: dict[str, list[float]], keys: tuple[str, ...]
) -> DataFrame:
    """(keys..., feature, position, n_bins, psi) from label counts and reference shares.

    A feature has at most ten bins plus null, so its counts fit in one map; the
    reference shares are literals.
    """
    per_feature = counts.groupBy(*[col(k) for k in keys], "feature").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))
        ).alias("by_bin"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("total"),
    )
    literals = _lookup(
        {n: F.expr(f"array({', '.join(literal(x) for x in s)})") for n, s in shares.items()}
    )
    position = _lookup({name: F.lit(i) for i, name in enumerate(shares)})
    with_shares = per_feature.withColumn("ref_shares", F.try_element_at(literals, F.col("feature")))
    psi = F.aggregate(
        F.sequence(F.lit(0), F.size("ref_shares") - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + psi_term(
            F.get(F.col("ref_shares"), i),
            F.coalesce(F.try_element_at(F.col("by_bin"), i.cast("string")), F.lit(0))
            / F.greatest(F.col("total"), F.lit(1)),
        ),
    )
    return with_shares.select(
        *[col(k) for k in keys],
        "feature",
        F.try_element_at(position, F.col("feature")).alias("position"),
        F.size("ref_shares").alias("n_bins"),
        F.when(F.col("total") == 0, F.lit(0.0)).otherwise(psi).alias("psi"),
    )


# Prefixes keep the kinds of signal apart where they share one table of counts.
NUMERIC, CATEGORICAL, OUTPUT = "n|", "c|", "o|"


def psi_labels(
    df: DataFrame, profile: ReferenceProfile, numeric: bool = True, prediction: str | None = "prediction"
) -> dict[str, Binned]:
    """Bin labels of the profiled numeric features in ``df`` and of its prediction column."""
    labels = {}
    if numeric:
        present = [n for n in profile.edges if n in df.columns]
        values = numeric_columns(df, present)
        labels |= {NUMERIC + n: Binned(values[n], profile.edges[n]) for n in present}
    if prediction and profile.output is not None:
        labels[OUTPUT + "prediction"] = Binned(col(prediction).cast("double"), OUTPUT_EDGES)
    return labels


def output_reference(output: dict[int, float]) -> list[float]:
    """Reference shares of the two output bins, from whole per-mille counts (at least 1)."""
    weights = [0, 0]
    for label, share in output.items():
        weights[0 if label < OUTPUT_EDGES[1] else 1] += max(int(share * 1000), 1)
    return [w / max(sum(weights), 1) for w in weights]


def psi_of(
    counts: DataFrame, profile: ReferenceProfile, cfg: DriftConfig, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Stability indexes from (keys..., prefixed feature, label, n) counts."""
    shares = {NUMERIC + n: s for n, s in profile.shares.items()}
    if profile.output is not None:
        shares[OUTPUT + "prediction"] = output_reference(profile.output)
    is_output = F.col("feature").startswith(OUTPUT)
    value = F.col("psi")
    return _psi_rows(counts, shares, keys).select(
        *[col(k) for k in keys],
        F.expr(f"substring(feature, {len(NUMERIC) + 1})").alias("feature"),
        F.when(is_output, "output_dist").otherwise("psi").alias("metric"),
        value.alias("value"),
        F.lit(None).cast("double").alias("pvalue"),
        "n_bins",
        F.when(is_output, cfg.output_psi).otherwise(cfg.psi_medium).alias("threshold"),
        F.when(is_output, psi_severity(value, cfg, output=True)).otherwise(psi_severity(value, cfg)).alias("severity"),
        F.lit(None).cast("boolean").alias("drifted"),
        F.when(is_output, 0).otherwise(F.col("position")).alias("position"),
    )


def numeric_psi(
    df: DataFrame, profile: ReferenceProfile, cfg: DriftConfig, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Stability index of every profiled numeric feature present in ``df``.

    A feature that is present but has no values scores 0.0; an absent one gives no row.
    """
    labels = psi_labels(df, profile, prediction=None)
    return psi_of(label_counts(df, labels, keys), profile, cfg, keys)


def output_psi(
    df: DataFrame,
    profile: ReferenceProfile,
    cfg: DriftConfig,
    prediction: str = "prediction",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Stability index of the predicted label against the reference label shares."""
    labels = psi_labels(df, profile, numeric=False, prediction=prediction)
    return psi_of(label_counts(df, labels, keys), profile, cfg, keys)


def categorical_chi2(
    df: DataFrame, profile: ReferenceProfile, cfg: DriftConfig, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Chi-square goodness of fit of every profiled categorical feature in ``df``.

    Cells are the union of reference and current categories. An unseen category
    has an expected count of 1e-6, and expected counts are rescaled to the
    observed total. With r = N / S (N observed, S expected before rescaling) the
    statistic equals (A - (1 - r)^2 S) / r, where A is the statistic before
    rescaling; that needs one pass over the cells instead of two.
    """
    counts = label_counts(df, categorical_labels(df, profile), keys)
    return categorical_chi2_of(counts, profile, cfg, keys)


def categorical_labels(df: DataFrame, profile: ReferenceProfile) -> dict[str, Column]:
    return {n: category_label(n) for n in profile.categorical if n in df.columns}


def categorical_chi2_of(
    counts: DataFrame, profile: ReferenceProfile, cfg: DriftConfig, keys: tuple[str, ...] = ()
) -> DataFrame:
    """The same from (keys..., feature, label, n) counts."""
    names = profile.categorical
    key_cols = [col(k) for k in keys]
    totals = counts.groupBy(*key_cols, "feature").agg(F.sum("n").alias("total"))
    if not keys:
        totals = F.broadcast(totals)  # one row per feature
    expected = totals.join(profile.categories, "feature").select(
        *key_cols, "feature", F.col("category").alias("label"), F.lit(0).cast("long").alias("n"), "ref_share", "total"
    )
    observed = counts.select(
        *key_cols, "feature", "label", "n", F.lit(0.0).alias("ref_share"), F.lit(0).cast("long").alias("total")
    )
    cells = observed.unionByName(expected).groupBy(*key_cols, "feature", "label")
    cells = cells.agg(*[F.sum(c).alias(c) for c in ("n", "ref_share", "total")])
    # An unseen category has share 0 here, hence the clipped expected count.
    e = F.greatest(F.col("ref_share") * F.greatest("total", F.lit(1)), F.lit(CLIP))
    sums = cells.groupBy(*key_cols, "feature").agg(
        F.sum("n").alias("total"),
        F.sum(e).alias("s"),
        F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("a"),
        F.count(F.lit(1)).cast("int").alias("n_bins"),
    )
    r = F.col("total") / F.col("s")
    stat = (F.col("a") - (1 - r) * (1 - r) * F.col("s")) / r
    rows = sums.withColumn("value", F.greatest(stat, F.lit(0.0))).withColumn(
        "pvalue", chi2_sf(F.col("value"), F.col("n_bins") - 1)
    )
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    return rows.select(
        *key_cols,
        "feature",
        F.lit("chi2").alias("metric"),
        "value",
        "pvalue",
        "n_bins",
        F.lit(cfg.chi2_pvalue).alias("threshold"),
        F.lit(None).cast("string").alias("severity"),
        F.coalesce(F.col("pvalue") < cfg.chi2_pvalue, F.lit(False)).alias("drifted"),
        position.cast("int").alias("position"),
    )


def drift_metrics(
    df: DataFrame,
    profile: ReferenceProfile,
    cfg: DriftConfig,
    keys: tuple[str, ...] = (),
    prediction: str = "prediction",
) -> DataFrame:
    """All signals of a window in one long frame.

    Numeric features and the prediction share one pass; categories take another,
    over other columns.
    """
    parts = []
    labels = psi_labels(df, profile, prediction=prediction)
    if labels:
        parts.append(psi_of(label_counts(df, labels, keys), profile, cfg, keys))
    if profile.categories is not None:
        parts.append(categorical_chi2(df, profile, cfg, keys))
    return reduce(DataFrame.unionByName, parts)


def overall_severity(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Worst signal per report; drifted categories count as one signal together."""
    summary = metrics.groupBy(*[col(k) for k in keys]).agg(
        F.max(severity_rank(F.col("severity"))).alias("worst"),
        F.count_if(F.col("metric") == "psi").alias("n_numeric"),
        F.count_if(F.col("drifted")).alias("n_categorical_drifted"),
    )
    n = F.col("n_categorical_drifted")
    by_category = (
        F.when(n >= 4, SEVERITY_RANK["high"])
        .when(n >= 2, SEVERITY_RANK["medium"])
        .when(n == 1, SEVERITY_RANK["low"])
        .otherwise(SEVERITY_RANK["none"])
    )
    worst = F.greatest(F.coalesce("worst", F.lit(SEVERITY_RANK["none"])), by_category)
    return summary.select(
        *[col(k) for k in keys], severity_name(worst).alias("severity"), "n_numeric", "n_categorical_drifted"
    )


def window_facts(
    df: DataFrame,
    keys: tuple[str, ...] = (),
    time: str = "created_at",
    tie_break: str = "id",
    version: str = "model_version",
) -> DataFrame:
    """Bounds and size of each window, and the model version of its newest row."""
    return df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("window_size"),
        F.min(col(time)).alias("window_start"),
        F.max(col(time)).alias("window_end"),
        F.max_by(col(version), F.struct(col(time), col(tie_break))).alias("model_version"),
    )


def with_previous_severity(
    reports: DataFrame, keys: tuple[str, ...] = (), time: str = "created_at"
) -> DataFrame:
    """Severity of the report before, over stored reports only.

    The frame holds one row per report, so ordering all reports of a model (or,
    without keys, all reports) in one task stays small.
    """
    order = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(time))
    stored = reports.where(F.col("severity") != "insufficient_data")
    return stored.withColumn("previous_severity", F.lag("severity").over(order))


def raises_alert(severity: Column, previous: Column) -> Column:
    """Alert on a change into an alerting level; a first report may alert too."""
    return (
        severity.isin(*ALERTING)
        & ~severity.eqNullSafe(previous)
        & ~previous.eqNullSafe(F.lit("insufficient_data"))
    )


_SOURCE_ORDER = {"psi": 0, "chi2": 1, "output_dist": 2}


def top_metrics(metrics: DataFrame, keys: tuple[str, ...] = (), n: int = 5) -> DataFrame:
    """The ``n`` largest signals by raw value; ties keep numeric, categorical, output order."""
    source = F.try_element_at(_lookup(_SOURCE_ORDER), F.col("metric"))
    ranked = metrics.withColumn(
        "rank",
        F.row_number().over(
            # One report has a few rows per feature.
            Window.partitionBy(*[col(k) for k in keys]).orderBy(
                F.col("value").desc(), source, F.col("position"), F.col("feature")
            )
        ),
    )
    return ranked.where(F.col("rank") <= n).select(
        *[col(k) for k in keys], "rank", "feature", "metric", "value", "threshold"
    )


def top_metrics_array(top: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("rank", "feature", "metric", "value", "threshold")))
    return top.groupBy(*[col(k) for k in keys]).agg(
        F.transform(
            cells,
            lambda c: F.struct(
                c["feature"].alias("feature"),
                c["metric"].alias("metric"),
                c["value"].alias("value"),
                c["threshold"].alias("threshold"),
            ),
        ).alias("top_metrics")
    )


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def event_payload(
    event_id: Column, emitted_at: Column, previous: Column, current: Column
) -> Column:
    """The drift event message as JSON, from a report row with ``top_metrics``."""
    return F.to_json(
        F.struct(
            event_id.alias("event_id"),
            F.date_format(emitted_at, _ISO).alias("emitted_at"),
            F.col("model_name"),
            version_number(F.col("model_version")).alias("model_version"),
            F.date_format("window_start", _ISO).alias("window_start"),
            F.date_format("window_end", _ISO).alias("window_end"),
            F.col("window_size"),
            contract_colour(previous).alias("previous_severity"),
            contract_colour(current).alias("current_severity"),
            F.col("top_metrics"),
        )
    )
