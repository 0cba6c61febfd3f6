"""Reference profile: the frozen distributions that later traffic is compared with.

The profile keeps bin shares, not raw values. With fixed edges they give the
same stability index and stay small whatever the size of the reference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col, is_numeric, literal, local_table, numeric_value
from plumbline.operators.ranks import exact_quantiles

DECILES = [k * 0.1 for k in range(10)] + [1.0]
OUTPUT_EDGES = [-0.5, 0.5, 1.5]


@dataclass
class ReferenceProfile:
    """Distributions of one reference population.

    ``edges``, ``stats`` and ``shares`` hold at most a dozen numbers per numeric
    feature and live in the driver, so they enter plans as literals. Category
    shares are a table, since the number of categories grows with the data.
    """

    edges: dict[str, list[float]]
    stats: dict[str, dict[str, float]]
    shares: dict[str, list[float]]
    categorical: tuple[str, ...]
    categories: DataFrame | None
    output: dict[int, float] | None


def split_by_type(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric (numbers and booleans) and categorical (the rest) column names."""
    fields = [f for f in df.schema.fields if f.name not in exclude]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    return numeric, [f.name for f in fields if f.name not in numeric]


def numeric_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    return {n: numeric_value(n, df.schema[n].dataType) for n in names}


def numeric_profile(df: DataFrame, names: list[str]) -> tuple[dict, dict, dict]:
    """(edges, shares, stats) of each numeric column.

    Edges are the distinct deciles; a constant column gets ``[min, max + 1]`` and
    a column without values is left out. Shares are those of the bins between
    the edges. Everything comes out of the same three passes.
    """
    found = exact_quantiles(
        df,
        numeric_columns(df, names),
        DECILES,
        extra={"mean": F.avg, "min": F.min, "max": F.max},
    )
    edges, shares, stats = {}, {}, {}
    for name in names:
        ranked = found[name]
        if not ranked.n:
            continue
        below = {ranked.values[i]: ranked.below[i] for i in ranked.values}
        distinct = sorted(below)
        if len(distinct) < 2:
            distinct = [ranked.extra["min"], ranked.extra["max"] + 1]
        steps = [0, *[below[e] for e in distinct[1:-1]], ranked.n]
        edges[name] = distinct
        shares[name] = [(b - a) / ranked.n for a, b in zip(steps, steps[1:])]
        stats[name] = {"n": ranked.n, **ranked.extra}
    return edges, shares, stats


@dataclass(frozen=True)
class Binned:
    """A numeric value labelled by its bin number; the outer bins are open, null stays null."""

    value: Column
    edges: list[float]

    def label(self, name: str) -> Column:
        """Labels are literals, so binning is a chain of comparisons in generated code."""
        inner = self.edges[1:-1]
        branches = " ".join(f"WHEN {name} < {literal(e)} THEN '{i}'" for i, e in enumerate(inner))
        return F.expr(f"CASE WHEN {name} IS NULL THEN NULL {branches} ELSE '{len(inner)}' END")


def category_label(name: str) -> Column:
    """Category as text; a missing value is a category of its own."""
    return F.coalesce(col(name).cast("string"), F.lit("nan"))


def long_labels(
    df: DataFrame, labels: dict[str, Column | Binned], keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys..., series, label): one row per input row and label expression."""
    names = {f"f{i}": name for i, name in enumerate(labels)}
    parts = {k: labels[n] for k, n in names.items()}
    key_cols = [col(k) for k in keys]
    values = [(p.value if isinstance(p, Binned) else p).alias(k) for k, p in parts.items()]
    # A second projection, so that each value is computed once for all its bins.
    wide = df.select(*key_cols, *values).select(
        *key_cols,
        *[(p.label(k) if isinstance(p, Binned) else F.col(k)).alias(k) for k, p in parts.items()],
    )
    return wide.unpivot(key_cols, list(names), "series", "label")


def feature_of(labels: dict[str, Column | Binned]) -> Column:
    """Feature name of a ``series`` value."""
    pairs = [F.lit(x) for i, name in enumerate(labels) for x in (f"f{i}", name)]
    return F.try_element_at(F.create_map(*pairs), F.col("series"))


def label_counts(
    df: DataFrame, labels: dict[str, Column | Binned], keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys..., feature, label, n) for every label expression, in one scan.

    One unpivot and one map-side combined aggregation serve all features, so a
    hot category or bin never travels as rows.
    """
    key_cols = [col(k) for k in keys]
    counted = long_labels(df, labels, keys).groupBy(*key_cols, "series", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*key_cols, feature_of(labels).alias("feature"), "label", "n")


def bins_table(spark: SparkSession, profile: ReferenceProfile) -> DataFrame:
    """(feature, bin, lower, upper, ref_share)."""
    rows = [
        (name, i, float(e[i]), float(e[i + 1]), share)
        for name, e in profile.edges.items()
        for i, share in enumerate(profile.shares[name])
    ]
    return local_table(spark, rows, "feature string, bin int, lower double, upper double, ref_share double")


def stats_table(spark: SparkSession, profile: ReferenceProfile) -> DataFrame:
    """(feature, position, n, mean, min, max, edges) of each numeric feature."""
    rows = [
        (name, i, s["n"], s["mean"], s["min"], s["max"], [float(x) for x in profile.edges[name]])
        for i, (name, s) in enumerate(profile.stats.items())
    ]
    schema = "feature string, position int, n bigint, mean double, min double, max double, edges array<double>"
    return local_table(spark, rows, schema)


def category_shares(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, category, n, ref_share); long form, so cardinality is not limited."""
    counts = label_counts(df, {n: category_label(n) for n in names})
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    # One total per feature.
    return counts.join(F.broadcast(totals), "feature").select(
        "feature",
        F.col("label").alias("category"),
        "n",
        (F.col("n") / F.col("total")).alias("ref_share"),
    )


def output_shares(df: DataFrame, target: str) -> DataFrame:
    """(label, ref_share) of the target."""
    counts = df.groupBy(col(target).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("label", (F.col("n") / total.scalar()).alias("ref_share"))


def output_sides(shares: DataFrame) -> dict[int, float]:
    """Label shares for the two output bins, at most one number for each whatever the number of labels.

    A bin of one label keeps its share. The labels of a bin that has several
    count in whole per-mille, at least one each; the share is that sum.
    """
    upper = F.col("label") >= F.lit(OUTPUT_EDGES[1])
    weight = F.sum(F.greatest(F.floor(F.col("ref_share") * 1000), F.lit(1)))
    sides = shares.where("label IS NOT NULL").groupBy(upper.alias("upper")).agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("label"), F.min("ref_share").alias("share"), weight.alias("weight")
    )
    # Half a per-mille more, so that a sum of whole ones stays whole.
    return {(r["label"] if r["n"] == 1 else int(r["upper"])): (r["share"] if r["n"] == 1 else (r["weight"] + 0.5) / 1000) for r in sides.collect()}


def build_profile(
    df: DataFrame, numeric: list[str], categorical: list[str], target: str | None = None
) -> ReferenceProfile:
    """Profile every listed feature and the target of a reference population."""
    edges, shares, stats = numeric_profile(df, numeric) if numeric else ({}, {}, {})
    output = None
    if target:
        output = output_sides(output_shares(df, target))
    return ReferenceProfile(
        edges=edges,
        stats=stats,
        shares=shares,
        categorical=tuple(categorical),
        categories=category_shares(df, categorical) if categorical else None,
        output=output,
    )
