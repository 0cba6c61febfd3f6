"""Stored reference profiles: append-only, the active one is the newest."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import local_table
from plumbline.operators.profile import ReferenceProfile, bins_table, stats_table
from plumbline.sources.tables import append, read_or_none

HEADER = "header"
BINS = "numeric_bins"
STATS = "numeric_stats"
CATEGORIES = "category_shares"
OUTPUTS = "output_shares"


@dataclass(frozen=True)
class ProfileHeader:
    profile_id: str
    model_name: str
    model_version: str
    dataset_hash: str
    created_at: object


def save_profile(
    spark: SparkSession,
    root: str,
    profile: ReferenceProfile,
    model_name: str,
    model_version: str,
    dataset_hash: str,
    created_at: object,
) -> str:
    """Append a profile. The header goes last, so a half-written profile is never active."""
    profile_id = uuid.uuid5(uuid.NAMESPACE_OID, f"{model_name}|{model_version}|{dataset_hash}|{created_at}").hex
    tag = F.lit(profile_id).alias("profile_id")
    append(stats_table(spark, profile).select(tag, "*"), f"{root}/{STATS}")
    append(bins_table(spark, profile).select(tag, "*"), f"{root}/{BINS}")
    if profile.categories is not None:
        append(profile.categories.select(tag, "feature", "category", "n", "ref_share"), f"{root}/{CATEGORIES}")
    if profile.output is not None:
        rows = [(k, v) for k, v in profile.output.items()]
        append(local_table(spark, rows, "label int, ref_share double").select(tag, "*"), f"{root}/{OUTPUTS}")
    header = local_table(
        spark,
        [(profile_id, model_name, model_version, dataset_hash, created_at, list(profile.categorical))],
        "profile_id string, model_name string, model_version string, dataset_hash string, "
        "created_at timestamp, categorical array<string>",
    )
    append(header, f"{root}/{HEADER}")
    return profile_id


def active_header(spark: SparkSession, root: str, model_name: str):
    """Header row of the newest profile of a model, or None."""
    headers = read_or_none(spark, f"{root}/{HEADER}")
    if headers is None:
        return None
    return (
        headers.where(F.col("model_name") == model_name)
        .orderBy(F.col("created_at").desc(), F.col("profile_id").desc())
        .limit(1)
        .first()
    )


def _part(spark: SparkSession, root: str, name: str, profile_id: str) -> DataFrame | None:
    table = read_or_none(spark, f"{root}/{name}")
    return None if table is None else table.where(F.col("profile_id") == profile_id).drop("profile_id")


def load_active(spark: SparkSession, root: str, model_name: str) -> ReferenceProfile | None:
    """The active profile. Numeric parts are a dozen numbers per feature; categories stay a table."""
    header = active_header(spark, root, model_name)
    if header is None:
        return None
    pid = header["profile_id"]
    stats = _part(spark, root, STATS, pid)
    bins = _part(spark, root, BINS, pid)
    outputs = _part(spark, root, OUTPUTS, pid)
    edges, facts, shares = {}, {}, {}
    for r in stats.orderBy("position").collect() if stats is not None else []:
        edges[r["feature"]] = list(r["edges"])
        facts[r["feature"]] = {k: r[k] for k in ("n", "mean", "min", "max")}
    for r in bins.orderBy("feature", "bin").collect() if bins is not None else []:
        shares.setdefault(r["feature"], []).append(r["ref_share"])
    output = {r["label"]: r["ref_share"] for r in outputs.collect()} if outputs is not None else None
    categorical = tuple(header["categorical"])
    categories = _part(spark, root, CATEGORIES, pid) if categorical else None
    return ReferenceProfile(edges, facts, shares, categorical, categories, output or None)
