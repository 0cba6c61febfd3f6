"""Recomputing and fetching the reference profile of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cleaning import BANK_RULES, CleaningRules, clean
from plumbline.operators.profile import ReferenceProfile, build_profile, split_by_type
from plumbline.sources.profiles import load_active, save_profile
from plumbline.sources.tables import table_fingerprint


def recompute_reference(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    model_name: str,
    model_version: str,
    created_at: object,
    rules: CleaningRules = BANK_RULES,
) -> str:
    """Clean the training data, profile every feature and the target, and store the profile as active."""
    cleaned = clean(raw, rules)
    numeric, categorical = split_by_type(cleaned, (rules.target,))
    profile = build_profile(cleaned, numeric, categorical, rules.target)
    mark = table_fingerprint(raw).select(F.md5(F.concat_ws("|", "rows", "hash_sum", "hash_xor"))).first()[0]
    return save_profile(spark, root, profile, model_name, model_version, mark, created_at)


def get_or_create_reference(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    model_name: str,
    model_version: str,
    created_at: object,
    rules: CleaningRules = BANK_RULES,
) -> ReferenceProfile:
    """The active profile; it is computed first when there is none."""
    found = load_active(spark, root, model_name)
    if found is None:
        recompute_reference(spark, raw, root, model_name, model_version, created_at, rules)
        found = load_active(spark, root, model_name)
    return found
