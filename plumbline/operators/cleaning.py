"""Projection, filtering and cleaning steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, require


@dataclass(frozen=True)
class Sentinel:
    """A value that means "absent": ``column`` equals ``value``."""

    column: str
    value: float
    flags: tuple[str, ...]
    clean: str
    replacement: float = 0


@dataclass(frozen=True)
class CleaningRules:
    """How one dataset is cleaned."""

    target: str
    labels: dict[str, int] = field(default_factory=lambda: {"yes": 1, "no": 0})
    drop: tuple[str, ...] = ()
    sentinels: tuple[Sentinel, ...] = ()


# The bank marketing campaign data.
BANK_RULES = CleaningRules(
    target="y",
    drop=("duration",),
    sentinels=(Sentinel("pdays", 999, ("pdays_was_999", "never_contacted_flag"), "pdays_clean"),),
)


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop what is there; names that are absent are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def to_number(df: DataFrame, name: str, dtype: str = "double") -> DataFrame:
    """Numeric coercion; text that is not a number becomes null."""
    return df.withColumn(name, col(name).try_cast(dtype))


def handle_sentinel(df: DataFrame, rule: Sentinel) -> DataFrame:
    """Add flag columns for the sentinel and a copy of the column without it."""
    field_type = df.schema[rule.column].dataType
    kind = field_type if isinstance(field_type, T.NumericType) else T.DoubleType()
    number = col(rule.column).try_cast(kind)
    hit = F.coalesce(number == F.lit(rule.value), F.lit(False))
    return df.withColumns(
        {
            **{name: hit.cast("long") for name in rule.flags},
            rule.clean: F.when(hit, F.lit(rule.replacement).cast(kind)).otherwise(number),
        }
    )


def encode_target(df: DataFrame, target: str, labels: dict[str, int]) -> DataFrame:
    """Text labels to integers; numeric targets are only cast. Unknown labels give null."""
    if isinstance(df.schema[target].dataType, T.StringType):
        code = F.lit(None).cast("int")
        for text, number in labels.items():
            code = F.when(col(target) == text, F.lit(number)).otherwise(code)
    else:
        code = col(target).cast("int")
    return df.withColumn(target, code)


def split_bad_targets(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows by whether the encoded target is present."""
    return df.where(col(target).isNotNull()), df.where(col(target).isNull())


def clean(df: DataFrame, rules: CleaningRules = BANK_RULES, on_bad_target: str = "raise") -> DataFrame:
    """Apply the rules without dropping useful rows.

    A row whose target is outside the domain is an error (``raise``) or is left
    out (``quarantine``; get such rows with ``split_bad_targets``).
    """
    out = strip_names(df)
    require(out, rules.target)
    out = drop_columns(out, *rules.drop)
    for rule in rules.sentinels:
        if rule.column in out.columns:
            out = handle_sentinel(out, rule)
    out = encode_target(out, rules.target, rules.labels)
    if on_bad_target == "raise":
        if not out.where(col(rules.target).isNull()).isEmpty():
            raise ValueError(f"{rules.target} holds values outside {sorted(rules.labels)} and 0/1")
        return out
    return split_bad_targets(out, rules.target)[0]


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    require(df, target)
    return df.drop(target), df.select(col(target).cast("int").alias(target))


def align_to(df: DataFrame, required: list[str]) -> DataFrame:
    """Required fields in their order; an error if one is absent."""
    require(df, *required)
    return df.select(*[col(n) for n in required])


# Declared dtypes that mean a whole number.
INTEGER_DTYPES = ("int64", "int32", "bool")


def json_safe(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Fill nulls (0, or "unknown" for enumerated fields) and cast by declared dtype."""
    out = []
    for f in fields:
        value = col(f["name"])
        if f.get("allowed_values") is not None:
            value = F.coalesce(value.cast("string"), F.lit("unknown"))
        else:
            kind = "long" if f["dtype"] in INTEGER_DTYPES else "double"
            value = F.coalesce(value.cast(kind), F.lit(0).cast(kind))
        out.append(value.alias(f["name"]))
    return df.select(*out)


def to_payload(df: DataFrame, integer: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON payload per row; null fields are left out, whole numbers stay whole."""
    cells = []
    for f in df.schema.fields:
        if f.name in keep:
            continue
        value = col(f.name)
        if f.name in integer or isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            value = value.cast("long") if not isinstance(f.dataType, T.BooleanType) else value.cast("int").cast("long")
        elif isinstance(f.dataType, (T.DecimalType, T.FractionalType)):
            value = value.cast("double")
        else:
            value = value.cast("string")
        cells.append(value.alias(f.name))
    return df.select(*[col(k) for k in keep], F.to_json(F.struct(*cells)).alias("payload"))


def cleaning_checks(cleaned: DataFrame, rules: CleaningRules, kept: dict[str, str]) -> DataFrame:
    """(check, passed) rows. ``kept`` maps a column to a value that must survive cleaning."""
    present = set(cleaned.columns)
    checks: dict[str, object] = {f"{name} removed": F.lit(name not in present) for name in rules.drop}
    target = col(rules.target)
    checks["target encoded as 0/1"] = F.count_if(~F.coalesce(target.isin(0, 1), F.lit(False))) == 0
    for rule in rules.sentinels:
        for name in (*rule.flags, rule.clean):
            checks[f"{name} created"] = F.lit(name in present)
    for name, value in kept.items():
        checks[f"{value} preserved in {name}"] = F.count_if(col(name) == value) > 0
    names = list(checks)
    row = cleaned.agg(*[checks[n].alias(f"k{i}") for i, n in enumerate(names)])
    cells = [F.struct(F.lit(n).alias("check"), F.col(f"k{i}").alias("passed")) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*cells)))
