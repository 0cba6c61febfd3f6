"""Serving contract: inferred from training data, enforced on payload rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, local_table
from plumbline.operators.cleaning import INTEGER_DTYPES
from plumbline.operators.profile import label_counts
from plumbline.sources.folders import ensure_checkpoint_folder

# A value list up to this length is carried as a literal set; a longer one stays
# a table, against which the different values of the payloads are looked up.
MAX_ENUM = 10_000
# Up to so many values that are not allowed are broadcast to the payloads.
MAX_BROADCAST_VALUES = 1_000_000

# Declared dtype by Spark type.
DTYPES = {
    "bigint": "int64",
    "int": "int32",
    "smallint": "int32",
    "tinyint": "int32",
    "double": "float64",
    "float": "float64",
    "boolean": "bool",
    "string": "object",
}


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    allowed_values: tuple[str, ...] | None = None
    by_table: bool = False
    n_values: int | None = None

    @property
    def enumerated(self) -> bool:
        return self.allowed_values is not None or self.by_table

    @property
    def json_type(self) -> str:
        if self.enumerated:
            return "string"
        return "integer" if self.dtype in INTEGER_DTYPES else "number"


@dataclass(frozen=True)
class Contract:
    """Required fields of a payload. ``values`` is the (field, value) table of long value lists."""

    fields: tuple[Field, ...]
    target: str = "y"
    excluded: tuple[str, ...] = ("duration",)
    values: DataFrame | None = None

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields]


def dtype_name(dtype: T.DataType) -> str:
    return DTYPES.get(dtype.simpleString(), dtype.simpleString())


def allowed_values(df: DataFrame, names: list[str]) -> DataFrame:
    """(field, value): distinct non-null values, in long form so that no list has to fit in one row."""
    counts = label_counts(df, {n: col(n).cast("string") for n in names})
    return counts.where(F.col("label").isNotNull()).select(F.col("feature").alias("field"), F.col("label").alias("value"))


def infer_contract(
    df: DataFrame, target: str = "y", excluded: tuple[str, ...] = ("duration",), max_enum: int = MAX_ENUM
) -> Contract:
    """Field names, dtypes and allowed values of every feature column."""
    kept = [f for f in df.schema.fields if f.name != target and f.name not in excluded]
    texts = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    lists: dict[str, tuple[str, ...]] = {}
    long: set[str] = set()
    sizes: dict[str, int] = {}
    values = None
    if texts:
        table = allowed_values(df, texts)
        sizes = {r["field"]: r["n"] for r in table.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
        long = {n for n in texts if sizes.get(n, 0) > max_enum}
        short = [n for n in texts if n not in long]
        # Bounded by max_enum values per text column.
        for r in allowed_values(df, short).collect() if short else []:
            lists.setdefault(r["field"], []).append(r["value"])
        if long:
            values = table.where(F.col("field").isin(*long))
    fields = tuple(
        Field(
            f.name,
            dtype_name(f.dataType),
            tuple(sorted(lists.get(f.name, []))) if f.name in texts and f.name not in long else None,
            f.name in long,
            sizes.get(f.name),
        )
        for f in kept
    )
    return Contract(fields, target, tuple(excluded), values)


def infer_fallback_contract(df: DataFrame, order: list[Column], target: str = "y", rows: int = 100) -> Contract:
    """Contract from the first ``rows`` rows only, for when no artifact is at hand."""
    return infer_contract(df.orderBy(*order).limit(rows), target)


def contract_table(df: DataFrame, target: str = "y", excluded: tuple[str, ...] = ("duration",)) -> DataFrame:
    """(field, dtype, required, json_type, n_allowed): one row per feature."""
    kept = [f for f in df.schema.fields if f.name != target and f.name not in excluded]
    texts = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    cells = []
    for f in kept:
        field = Field(f.name, dtype_name(f.dataType), () if f.name in texts else None)
        cells.append((f.name, field.dtype, True, field.json_type, f.name in texts))
    table = local_table(df.sparkSession, cells, "field string, dtype string, required boolean, json_type string, text boolean")
    # One count of the different values of all text columns; long texts are counted by their digest.
    labels = {n: F.when(F.length(col(n)) > 32, F.md5(col(n))).otherwise(col(n)) for n in texts}
    counts = label_counts(df, labels).where(F.col("label").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("n")) if texts else None
    if counts is None:
        return table.select("field", "dtype", "required", "json_type", F.lit(None).cast("long").alias("n_allowed"))
    joined = table.join(F.broadcast(counts), F.col("field") == F.col("feature"), "left")  # one row per text column
    return joined.select("field", "dtype", "required", "json_type", F.when(F.col("text"), F.coalesce("n", F.lit(0))).alias("n_allowed"))


def json_schema(contract: Contract) -> str:
    """The contract as a JSON Schema document, with every allowed value of every text field, however many there are."""
    properties = {}
    for f in contract.fields:
        properties[f.name] = {"type": f.json_type}
        if f.allowed_values is not None:
            properties[f.name]["enum"] = list(f.allowed_values)
        elif f.by_table:
            listed = contract.values.where(F.col("field") == f.name).select("value").orderBy("value")
            properties[f.name]["enum"] = [r["value"] for r in listed.toLocalIterator()]
    return json.dumps(
        {
            "type": "object",
            "required": contract.required,
            "properties": properties,
            "additionalProperties": False,
        }
    )


def property_table(df: DataFrame, contract: Contract) -> DataFrame:
    """(field, property): each field's JSON Schema fragment."""
    document = json.loads(json_schema(contract))
    cells = [
        F.struct(F.lit(n).alias("field"), F.lit(json.dumps(p, separators=(",", ":"))).alias("property"))
        for n, p in document["properties"].items()
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*cells)))


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def validate(df: DataFrame, contract: Contract, payload: str = "payload") -> DataFrame:
    """Add ``errors`` (struct), ``valid`` and ``clean`` (typed struct) to payload rows.

    A payload that is not a JSON object, or repeats a key, is malformed. A JSON
    boolean is never a number and 1.0 is not an integer. Of fields whose allowed
    values are a table, the different values of all payloads are looked up once,
    all fields together; only those that are not allowed go back to the payloads.
    """
    required, excluded = contract.required, sorted({*contract.excluded, contract.target})
    names = F.array(*[F.lit(n) for n in required])
    parsed = df.withColumns({"_doc": F.try_parse_json(col(payload)), "_keys": F.json_object_keys(col(payload))})
    malformed = F.col("_doc").isNull() | F.col("_keys").isNull()
    keys = F.coalesce(F.col("_keys"), F.array().cast("array<string>"))

    kinds = {f"_k{i}": F.schema_of_variant(F.try_variant_get("_doc", _path(f.name), "variant")) for i, f in enumerate(contract.fields)}
    parsed = parsed.withColumns(kinds)
    if any(f.by_table for f in contract.fields):
        parsed = _with_unlisted(parsed, contract)

    types, values, clean = [], [], []
    for i, f in enumerate(contract.fields):
        kind, there = F.col(f"_k{i}"), F.array_contains(keys, f.name)
        if f.enumerated:
            good, spark_type = kind == "STRING", "string"
            text = F.try_variant_get("_doc", _path(f.name), "string")
            listed = ~F.coalesce(F.col(f"_not{i}"), F.lit(False)) if f.by_table else text.isin(*f.allowed_values)
            values.append(F.when(there & good & ~listed, F.lit(f.name)))
        elif f.json_type == "integer":
            good, spark_type = kind == "BIGINT", "bigint"
        else:
            good, spark_type = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "double"
        wrong = F.struct(F.lit(f.name).alias("key"), F.lit(f"expected {f.json_type}").alias("value"))
        types.append(F.when(there & ~F.coalesce(good, F.lit(False)), wrong))
        clean.append(F.try_variant_get("_doc", _path(f.name), spark_type).alias(f.name))

    none = F.array().cast("array<string>")
    errors = F.struct(
        malformed.alias("malformed"),
        F.when(malformed, none).otherwise(F.array_except(names, keys)).alias("missing"),
        F.array_sort(F.array_except(keys, names)).alias("unknown"),
        F.array_sort(F.array_intersect(keys, F.array(*[F.lit(x) for x in excluded]))).alias("excluded"),
        F.map_from_entries(F.array_compact(F.array(*types))).alias("invalid_types"),
        (F.array_compact(F.array(*values)) if values else none).alias("invalid_values"),
    )
    checked = parsed.withColumn("errors", errors)
    e = F.col("errors")
    valid = (
        ~e["malformed"]
        & (F.size(e["missing"]) == 0)
        & (F.size(e["unknown"]) == 0)
        & (F.size(e["excluded"]) == 0)
        & (F.size(e["invalid_types"]) == 0)
        & (F.size(e["invalid_values"]) == 0)
    )
    return checked.select(
        *[col(c) for c in df.columns], "errors", valid.alias("valid"), F.when(valid, F.struct(*clean)).alias("clean")
    )


def _with_unlisted(parsed: DataFrame, contract: Contract) -> DataFrame:
    """``parsed`` with ``_not{i}``: true where the value of field i is not among its table of allowed values.

    One map-side combined aggregation finds the different values of all fields,
    so a value in most payloads travels once per task. What is not allowed is
    joined back, as a broadcast while it is small.
    """
    long = {i: f for i, f in enumerate(contract.fields) if f.by_table}
    text = {i: F.try_variant_get("_doc", _path(f.name), "string") for i, f in long.items()}
    if parsed.isStreaming:  # nothing can be counted on a stream; each field is joined as it is
        for i, f in long.items():
            known = contract.values.where(F.col("field") == f.name).select(F.col("value").alias(f"_v{i}"), F.lit(False).alias(f"_not{i}"))
            parsed = parsed.withColumn(f"_v{i}", text[i]).join(known, f"_v{i}", "left").withColumn(f"_not{i}", F.coalesce(f"_not{i}", F.lit(True))).drop(f"_v{i}")
        return parsed
    ensure_checkpoint_folder(parsed.sparkSession)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), text[i].alias("value")) for i, f in long.items()])
    seen = parsed.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    unlisted = seen.join(contract.values, ["field", "value"], "left_anti").select("field", "value").checkpoint()
    small = unlisted.count() <= MAX_BROADCAST_VALUES
    for i, f in long.items():
        own = unlisted.where(F.col("field") == f.name).select(F.col("value").alias(f"_v{i}"), F.lit(True).alias(f"_not{i}"))
        parsed = parsed.withColumn(f"_v{i}", text[i]).join(F.broadcast(own) if small else own, f"_v{i}", "left").drop(f"_v{i}")
    return parsed


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows)."""
    extra = ("errors", "valid", "clean")
    rest = [col(c) for c in checked.columns if c not in extra]
    good = checked.where("valid").select(*rest, "clean.*")
    return good, checked.where("not valid").select(*rest, "errors")


# The drift event message.
EVENT_SCHEMA = (
    "event_id string, emitted_at timestamp, model_name string, model_version int, "
    "window_start timestamp, window_end timestamp, window_size bigint, "
    "previous_severity string, current_severity string, "
    "top_metrics array<struct<feature: string, metric: string, value: double, threshold: double>>"
)
EVENT_LEVELS = ("green", "yellow", "red")
EVENT_METRICS = ("psi", "chi2", "output_dist")
MAX_EVENT_METRICS = 5


def validate_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``event`` (parsed struct) and ``event_valid`` to drift event messages."""
    parsed = df.withColumn("event", F.from_json(col(payload), EVENT_SCHEMA, {"mode": "PERMISSIVE"}))
    e = F.col("event")
    names = [f.name for f in T._parse_datatype_string(EVENT_SCHEMA).fields]
    complete = e.isNotNull()
    for n in names:
        complete = complete & e[n].isNotNull()
    metrics_ok = F.forall(
        e["top_metrics"],
        lambda m: m["feature"].isNotNull()
        & m["value"].isNotNull()
        & m["threshold"].isNotNull()
        & F.coalesce(m["metric"].isin(*EVENT_METRICS), F.lit(False)),
    )
    valid = (
        complete
        & e["previous_severity"].isin(*EVENT_LEVELS)
        & e["current_severity"].isin(*EVENT_LEVELS)
        & (F.size(e["top_metrics"]) <= MAX_EVENT_METRICS)
        & metrics_ok
    )
    return parsed.withColumn("event_valid", F.coalesce(valid, F.lit(False)))
