"""Data-quality and exploratory profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, is_numeric, local_table
from plumbline.functions.stats import adjusted_skewness
from plumbline.operators.moments import correlations
from plumbline.operators.profile import label_counts, numeric_columns, split_by_type
from plumbline.operators.ranks import exact_quantiles, values_at_ranks

# Up to this many colliding row hashes the exact duplicate check looks at those
# rows only (they are broadcast, 8 bytes each); beyond it, whole rows are grouped.
MAX_BROADCAST_HASHES = 200_000


def _as_rows(row: DataFrame, names: list[str], cells: dict[str, list[str]]) -> DataFrame:
    """Turn one row of aggregates into one row per column.

    ``cells`` maps an output name to the aggregate columns, in the order of ``names``.
    """
    structs = [
        F.struct(F.lit(name).alias("column"), *[F.col(parts[i]).alias(out) for out, parts in cells.items()])
        for i, name in enumerate(names)
    ]
    return row.select(F.inline(F.array(*structs)))


def _missing(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def _common_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "double"
    return dtype.simpleString()


def column_overview(df: DataFrame) -> DataFrame:
    """dtype, missing count and percent, and distinct values (null counts as one).

    Columns of one type are unpivoted together and grouped by (column, value), so
    what is shuffled is one narrow row per distinct value of a column. Each type
    scans only its own columns.
    """
    fields = {f"c{i}": f for i, f in enumerate(df.schema.fields)}
    kinds: dict[str, list[str]] = {}
    for k, f in fields.items():
        kinds.setdefault(_common_type(f.dataType), []).append(k)
    parts = []
    for kind, names in kinds.items():
        values = [
            F.when(~_missing(fields[k].name, fields[k].dataType), col(fields[k].name)).cast(kind).alias(k) for k in names
        ]
        groups = df.select(*values).unpivot([], names, "series", "v").groupBy("series", "v").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            groups.groupBy("series").agg(
                F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
                F.sum("n").alias("rows"),
                F.count(F.lit(1)).alias("unique_count"),
            )
        )
    facts = F.create_map(
        *[x for k, f in fields.items() for x in (F.lit(k), F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype")))]
    )[F.col("series")]
    return reduce(DataFrame.unionByName, parts).select(
        facts["name"].alias("column"),
        facts["dtype"].alias("dtype"),
        "missing_count",
        F.round(F.col("missing_count") / F.col("rows") * 100, 2).alias("missing_percent"),
        "unique_count",
    )


def missing_summary(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    percents = [F.when(F.col("rows") > 0, F.col(f"m{i}") / F.col("rows") * 100).alias(f"p{i}") for i in range(len(fields))]
    return _as_rows(
        row.select("*", *percents),
        [f.name for f in fields],
        {"missing_count": [f"m{i}" for i in range(len(fields))], "missing_percent": [f"p{i}" for i in range(len(fields))]},
    )


def _count_duplicates(df: DataFrame) -> tuple[int, int]:
    """(rows, rows beyond the first of each group of equal rows).

    Only an 8-byte hash per row is shuffled at first. Rows whose hash is unique
    cannot be duplicates; the others are compared in full.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[col(c) for c in df.columns]))
    sizes = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("shared")).first()
    rows, shared = facts["rows"] or 0, facts["shared"] or 0
    if not shared:
        return rows, 0
    suspects = hashed
    if shared <= MAX_BROADCAST_HASHES:
        keys = sizes.where(F.col("n") > 1).select("_h")
        suspects = hashed.join(F.broadcast(keys), "_h", "left_semi")
    groups = suspects.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return rows, groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).first()["d"]


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls compare equal."""
    rows, extra = _count_duplicates(df)
    percent = extra / rows * 100 if rows else 0.0
    return local_table(
        df.sparkSession,
        [(rows, extra, percent)],
        "row_count bigint, duplicate_count bigint, duplicate_percent double",
    )


def quality_summary(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and missing cells."""
    rows, extra = _count_duplicates(df)
    cells = [_missing(f.name, f.dataType).cast("int") for f in df.schema.fields]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return df.agg(
        F.lit(rows).cast("long").alias("row_count"),
        F.lit(extra).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("missing_cells"),
    )


def shape(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows, columns, and how many features are numeric / categorical."""
    numeric, categorical = split_by_type(df, (target,) if target else ())
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric)).alias("numeric_features"),
        F.lit(len(categorical)).alias("categorical_features"),
    )


def category_target_rate(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Count and target rate of every value of every categorical column, with cardinality."""
    names = {f"f{i}": c for i, c in enumerate(columns)}
    long = df.select(
        col(target).cast("double").alias("_y"), *[col(c).cast("string").alias(k) for k, c in names.items()]
    ).unpivot(["_y"], list(names), "series", "category")
    groups = long.groupBy("series", "category").agg(
        F.count("_y").alias("count"), (F.avg("_y") * 100).alias("target_yes_percent")
    )
    # One row per column.
    sizes = groups.groupBy("series").agg(F.count(F.lit(1)).alias("cardinality"))
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return groups.join(F.broadcast(sizes), "series").select(
        named[F.col("series")].alias("column"), "category", "count", "target_yes_percent", "cardinality"
    )


def target_rate_table(
    df: DataFrame, column: str, target: str, min_count: int = 25, top: int | None = None
) -> DataFrame:
    """Target rate (percent) by value, for values with enough rows, best first.

    ``top`` keeps the report's first lines.
    """
    out = (
        df.groupBy(col(column).alias("category"))
        .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(col(target)) * 100, 2).alias("yes_rate"))
        .where(F.col("count") >= min_count)
        .orderBy(F.col("yes_rate").desc(), F.col("category"))
    )
    return out if top is None else out.limit(top)


def numeric_summary(df: DataFrame) -> DataFrame:
    """Mean, median, min, max and bias-adjusted skewness of each numeric column."""
    names, _ = split_by_type(df)
    found = exact_quantiles(
        df,
        numeric_columns(df, names),
        [0.5],
        extra={"mean": F.avg, "min": F.min, "max": F.max, "skew": adjusted_skewness},
    )
    rows = [
        (n, r.extra["mean"], r.values.get(0), r.extra["min"], r.extra["max"], r.extra["skew"])
        for n, r in found.items()
    ]
    schema = "column string, mean double, median double, min double, max double, skew double"
    return local_table(df.sparkSession, rows, schema)


def describe_numeric(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max of each numeric column."""
    names, _ = split_by_type(df)
    found = exact_quantiles(
        df,
        numeric_columns(df, names),
        [0.25, 0.5, 0.75],
        extra={"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )
    rows = [
        (n, r.n, r.extra["mean"], r.extra["std"], r.extra["min"], *[r.values.get(i) for i in range(3)], r.extra["max"])
        for n, r in found.items()
    ]
    schema = (
        "column string, count bigint, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double"
    )
    return local_table(df.sparkSession, rows, schema)


def text_labels(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Text columns with texts longer than a digest replaced by their digest, so that no long text is moved."""
    return {n: F.when(F.length(col(n)) > 32, F.md5(col(n))).otherwise(col(n)) for n in names}


def token_summary(df: DataFrame, token: str = "unknown") -> DataFrame:
    """Text columns that hold the token: its count and percent, and the column's distinct values."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = label_counts(df, text_labels(df, names))
    mark = F.lit(token) if len(token) <= 32 else F.md5(F.lit(token))
    per = counts.groupBy(F.col("feature").alias("column")).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("label") == mark, F.col("n"))), F.lit(0)).alias("token_count"), F.count(F.lit(1)).alias("unique_count")
    )
    percent = F.round(F.when(F.col("rows") > 0, F.col("token_count") / F.col("rows") * 100), 2).alias("token_percent")
    rows = per.where("token_count > 0").select("column", "token_count", percent, "unique_count")
    return rows.orderBy(F.col("token_percent").desc(), "column")


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """Pearson correlation of each numeric column with the target, strongest first."""
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != target]
    values = numeric_columns(df, [*names, target])
    row = df.agg(*[F.corr(values[n], values[target]).alias(f"r{i}") for i, n in enumerate(names)])
    out = _as_rows(row, names, {"correlation": [f"r{i}" for i in range(len(names))]})
    return out.orderBy(F.abs("correlation").desc_nulls_last(), "column")


def correlation_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(left, right, correlation) for all ordered pairs of numeric columns, each over the rows that have both, in one pass."""
    names = names or split_by_type(df)[0]
    return correlations(df, numeric_columns(df, names))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count and percent of each value, most frequent first; ``top`` keeps the report's first lines."""
    counts = df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).scalar()
    out = counts.select("value", "count", F.round(F.col("count") / total * 100, 2).alias("percent"))
    out = out.orderBy(F.col("count").desc(), F.col("value"))
    return out if top is None else out.limit(top)


def group_share(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Percent of each value within its group."""
    counts = df.groupBy(group.alias("group"), col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct (group, value), not per input row.
    total = F.sum("n").over(Window.partitionBy("group"))
    return counts.select("group", "value", F.round(F.col("n") / total * 100, 2).alias("percent"))


def order_bands(
    df: DataFrame, key: Column, tie_break: Column, means: dict[str, Column], bands: int = 10
) -> DataFrame:
    """Means per equal-count band of the row order (key, tie_break).

    Row i of n lies in band max(1, ceil(bands * i / (n - 1))). The rows at the
    band ends are found by rank search, first on the key and then, among rows
    with that very key, on the tie-break; each row then compares itself with them.
    """
    share = [b / bands for b in range(1, bands)]

    def ends(n: int) -> list[int]:
        return [b * (n - 1) // bands for b in range(1, bands)]

    first = values_at_ranks(df, {"k": key}, share, lambda _, n: ends(n), dtype="bigint")["k"]
    if not first.n:
        return df.groupBy(F.lit(1).alias("band")).agg(*[F.avg(v).alias(n) for n, v in means.items()])
    cuts = [(first.values[r], r - first.below[r]) for r in ends(first.n)]
    ties = values_at_ranks(
        df.where(key.isin(*{v for v, _ in cuts})),
        {f"t{i}": F.when(key == F.lit(v), tie_break) for i, (v, _) in enumerate(cuts)},
        [0.0, 0.5, 1.0],
        lambda name, _: [cuts[int(name[1:])][1]],
        dtype="bigint",
    )
    band = F.lit(1)
    for i, (v, r) in enumerate(cuts):
        after = (key > F.lit(v)) | ((key == F.lit(v)) & (tie_break > F.lit(ties[f"t{i}"].values[r])))
        band = band + after.cast("int")
    return df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(v), 3).alias(n) for n, v in means.items()]
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width bins of each column, optionally per class with per-class density.

    The last bin is closed. (column, bin, [class,] lower, upper, n, density);
    empty bins give no row.
    """
    values = numeric_columns(df, columns)
    limits = df.agg(
        *[F.min(values[c]).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(values[c]).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    known = [(i, c) for i, c in enumerate(columns) if limits[f"lo{i}"] is not None]
    span = {}
    for i, c in known:
        lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
        span[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    cells = [
        F.when(
            values[c].isNotNull(),
            F.least(F.width_bucket(values[c], F.lit(span[c][0]), F.lit(span[c][1]), F.lit(bins)), F.lit(bins)),
        )
        .cast("int")
        .alias(f"b{i}")
        for i, c in known
    ]
    keys = [col(by).alias("class")] if by else []
    names = ["class"] if by else []
    long = df.select(*keys, *cells).unpivot(names, [f"b{i}" for i, _ in known], "series", "bin")
    counts = long.where(F.col("bin").isNotNull()).groupBy("series", "bin", *names).agg(F.count(F.lit(1)).alias("n"))
    facts = F.create_map(
        *[
            x
            for i, c in known
            for x in (
                F.lit(f"b{i}"),
                F.struct(F.lit(c).alias("c"), F.lit(span[c][0]).alias("lo"), F.lit((span[c][1] - span[c][0]) / bins).alias("w")),
            )
        ]
    )[F.col("series")]
    # At most ``bins`` rows per column and class.
    total = F.sum("n").over(Window.partitionBy("series", *names))
    return counts.select(
        facts["c"].alias("column"),
        *names,
        "bin",
        (facts["lo"] + facts["w"] * (F.col("bin") - 1)).alias("lower"),
        (facts["lo"] + facts["w"] * F.col("bin")).alias("upper"),
        "n",
        (F.col("n") / total / facts["w"]).alias("density"),
    )
