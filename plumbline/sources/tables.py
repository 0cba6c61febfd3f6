"""Reading delimited files, and appending and reading monitoring tables."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.cleaning import strip_names

# Columns of the bank marketing campaign file, in file order.
BANK_SCHEMA = (
    "age bigint, job string, marital string, education string, default string, housing string, loan string, "
    "contact string, month string, day_of_week string, duration bigint, campaign bigint, pdays bigint, "
    "previous bigint, poutcome string, `emp.var.rate` double, `cons.price.idx` double, `cons.conf.idx` double, "
    "euribor3m double, `nr.employed` double, y string"
)


def sniff_delimiter(spark: SparkSession, path: str, candidates: str = ";,\t|") -> str:
    """Delimiter of a text file, from its header line."""
    try:
        line = spark.read.text(path).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"dataset not found: {path}") from error
    if line is None:
        raise ValueError(f"dataset is empty: {path}")
    return max(candidates, key=lambda d: len(next(csv.reader([line[0]], delimiter=d))))


def load_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A delimited file with a header. The schema is explicit; without one every column is text."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path))
    if schema is not None:
        reader = reader.schema(schema)
    return strip_names(reader.csv(path))


#: Partition column of tables stored by day.
DAY = "dt"


def append(df: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append to a Parquet table, optionally partitioned by the day of a timestamp column."""
    if day_of is None:
        df.write.mode("append").parquet(path)
        return
    df.withColumn(DAY, F.to_date(col(day_of))).write.mode("append").partitionBy(DAY).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None while nothing has been appended yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def newest(df: DataFrame, limit: int, time: str = "created_at", tie_break: str = "id") -> DataFrame:
    """The newest rows first, as a top-k."""
    return df.orderBy(col(time).desc(), col(tie_break).desc()).limit(limit)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_fingerprints(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, md5, sha256) of artifact files.

    Meant for model and schema files; a file is one row, so large data sets are
    fingerprinted with ``table_fingerprint`` instead.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: rows, and sum and xor of row hashes.

    Null positions enter the hash, so moving a value between columns shows.
    """
    nulls = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    h = F.xxhash64(*[col(c) for c in df.columns], nulls)
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.pmod("h", F.lit(2**31))), F.lit(0)).alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def as_of(value: str) -> Column:
    """A fixed timestamp in place of the current time, so that results repeat."""
    return F.lit(value).cast("timestamp")
