"""The given tables in monitoring roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.workloads.registry import Tables

REFERENCE_END = "2024-01-16"
NUMERIC = ["value", "user_id", "k"]
CATEGORICAL = ["event_type"]
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(column: str | Column) -> Column:
    """Timestamp as text, so that results compare across engines."""
    return F.date_format(column, STAMP)


def prediction_log(events: DataFrame) -> DataFrame:
    """Events as a log of scored records: prediction 1 for a value of 50 or more."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "value",
        F.col("user_id").cast("double").alias("user_id"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        "event_type",
        (F.col("value") >= 50).cast("int").alias("prediction"),
        F.concat(F.lit("v"), (1 + F.floor(F.dayofmonth("ts") / 10)).cast("string")).alias("model_version"),
    )


def reference_part(log: DataFrame) -> DataFrame:
    return log.where(F.col("created_at") < F.lit(REFERENCE_END).cast("timestamp"))


def current_part(log: DataFrame) -> DataFrame:
    return log.where(F.col("created_at") >= F.lit(REFERENCE_END).cast("timestamp"))


def labelled_documents(t: Tables) -> DataFrame:
    """Documents with a quality label and a score that falls with length."""
    score = 1500.0 / (F.col("n_chars") + 1500.0)
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id").withColumn("score", score)


# The same as SQL common table expressions.
LOG_SQL = f"""
log AS (
  SELECT event_id AS id, ts AS created_at, value, user_id::DOUBLE AS user_id,
         json_extract_string(props, '$.k')::DOUBLE AS k, event_type,
         CASE WHEN value >= 50 THEN 1 ELSE 0 END AS prediction,
         'v' || (1 + day(ts) // 10) AS model_version
  FROM events),
ref AS (SELECT * FROM log WHERE created_at < TIMESTAMP '{REFERENCE_END}'),
cur AS (SELECT * FROM log WHERE created_at >= TIMESTAMP '{REFERENCE_END}'),
win AS (SELECT * FROM log ORDER BY created_at DESC, id DESC LIMIT 200)"""

LABELLED_SQL = """
labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         1500.0::DOUBLE / (d.n_chars + 1500.0::DOUBLE) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
