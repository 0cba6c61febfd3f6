"""From raw documents to token ids: low quality, near copies and benchmark items go, secrets are masked, the rest is encoded.

Stages run one after another over all that the stage before kept; each result is written as Parquet and read again. All but the last
return the columns of `documents`, and further ones whatever their names.

A null or empty text is scored, kept as it is and encoded as no ids; it is nobody's copy, holds no item and no secret. Of rows with the
same id and text one stays; rows that repeat an id with other texts are rows of their own. Ties between copies go to the least id, then to
the least text hash. Long texts are read whole by every stage. Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_pairs, decontamination, jaccard_join, quality_mil, secret_scan
from plumbline.llm.tables import free, small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; the classifier learns from the labels of four fifths of all ids."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    name = free(docs, "score")
    return quality_mil.score(docs, quality_mil.fit(docs, labels), out=name).where(F.col(name) >= 0.3).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    small_batches(spark)
    return jaccard_join.one_per_component(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mark; `n_chars` follows."""
    name, kind = free(docs, "secrets"), docs.schema["n_chars"].dataType
    found = secret_scan.find_secrets(docs, out=name)
    n_chars = F.when(F.size(name) > 0, F.lit(None)).otherwise(F.col("n_chars"))
    clean = secret_scan.redact(found.withColumn("n_chars", n_chars.cast(kind)), secrets=name)
    # Only texts without a count were masked, or had none before.
    return clean.withColumn("n_chars", F.coalesce("n_chars", F.length("text").cast(kind))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_pairs.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    return byte_pairs.decode(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("encode", encode)]

#: A trained network and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
