"""Distinct shingles of whole texts, and checking candidate pairs of texts on them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import drop, written
from plumbline.llm.words import Hasher, per_text, shingles, utf8

#: Rows of (text name, class) that may be broadcast: about 50 bytes each.
MOST_NAMES = 200_000
#: Pairs that one task compares at least, if there are as many.
PAIRS = 256
#: Bytes of texts that are compared at once.
COMPARED = 4 << 20


def text_name(text_col: str) -> Column:
    """Two hashes and the length name a text, so that texts of few classes can be picked without encoding all of them again."""
    return F.struct(F.xxhash64(text_col).alias("h"), F.hash(text_col).alias("g"), F.octet_length(text_col).alias("l"))


def shingle_sets(texts: pa.Array, hasher: Hasher, k: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    data, offsets = utf8(texts)
    starts, _, words = hasher.words(data, offsets)
    grams, made = shingles(words, per_text(starts, offsets), k)
    at = 0
    for m in made.tolist():
        yield np.unique(grams[at : at + m])
        at += m


def digest(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def texts_of(plain: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text of each class in `pairs` (a, b); `plain` has name and text, `classes` has cls and name."""
    wanted = classes.select("cls", "name").join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls")
    if pairs.count() <= MOST_NAMES // 2:  # so at most MOST_NAMES classes
        wanted = F.broadcast(wanted)
    return plain.select("name", "text").join(wanted, "name").groupBy("cls").agg(F.first("text").alias("text"))


def linked(pairs: DataFrame, plain: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets link, as a written table."""
    tasks = math.ceil(pairs.count() / PAIRS) or 1
    texts = written(texts_of(plain, classes, pairs).coalesce(tasks))
    p = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").coalesce(tasks)
    p = p.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            a = 0
            sizes = np.diff(utf8(batch.column("text_a"))[1]) + np.diff(utf8(batch.column("text_b"))[1])
            while a < batch.num_rows:
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), COMPARED)))
                part, keep = batch.slice(a, b - a), []
                both = zip(shingle_sets(part.column("text_a"), hasher, k), shingle_sets(part.column("text_b"), hasher, k), strict=True)
                for x, y in both:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                a = b

    found = written(p.select("a", "b", "text_a", "text_b").coalesce(tasks).mapInArrow(compare, "a binary, b binary"))
    drop(plain.sparkSession, texts)
    return found
