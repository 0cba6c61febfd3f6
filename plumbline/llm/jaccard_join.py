"""Exact Jaccard join of documents on word n-grams, with token-combination prefixes.

A document is its set of distinct word n-grams. Two documents link when ``100 * |intersection| >= percent * |union|``. The result is
one row per document with the component of the link graph it belongs to.

1. A sketch over all documents counts words and n-grams in hashed counters. It orders n-grams by rarity (frequency class, then the
   product of the word counts, then hash) and puts n-grams that many documents share into higher classes. Any order gives the same
   links; a good one gives few candidates.
2. A set x can miss at most ``t(x) = |x| - ceil(percent/100 * |x|)`` of its n-grams in a partner. Rare n-grams (class 1) are indexed one
   by one; n-grams of class k >= 2 are dealt into groups and indexed as k-combinations within their group. A prefix with p n-grams of a
   group of class k keeps a combination unless p - k + 1 of them are missing, so the prefix is extended until these numbers sum to more
   than t(x); then linked sets share an entry. Combinations keep the lists of passages and copies that a large share of the documents
   hold short.
3. Exact copies (one digest of the set) are one class. In each list every class is first compared with the most ordinary one of its size
   (the star round); components of those links are contracted. Further rounds have several hubs in each list, each with the closest class
   of every other component, which joins large groups whose copies are far from the first one. After that classes of different components
   are compared, list by list, lists of the same classes once, in blocks of bounded size. Parity bitmaps rule pairs out where they stand, so
   hardly any but links leave a list.
4. Each candidate pair is verified on its texts.

Rows without words have 0 n-grams, link to nothing and are their own component. A null id takes part like any other; it is never the
least id of a component unless all are null. Repeated ids are separate rows. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pairs import BITMAP, bitmap, compared, starred
from plumbline.llm.tables import components, drop, free, written
from plumbline.llm.texts import linked
from plumbline.llm.words import Hasher, mix, per_text, shingles, slices, utf8

#: Hashed counters of each sketch, and counters per row of the sketch while it is summed.
COUNTERS, BLOCK = 1 << 18, 1 << 13
#: Classes 2 and 3 hold n-grams that this share of the documents contains.
SHARES = (0.01, 0.1)
#: Rounds of further hubs at most; one that finds less than a tenth of the links of the one before is the last.
TURNS = 6


def _sets(batch: pa.RecordBatch, column: str, hasher: Hasher, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: its words, its n-grams in order of position, made distinct, and where each stands first."""
    data, offsets = utf8(batch.column(column))
    starts, _, words = hasher.words(data, offsets)
    counts = per_text(starts, offsets)
    grams, made = shingles(words, counts, k)
    w = s = 0
    for c, m in zip(counts, made, strict=True):
        distinct, at = np.unique(grams[s : s + m], return_index=True)
        yield words[w : w + c], distinct, at
        w, s = w + c, s + m


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def _digest(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def _sketch(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Two rows of counters: occurrences of words, and documents with an n-gram. Fixed size, so it may go to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, totals = Hasher(), np.zeros((2, COUNTERS), np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                data, offsets = utf8(part.column(text_col))
                starts, _, words = hasher.words(data, offsets)
                totals[0] += np.bincount(_slot(words), minlength=COUNTERS)
                totals[1] += np.bincount(_slot(shingles(words, per_text(starts, offsets), k)[0]), minlength=COUNTERS)
        blocks = totals.reshape(-1, BLOCK)
        yield pa.record_batch({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in blocks])})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "block int, counts binary"
    rows = docs.select(text_col).mapInArrow(count, schema)
    # Summed in two steps, so that no group holds a row of every task.
    rows = rows.groupBy("block", F.floor(F.spark_partition_id() / 64)).applyInPandas(add, schema)
    got = {r["block"]: r["counts"] for r in rows.groupBy("block").applyInPandas(add, schema).collect()}
    if not got:
        return np.zeros((2, COUNTERS), np.int64)
    return np.frombuffer(b"".join(zlib.decompress(got[b]) for b in sorted(got)), np.int64).reshape(2, COUNTERS)


def entries(words: np.ndarray, distinct: np.ndarray, at: np.ndarray, k: int, percent: int, rarity: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Index entries of one set: single rare n-grams and k-combinations of frequent ones, from its extended prefix.

    `rarity` has the logarithm of each word counter, `classes` the class of each n-gram counter. Entries are tagged with a size level, a
    power of two; a set has those of every level a partner may have, so that the number of groups can follow the size.
    """
    n = len(distinct)
    least_partner, most_partner = -(-n * percent // 100), n * 100 // percent
    if most_partner == n and least_partner == n:  # only equal sets link
        return np.zeros(0, np.uint64)
    missing = n - least_partner
    seen = rarity[_slot(words)]
    score = sum(seen[np.minimum(at + i, len(seen) - 1)] for i in range(k))
    cls = classes[_slot(distinct)]
    order = np.lexsort((distinct, score, cls))
    tokens, cls = distinct[order], cls[order]
    out = []
    for level in range(least_partner.bit_length(), most_partner.bit_length() + 1):
        tag = mix(np.array([level], np.uint64))[0]
        cut = int(np.searchsorted(cls, 2))
        if cut > missing:  # class 1 alone reaches the bound
            out.append(mix(tokens[: missing + 1] ^ tag))
            continue
        out.append(mix(tokens[:cut] ^ tag))
        need, members = missing + 1 - cut, {}
        deal = mix(tokens[cut:] ^ np.uint64(0xA5A5A5A5))
        for token, c, d in zip(tokens[cut:].tolist(), cls[cut:].tolist(), deal.tolist(), strict=True):
            group = (c, d % max(1, (1 << level) >> 6))
            held = members.setdefault(group, [])
            held.append(token)
            need -= len(held) >= c
            if need <= 0:
                break
        for (c, g), held in members.items():
            if len(held) >= c:
                made = np.array(list(combinations(sorted(held), c)), np.uint64)
                h = np.full(len(made), c * 1_000_003 + g, np.uint64)
                for j in range(c):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + made[:, j])
                out.append(mix(h ^ tag))
    return np.concatenate(out)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _classified(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's id, text name, size and class (columns id, name, n, cls), and every class's component with its smallest id."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    # Two hashes and the length name a text, so that texts of few classes can be picked without encoding all of them again.
    name = F.struct(F.xxhash64(text_col).alias("h"), F.hash(text_col).alias("g"), F.octet_length(text_col).alias("l"))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), name.alias("name"))
    counters = _sketch(plain, "text", k)
    n_docs = plain.count()
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    rarity = context.broadcast(np.log1p(counters[0]).astype(np.float32))
    known = context.broadcast((1 + sum((counters[1] >= max(16, share * n_docs)).astype(np.int8) for share in SHARES)).astype(np.int8))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, digests, scores, lists, bits = [], [], [], [], []
                for words, distinct, at in _sets(part, "text", hasher, k):
                    sizes.append(len(distinct))
                    digests.append(_digest(distinct) if len(distinct) else None)
                    scores.append(float(rarity.value[_slot(words)].mean()) if len(words) else 0.0)
                    lists.append(entries(words, distinct, at, k, percent, rarity.value, known.value).view(np.int64) if len(distinct) else np.zeros(0, np.int64))
                    bits.append(bitmap(distinct) if len(lists[-1]) else np.zeros(0, np.int64))
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "name": part.column("name"),
                        "n": pa.array(sizes, pa.int64()),
                        "cls": pa.array(digests, pa.binary()),
                        "score": pa.array(scores, pa.float32()),
                        "bits": _lists(bits),
                        "entries": _lists(lists),
                    }
                )

    kind = plain.schema["id"].dataType.simpleString()
    marks = written(plain.mapInArrow(mark, f"id {kind}, name struct<h:long,g:int,l:int>, n long, cls binary, score float, bits array<long>, entries array<long>"))
    # Only an entry and a class number of 8 bytes each are shuffled for all entries; the digest tells classes apart from there on.
    posts = marks.select(F.xxhash64("cls").alias("c"), F.explode("entries").alias("entry"))
    lists = posts.groupBy("entry").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("entry")
    held = written(posts.join(lists, "entry").distinct())
    marked = marks.where(F.size("bits") > 0).select("cls", F.xxhash64("cls").alias("c"), "n", "score", "bits", "name")
    classes = marked.join(held.select("c").distinct(), "c", "left_semi").groupBy("cls", "c")
    classes = classes.agg(*(F.first(x).alias(x) for x in ("n", "score", "bits")), F.min("name").alias("name"))
    classes = written(classes.withColumn("level", _level(F.col("n"))))
    shared = held.join(classes.select("c", "cls", "score", "level"), "c").drop("c")

    # The most ordinary words first: an original before its edited copies.
    hubs = shared.groupBy("entry", "level").agg(F.min(F.struct(-F.col("score"), "cls")).alias("hub"))
    star = shared.join(hubs, ["entry", "level"]).where("cls <> hub.cls").select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct()
    near = written(_near(star, classes, percent))
    first = linked(near, plain, classes, k, percent)
    label = written(components(first))

    # What is left: classes of different components in one list. Lists of the same classes are one list.
    several = _named(classes, label).join(held, "c")
    ways = F.struct(F.count("*").alias("m"), F.bit_xor("c").alias("x"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("s")).alias("same")
    several = several.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), ways).where("low <> high")
    several = several.groupBy("same").agg(F.min("entry").alias("entry")).select("entry")
    lists = written(held.join(several, "entry").select(F.col("entry").alias("bucket"), "c"))
    done = [held, near, first, label]

    # The hub of the first round may be far from most copies of a large group. Other hubs of each list, tried until its rows are near one,
    # join such groups before all pairs are compared.
    before, more_turns = first.count(), True
    for turn in range(TURNS + 1):
        named = written(_named(classes, label).select("c", "cls", "component", "n", "bits"))
        sizes = lists.join(named.select("c", "component"), "c").groupBy("bucket")
        sizes = sizes.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high")
        open_ = written(lists.join(sizes.select("bucket", "m"), "bucket"))
        if turn == TURNS or not more_turns or not open_.head(1):
            break
        star = written(starred(open_.join(named, "c"), percent, turn).distinct())
        found = linked(star, plain, classes, k, percent)
        drop(spark, star)
        done.append(found)
        many = found.count()
        if not many:
            break
        label = written(components(_links(label).union(found)))
        done.append(label)
        before, more_turns = many, 10 * many >= before
        drop(spark, named)
        drop(spark, open_)

    # Pairs of each list are compared by their parity bitmaps where they stand, so that hardly any but links leave it.
    more = written(compared(open_.join(named, "c"), percent).distinct())
    second = linked(more, plain, classes, k, percent)
    final = components(_links(label).union(second)) if second.head(1) else label

    ids = marks.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"))
    ids = ids.join(final.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = written(ids)
    for table in (*done, classes, lists, named, open_, more, second):
        drop(spark, table)
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    return marks.select("id", "name", "n", "cls"), ids.join(least, "component").select("cls", "component", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """Every row's id with `n_shingles` and `component_id` (the smallest id reachable by links), by the method above."""
    rows, classes = _classified(docs, id_col, text_col, k, percent)
    return rows.join(classes, "cls", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row of `docs` per component: the one with the smallest id, of equal or null ids that with the least text hash.

    Rows without words are components of their own; of rows with the same id and text only one stays.
    """
    rows, classes = _classified(docs, id_col, text_col, k, percent)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "name")
    best = rows.join(classes, "cls").groupBy("component").agg(F.min(best).alias("best")).select("best.id", "best.name")
    names = [free(docs, n) for n in ("i", "h", "g", "l")]
    made = dict(zip(names, (F.xxhash64(id_col), F.xxhash64(text_col), F.hash(text_col), F.octet_length(text_col))))
    key = [c.alias(n) for n, c in zip(names, (F.xxhash64("id"), F.col("name.h"), F.col("name.g"), F.col("name.l")))]
    stay = best.select(*key).union(rows.where("cls IS NULL").select(*key).distinct())
    named = docs.withColumns(made)
    for c in names:  # a null text has no length
        named, stay = named.withColumn(c, F.coalesce(c, F.lit(-1).cast(named.schema[c].dataType))), stay.withColumn(c, F.coalesce(c, F.lit(-1).cast(named.schema[c].dataType)))
    return named.join(stay, names, "left_semi").dropDuplicates(names).drop(*names)


def _named(classes: DataFrame, label: DataFrame) -> DataFrame:
    """`classes` with a number for the component of each."""
    named = classes.join(label.withColumnRenamed("vertex", "cls"), "cls", "left")
    return named.withColumn("component", F.xxhash64(F.coalesce("component", "cls")))


def _links(label: DataFrame) -> DataFrame:
    """The links (a, b) of components, which are stars."""
    return label.where("vertex <> component").select(F.col("vertex").alias("a"), F.col("component").alias("b"))


def _level(n: Column) -> Column:
    """Size level: grows with the size, one step for a ninth more."""
    return F.floor(F.log(n) / math.log(10 / 9)).cast("int")


def _fits(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """False only where sizes or differing bits rule a link out: linked sets differ in (100 - p)/(100 + p) of their sizes' sum at most."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    narrow = classes.select("cls", "n", "bits")
    p = pairs.join(narrow.select(F.col("cls").alias("a"), F.struct("n", "bits").alias("x")), "a")
    p = p.join(narrow.select(F.col("cls").alias("b"), F.struct("n", "bits").alias("y")), "b")
    differ = sum(F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITMAP))
    return p.where(_fits(F.col("x.n"), F.col("y.n"), differ, percent)).select("a", "b")
