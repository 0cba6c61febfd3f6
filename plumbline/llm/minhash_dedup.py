"""Near duplicates by MinHash: many universal hash minima with banding, signature check, verification, and connected components.

A document is its set of distinct word shingles. Two documents link when ``100 * |intersection| >= percent * |union|``.

1. Equal sets are one class from the start, named by a digest. A class keeps `MINIMA` minima of its shingle hashes under universal hash
   functions (multiply, add, keep the high bits).
2. Bands of `ROWS` minima each put classes into buckets. Two sets of Jaccard similarity 0.8 share none of the 40 buckets with a
   probability of 7e-10, and fewer than two with 2e-8.
3. In each bucket of the first `STARS` bands every class is compared with the one whose buckets hold the most classes (an original shares
   more buckets with its copies than these with each other). Components of the links are contracted; after that only classes of different
   components that share a bucket of any band are compared, in the first one they share. Buckets with more than `CROWD` classes are taken
   apart by a second band: linked classes share two bands.
4. A pair is a candidate if its sizes fit, its signatures (four bits of each minimum) agree in as many places as all but one in 10^9 of the
   pairs at the bound do, and its parity bitmaps differ in no more bits than linked sets do in shingles. Candidates are confirmed on their
   whole sets.
5. Components by alternating large-star and small-star.

Rows without words have no shingles, link to nothing and are their own component. A null id takes part like any other; it is never the
least id of a component unless all are null, and such a component has a null id and keeps all of its rows. Repeated ids are separate rows.
Other columns, whatever their names, are not read; the result has `id_col`, `n_shingles`, `component_id` and `kept` only. An empty table
gives an empty result. Texts of any length are read whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pairs import bitmap, compared
from plumbline.llm.tables import components, drop, written
from plumbline.llm.texts import digest, linked, shingle_sets, text_name
from plumbline.llm.words import Hasher, mix, slices

#: Hash minima of a signature, and minima in a band.
MINIMA, ROWS = 160, 4
#: Minima of which four bits fill one 64-bit number of the short signature.
_PLACES = 16
#: Bands of which the buckets make stars.
STARS = 8
#: Classes that are compared within one bucket without taking it apart.
CROWD = 4096
#: Shingles hashed at once.
_CHUNK = 4096

_SEEDS = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
_MULTIPLY = (_SEEDS[:MINIMA] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_ADD = (_SEEDS[MINIMA:] >> np.uint64(32)).astype(np.uint32)[:, None]


def minima(distinct: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set of 64-bit hashes."""
    x = (distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), _CHUNK):
            np.minimum(out, (_MULTIPLY * x[a : a + _CHUNK] + _ADD).min(axis=1), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name for each `ROWS` minima."""
    rows = signature.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return h.view(np.int64)


def short(signature: np.ndarray) -> np.ndarray:
    """Four mixed bits of each minimum, 16 to a 64-bit number."""
    nibbles = (mix(signature.astype(np.uint64)) & np.uint64(15)).reshape(-1, _PLACES)
    return np.bitwise_or.reduce(nibbles << (np.arange(_PLACES, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def least_agreeing(percent: int, missed: float = 1e-9) -> int:
    """Places in which short signatures agree at least, but for `missed` of the pairs at the bound."""
    p = percent / 100 + (1 - percent / 100) / 16
    total = 0.0
    for places in range(MINIMA + 1):
        total += comb(MINIMA, places) * p**places * (1 - p) ** (MINIMA - places)
        if total > missed:
            return places
    return MINIMA


def _agreeing(x: Column, y: Column) -> Column:
    """Places in which two short signatures agree."""
    differ = F.lit(0)
    for i in range(MINIMA // _PLACES):
        d = x[i].bitwiseXOR(y[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(d)
    return F.lit(MINIMA) - differ


def _near(x: Column, y: Column, percent: int) -> Column:
    """Sizes fit and signatures agree; both are structs of n and sig."""
    fit = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    return fit & (_agreeing(x["sig"], y["sig"]) >= least_agreeing(percent))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _marked(plain: DataFrame, k: int) -> DataFrame:
    """Id, text name, number of shingles, class, buckets and short signature of every row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, none = Hasher(), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, names, buckets, signatures, bits = [], [], [], [], []
                for distinct in shingle_sets(part.column("text"), hasher, k):
                    some = len(distinct) > 0
                    signature = minima(distinct) if some else None
                    sizes.append(len(distinct))
                    names.append(digest(distinct) if some else None)
                    buckets.append(bands(signature) if some else none)
                    signatures.append(short(signature) if some else none)
                    bits.append(bitmap(distinct) if some else none)
                made = {"n": pa.array(sizes, pa.int64()), "cls": pa.array(names, pa.binary()), "bands": _lists(buckets)}
                made |= {"sig": _lists(signatures), "bits": _lists(bits)}
                yield pa.record_batch({"id": part.column("id"), "name": part.column("name")} | made)

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(mark, f"id {kind}, name struct<h:long,g:int,l:int>, n long, cls binary, bands array<long>, sig array<long>, bits array<long>")


def _buckets(classes: DataFrame, few: int = MINIMA // ROWS) -> DataFrame:
    """A row for each class and bucket of the first `few` bands; `band` is the number of the band."""
    return classes.select("c", "component", F.posexplode(F.slice("bands", 1, few)).alias("band", "bucket"))


def _several(lists: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component, with the number of rows of the bucket (`m`)."""
    sizes = lists.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
    return lists.join(sizes.where("low <> high").select("bucket", "m"), "bucket")


def _apart(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `lists`, with crowded buckets taken apart by every second bucket of their classes (band 0: pairs may come up again)."""
    if not lists.where(F.col("m") > CROWD).head(1):
        return lists
    hot = lists.where(F.col("m") > CROWD).select("c", F.col("bucket").alias("one"))
    two = hot.join(_buckets(classes).withColumnRenamed("bucket", "other"), "c").where("one <> other")
    name = F.xxhash64(F.least("one", "other"), F.greatest("one", "other")).alias("bucket")
    pairs = _several(two.select("c", "component", F.lit(0).alias("band"), name).distinct())
    return lists.where(F.col("m") <= CROWD).unionByName(pairs)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Every row's id with `n_shingles`, `component_id` (the least id reachable by links) and `kept` (it is that id)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_name(text_col).alias("name"))
    marks = written(_marked(plain, k))
    classes = marks.where("n > 0").groupBy("cls").agg(
        F.min("id").alias("least"), F.min("name").alias("name"), *(F.first(x).alias(x) for x in ("n", "bands", "sig", "bits"))
    )
    classes = written(classes.withColumns({"c": F.xxhash64("cls"), "marks": F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))}))

    # Stars in the first buckets: linked classes share one of them nearly always, and equal parts of the table meet in few rows.
    signed = classes.select("c", "cls", F.struct("n", "sig").alias("s"))
    posts = _buckets(classes.withColumn("component", F.lit(None)), STARS).select("c", "bucket")
    sizes = posts.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    held = written(posts.join(sizes, "bucket"))
    weight = held.groupBy("c").agg(F.sum("m").alias("weight"))
    hubs = held.join(weight, "c").groupBy("bucket").agg(F.max(F.struct("weight", "c"))["c"].alias("hub"))
    star = held.join(hubs, "bucket").where("c <> hub").select("hub", "c").distinct()
    one, two = (signed.select(F.col("c").alias(c), F.col("cls").alias(a), F.col("s").alias(s)) for c, a, s in (("hub", "a", "x"), ("c", "b", "y")))
    near = star.join(one, "hub").join(two, "c").where(_near(F.col("x"), F.col("y"), percent)).select("a", "b")
    first = linked(written(near), plain, classes, k, percent)

    # What is left: classes of different components in one bucket of any band. Numbers of 8 bytes stand for classes and components in the
    # buckets; the digest tells classes apart in the candidates.
    label = written(components(first))
    named = classes.join(label.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.xxhash64(F.coalesce("component", "cls")))
    named = written(named.select("c", "cls", "component", "bands", "n", "sig", "bits", "marks"))
    lists = written(_apart(_several(_buckets(named)), named).select("bucket", "band", "c", "component", "m"))
    more = compared(lists.join(named.drop("component", "bands"), "c"), percent, least_agreeing(percent)).distinct()
    second = linked(written(more), plain, classes, k, percent)
    # The components found so far are stars already.
    stars = label.where("vertex <> component").select(F.col("vertex").alias("a"), F.col("component").alias("b"))
    final = written(components(stars.union(second))) if second.head(1) else label

    ids = classes.select("cls", "least").join(final.withColumnRenamed("vertex", "cls"), "cls", "left")
    ids = written(ids.select("cls", "least", F.coalesce("component", "cls").alias("component")))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = written(ids.join(least, "component").select("cls", "component_id"))
    for done in (classes, held, named, lists, label, first, second, final, ids):
        drop(spark, done)
    out = marks.select("id", "n", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
