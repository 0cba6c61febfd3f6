"""Chains over ordered rows of any size: the next row beyond a distance, positions, and what can be reached from a first row."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, local_table
from plumbline.sources.folders import ensure_checkpoint_folder

log = logging.getLogger(__name__)


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes of `starts` (column node) and all that follow them along `links` (node, next; at most one row per node).

    Pointers are doubled: after round i they lead 2^i links on, and what is reached grows to the first 2^i nodes of each chain. So a chain of n
    links takes log2(n) rounds, each a join of all pointers that still lead somewhere. Chains must not be circular.
    """
    ensure_checkpoint_folder(links.sparkSession)
    jumps = links.where(F.col("next").isNotNull()).select("node", "next").checkpoint()
    reached = starts.select("node").distinct().checkpoint()
    rounds = 0
    while not jumps.isEmpty():
        reached = reached.union(reached.join(jumps, "node").select(F.col("next").alias("node"))).distinct().checkpoint()
        onward = jumps.select(F.col("node").alias("next"), F.col("next").alias("further"))
        jumps = jumps.join(onward, "next").select("node", F.col("further").alias("next")).checkpoint()
        rounds += 1
    log.info("%d rounds of pointer doubling", rounds)
    return reached


def first_beyond(points: DataFrame, gap: int) -> DataFrame:
    """(k, t, next): for each of the `points` (k, t), the least time of its key that is greater than t + gap; null where there is none.

    Points and the places t + gap are sorted together, latest first, in ranges over all keys; the latest point seen so far is the answer. What
    a range takes over from the one before is a row per range, so a key with any number of points is spread over many tasks.
    """
    spark = points.sparkSession
    ensure_checkpoint_folder(spark)
    key_type = points.schema["k"].dataType.simpleString()
    both = points.select("k", F.col("t").alias("at"), F.lit(True).alias("point"), "t")
    both = both.unionByName(points.select("k", (F.col("t") + gap).alias("at"), F.lit(False).alias("point"), "t"))
    # A point at the very place is not beyond it, so it comes behind.
    order = [F.col("k"), F.col("at").desc(), F.col("point")]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = key = last = part = None  # first key of the range; key and latest point so far
        for batch in batches:
            if batch.empty:
                continue
            k, at, point = batch["k"].to_numpy(object), batch["at"].to_numpy(), batch["point"].to_numpy()
            if part is None:
                part, first, key = int(batch["part"].iloc[0]), k[0], k[0]
            change = np.append(k[0] != key, k[1:] != k[:-1])
            row = np.arange(len(k))
            begin = np.maximum.accumulate(np.where(change, row, -1))  # -1: the key goes on from the batch before
            seen = np.maximum.accumulate(np.where(point, row, -1))
            here = seen > np.where(begin < 0, -1, begin - 1)
            found = pd.array(np.where(here, at[np.maximum(seen, 0)], 0), "Int64")
            found[~here] = pd.NA
            if last is not None:
                found[~here & (begin < 0)] = last
            ask = ~point
            out = pd.DataFrame({"part": part, "k": k, "t": batch["t"].to_numpy(), "next": found, "edge": False})
            out["open"] = out["next"].isna() & (k == first)
            yield out[ask]
            key = k[-1]
            last = int(at[seen[-1]]) if here[-1] else (last if begin[-1] < 0 else None)
        if part is not None:
            yield pd.DataFrame({"part": [part], "k": [key], "t": [0], "next": pd.array([pd.NA if last is None else last], "Int64"), "edge": True, "open": False})

    found = dealt.mapInPandas(carry, f"part int, k {key_type}, t long, next long, edge boolean, open boolean").checkpoint()
    # One row per range.
    edges, taken, before = sorted(found.where("edge").select("part", "k", "next").collect()), [], None
    for part, key, last in edges:
        if before is not None:
            taken.append((part, *before))
        if last is not None:
            before = (key, last)
        elif before is not None and before[0] != key:
            before = None
    given = local_table(spark, taken, f"part int, k {key_type}, given long")
    asked = found.where("NOT edge").join(F.broadcast(given), ["part", "k"], "left")
    return asked.select("k", "t", F.when(F.col("open"), F.col("given")).otherwise(F.col("next")).alias("next"))


def numbered(df: DataFrame, key: str, order: tuple[str, ...], name: str = "position") -> DataFrame:
    """`df` with each row's position (from 1) among the rows of its key, in the given order.

    Rows are sorted in ranges over all keys, so a key of any size is spread over many tasks; what a range adds to the positions of the next
    one is a row per range. Rows equal in `key` and `order` are numbered in any order, always the same within one run.
    """
    ensure_checkpoint_folder(df.sparkSession)
    inside = lambda c: F.col("row").getField(c)
    by = [inside(key), *[inside(c) for c in order]]
    packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"))  # columns of any name stay apart from those made here
    dealt = packed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    # A key's rows of one range stand one behind the other, so counting on is enough.
    dealt = dealt.withColumns({"at": F.monotonically_increasing_id(), "key": inside(key)}).checkpoint()
    runs = dealt.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # Only the first key of a range may have begun in an earlier one: as many rows as there are ranges.
    edges = runs.groupBy("part").agg(F.min_by(F.struct("key", "n", "first"), "first").alias("a"), F.max_by(F.struct("key", "n", "first"), "first").alias("z"))
    offsets, before, total = [], None, 0
    for r in sorted(edges.collect(), key=lambda r: r["part"]):
        taken = total if before is not None and before == (r["a"]["key"],) else 0
        offsets.append((r["part"], r["a"]["first"], taken))
        total = r["z"]["n"] + (taken if r["a"]["first"] == r["z"]["first"] else 0)
        before = (r["z"]["key"],)
    given = F.broadcast(local_table(df.sparkSession, offsets, "part int, begin long, taken long"))
    begin = F.col("first") - F.when(F.col("first") == F.col("begin"), F.col("taken")).otherwise(0)
    starts = runs.join(given, "part").select("part", "key", begin.alias("start"))
    d, s = dealt.alias("d"), starts.alias("s")
    out = d.join(s, (F.col("d.part") == F.col("s.part")) & F.col("d.key").eqNullSafe(F.col("s.key")))
    return out.select("d.row.*", (F.col("d.at") - F.col("s.start") + 1).alias(name))
