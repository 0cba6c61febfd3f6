"""Candidate pairs among the classes of lists of any length, by array operations on blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import mix

#: 64-bit numbers of a parity bitmap.
BITMAP = 32
#: Classes of a list that are compared with as many others in one group, and rows of these at once.
PART, ROWS = 2048, 64


def bitmap(distinct: np.ndarray) -> np.ndarray:
    """Parity of the n-grams that fall on each bit: two bitmaps differ in no more bits than their sets differ in n-grams."""
    bits = np.bincount((mix(distinct) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their groups of four bits the rows of two matrices of 64-bit numbers agree."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return 16 * x.shape[1] - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


@dataclass
class Classes:
    """Classes of a list, or of a part of it, as arrays. Signatures and marks may be left out."""

    component: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    sig: np.ndarray | None = None
    marks: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pa.Table) -> Classes:
        def matrix(name: str) -> np.ndarray | None:
            if name not in rows.column_names:
                return None
            return np.concatenate([x.flatten().to_numpy() for x in rows.column(name).chunks]).reshape(rows.num_rows, -1)

        component, n = (rows.column(c).to_numpy() for c in ("component", "n"))
        sig = matrix("sig")
        return cls(component, n, matrix("bits").view(np.uint64), None if sig is None else sig.view(np.uint64), matrix("marks"))

    def take(self, rows: np.ndarray) -> Classes:
        return Classes(*(None if x is None else x[rows] for x in (self.component, self.n, self.bits, self.sig, self.marks)))


def near_pairs(x: Classes, y: Classes | None, percent: int, agreeing: int = 0, band: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of `x` and of `y` (None: later rows of `x`) that are candidates.

    Their components differ, sizes fit, signatures agree in `agreeing` places, parity bitmaps differ in no more bits than linked sets do in
    n-grams, and no mark in front of the one numbered `band` is the same.
    """
    other = x if y is None else y
    for a in range(0, len(x.n), ROWS):
        n, m = x.n[a : a + ROWS, None], other.n
        good = (x.component[a : a + ROWS, None] != other.component) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if y is None:
            good &= np.arange(len(m)) > np.arange(a, a + len(n))[:, None]
        i, j = np.nonzero(good)
        i += a
        if x.sig is not None and len(i):
            keep = agreement(x.sig[i], other.sig[j]) >= agreeing
            i, j = i[keep], j[keep]
        if len(i):
            differ = np.bitwise_count(x.bits[i] ^ other.bits[j]).sum(axis=1, dtype=np.int64)
            keep = differ * (100 + percent) <= (x.n[i] + other.n[j]) * (100 - percent)
            i, j = i[keep], j[keep]
        if x.marks is not None and len(i):
            keep = np.argmax(x.marks[i] == other.marks[j], axis=1) >= band
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


def near_hubs(x: Classes, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of hubs, each with the closest candidate of every other component.

    Hubs are the first row, then the first one that is a candidate of no hub yet, and so on, until all rows are.
    """
    free = np.ones(len(x.n), bool)
    while free.any():
        hub = int(free.argmax())
        near = np.flatnonzero(100 * np.minimum(x.n, x.n[hub]) >= percent * np.maximum(x.n, x.n[hub]))
        differ = np.bitwise_count(x.bits[near] ^ x.bits[hub]).sum(axis=1, dtype=np.int64)
        fits = differ * (100 + percent) <= (x.n[near] + x.n[hub]) * (100 - percent)
        near = near[fits][np.argsort(differ[fits], kind="stable")]
        free[near] = False  # the hub is its own candidate
        near = near[np.unique(x.component[near], return_index=True)[1]]
        near = near[x.component[near] != x.component[hub]]
        if len(near):
            yield np.full(len(near), hub), near


def starred(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Candidates (a, b) of the hubs of each list, or of each part of a long one: a few for each row, so that large groups are joined.

    Columns as for `compared`. Every `turn` has an order of all classes, so lists that share classes mostly have the same hubs.
    """
    key, order = ["bucket", "part"], F.xxhash64("c", F.lit(turn))
    dealt = lists.withColumns({"part": F.pmod(F.xxhash64("c"), F.ceil(F.col("m") / PART)).cast("int"), "order": order})
    dealt = dealt.select(*key, "order", "cls", "component", "n", "bits").repartition(*key).sortWithinPartitions(*key, "order")

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays(group.column("cls").chunks)
        for i, j in near_hubs(Classes.of(group), percent):
            yield pa.record_batch({"a": names.take(pa.array(i)), "b": names.take(pa.array(j))})

    return dealt.mapInArrow(lambda batches: by_group(batches, key, pairs), "a binary, b binary")


def by_group(batches: Iterator[pa.RecordBatch], key: list[str], made: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What is `made` of each group of rows of the same key, which stand together."""
    held: list[pa.RecordBatch] = []  # rows of the group that goes on in the next batch
    last = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in key]
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            now = tuple(c[a] for c in columns)
            if now != last and held:
                yield from made(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield from made(pa.Table.from_batches(held))


def compared(lists: DataFrame, percent: int, agreeing: int = 0) -> DataFrame:
    """Candidates (a, b) among the classes of each list; a pair comes up once for each list, unless marks tell the first one.

    `lists` has a row for each class of a list: bucket, m (rows of the list), c (a number for the class), cls, component (a number), n, bits,
    and perhaps band, sig and marks. Lists are dealt into parts, and every two parts of a list are a group.
    """
    parts = F.ceil(F.col("m") / PART).cast("int")
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    key, more = ["bucket", "i", "j"], [c for c in ("band", "sig", "marks") if c in lists.columns]
    dealt = dealt.select(*key, "part", "cls", "component", "n", "bits", *more).repartition(*key).sortWithinPartitions(*key)

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        first, second, own = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("part").to_numpy()
        band = group.column("band")[0].as_py() if "band" in group.column_names else 0
        names, every = pa.concat_arrays(group.column("cls").chunks), Classes.of(group)
        rows_x, rows_y = np.flatnonzero(own == first), np.flatnonzero(own == second)
        x, y = every.take(rows_x), None if first == second else every.take(rows_y)
        for i, j in near_pairs(x, y, percent, agreeing, band):
            yield pa.record_batch({"a": names.take(pa.array(rows_x[i])), "b": names.take(pa.array(rows_y[j]))})

    return dealt.mapInArrow(lambda batches: by_group(batches, key, pairs), "a binary, b binary")
