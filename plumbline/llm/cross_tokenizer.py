"""Aligns the tokens of two tokenizers over the same text, and counts which ids stand for the same stretch across the corpus.

Both tokenizers read a space and the text. Offsets at which tokens of both end cut the tokens into groups, found by pointer jumping: every
token points to its farthest-right overlapping token (one that ends where a token of the other also ends points to itself), and pointers
are doubled until each names the terminal token of its group. A link is a pair of token occurrences in one group; the count of a pair of
ids is the number of documents that hold it linked.

Tokenizers and pointers work on units (`units.py`): stretches that both encode independently, so that each different one of a block of
documents is aligned once. Documents of up to `BLOCK` bytes form a block. A block keeps its distinct pairs of ids with the number of its
documents that hold them; these numbers are summed over all blocks, looked up once for each pair of each block, and brought back to the
block, where they are added up by document. So no table of all pairs is collected or broadcast; only the highest count of each id of the
first tokenizer is, at most one row for each id of its vocabulary.

Texts that are null, empty, or that one tokenizer doesn't give back byte for byte have no tokens: zeros, and an empty digest. Repeated rows
and ids are separate documents; a null id takes part like any other. Other columns, whatever their names, are not read. An empty table
gives an empty result. A long text is read whole, unit by unit. Ties for the highest count are all best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.tables import written
from plumbline.llm.token_files import pack, unpack
from plumbline.llm.units import ByteLevel, Pieces, distinct_units, unit_starts
from plumbline.llm.words import slices, utf8

#: Bytes of texts in a block, and of the units looked up at once.
BLOCK, PIECE = 16 << 20, 2 << 20
#: Different units that a worker keeps.
KEPT = 500_000
#: Link occurrences of a group that are written out one by one; a larger group is counted by its distinct ids.
PLAIN = 4096


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """End of the terminal token of each token's group: those of the first tokenizer, then those of the second.

    Both sequences of ends are ascending and have the same last value.
    """
    n = len(ends_a)
    ends = np.concatenate([ends_a, ends_b])
    right = np.concatenate([n + np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)])
    to = np.where(ends[right] > ends, right, np.arange(len(ends)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return ends[to]
        to = further


def pair_counts(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs `a * width + b` of one group's ids, and how many occurrences each has."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    return (x[:, None] * width + y).ravel(), (n[:, None] * m).ravel()


class Units:
    """What is known of each different unit: tokens of both tokenizers, groups, links, the groups as text, distinct pairs."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.apart = self.a.apart and self.b.apart
        self.width = len(self.b.bytes)
        self.names = [str(i) for i in range(max(len(self.a.bytes), self.width))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.written: list[bytes] = []
        self.totals = np.zeros((0, 5), np.int64)  # same, tokens of a, tokens of b, groups, links
        self.first = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """Row of each of the different `units`; new ones are aligned."""
        if len(self.number) > KEPT:
            self.clear()
        new = [u for u in units if u not in self.number]
        if new:
            for u in new:
                self.number[u] = len(self.number)
            self._align(new)
        return np.array([self.number[u] for u in units], np.int64)

    def _align(self, units: list[bytes]) -> None:
        (ids_a, n_a), (ids_b, n_b) = self.a(units), self.b(units)
        same = self._gives(self.a, ids_a, n_a, units) & self._gives(self.b, ids_b, n_b, units)
        ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
        n_a, n_b = np.where(same, n_a, 0), np.where(same, n_b, 0)
        ends_a, ends_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        last = terminals(ends_a, ends_b)
        of_a = last[: len(ids_a)]  # ascending
        groups = of_a[np.flatnonzero(np.diff(of_a, prepend=0))]
        size_a, size_b = (np.diff(np.searchsorted(x, groups, "right"), prepend=0) for x in (of_a, last[len(ids_a) :]))
        links = size_a * size_b
        # Groups of each unit: units end where groups end.
        ends = np.cumsum(np.where(same, [len(u) for u in units], 0))
        upto = np.searchsorted(groups, ends, "right")
        count = np.diff(upto, prepend=0)
        total = np.concatenate([[0], np.cumsum(links)])
        self.totals = np.concatenate([self.totals, np.stack([same, n_a, n_b, count, total[upto] - total[upto - count]], axis=1).astype(np.int64)])

        a, b = ([self.names[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        cut_a, cut_b = np.concatenate([[0], np.cumsum(size_a)]).tolist(), np.concatenate([[0], np.cumsum(size_b)]).tolist()
        texts = [f"{','.join(a[cut_a[g] : cut_a[g + 1]])}|{','.join(b[cut_b[g] : cut_b[g + 1]])}" for g in range(len(groups))]
        self.written += [";".join(texts[u - c : u]).encode() for u, c in zip(upto.tolist(), count.tolist(), strict=True)]

        # Pairs of small groups occurrence by occurrence, of large ones by distinct ids.
        small = links <= PLAIN
        of = np.repeat(np.flatnonzero(small), links[small])
        rank = np.arange(len(of)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        start_a, start_b = np.array(cut_a[:-1], np.int64), np.array(cut_b[:-1], np.int64)
        pairs = ids_a[start_a[of] + rank // size_b[of]] * self.width + ids_b[start_b[of] + rank % size_b[of]]
        times = np.ones(len(pairs), np.int64)
        if not small.all():
            more = [(g, *pair_counts(ids_a[cut_a[g] : cut_a[g + 1]], ids_b[cut_b[g] : cut_b[g + 1]], self.width)) for g in np.flatnonzero(~small).tolist()]
            of = np.concatenate([of, *(np.full(len(p), g) for g, p, _ in more)])
            order = np.argsort(of, kind="stable")
            pairs, times = np.concatenate([pairs, *(p for _, p, _ in more)])[order], np.concatenate([times, *(t for _, _, t in more)])[order]
            of = of[order]
        self.first = np.concatenate([self.first, self.first[-1] + np.searchsorted(of, upto)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    @staticmethod
    def _gives(coder: ByteLevel | Pieces, ids: np.ndarray, counts: np.ndarray, units: list[bytes]) -> np.ndarray:
        """The tokens of a unit joined are the unit."""
        known, ends = coder.bytes, np.cumsum(counts).tolist()
        tokens = [known[i] for i in ids.tolist()]
        return np.array([b"".join(tokens[e - c : e]) == u for e, c, u in zip(ends, counts.tolist(), units, strict=True)], bool)


class _Document:
    """What has been read of one text."""

    def __init__(self):
        self.totals, self.same, self.hash, self.pairs, self.times = np.zeros(5, np.int64), True, None, [], []

    def add(self, known: Units, numbers: np.ndarray) -> None:
        totals = known.totals[numbers]
        self.same = self.same and bool(totals[:, 0].all())
        if not self.same:
            return
        self.totals += totals.sum(axis=0)
        text = b";".join([known.written[i] for i in numbers.tolist()])
        if self.hash is None:
            self.hash = hashlib.sha256(text)
        else:
            self.hash.update(b";" + text)
        size = known.first[numbers + 1] - known.first[numbers]
        at = np.repeat(known.first[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self._count(known.pairs[at], known.times[at])

    def _count(self, pairs: np.ndarray, times: np.ndarray) -> None:
        distinct, where = np.unique(pairs, return_inverse=True)
        self.pairs.append(distinct)
        self.times.append(np.bincount(where, times, len(distinct)).astype(np.int64))

    def result(self) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """Totals, digest of the groups, distinct pairs and their occurrences."""
        if not self.same or self.hash is None:
            return np.zeros(5, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) > 1:
            pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
            self.pairs, self.times = [], []
            self._count(pairs, times)
        return self.totals, self.hash.hexdigest(), self.pairs[0], self.times[0]


_known: dict[tuple[str, str], Units] = {}  # one per worker process


def documents(known: Units, texts: pa.Array) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
    """The result of each of the texts, which begin with the added space; an empty one has no tokens."""
    data, offsets = utf8(texts)
    starts = unit_starts(data, offsets) if known.apart else offsets[:-1][np.diff(offsets) > 0]
    of = np.searchsorted(offsets, starts, "right") - 1  # the text of each unit
    doc, at = _Document(), 0
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE)))
        low, high = starts[a], starts[b] if b < len(starts) else len(data)
        places, units = distinct_units(data[low:high], starts[a:b] - low)
        numbers = known.numbers(units)[places]
        cuts = np.flatnonzero(np.diff(of[a:b])) + 1
        for x, y in zip([0, *cuts], [*cuts, b - a], strict=True):
            while at < of[a + x]:
                yield doc.result()
                doc, at = _Document(), at + 1
            doc.add(known, numbers[x:y])
        a = b
    while at < len(texts):
        yield doc.result()
        doc, at = _Document(), at + 1


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`; the two files are on every worker."""
    kind, kind_of = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    spaced = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col)))
    plain = docs.select(F.col(id_col).alias("id"), spaced.alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_level, pieces) not in _known:
            _known[byte_level, pieces] = Units(byte_level, pieces)
        known = _known[byte_level, pieces]
        task, number, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                rows += zip(part.column("id").to_pylist(), documents(known, part.column("text")), strict=True)
                size += len(utf8(part.column("text"))[0])
                if size >= BLOCK:
                    yield from block(task << 32 | number, rows, known.width)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield from block(task << 32 | number, rows, known.width)

    def block(name: int, rows: list, width: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, the first with the block's distinct pairs and the number of its documents that hold each."""
        pairs, docs_of = np.unique(np.concatenate([r[1][2] for r in rows]), return_counts=True)
        order = np.argsort(-docs_of, kind="stable")  # frequent pairs get small numbers
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        packed = []
        for _, (_, _, held, times) in rows:
            at = place[np.searchsorted(pairs, held)]
            by = np.argsort(at)
            control, data = pack(np.diff(at[by], prepend=0))
            more, counts = pack(times[by] - 1)
            packed.append((len(held), control, data, more, counts))
        totals = np.array([r[1][0] for r in rows])
        columns = {
            "block": pa.array([name] * len(rows), pa.int64()),
            "id": pa.array([r[0] for r in rows], kind_of),
            **{c: pa.array(totals[:, i + 1]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups_sha256": pa.array([r[1][1] for r in rows]),
            "held": pa.array([p[0] for p in packed], pa.int32()),
            **{c: pa.array([p[i + 1] for p in packed], pa.binary()) for i, c in enumerate(("control", "data", "more", "counts"))},
            "a": pa.array([pairs[order] // width] + [None] * (len(rows) - 1), pa.list_(pa.int32())),
            "b": pa.array([pairs[order] % width] + [None] * (len(rows) - 1), pa.list_(pa.int32())),
            "docs": pa.array([docs_of[order]] + [None] * (len(rows) - 1), pa.list_(pa.int32())),
        }
        yield pa.record_batch(columns)

    shape = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held int, control binary, data binary, more binary, counts binary, a array<int>, b array<int>, docs array<int>"
    read_docs = written(plain.mapInArrow(read, shape))

    held = read_docs.where("a IS NOT NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p"))
    held = held.select("of", "place", "p.a", "p.b", "p.docs")
    counts = written(held.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of a vocabulary
    judged = counts.join(F.broadcast(best), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    found = held.join(judged, ["a", "b"]).select("of", "place", "count", "best")

    def add_up(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        size = int(right["place"].max()) + 1 if len(right) else 0
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[right["place"]], best[right["place"]] = right["count"], right["best"]
        sums, bests = [], []
        for n, control, data, more, counts in zip(*(left[c] for c in ("held", "control", "data", "more", "counts")), strict=True):
            at, times = np.cumsum(unpack(control, data, n), dtype=np.int64), unpack(more, counts, n).astype(np.int64) + 1
            sums.append(int((count[at] * times).sum()))
            bests.append(int((best[at] * times).sum()))
        out = left[["id", "n_a", "n_b", "n_groups", "n_links"]].copy()
        out["n_best"], out["count_sum"], out["groups_sha256"] = bests, sums, left["groups_sha256"]
        return out

    rows = read_docs.drop("a", "b", "docs")
    done = rows.groupBy("block").cogroup(found.groupBy("of")).applyInPandas(
        add_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return done.withColumnRenamed("id", id_col)
