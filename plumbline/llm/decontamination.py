"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Test items are cut into equal segments of at most `SEGMENT` words. Items are handled in blocks of a bounded number of words (a hash of
   the row names the block), so a block fits a broadcast whatever the size of the benchmark; the documents are scanned for each block.
2. One scan counts how often each of the block's n-grams occurs in the documents. In every run of `window` neighbouring n-grams of a
   segment the rarest one is a seed: any `n + window - 1` unchanged words in a row keep a seed, however often an item was copied.
3. A second scan joins documents to segments on the seeds and aligns the words around them with the segment: +2 for an equal word, -1
   for another one, -1 for a missing or additional one. The score is the best local alignment divided by that of the whole segment.
   A document is contaminated by an item when a segment reaches `min_score` and at least `min_words` equal words' worth, or all of a
   segment little longer than that but one word. Items of fewer than `min_words` words must be in the document word for word.

Words are runs of letters and digits, A-Z in lower case, and single characters of scripts without spaces. Both scans are map-only; only
counts of the block's n-grams are shuffled. Null and empty texts, and items with fewer than `n` words, match nothing. Repeated documents each get their rows; equal items each
match. Ties between segments go to the higher score, then the earlier place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import NOT_WORD, Hasher, per_text, shingles, slices, unicode_words, utf8

SEGMENT = 128
#: Words of a block of items.
BLOCK_WORDS = 1_000_000


@dataclass
class Block:
    """Segments of some items: their words, one after another, and the n-grams in them."""

    items: list  # id of each segment's item
    words: np.ndarray
    begins: np.ndarray  # first word of each segment, and behind the last one
    grams: np.ndarray  # distinct n-gram hashes, sorted
    gram_at: np.ndarray  # n-gram number at each of `places`
    places: np.ndarray  # word position of each n-gram occurrence


def _block(rows: list, n: int) -> Block:
    hasher = Hasher(NOT_WORD)
    items, words, sizes = [], [], []
    for item, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, _, h = unicode_words(hasher, data, np.array([0, len(data)]))
        if not len(h):
            continue
        for part in np.array_split(h, -(-len(h) // SEGMENT)):
            items.append(item)
            words.append(part)
            sizes.append(len(part))
    sizes = np.array(sizes, np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    long = sizes >= n
    places = np.concatenate([np.zeros(0, np.int64), *(np.arange(b, b + s - n + 1) for b, s in zip(begins[:-1][long], sizes[long], strict=True))])
    all_grams, made = shingles(flat, sizes, n)
    all_grams = all_grams[np.repeat(long, made)]
    grams, gram_at = np.unique(all_grams, return_inverse=True)
    return Block(items, flat, begins, grams, gram_at, places)


class _Lookup:
    """Positions of hashes in a sorted array, with a bit table in front of the binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.mask = keys, np.uint64((1 << 22) - 1)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and the number of their key."""
        maybe = np.flatnonzero(self.bits[(hashes & self.mask).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.searchsorted(self.keys, hashes[maybe])
        ok = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes[maybe]
        return maybe[ok], at[ok]


def _grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of whole n-grams only, and the position of their first word."""
    grams, made = shingles(words, counts, n)
    begins = np.cumsum(counts) - counts
    at = np.repeat(begins - (np.cumsum(made) - made), made) + np.arange(len(grams))
    whole = np.repeat(counts >= n, made)
    return (grams, at) if whole.all() else (grams[whole], at[whole])


def _frequencies(docs: DataFrame, text_col: str, block: Block, n: int) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast(block.grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lookup = Hasher(NOT_WORD), _Lookup(shared.value)
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                data, offsets = utf8(part.column(text_col))
                starts, _, words = unicode_words(hasher, data, offsets)
                total += np.bincount(lookup(_grams(words, per_text(starts, offsets), n)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(some), "times": pa.array(total[some])})

    rows = docs.select(text_col).mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).toPandas()
    out = np.zeros(len(block.grams), np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["times"].to_numpy(np.int64)
    return out


def seeds(block: Block, frequencies: np.ndarray, window: int, n: int = 3) -> np.ndarray:
    """Which n-gram occurrences are the rarest of some run of `window` neighbours in their segment; all of a segment that one change can leave without."""
    order = np.lexsort((block.grams, frequencies))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    value, chosen = rank[block.gram_at], np.zeros(len(block.places), bool)
    segment = np.searchsorted(block.begins, block.places, "right")
    for run in np.split(np.arange(len(value)), np.flatnonzero(np.diff(segment)) + 1):
        if len(run) < n + 2 * window:
            chosen[run] = True
        else:
            views = np.lib.stride_tricks.sliding_window_view(value[run], min(window, len(run)))
            chosen[run[0] + np.arange(len(views)) + views.argmin(1)] = True
    return chosen


def align(segment: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of `segment` (its first `sizes` words) with the same row of `texts`: score, first and last word.

    Scores and begins travel in one number: score times 2^32 plus begin. Gaps along the text come from a running maximum.
    """
    high, width = np.int64(1) << 32, texts.shape[1]
    columns = np.arange(width, dtype=np.int64)
    slope = columns * high
    before = np.zeros(texts.shape, np.int64)
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i in range(segment.shape[1]):
        live = i < sizes
        equal = (segment[:, i : i + 1] == texts) & live[:, None]
        diagonal = np.zeros_like(before)
        diagonal[:, 1:] = before[:, :-1]
        fresh = diagonal < high
        new = np.where(fresh, np.where(equal, 2 * high + columns, 0), diagonal + np.where(equal, 2 * high, -high))
        new = np.maximum(new, before - high)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[new < high] = 0
        new[~live] = 0
        at = new.argmax(1)
        top = new[np.arange(len(new)), at]
        better = (top >> 32) > (best >> 32)
        best, end = np.where(better, top, best), np.where(better, at, end)
        before = new
    return best >> 32, best & (high - 1), end


def _matcher(block: Block, chosen: np.ndarray, n: int, min_score: float, min_words: int) -> Callable:
    """A function from a part of a batch to its matches: row, segment, score, first and last byte."""
    order = np.argsort(block.gram_at[chosen], kind="stable")
    gram, place = block.gram_at[chosen][order], block.places[chosen][order]
    numbers, first, times = np.unique(gram, return_index=True, return_counts=True)
    lookup, hasher = _Lookup(block.grams[numbers]), Hasher(NOT_WORD)
    size = np.diff(block.begins)

    def match(part: pa.RecordBatch, column: str):
        data, offsets = utf8(part.column(column))
        starts, ends, words = unicode_words(hasher, data, offsets)
        counts = per_text(starts, offsets)
        grams, at = _grams(words, counts, n)
        hit, key = lookup(grams)
        reps = times[key]
        where = np.repeat(at[hit], reps)
        place_of = place[np.repeat(first[key], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        text_end = np.cumsum(counts)
        row = np.searchsorted(text_end, where, "right")
        segment = np.searchsorted(block.begins, place_of, "right") - 1
        diagonal = where - (place_of - block.begins[segment])
        order = np.lexsort((diagonal, segment, row))
        row, segment, diagonal = row[order], segment[order], diagonal[order]
        if not len(row):
            return []
        cut = (np.diff(row) != 0) | (np.diff(segment) != 0) | (np.diff(diagonal) > 2 * size[segment[1:]])
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
        last = np.concatenate([begin[1:], [len(row)]]) - 1
        row, segment = row[begin], segment[begin]
        m = size[segment]
        lo = np.maximum(diagonal[begin] - m // 2 - 2, (text_end - counts)[row])
        hi = np.minimum(diagonal[last] + m + m // 2 + 2, text_end[row])
        found, by_size, a = [], np.lexsort((m, hi - lo)), 0
        while a < len(by_size):
            b, widest = a + 1, hi[by_size[a]] - lo[by_size[a]]
            while b < len(by_size) and (b - a + 1) * (hi[by_size[b]] - lo[by_size[b]]) <= 1 << 18:
                widest = hi[by_size[b]] - lo[by_size[b]]
                b += 1
            c = by_size[a:b]
            columns = lo[c][:, None] + np.arange(widest)
            texts = np.where(columns < hi[c][:, None], words[np.minimum(columns, len(words) - 1)], np.uint64(0))
            rows = block.begins[segment[c]][:, None] + np.arange(m[c].max())
            parts = np.where(rows < block.begins[segment[c] + 1][:, None], block.words[np.minimum(rows, len(block.words) - 1)], np.uint64(1))
            score, start, end = align(parts, m[c], texts)
            # One changed or missing word costs 3. Segments below `min_words` must be there word for word.
            least = np.where(m[c] < min_words, 2 * m[c], np.minimum(2 * min_words, 2 * m[c] - 3))
            good = (score >= least) & (score >= min_score * 2 * m[c])
            for r, s, v, x, y in zip(row[c][good], segment[c][good], score[good], (lo[c] + start)[good], (lo[c] + end)[good], strict=True):
                found.append((int(r), int(s), float(v / (2 * size[s])), int(starts[x] - offsets[r]), int(ends[y] - offsets[r])))
            a = b
        return found

    return match


def _blocks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, n: int, window: int):
    """Each block of items with its seeds."""
    known = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    number = max(1, -(-size // (4 * BLOCK_WORDS)))
    for i in range(number):
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == i).collect()
        block = _block([(r["id"], r["text"]) for r in sorted(rows, key=lambda r: (r["id"] is None, r["id"], r["text"]))], n)
        if len(block.places):
            yield block, seeds(block, _frequencies(docs, text_col, block, n), window, n)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 3,
    window: int = 3,
    min_score: float = 0.4,
    min_words: int = 8,
) -> DataFrame:
    """One row per document and item it holds: the ids, score, and the passage's begin and end as code points of the text."""
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {id_kind}, `{item_id}` {item_kind}, score double, begin long, end long"
    context, out = docs.sparkSession.sparkContext, docs.sparkSession.createDataFrame([], schema)
    for block, chosen in _blocks(docs, items, id_col, text_col, item_id, item_text, n, window):
        shared = context.broadcast((block, chosen))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, match = shared.value[0], _matcher(*shared.value, n, min_score, min_words)
            for batch in batches:
                for part in slices(batch, "text"):
                    best = {}
                    for r, s, score, a, b in match(part, "text"):
                        key, value = (r, block.items[s]), (score, -a, -b)
                        best[key] = max(best.get(key, value), value)
                    ids, text = part.column("id"), part.column("text")
                    rows = []
                    for (r, item), (score, a, b) in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1]))):
                        raw = text[r].as_py().encode()
                        begin = len(raw[:-a].decode())
                        rows.append((ids[r].as_py(), item, score, begin, begin + len(raw[-a:-b].decode())))
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out.schema)
        kinds, names = arrow.types, arrow.names
        out = out.union(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, window: int = 3, min_score: float = 0.4, min_words: int = 8) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    context, out = docs.sparkSession.sparkContext, docs
    for block, chosen in _blocks(docs, items, text_col, text_col, item_id, item_text, n, window):
        shared = context.broadcast((block, chosen))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = _matcher(*shared.value, n, min_score, min_words)
            for batch in batches:
                for part in slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[[m[0] for m in match(part, text_col)]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
