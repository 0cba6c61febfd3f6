"""Toxicity by a classifier chain.

Categories are predicted one after another. Each is a logistic model over the words of the text (whole words and word beginnings, hashed)
and the probabilities of the categories before it. In training those probabilities are out-of-fold predictions, so that a later model
sees them as uncertain as they will be. The last category is the label itself; the ones before it are groups of seed words, known for a
training text when its label is 1 and it holds a seed of the group.

Training takes a bounded sample: at most `max_docs` labelled documents of each label value, those with the least hash of their id. The
`most_features` hashes that tell the label best (chi-square over documents of the sample, in at least three of them) are the inputs.
Scoring is one map over all documents and reads whole texts.

Null and empty texts hold no words and get the base probabilities. Labels other than 0 and 1 and null ids are ignored; several labels of
an id count as 1 if one does. Without both label values the probabilities are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import without
from plumbline.llm.words import NOT_WORD, Hasher, mix, per_text, slices, utf8

#: Groups of seed words, in chain order.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown"),
    "degrading": ("scum", "trash", "worthless"),
    "contempt": ("stupid", "pathetic", "disgusting"),
}
#: Chi-square below which a hash may tell the label by chance.
LEAST_GAIN = 15.0
#: Bytes of word beginnings.
BEGINNINGS = (4, 5)


def features(part: pa.RecordBatch, column: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of beginnings of longer words, and the text each comes from."""
    data, offsets = utf8(part.column(column))
    starts, ends, words = hasher.words(data, offsets)
    text = np.repeat(np.arange(part.num_rows), per_text(starts, offsets))
    hashes, texts = [words], [text]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        begin = np.full(len(long), n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                begin = begin * np.uint64(0x9E3779B97F4A7C15) + hasher.byte[data[starts[long] + i]]
        hashes.append(mix(begin))
        texts.append(text[long])
    return np.concatenate(hashes), np.concatenate(texts)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Hasher(NOT_WORD).words(raw, np.array([0, len(raw)]))[2][0])


@dataclass
class Chain:
    names: list[str]
    keys: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # per category: keys, categories before it, constant

    def inputs(self, hashes: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
        x = np.zeros((rows, len(self.keys)), np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            ok = self.keys[at] == hashes
            x[text[ok], at[ok]] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            out = np.hstack([out, _predict(w, np.hstack([x, out]))[:, None]])
        return out


def _predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic model by accelerated gradient steps; the last one is the constant."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, step = w.copy(), 4.0 / (1 + np.square(x).sum(1).mean())
    for t in range(rounds):
        d = (_predict(ahead, x) - y) / len(y)
        g = np.append(x.T @ d, d.sum()) + decay * np.append(ahead[:-1], 0)
        new = ahead - step * g
        ahead, w = new + t / (t + 3) * (new - w), new
    return w.astype(np.float32)


def train(x: np.ndarray, targets: np.ndarray, names: list[str], keys: np.ndarray, folds: int = 4) -> Chain:
    """Fit the chain: one model per column of `targets`, later ones on out-of-fold probabilities of the earlier."""
    fold, before, weights = np.arange(len(x)) % folds, np.zeros((len(x), 0), np.float32), []
    for j in range(targets.shape[1]):
        z, y = np.hstack([x, before]), targets[:, j]
        weights.append(logistic(z, y))
        apart = np.zeros(len(x), np.float32)
        for f in range(folds if j + 1 < targets.shape[1] else 0):
            apart[fold == f] = _predict(logistic(z[fold != f], y[fold != f]), z[fold == f])
        before = np.hstack([before, apart[:, None]])
    return Chain(names, keys, weights)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_docs: int = 3000, most_features: int = 512) -> Chain | None:
    """A chain over `SEEDS` and `label`, from at most `max_docs` documents of each label value; None without both values."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    pick = lambda v: known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick(0).union(pick(1))), "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(NOT_WORD)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, text = features(part, "text", hasher)
                cut = [np.unique(hashes[text == i]).tobytes() for i in range(part.num_rows)]
                yield pa.record_batch({"h": part.column("h"), "y": part.column("y"), "x": pa.array(cut, pa.binary())})

    got = rows.select("text", F.col("y").cast("int"), F.xxhash64("id").alias("h")).mapInArrow(encode, "h long, y int, x binary").toArrow()
    if not got.num_rows or len(set(got["y"].to_pylist())) < 2:
        return None
    got = got.sort_by("h")
    sets, y = [np.frombuffer(b.as_py(), np.uint64) for b in got["x"]], got["y"].to_numpy()
    flat, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys, where = np.unique(flat, return_inverse=True)
    df, hit = np.bincount(where), np.bincount(where, y[text], len(keys))
    share = y.mean()
    gain = np.where(df >= 3, (hit - df * share) ** 2 / (df * share * (1 - share) * (1 - df / len(y)) + 1e-9), -1)
    chosen = keys[[i for i in np.lexsort((keys, -gain))[:most_features] if gain[i] >= LEAST_GAIN]]
    seeds = {name: [word_hash(w) for w in words] for name, words in SEEDS.items()}
    targets = [np.array([v and np.isin(np.array(s, np.uint64), h).any() for h, v in zip(sets, y, strict=True)]) for s in seeds.values()]
    model = Chain([*SEEDS, label], np.sort(chosen), [])
    x = model.inputs(flat, text, len(sets))
    return train(x, np.array([*targets, y], np.float32).T, model.names, model.keys)


def score(docs: DataFrame, model: Chain | None, names: list[str], text_col: str = "text") -> DataFrame:
    """`docs` with a probability per category, named `p_<category>`; columns of these names are replaced."""
    docs = without(docs, [f"p_{n}" for n in names], (text_col,))
    if model is None:
        return docs.withColumns({f"p_{n}": F.lit(0.0) for n in names})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(NOT_WORD)
        for batch in batches:
            for part in slices(batch, text_col):
                p = shared.value.probabilities(shared.value.inputs(*features(part, text_col, hasher), part.num_rows)).astype(np.float64)
                yield pa.record_batch([*part.columns, *map(pa.array, p.T)], names=[*part.schema.names, *(f"p_{n}" for n in names)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(f"p_{n}", T.DoubleType()) for n in names)]))
