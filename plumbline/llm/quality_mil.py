"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Each passage of the whole text is encoded as numbers (shares of byte kinds and of pairs of them, word
lengths, repeats within the passage and within the document) and embedded; gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``
over the document's passages, weighs the embeddings, and a logistic layer scores the weighted sum. Only document labels are needed.

Training takes a bounded sample: at most `max_docs` labelled documents, those with the least hash of their id, with at most
`MOST_PASSAGES` passages each; passages of longer texts are longer, so that no word is left out. Its passages fit the driver, where the
small network is fitted. Scoring is one map over all documents, with passages of `PASSAGE_WORDS` words at any length of text.

Null and empty texts are one passage without words. Labels other than 0 and 1 and null ids are ignored; several labels of one id count
by their majority, ties as 1. Repeated documents are scored alike. Without any label all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import without
from plumbline.llm.words import Hasher, per_text, shingles, slices, utf8

PASSAGE_WORDS = 50
MOST_PASSAGES = 64


def _byte_kinds() -> tuple[np.ndarray, int, np.ndarray]:
    """Kind of each byte (every ASCII sign its own), their number, and a coarse kind of 8."""
    kind, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    next_kind = 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b], coarse[b] = 0, 0
        elif c.islower():
            kind[b], coarse[b] = 1, 1
        elif c.isupper():
            kind[b], coarse[b] = 2, 2
        elif c.isdigit():
            kind[b], coarse[b] = 3, 3
        elif c in " \t\r\x0b\x0c":
            kind[b], coarse[b] = 4, 4
        elif c == "\n":
            kind[b], coarse[b] = 5, 5
        elif 32 < b < 127:
            kind[b], coarse[b] = next_kind, 6 if c in ".,;:!?'\"()-" else 7
            next_kind += 1
    return kind, next_kind, coarse


KIND, KINDS, COARSE = _byte_kinds()
FEATURES = KINDS + 64 + 8


def passages(part: pa.RecordBatch, column: str, hasher: Hasher, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of a part of a batch, and their number per text (one at least); with `most`, longer ones instead of more."""
    data, offsets = utf8(part.column(column))
    starts, ends, words = hasher.words(data, offsets)
    counts = per_text(starts, offsets)
    size = np.maximum(PASSAGE_WORDS, -(-counts // most) if most else 0 * counts)
    number = np.maximum(1, -(-counts // size))
    first = np.cumsum(number) - number
    total = int(number.sum())
    text_of = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    of_word = first[text_of] + nth // np.repeat(size, counts)

    # A byte belongs to the passage of the last word that began, those before the first word to the first passage.
    of_byte = np.repeat(first, np.diff(offsets))
    if len(words):
        begins = np.zeros(len(data), np.int64)
        begins[starts] = nth % np.repeat(size, counts) == 0
        begins[starts[nth == 0]] = 0
        jumps = np.cumsum(begins)
        of_byte = of_byte + jumps - np.repeat(np.concatenate([[0], jumps])[offsets[:-1]], np.diff(offsets))
    kinds = np.bincount(of_byte * KINDS + KIND[data], minlength=total * KINDS).reshape(total, KINDS)
    coarse = COARSE[data]
    pairs = np.bincount(of_byte[1:] * 64 + coarse[:-1] * 8 + coarse[1:], minlength=total * 64).reshape(total, 64) if len(data) else np.zeros((total, 64))
    length = np.maximum(1, kinds.sum(1, keepdims=True))

    n = np.maximum(1, np.bincount(of_word, minlength=total))
    letters = ends - starts
    mean = np.bincount(of_word, letters, minlength=total) / n
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, letters**2.0, minlength=total) / n - mean**2))
    order = np.lexsort((words, of_word))
    w, p = words[order], of_word[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[fresh], minlength=total) / n
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    grams, made = shingles(words, counts, 3)
    of_gram = np.repeat(np.arange(len(counts)), made)
    order = np.lexsort((grams, of_gram))
    g, t = grams[order], of_gram[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    kept = np.bincount(t[fresh], minlength=len(counts)) / np.maximum(1, made)
    of_text = np.repeat(np.arange(len(counts)), number)
    more = [mean / 10, spread / 10, distinct, np.bincount(of_word[again], minlength=total) / n, kept[of_text], np.log1p(counts)[of_text] / 10, np.log1p(n) / 5, np.log1p(length[:, 0]) / 10]
    return np.hstack([np.sqrt(kinds / length), np.sqrt(pairs / length), np.array(more).T]).astype(np.float32), number


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict = field(default_factory=dict)

    def scores(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, number)["score"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, number: np.ndarray) -> dict:
    first = np.cumsum(number) - number
    h = np.tanh(x @ p["embed"] + p["embed0"])
    a, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (a * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), number))
    alpha = e / np.repeat(np.add.reduceat(e, first), number)
    z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
    return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "first": first, "score": _sigmoid(z @ p["out"] + p["out0"])}


def _gradients(p: dict, x: np.ndarray, number: np.ndarray, y: np.ndarray, decay: float) -> dict:
    f = _forward(p, x, number)
    d = (f["score"] - y) / len(y)
    dz = np.repeat(d[:, None] * p["out"], number, axis=0)
    back = (dz * f["h"]).sum(1)
    de = f["alpha"] * (back - np.repeat(np.add.reduceat(f["alpha"] * back, f["first"]), number))
    gate = de[:, None] * p["w"]
    da, dg = gate * f["g"] * (1 - f["a"] ** 2), gate * f["a"] * f["g"] * (1 - f["g"])
    dh = f["alpha"][:, None] * dz + da @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    grads = {"embed": x.T @ dx, "embed0": dx.sum(0), "V": f["h"].T @ da, "U": f["h"].T @ dg, "w": (f["a"] * f["g"]).T @ de, "out": f["z"].T @ d, "out0": d.sum()}
    return {k: v + decay * p[k] for k, v in grads.items()}


def train(x: np.ndarray, number: np.ndarray, y: np.ndarray, width: int = 32, gates: int = 16, epochs: int = 20, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> QualityModel:
    """Fit the network to labelled bags: passages `x`, their `number` per document, labels `y`."""
    random = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    draw = lambda *s: (random.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": draw(x.shape[1], width), "embed0": np.zeros(width, np.float32), "V": draw(width, gates), "U": draw(width, gates), "w": draw(gates), "out": draw(width), "out0": np.float32(0)}
    first = np.cumsum(number) - number
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(q) for k, q in p.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            rows = np.concatenate([np.arange(first[i], first[i] + number[i]) for i in pick])
            step += 1
            slow = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in _gradients(p, x[rows], number[pick], y[pick], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean, scale, p)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = 6000) -> QualityModel | None:
    """A model of `label` from at most `max_docs` labelled documents; None without labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "text"):
                x, number = passages(part, "text", hasher, MOST_PASSAGES)
                cut = np.split(x, np.cumsum(number)[:-1])
                yield pa.record_batch({"h": part.column("h"), "y": part.column("y"), "x": pa.array([c.tobytes() for c in cut], pa.binary())})

    got = rows.select("text", "y", F.xxhash64("id").alias("h")).mapInArrow(encode, "h long, y int, x binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("h")
    bags = [np.frombuffer(b.as_py(), np.float32).reshape(-1, FEATURES) for b in got["x"]]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), got["y"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: QualityModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the model's score (0 to 1, higher: label 1 likelier) in the column `out`, which replaces one of that name."""
    docs = without(docs, [out], (text_col,))
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, text_col):
                made = shared.value.scores(*passages(part, text_col, hasher))
                yield pa.record_batch([*part.columns, pa.array(made.astype(np.float64))], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
