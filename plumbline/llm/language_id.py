"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text becomes lower-case letters with single spaces between words. Four-letter windows of all training texts are counted per language on
the cluster; lower orders follow from the distinct windows (continuation counts). Each order is one sorted array of hashes for all
languages with a row of interpolated log-probabilities per hash, and one of contexts with their interpolation weights; a window is looked
up by binary search from the highest order down. The language with the lowest cross-entropy per letter is predicted.

A tenth of the training texts (by a hash of the id, at most about `most_calibration` of them: those with the least hashes) is kept out of
the counts, all others are counted. It calibrates how differences of cross-entropy become a probability, and for each language the
cross-entropy beyond which a text is marked `rejected`.

The model holds every window of every language, so continuation counts and discounts are those of the whole corpus. Its size grows with
the distinct windows (not with the rows); it is built on the driver and shared with the workers. Null texts and texts without a letter
are `und`; ties go to the name that sorts first. Rows with a null language or id teach nothing. With no training text all texts are
`und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import free, without
from plumbline.llm.words import mix, slices

ORDER = 4
UNKNOWN = "und"
_PAD = 1


class Letters:
    """Texts as 16-bit letter codes; make one per task."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(0x30000)])

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed windows ending at each letter or space, the text each belongs to, and the number of letters per text."""
        joined = "".join("\x01\x01\x01" + (t or "").replace("\x01", " ").lower() + " " for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        pad = points == _PAD
        inside = self.letter[np.minimum(points, len(self.letter) - 1)]
        space = ~pad & ~inside
        # Several spaces count as one, and none follows the beginning.
        keep = ~space
        keep[1:] |= space[1:] & inside[:-1]
        code = np.where(space, 32, points & 0xFFFF).astype(np.uint64)[keep]
        pad = pad[keep]
        text = np.cumsum(pad) // 3 - 1
        window = code.copy()
        for i in range(1, ORDER):
            window[i:] |= code[:-i] << np.uint64(16 * i)
        letters = np.bincount(text[~pad & (code != 32)], minlength=len(texts))
        return window[~pad], text[~pad], letters


@dataclass
class LanguageModel:
    names: list[str]
    keys: list[np.ndarray]  # per order: sorted hashes of windows
    logs: list[np.ndarray]  # per order: log-probabilities, a row per hash, a column per language
    context_keys: list[np.ndarray]  # per order above 1: sorted hashes of contexts
    weights: list[np.ndarray]  # logarithms of the interpolation weights
    unknown: np.ndarray  # log-probability of a letter never seen
    sharpness: float = 30.0
    limits: np.ndarray | None = None  # cross-entropy above which a text is rejected

    def log_probability(self, windows: np.ndarray) -> np.ndarray:
        out = np.tile(self.unknown, (len(windows), 1)).astype(np.float32)
        for n in range(1, ORDER + 1):
            grams = windows & np.uint64((1 << 16 * n) - 1)
            if n > 1:
                at, ok = _find(self.context_keys[n - 2], mix(grams >> np.uint64(16)))
                out[ok] += self.weights[n - 2][at]
            at, ok = _find(self.keys[n - 1], mix(grams))
            out[ok] = self.logs[n - 1][at]
        return out

    def entropies(self, texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text in each language, and letters per text."""
        windows, text, count = letters.codes(texts)
        distinct, which = np.unique(windows, return_inverse=True)
        logs = self.log_probability(distinct)
        ends = np.cumsum(np.bincount(text, minlength=len(texts)))
        n = np.diff(ends, prepend=0)
        total = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(logs[which, j], dtype=np.float64)])[ends], prepend=0) for j in range(len(self.names))], axis=1)
        return -total / np.maximum(1, n)[:, None], count


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of those hashes that are keys, and which they are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    ok = keys[at] == wanted
    return at[ok], ok


def build(names: list[str], grams: list[np.ndarray], counts: list[np.ndarray]) -> LanguageModel:
    """Kneser-Ney models of all languages from the windows of the highest order and their counts."""
    per_order = []
    for g, c in zip(grams, counts, strict=True):
        levels = [None] * (ORDER + 1)
        levels[ORDER] = (g, c.astype(np.float64))
        for n in range(ORDER - 1, 0, -1):  # how many letters stand before it
            longer = levels[n + 1][0]
            levels[n] = tuple(x if i == 0 else x.astype(np.float64) for i, x in enumerate(np.unique(longer & np.uint64((1 << 16 * n) - 1), return_counts=True)))
        per_order.append(levels)
    many = len(names)
    alphabet = max(1, len(np.unique(np.concatenate([p[1][0] for p in per_order]))))
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, many))
    unknown = np.zeros(many)
    keys, logs, context_keys, weights = [], [], [], []
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([p[n][0] for p in per_order]))
        context = np.unique(union >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
        own, weight = np.zeros((len(union), many)), np.ones((len(context), many))
        for j, p in enumerate(per_order):
            g, c = p[n]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            where = np.searchsorted(context, g >> np.uint64(16)) if n > 1 else np.zeros(len(g), np.int64)
            total, kinds = np.bincount(where, c, len(context)), np.bincount(where, minlength=len(context))
            own[np.searchsorted(union, g), j] = np.maximum(c - discount, 0) / total[where]
            weight[total > 0, j] = discount * kinds[total > 0] / total[total > 0]
        if n == 1:
            unknown = weight[0] / (alphabet + 1)
            full = own + unknown
        else:
            full = own + weight[np.searchsorted(context, union >> np.uint64(16))] * below[np.searchsorted(below_keys, union & np.uint64((1 << 16 * (n - 1)) - 1))]
            order = np.argsort(mix(context))
            context_keys.append(mix(context)[order])
            weights.append(np.log(np.maximum(weight, 1e-12))[order].astype(np.float32))
        below_keys, below = union, full
        order = np.argsort(mix(union))
        keys.append(mix(union)[order])
        logs.append(np.log(np.maximum(full, 1e-12))[order].astype(np.float32))
    return LanguageModel(names, keys, logs, context_keys, weights, np.log(np.maximum(unknown, 1e-12)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_calibration: int = 4000) -> LanguageModel | None:
    """Models of all languages in `docs`; None if there is no text with a language."""
    rows = docs.select(F.xxhash64(id_col, F.lit("calibration")).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col(id_col).isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    apart = F.pmod("h", F.lit(10)) == 0
    # The hash up to which the sample goes comes from the hashes alone, so that no text is moved for it.
    last = rows.where(apart).select("h").orderBy("h").limit(most_calibration).agg(F.max("h")).first()[0]
    aside = apart & (F.col("h") <= last) if last is not None else F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = Letters(), {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                windows, text, _ = letters.codes(part.column("text").to_pylist())
                for lang in sorted(set(langs)):
                    held.setdefault(lang, []).append(np.unique(windows[(langs == lang)[text]], return_counts=True))
                    if len(held[lang]) == 8:
                        held[lang] = [_summed(held[lang])]
        for lang, parts in held.items():
            grams, times = _summed(parts)
            for a in range(0, len(grams), 100_000):
                g = grams[a : a + 100_000]
                yield pa.record_batch({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g.view(np.int64)), "times": pa.array(times[a : a + 100_000])})

    counted = rows.where(~aside).select("text", "lang").mapInArrow(count, "lang string, gram long, times long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    got = counted.toArrow().to_pandas().sort_values(["lang", "gram"])
    names = sorted(set(got["lang"]))
    if not names:
        return None
    parts = [got[got["lang"] == name] for name in names]
    model = build(names, [np.sort(p["gram"].to_numpy(np.int64).view(np.uint64)) for p in parts], [p["times"].to_numpy()[np.argsort(p["gram"].to_numpy(np.int64).view(np.uint64))] for p in parts])
    check = entropies(rows.where(aside), model, "text")
    _calibrate(model, check.select("lang", "entropies", "letters").where("letters > 0").toPandas())
    return model


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def _calibrate(model: LanguageModel, seen) -> None:
    """Choose the sharpness with the best likelihood, and per language a limit that one text in a thousand exceeds, with a margin."""
    model.limits = np.full(len(model.names), np.inf)
    seen = seen[seen["lang"].isin(model.names)]
    if not len(seen):
        return
    h = np.stack(seen["entropies"].to_list())
    y = seen["lang"].map({n: i for i, n in enumerate(model.names)}).to_numpy()
    grid = [1, 2, 5, 10, 20, 30, 50, 80]
    model.sharpness = float(min(grid, key=lambda s: -np.log(np.maximum(_posterior(h, s)[np.arange(len(y)), y], 1e-9)).sum()))
    for j in set(y):
        model.limits[j] = np.quantile(h[y == j, j], 0.999) + 0.5


def _posterior(h: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (h - h.min(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def entropies(docs: DataFrame, model: LanguageModel, text_col: str, out: tuple[str, str] = ("entropies", "letters")) -> DataFrame:
    """`docs` with entropies, one number per language in the order of `model.names`, and the number of letters, in the columns `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            for part in slices(batch, text_col):
                h, count = shared.value.entropies(part.column(text_col).to_pylist(), letters)
                cut = pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32())
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(cut, pa.array(h.ravel())), pa.array(count)], names=[*part.schema.names, *out])

    more = [T.StructField(out[0], T.ArrayType(T.DoubleType())), T.StructField(out[1], T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (calibrated probability; 0 for `und`), and `rejected`: the text fits no learned language.

    Columns of these names are replaced.
    """
    docs = without(docs, ["lang_pred", "score", "rejected"], (text_col,))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    inside = free(docs, "entropies"), free(docs, "letters")
    h: Column = F.col(inside[0])
    best = F.array_position(h, F.array_min(h)).cast("int")
    known = F.col(inside[1]) > 0
    names, limits = F.array(*map(F.lit, model.names)), F.array(*[F.lit(float(x)) for x in model.limits])
    total = F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.exp(-F.lit(model.sharpness) * (x - F.array_min(h))))
    made = entropies(docs, model, text_col, inside).withColumns(
        {
            "lang_pred": F.when(known, F.element_at(names, best)).otherwise(UNKNOWN),
            "score": F.when(known, 1 / total).otherwise(0.0),
            "rejected": F.when(known, F.array_min(h) > F.element_at(limits, best)).otherwise(True),
        }
    )
    return made.drop(*inside)
