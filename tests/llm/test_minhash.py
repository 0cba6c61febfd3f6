"""MinHash near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plumbline.llm import minhash_dedup
from tests.llm.test_operators import ODD, gram_set, texts

SCHEMA = "doc_id long, text string, cls string, bucket int, component string, n int"  # names that are used inside, too


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def plain(rows, k, percent):
    sets, at = [gram_set(t, k) for _, t in rows], list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), component, d == component))
    return sorted(out, key=str)


def near_copies(n=150, seed=4):
    """A cluster of edited copies of one text, from hardly changed to no longer alike, and texts that share half of it."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=160)
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        if i % 5 == 0:
            copy[80:] = rng.choices(words, k=80)
        out.append((1000 + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("k, percent, crowd", [(4, 80, 4096), (4, 80, 8), (5, 80, 4096), (2, 60, 8)])
def test_against_all_pairs(spark, k, percent, crowd, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    rows = texts(n=60) + near_copies() + ODD + [(5000, "x y z " * 40_000), (5001, "x y z " * 40_000)]
    got = minhash_dedup.near_duplicates(table(spark, rows), k=k, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, k, percent)


def test_of_nothing(spark):
    assert minhash_dedup.near_duplicates(table(spark, [])).collect() == []
    got = minhash_dedup.near_duplicates(table(spark, [(None, "a b"), (None, "a b"), (3, ""), (4, None)])).collect()
    assert sorted(map(tuple, got), key=str) == [(3, 0, 3, True), (4, 0, 4, True), (None, 1, None, True), (None, 1, None, True)]


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for shared in (0.2, 0.5, 0.8, 0.95):
        agree, alike = [], 0
        for _ in range(40):
            x = rng.integers(0, 2**63, 600).astype(np.uint64)
            y = np.concatenate([x[: int(600 * shared)], rng.integers(0, 2**63, 600 - int(600 * shared)).astype(np.uint64)])
            a, b = minhash_dedup.minima(np.unique(x)), minhash_dedup.minima(np.unique(y))
            agree.append((a == b).mean())
            alike += bool((minhash_dedup.bands(a) == minhash_dedup.bands(b)).any())
        similarity = shared / (2 - shared)
        assert abs(np.mean(agree) - similarity) < 0.03
        if similarity >= 0.8:
            assert alike == 40
    assert 90 < minhash_dedup.least_agreeing(80) < 110
