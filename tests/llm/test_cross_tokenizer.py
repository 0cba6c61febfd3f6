"""Alignment of two tokenizers against a walk over both token sequences."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import cross_tokenizer, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, a int, b int, docs int, held int, place int"  # names that are used inside, too
BITS = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\xa0", "\u3000", "\u2003", "\u200b", "a", "bc", "Hello", "world", "'s", "123", "!!"]
BITS += ["==========", "\u2581", "<|endoftext|>", "<s>", "<0x41>", "é", "e\u0301", "漢字", "😀", "\x00", "\x1c", "\x85", "The", "  the", "{\r", "ing"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


class Plain:
    def __init__(self):
        self.a, self.b = units.ByteLevel(A), units.Pieces(B)
        self.whole_a = Tokenizer.from_file(A)
        self.whole_a.encode_special_tokens = True
        self.whole_b = sentencepiece.SentencePieceProcessor(model_file=B)

    def __call__(self, text):
        """Tokens of each, groups, digest of the groups and links by pair; None without tokens."""
        if not text:
            return None
        a, b = self.whole_a.encode(" " + text, add_special_tokens=False).ids, self.whole_b.encode(text)
        bytes_a, bytes_b = [self.a.bytes[i] for i in a], [self.b.bytes[i] for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        groups, pairs, i, j = [], Counter(), 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = [t for t, e in zip(a[i:], ends_a[i:]) if e <= end], [t for t, e in zip(b[j:], ends_b[j:]) if e <= end]
            i, j = i + len(x), j + len(y)
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            pairs.update((p, q) for p in x for q in y)
        return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def test_against_a_walk(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(400))] + [(None, "null id"), (7, None), (7, ""), (7, "twice"), (7, "twice"), (8, "=" * 999 + "the cat " * 30_000)]
    plain = Plain()
    made = [(d, plain(t)) for d, t in rows]
    counts = Counter(p for _, m in made if m for p in m[4])
    best = Counter()
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    want = []
    for d, m in made:
        if m is None:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = m[4].items()
            want.append((d, *m[:3], sum(n for _, n in links), sum(n for p, n in links if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links), m[3]))
    got = cross_tokenizer.align(table(spark, rows).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_of_nothing(spark):
    assert cross_tokenizer.align(table(spark, []), A, B).collect() == []
    assert cross_tokenizer.align(table(spark, [(1, None)]), A, B).first()["groups_sha256"] == ""


def test_units_of_a_text_are_encoded_as_the_text(monkeypatch):
    """Small pieces, and a store that is emptied again and again, give the same."""
    monkeypatch.setattr(cross_tokenizer, "PIECE", 16)
    monkeypatch.setattr(cross_tokenizer, "KEPT", 50)
    monkeypatch.setattr(cross_tokenizer, "PLAIN", 3)  # groups of more links are counted by distinct ids
    known, plain = cross_tokenizer.Units(A, B), Plain()
    some = odd_texts(1500, seed=9)
    assert known.apart
    for text, (totals, digest, pairs, times) in zip(some, cross_tokenizer.documents(known, pa.array([" " + t if t else None for t in some])), strict=True):
        want = plain(text)
        if want is None:
            assert digest == "" and not totals.any() and not len(pairs)
        else:
            assert (*totals[1:4], digest) == want[:4] and totals[4] == sum(want[4].values())
            assert {(p // known.width, p % known.width): n for p, n in zip(pairs.tolist(), times.tolist())} == want[4]


def test_pointers_end_at_the_terminal_token():
    rng = np.random.default_rng(1)
    for _ in range(50):
        last = int(rng.integers(1, 400))
        ends = [np.append(np.unique(rng.integers(1, last + 1, int(rng.integers(0, 200)))), last) for _ in range(2)]
        ends = [np.unique(e) for e in ends]
        common = np.intersect1d(*ends)
        want = np.concatenate([common[np.searchsorted(common, e)] for e in ends])
        assert np.array_equal(cross_tokenizer.terminals(*ends), want)
