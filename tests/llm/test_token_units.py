"""Words apart give the ids of whole texts, and counts of ids come in rows of bounded size."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from plumbline.llm import token_files


def test_counts_in_rows_of_bounded_size(spark, tmp_path, monkeypatch):
    tables, write = [], token_files.written
    monkeypatch.setattr(token_files, "written", lambda df: tables.append(write(df)) or tables[-1])
    monkeypatch.setattr(token_files, "drop", lambda spark, df: None)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(spark.createDataFrame([(i, "éa b " * i + "c.\nd") for i in range(30)], "doc_id long, text string"), f"{tmp_path}/t", path, end_id=2)
    rows = tables[0].where("counts IS NOT NULL").collect()
    assert rows and all(len(r.counts) == 8 * (1 << 13) for r in rows)
    seen = np.concatenate([np.frombuffer(r.ids, "<u4") for r in token_files.read_tokens(spark, f"{tmp_path}/t").collect()])
    ids, times = np.unique(seen, return_counts=True)
    ranks = [r.token for r in spark.read.parquet(f"{tmp_path}/t/ranks").orderBy("rank").collect()]
    assert ranks == [int(i) for _, i in sorted(zip(-times, ids))]


def test_words_apart_as_whole_texts():
    encoder = token_files.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng, parts = random.Random(1), ["a", "b c", " ", "\n", "é", "中", "'s", ".", "!?", "1", "word", "<|endoftext|>", "\r"]
    texts = ["", "a\nb.", "é ü.\nß!", "don't we'll.", "a\n.b"] + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(500)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
