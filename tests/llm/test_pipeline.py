"""The pipeline's stages on small tables, each against a plain version of its decision."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from plumbline.llm import byte_pairs, quality_mil

from .test_operators import ITEM, brute_components, labelled


def test_stages(spark, tmp_path):
    rows = labelled()
    rows += [(1000, rows[1][1]), (1001, rows[2][1] + " tail"), (1002, f"{rows[4][1]} {ITEM}"), (1003, rows[5][1] + " password = hunter2hunter2"), (None, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows[:240]], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(at)
        if name != "encode":
            assert at.columns == docs.columns
    quality, near, clean, masked, ids = ({r.doc_id: r for r in d.collect()} for d in seen)
    assert quality_mil.PASSAGE_WORDS and not {i for i in quality if i is not None and i < 240 and i % 3 == 0}
    assert {i for i, _ in rows[:240] if i % 3} <= set(quality)
    kept = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in quality.values()], 90)}
    assert set(near) == kept
    assert set(clean) == set(near) - {1002}
    secret = masked.get(1003) or masked.get(5)
    assert all("hunter2" not in r.text and len(r.text) == r.n_chars for r in masked.values()) and secret is not None
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in masked.items():
        assert np.frombuffer(ids[i].ids, "<u4").tolist() == plain.encode_ordinary(r.text) and ids[i].n_tokens * 4 == len(ids[i].ids)
    whole = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: bytes(r.ids) for i, r in ids.items()}


def test_stages_of_nothing_and_of_odd_columns(spark, tmp_path):
    """Empty tables, and rows without text with columns of names that the stages use."""
    names = ["score", "secrets", "ids", "decoded", "key", "kinds", "i", "h", "g", "l"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, None, None, None, None, *names), (None, "", None, None, 0, *names), (2, "password = hunter2hunter2", None, None, None, *names)]):
        at = spark.createDataFrame(rows, schema)
        columns = at.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == columns
        got = at.collect()
        assert len(got) == len(rows) and all(r[n] == n for r in got for n in names)
        assert not any("hunter2" in (r["text"] or "") for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == len(rows)
