"""Ids are counted while they are encoded."""

from __future__ import annotations

import public_tokenizers

from plumbline.llm import token_files


def test_counts_come_with_the_encoding(spark, tmp_path, monkeypatch):
    tables, write = [], token_files.written

    def written(df):
        tables.append(write(df))
        return tables[-1]

    monkeypatch.setattr(token_files, "written", written)
    monkeypatch.setattr(token_files, "drop", lambda spark, df: None)
    docs = [(i, "a b " * i + "c") for i in range(50)] + [(None, None), (7, "")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_path}/t", path, end_id=2)
    rows = token_files.read_tokens(spark, f"{tmp_path}/t").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
    counted = [r.counts for r in tables[0].where("counts IS NOT NULL").select("counts").collect()]
    assert sum(int.from_bytes(c[8 * i : 8 * i + 8], "little") for c in counted for i in range(len(c) // 8)) == sum(r.n_tokens for r in rows)
