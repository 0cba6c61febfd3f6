"""Columns of the names that operators use inside come back as they were; columns of the names they make are replaced."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import byte_pairs, cross_tokenizer, decontamination, jaccard_join, language_id, license_scan, minhash_dedup, quality_mil, secret_scan, toxicity_chain
from plumbline.llm.tables import free, without

NAMES = """_ _class _g _h _i _key _kinds _l _row _run a at b bands bits block bucket c cls component counts data decoded entropies entries found
g h heads held i ids j key kinds l label lang_pred last least letters level licenses m marks more n name number out p p_toxic part piece
place q rejected rest run score secrets sig tails text_a text_b tree turn unmatched until v x y""".split()
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    long = "Some longer words stand here, one behind the other. " * 900
    rows = [(1, "password: hunter2hunter2 is here."), (2, None), (3, ""), (4, long), (5, long + "x"), (6, "Licensed under the Apache License, Version 2.0.\nMore text.")]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in rows], "doc_id long, text string, lang string")
    return df.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in NAMES])


def kept(df, made, rows=6):
    """All columns of the table that are not made stand in the result as they were."""
    got = df.collect()
    assert len(got) == rows and len(set(df.columns)) == len(df.columns)
    for r in got:
        assert all(r[n] == f"{n}-{r['doc_id']}" for n in NAMES if n not in made)
    assert set(made) <= set(df.columns)
    return {r["doc_id"]: r for r in got}


def test_secrets(docs):
    found = secret_scan.find_secrets(docs)
    assert kept(found, ["secrets"])[1]["secrets"]
    named = secret_scan.find_secrets(docs, out="hits")
    assert "hunter2" not in kept(secret_scan.redact(named, secrets="hits"), [])[1]["text"]


def test_licences(docs):
    assert kept(license_scan.find_licenses(docs), ["licenses", "unmatched"])[6]["licenses"] == "Apache-2.0"


def test_byte_pairs(docs):
    done = byte_pairs.decode(byte_pairs.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI)
    rows = kept(done, ["ids", "decoded"])
    assert bytes(rows[4]["decoded"]).decode() == rows[4]["text"]


def test_quality(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    assert kept(quality_mil.score(docs, None), ["score"])[1]["score"] == 0.5
    model = quality_mil.fit(docs, labels)
    assert 0 <= kept(quality_mil.score(docs, model), ["score"])[4]["score"] <= 1
    assert [c for c in quality_mil.score(docs, model, out="Score").columns if c.lower() == "score"] == ["Score"]


def test_languages(docs):
    model = language_id.fit(docs)
    assert kept(language_id.predict(docs, model), ["lang_pred", "score", "rejected"])[4]["lang_pred"] in ("de", "en")
    kept(language_id.predict(docs, None), ["lang_pred", "score", "rejected"])


def test_toxicity(docs, spark):
    names = [*toxicity_chain.SEEDS, "toxic"]
    made = [f"p_{n}" for n in names]
    kept(toxicity_chain.score(docs, None, names), made)
    bad = " ".join(w for words in toxicity_chain.SEEDS.values() for w in words)
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, f"{bad} {i}" if i % 2 else f"fine words {i}") for i in range(100, 160)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)], "doc_id long, toxic int")
    kept(toxicity_chain.score(docs, toxicity_chain.fit(many, labels), names), made)


def test_copies(docs, spark):
    rows = kept(jaccard_join.one_per_component(docs), [], rows=5)
    assert 4 in rows and 5 not in rows
    assert jaccard_join.jaccard_components(docs).columns == ["doc_id", "n_shingles", "component_id"]
    assert minhash_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").collect() == [(5,)]
    items = spark.createDataFrame([("q", "Licensed under the Apache License, Version 2.0. More text.")], "item_id string, text string")
    assert 6 not in kept(decontamination.decontaminate(docs, items), [], rows=5)
    assert cross_tokenizer.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 6


def test_what_is_read_is_not_replaced(docs):
    with pytest.raises(ValueError):
        quality_mil.score(docs, None, text_col="text", out="TEXT")
    assert free(docs, "Key") == "Key_" and free(docs, "nothing") == "nothing"
    assert "ids" not in without(docs, ["IDS"]).columns
