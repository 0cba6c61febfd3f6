"""Byte-level BPE encoding of long and short texts, and decoding.

Texts of at most `chunk` characters are encoded where they stand. Longer ones are cut into chunks that overlap; the chunks are dealt out
and split into pre-tokens in parallel. Splitting from any place agrees with splitting the whole text from the first boundary on that
both have, so neighbours are stitched at their first common boundary in the overlap. The pieces between stitches are encoded in
parallel, their ids joined in order. Where two chunks share no boundary (one run longer than the overlap), the rest of that text is one
piece. Decoding concatenates the bytes of the ids.

Null texts count as empty and have no ids. Other columns, repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.tables import free, without, written
from plumbline.llm.words import slices

#: Characters behind a boundary that decide whether it is one: the longest alternative of the pattern looks that far ahead.
MARGIN = 4

_known: dict = {}  # one encoder per worker process and vocabulary


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _known:
        _known[path, pattern] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _known[path, pattern]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", chunk: int = 1 << 15, overlap: int = 1 << 11) -> DataFrame:
    """`docs` with the ids of each text as little-endian unsigned 32-bit integers in the binary column `out`.

    `path` is the vocabulary's rank file, on every worker; `pattern` splits a text into pre-tokens. A column of that name is replaced.
    """
    docs = without(docs, [out], (text_col,))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = [_packed(bpe.encode_ordinary(t)) if t else b"" for t in part.column(text_col).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, out])

    few = F.coalesce(F.length(text_col), F.lit(0)) <= chunk
    return docs.where(few).mapInArrow(short, schema).unionByName(_long(docs.where(~few), path, pattern, text_col, out, chunk, overlap))


def boundaries(text: str, splitter: regex.Pattern, begin: int, end: int) -> list[int]:
    """Pre-token boundaries of `text` from `begin` to `end`."""
    return [m.start() for m in splitter.finditer(text) if begin <= m.start() <= end]


def _long(docs: DataFrame, path: str, pattern: str, text_col: str, out: str, chunk: int, overlap: int) -> DataFrame:
    step = chunk - overlap
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias(free(docs, "_")))
    # Numbered where the rows are read, before anything is dealt out, so a repeated task gives the same numbers.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), F.col(f"`{text_col}`").alias("text"))
    kinds = T.StructType([T.StructField("row", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("rest", rows.schema["rest"].dataType), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py()
                starts = list(range(0, max(1, len(text) - overlap), step))
                yield pa.record_batch(
                    {
                        "row": batch.column("row").take(pa.array([r] * len(starts))),
                        "i": pa.array(range(len(starts)), pa.int32()),
                        "last": pa.array([i + 1 == len(starts) for i in range(len(starts))]),
                        "rest": batch.column("rest").take(pa.array([r] + [None] * (len(starts) - 1), pa.int64())),
                        "text": pa.array([text[s : s + chunk] for s in starts]),
                    }
                )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for i, last, text in zip(*(batch.column(c).to_pylist() for c in ("i", "last", "text")), strict=True):
                heads.append([p + i * step for p in boundaries(text, splitter, 0, overlap - MARGIN)] if i else [])
                tails.append([] if last else [p + i * step for p in boundaries(text, splitter, step, len(text) - MARGIN)])
            kind = pa.list_(pa.int64())
            yield pa.record_batch([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*batch.schema.names, "heads", "tails"])

    both = T.StructType([*kinds.fields, T.StructField("heads", T.ArrayType(T.LongType())), T.StructField("tails", T.ArrayType(T.LongType()))])
    chunks = written(rows.mapInArrow(cut, kinds).repartition(F.col("row"), F.col("i")).mapInArrow(split, both))

    before = chunks.select("row", (F.col("i") + 1).alias("i"), F.col("tails").alias("before"))
    order = Window.partitionBy("row").orderBy("i")
    stitches = chunks.select("row", "i", "heads").join(before, ["row", "i"], "left")
    stitches = stitches.withColumn("at", F.when(F.col("i") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("heads", "before"))))
    broken = F.min(F.when(F.col("at").isNull(), F.col("i"))).over(order)  # the first chunk without a stitch
    stitches = stitches.select("row", "i", "at", F.coalesce(broken - 1, F.col("i")).alias("piece"))
    stitches = stitches.withColumn("until", F.when(F.lead("piece").over(order) != F.col("piece"), F.lead("at").over(order)))

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        begin, end, text = int(pdf["at"].iloc[0]), pdf["until"].iloc[-1], ""
        origin = int(pdf["i"].iloc[0]) * step
        parts = [t[:step] for t in pdf["text"].iloc[:-1]] + [pdf["text"].iloc[-1]]
        text = "".join(parts)[begin - origin : None if pd.isna(end) else int(end) - origin]
        return pd.DataFrame({"row": [key[0]], "i": [int(pdf["i"].iloc[0])], "ids": [_packed(encoder(path, pattern).encode_ordinary(text))]})

    pieces = chunks.select("row", "i", "text").join(stitches, ["row", "i"])
    ids = pieces.groupBy("row", "piece").applyInPandas(join, "row long, i int, ids binary")
    inner = F.sort_array(F.collect_list(F.struct("i", "ids")))
    ids = ids.groupBy("row").agg(inner.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    texts = chunks.select("row", "i", "last", "rest", F.when(F.col("last"), F.col("text")).otherwise(F.expr(f"substring(text, 1, {step})")).alias("text"))
    texts = texts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("texts"), F.min_by("rest", "i").alias("rest"))
    whole = F.array_join(F.transform("texts", lambda p: p["text"]), "")
    done = texts.join(ids, "row")
    columns = [whole.alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns]
    return done.select(*columns, joined.alias(out))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the bytes that its ids stand for, in the binary column `out`, which replaces one of that name."""
    encoded = without(encoded, [out], (ids_col,))
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            _known[path] = {i: b for b, i in load_ranks(path).items()}
        table = _known[path]
        for batch in batches:
            for part in slices(batch, ids_col):
                texts = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(ids_col).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, out])

    return encoded.mapInArrow(look_up, schema)
