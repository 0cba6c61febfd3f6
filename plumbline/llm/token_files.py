"""Token ids of documents in a compact file format, and reading them back.

Ids are renumbered by their frequency in the corpus, so that common ones take one byte. Numbers are stored in 1 to 4 bytes; the lengths
stand apart in control bytes, two bits each, four ids to a byte. A reader turns control bytes into lengths by one table lookup, and the
lengths into ids with array operations.

Layout below a folder: `blocks` (Parquet; one row per run of documents: `at`, the number of ids before the run, the documents' ids and
lengths, the control bytes and the data bytes) and `ranks` (rank, token id). Blocks are in ascending document order.

Documents are dealt into ranges of their id (then of a hash of the text, so that a frequent or null id is split), sorted, and encoded
once; the range files are counted and rewritten without another shuffle. Nulls in the id sort first, null texts count as empty, repeated
rows stay. Every document ends with the end id, so none is without ids.
"""

from __future__ import annotations

import json
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.tables import drop, written
from plumbline.llm.words import slices, utf8

#: Bytes of raw ids in one block.
BLOCK = 4 << 20
#: Words whose ids a worker keeps.
KEPT = 2_000_000
#: Counts of ids in one row.
COUNTED = 1 << 13

#: White space besides the space and the line feed.
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x0A, 0x20)]

#: Signs that may stand behind a word.
SIGNS = string.punctuation

#: Lengths of the four numbers of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers that `pack` packed."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    first = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    out = raw[first].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(lengths > i)
        if len(more):
            out[more] |= raw[first[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class _Words(dict):
    """Ids of words behind one kind of gap, worked out when first asked for."""

    def __init__(self, encoder: UnitEncoder, gap: str):
        self.encoder, self.gap = encoder, gap

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encoder.unit(self.gap, word)
        return ids


class UnitEncoder:
    """Encodes texts word by word, keeping the ids of the words it has seen.

    For a byte-level tokenizer with the usual pre-token pattern, a single space or line feed between two other characters starts a new
    pre-token, so words can be encoded apart; a word of letters, with the space before it, is one pre-token, which goes straight to the
    tokenizer's merges. Texts with other white space, or with an added token in them, and all texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        before, model = known["pre_tokenizer"] or {}, known["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not known["normalizer"]
        self.apart = bool(plain and model["type"] == "BPE" and not model.get("dropout"))
        self.merges = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write a byte as the character of its number where that is printable, the others, in order, as characters
        # from 256 on (so the space is U+0120).
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.first, self.spaced, self.lined = (_Words(self, gap) for gap in ("", " ", "\n"))
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, gap: str, word: str) -> bytes:
        if word.isalpha():
            if gap == "\n":  # a pre-token of its own
                return self.line + self.first[word]
            written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.merges.tokenize("\u0120" + written if gap else written)]).tobytes()
        stem = word.rstrip(SIGNS)
        if stem.isalpha():  # the signs behind a word are one pre-token
            return {"": self.first, " ": self.spaced, "\n": self.lined}[gap][stem] + self.first[word[len(stem) :]]
        return self._whole(gap + word)

    def encode(self, text: str) -> bytes:
        flat = text.replace("\n", " ")
        if not self.apart or "  " in flat or flat[:1] == " " or flat[-1:] == " " or any(c in text for c in OTHER_SPACES) or any(t in text for t in self.added):
            return self._whole(text)
        out, words, get = [], self.first, self.spaced.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(words[first])
            out += map(get, rest)
            words = self.lined
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        for words in (self.first, self.spaced, self.lined):
            if len(words) > KEPT:
                words.clear()
        return [self.encode(t) for t in texts]


_encoders: dict[str, UnitEncoder] = {}  # one per worker process


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode `docs` with a tokenizer file (present on every worker) and write them below `folder`."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = UnitEncoder(tokenizer)
        at, total = 0, np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pa.array([x + end for x in _encoders[tokenizer]([t or "" for t in part.column("text").to_pylist()])], pa.binary())
                raw, offsets = utf8(ids)
                seen = np.bincount(raw.view("<u4"), minlength=len(total))
                seen[: len(total)] += total
                total, n = seen, np.diff(offsets) // 4
                begin = at + np.cumsum(n) - n
                at += int(n.sum())
                made = {"part": part.column("part"), "at": pa.array(begin), "id": part.column("id"), "n": pa.array(n), "ids": ids}
                yield pa.record_batch(made | {"counts": pa.nulls(len(ids), pa.binary())})
        if at:  # last rows, numbered by `at`, hold how often this task has met each id
            counts = [x.tobytes() for x in np.pad(total, (0, -len(total) % COUNTED)).reshape(-1, COUNTED)]
            none = {c: pa.nulls(len(counts), x.type) for c, x in made.items()}
            yield pa.record_batch(none | {"at": pa.array(range(len(counts)), pa.int64()), "counts": pa.array(counts, pa.binary())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text", F.spark_partition_id().alias("part"))
    both = written(dealt.mapInArrow(encode, f"part int, at long, id {kind}, n long, ids binary, counts binary"))
    encoded = both.where("counts IS NULL").drop("counts")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "counts": [sum(np.frombuffer(x, np.int64) for x in pdf["counts"]).tobytes()]})

    # Whole rows of counts are summed, in two steps, so that no group holds a row of every task; the vocabulary's size reaches the driver.
    schema = "at long, counts binary"
    counted = both.where("counts IS NOT NULL").select("at", "counts").groupBy("at", F.floor(F.spark_partition_id() / 64)).applyInPandas(add, schema)
    counted = sorted(counted.groupBy("at").applyInPandas(add, schema).collect())
    times = np.frombuffer(b"".join(r["counts"] for r in counted), np.int64) if counted else np.zeros(0, np.int64)
    some = np.flatnonzero(times)
    tokens = some[np.argsort(-times[some], kind="stable")].tolist()
    spark.createDataFrame(list(enumerate(tokens)), "rank long, token long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(tokens, default=0) + 1, np.uint32)
    rank[tokens] = np.arange(len(tokens), dtype=np.uint32)
    sizes = sorted((r["part"], r["n"]) for r in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())
    origin = dict(zip([p for p, _ in sizes], np.cumsum([0] + [n for _, n in sizes]).tolist()))
    shared = spark.sparkContext.broadcast((rank, origin))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, origin = shared.value
        for batch in batches:
            for part in slices(batch, "ids", BLOCK):
                parts, at, n = (part.column(c).to_numpy() for c in ("part", "at", "n"))
                ids, (raw, offsets) = part.column("id"), utf8(part.column("ids"))
                cuts = np.flatnonzero((np.diff(parts) != 0) | (at[1:] != at[:-1] + n[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                    control, data = pack(rank[raw[offsets[a] : offsets[b]].view("<u4")])
                    yield pa.record_batch(
                        {
                            "at": pa.array([origin[int(parts[a])] + int(at[a])]),
                            "ids": pa.array([ids[a:b].to_pylist()], pa.list_(ids.type)),
                            "sizes": pa.array([n[a:b].tolist()], pa.list_(pa.int64())),
                            "control": pa.array([control]),
                            "data": pa.array([data]),
                        }
                    )

    blocks = encoded.mapInArrow(code, f"at long, ids array<{kind}>, sizes array<long>, control binary, data binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    drop(spark, both)


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per written document: its id, `start` (ids of all documents before it), `n_tokens`, and `ids` as 32-bit integers."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    tokens = np.array([r["token"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(tokens)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sizes = batch.column("sizes").slice(r, 1).flatten().to_numpy()
                ids = shared.value[unpack(batch.column("control")[r].as_py(), batch.column("data")[r].as_py(), int(sizes.sum()))].tobytes()
                ends = np.cumsum(sizes)
                cut = pa.array(np.concatenate([[0], ends * 4]).astype(np.int32))
                yield pa.record_batch(
                    {
                        id_col: batch.column("ids").slice(r, 1).flatten(),
                        "start": pa.array(batch.column("at")[r].as_py() + ends - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids": pa.Array.from_buffers(pa.binary(), len(sizes), [None, cut.buffers()[1], pa.py_buffer(ids)]),
                    }
                )

    return blocks.mapInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
