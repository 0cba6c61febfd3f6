"""Pieces of text that tokenizers encode independently of each other, so that each different piece is encoded once.

A unit begins at a space or line feed behind a character that is no white space, and at the begin of a text. There every pre-token of a
byte-level tokenizer with the usual pattern ends, and so does every piece of a vocabulary without pieces that have a space mark behind
another character. The units of a text joined are the text.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

#: ASCII bytes that some library takes for white space.
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True

#: White space beyond ASCII, as some library has it, by its last two or three bytes.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_ENDS = tuple(_WIDE)
_TAILS = np.zeros(1 << 24, bool)
for _sign in _WIDE:
    if len(_sign) == 3:
        _TAILS[int.from_bytes(_sign)] = True
    else:
        _TAILS[int.from_bytes(_sign) + (np.arange(256) << 16)] = True

#: The space mark of piece vocabularies.
MARK = "▁".encode()


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each unit of the texts bounded by `offsets`; texts without bytes have none."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    before = data[at - 1]
    cut = ~_ASCII[before]
    wide = np.flatnonzero(cut & (before >= 0x80))
    if len(wide):
        p = at[wide]
        three = data[p - 1].astype(np.int64) | data[p - 2].astype(np.int64) << 8 | data[np.maximum(p - 3, 0)].astype(np.int64) << 16
        cut[wide] = ~_TAILS[three]
    first = np.zeros(len(data), bool)
    first[at[cut]] = True
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


def distinct_units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of the distinct unit at each place, and the distinct units. The units fill `data`."""
    ends = np.append(starts, len(data)).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    coded = made.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _alone(unit: bytes) -> bool:
    """The unit can't stand in the middle of a joined text."""
    return unit[0] not in b" \n" or _ASCII[unit[-1]] or unit.endswith(_ENDS) or MARK in unit


class _Coder:
    """Ids of units; `size` has the number of bytes of each id. Joined units are encoded in one go and told apart by their bytes.

    Unless `apart`, only whole texts may be given as units.
    """

    size: np.ndarray
    apart: bool

    def joined(self, text: bytes) -> list[int]:
        raise NotImplementedError

    def alone(self, unit: bytes) -> list[int]:
        raise NotImplementedError

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and the number of ids of each."""
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        easy = [u for u in units if not _alone(u)] if self.apart else []
        sizes = np.array([len(u) for u in easy], np.int64)
        ids = np.array(self.joined(b"".join(easy)) if easy else [], np.int64)
        ends, wanted = np.cumsum(self.size[ids]), np.cumsum(sizes)
        cut = np.searchsorted(ends, wanted)
        if len(ids) != (int(cut[-1]) + 1 if easy else 0) or not np.array_equal(ends[cut], wanted):  # the text was changed: each for itself
            easy, cut, ids = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(easy) == len(units):
            return ids, np.diff(cut, prepend=-1)
        parts, at = [], iter(np.split(ids, cut[:-1] + 1) if easy else [])
        easy = set(easy)
        parts = [next(at) if u in easy else np.array(self.alone(u), np.int64) for u in units]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


class ByteLevel(_Coder):
    """Byte-level BPE from a tokenizers file; strings of special tokens are plain text."""

    def __init__(self, path: str, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        known = json.loads(self.tokenizer.to_str())
        before, model = known["pre_tokenizer"] or {}, known["model"]
        usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not known["normalizer"]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.apart = bool(usual and model["type"] == "BPE" and not model.get("dropout") and not any(t.lstrip or t.rstrip or t.single_word or set(t.content) & set(" \n") for t in added))
        # Byte-level vocabularies write a byte as the character of its number where that is printable, the others, in order, as characters
        # from 256 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        letters = {chr(b): b for b in printable} | hidden
        self.bytes = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            plain = all(c in letters for c in token)
            self.bytes[i] = bytes(letters[c] for c in token) if plain else token.encode()
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def joined(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    alone = joined


class Pieces(_Coder):
    """Pieces of a sentencepiece model that adds a space; units come with that space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any("\n" in n or re.search("[^▁]▁", n) for n in names)
        self.bytes = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id("▁")

    def alone(self, unit: bytes) -> list[int]:
        text = unit.decode()
        if text == " ":  # nothing is added to nothing
            return [self.space]
        if text[0] == " ":
            return self.model.encode(text[1:])
        ids = self.model.encode(text)
        return ids[1:] if ids[:1] == [self.space] else []  # without the added space

    joined = alone
