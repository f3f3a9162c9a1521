"""Byte-level BPE encoding and decoding through a sentencepiece model written straight from the vocabulary.

Each vocabulary entry becomes a piece: its bytes mapped to one character a byte, scored by its negative rank, under
identity normalisation, so that sentencepiece's best-score merges are the lowest-rank merges of the vocabulary. Texts
are split into pre-tokens by the vocabulary's pattern, every distinct pre-token is encoded once a worker, and decoding
is the inverse mapping from id to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pre-tokens that a worker remembers, and the longest worth remembering.
REMEMBERED, LONGEST = 500_000, 64
#: The first character that stands for a byte. No other character occurs, so any block of 256 letters will do.
BASE = 0x4E00


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_characters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_UP)


_UP = {b: BASE + b for b in range(256)}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is rank i, and one unknown piece at the end."""
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must run from 0 without gaps")
    # fixed values: field numbers and types of the public sentencepiece model format
    normal, unknown, bpe = 1, 2, 2
    body = b"".join(_field(1, _field(1, as_characters(raw).encode()) + _field(2, float(-rank)) + _field(3, normal)) for raw, rank in pieces)
    body += _field(1, _field(1, b"<unk>") + _field(2, float(-len(pieces))) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces))  # model type, size, id of the unknown piece
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, extra spaces kept, not escaped
    return body + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary; see coder_of."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = load_ranks(path)
        self.bytes_of = [raw for raw, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        raws = [w.encode("utf-8") for w in words]
        rest = [i for i, r in enumerate(raws) if r not in self.ranks]  # an entry of the vocabulary is itself, merges or not
        out = {w: (self.ranks[r],) for w, r in zip(words, raws, strict=True) if r in self.ranks}
        for i, ids in zip(rest, self.model.encode([as_characters(raws[i]) for i in rest], num_threads=1), strict=True):
            out[words[i]] = tuple(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        words, known = self.split(text or ""), self.known
        try:
            return [i for w in words for i in known[w]]
        except KeyError:
            distinct = set(words)
            new = self._learn([w for w in distinct if w not in known])
            found = {w: new[w] if w in new else known[w] for w in distinct}
            if len(known) < REMEMBERED:  # frequent pre-tokens come early, so the first ones stay
                known.update(x for x in new.items() if len(x[0]) <= LONGEST)
            return [i for w in words for i in found[w]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder_of(vocabulary: str, pattern: str) -> ByteBpe:
    """One a worker process, so that what a task has learnt serves the next."""
    if (vocabulary, pattern) not in _CODERS:
        _CODERS[vocabulary, pattern] = ByteBpe(vocabulary, pattern)
    found = _CODERS[vocabulary, pattern]
    common.claim(f"bytes {vocabulary}", found.known)
    return found


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text (null: empty) and decode the ids: id_col, n_tokens, ids_sha256, decoded_sha256.

    One row per input row in its own task, no shuffle; null and repeated ids stay as they are; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)

    def code(batches):
        coder = coder_of(vocabulary, pattern)
        names = [b"%d" % i for i in range(len(coder.bytes_of))]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                listed = b" ".join([names[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(code, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of text_col as an array<int> column."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([np.array(coder.encode(t), np.int32) for t in texts])

    return docs.withColumn(out_col, encode(F.col(text_col)))
