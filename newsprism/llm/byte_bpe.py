"""Byte-level BPE on a sentencepiece model written directly from a rank file.

Every byte string of the rank file becomes one piece: its bytes are mapped to
printable characters and its score is the negative rank, so the piece merged first
is the one of lowest rank. Normalisation is the identity. Pre-tokens are encoded one
by one; decoding maps pieces back to bytes. Nothing is trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.llm.common import pick, worker_state

#: Pre-tokens that one Python worker remembers with their ids; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Rows whose results a worker holds at once.
SLICE = 256
#: Only pre-tokens up to this many bytes are remembered.
REMEMBERED_BYTES = 64


def byte_characters() -> list[str]:
    """One printable character per byte value: the byte itself if it prints, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 piece, rank per line); the vocabulary bounds its size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model (protocol buffer) whose piece i + 1 is the piece of rank i; piece 0 is unknown."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    to_char = byte_characters()
    text = ["".join(map(to_char.__getitem__, piece)) for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a piece: {missing[:5]}")
    score = lambda x: _varint(2 << 3 | 5) + np.float32(x).tobytes()
    pieces = [_field(1, _field(1, b"<unk>") + score(0) + _flag(3, 2))]
    pieces += [_field(1, _field(1, t.encode()) + score(-rank)) for rank, t in enumerate(text)]
    trainer = _flag(3, 2) + _flag(4, len(pieces))  # BPE; vocabulary size
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.to_char = {b: ord(c) for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = [bytes(map(back.__getitem__, self.model.id_to_piece(i + 1)))
                         for i in range(self.model.get_piece_size() - 1)]
        rank_of = {piece: rank for rank, piece in enumerate(self.bytes_of)}
        codec = self

        class Known(dict):
            def __missing__(self, token: str) -> bytes:
                raw = token.encode()
                rank = rank_of.get(raw)  # a pre-token that is a piece needs no merge
                ids = [rank] if rank is not None else codec.merge(raw)
                packed = np.array(ids, dtype="<u4").tobytes()
                if len(raw) <= REMEMBERED_BYTES:
                    self[token] = packed
                return packed
        self.known = Known()

    def merge(self, raw: bytes) -> list[int]:
        return [i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.to_char))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _codec(model: bytes, pattern: str) -> Codec:
    """The worker's codec: later tasks of the same worker find it warm."""
    return worker_state(("byte_bpe", model, pattern), lambda: Codec(model, pattern))


def encode_column(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids of each text as packed little-endian unsigned 32-bit integers (binary); null reads as empty."""
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            yield pd.Series([codec.encode(t or "") for t in batch], dtype=object)
    return encode(text)


def decode_column(spark: SparkSession, ids: Column, ranks_path: str, pattern: str) -> Column:
    """Bytes of packed ids; null stays null."""
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            yield pd.Series([None if p is None else codec.decode(p) for p in batch], dtype=object)
    return decode(ids)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (packed), decoded (binary).

    Special-token strings are ordinary text. Null and empty texts give no ids and
    empty bytes; ids may be null; repeated rows each return a row; an empty table
    gives an empty result. Scan and one pass of the workers, no shuffle; results
    leave a worker SLICE rows at a time.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                ids = [codec.encode(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())],
                    names=["doc_id", "ids", "decoded"])

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(both, "doc_id long, ids binary, decoded binary")
