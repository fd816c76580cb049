"""Byte-level BPE encoding and decoding through a sentencepiece model.

A rank file (one ``base64 rank`` line per token) is turned into a serialised
sentencepiece BPE model: each token's bytes are written as a string of 256
stand-in characters, its score is the negative rank, and the normaliser does
nothing.  Merging the adjacent pair with the best score is then the same as
merging the pair with the lowest rank.  A pre-token that is itself a token is
taken whole, as byte-level encoders do.

Encoding and decoding are map-only (``mapInArrow``): no shuffle, a lost task
is simply run again, and memory is bounded by a few hundred texts, the model
(about 2 MB) and a cache of short pre-tokens with a fixed number of entries.
Where ids are also decoded, the same worker does both for one text after the
other.

Defined results: null text is the empty text and gives no ids; a text of any
length is encoded whole; an empty table gives no rows; repeated rows give
repeated results; further columns pass through unless they bear the name
of an output column, which then wins.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import REMEMBERED, Remembered, slices, small_batches, whole_text

#: Byte b is written as the character with code point FIRST_STAND_IN + b.
FIRST_STAND_IN = 0x2800
STAND_INS = [chr(FIRST_STAND_IN + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def as_stand_ins(data: bytes) -> str:
    return "".join(map(STAND_INS.__getitem__, data))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model (protobuf wire format) of a rank table with ranks 0..n-1.

    Piece i is the token of rank i, so piece ids are token ids; the unknown
    piece the format asks for comes last and is never produced, since every
    byte is a token.
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0..n-1")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_block(1, as_stand_ins(t).encode()) + b"\x15" + struct.pack("<f", -float(i)) + _number(3, normal)
              for i, t in enumerate(tokens)]
    pieces.append(_block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Encodes texts with the model; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.known = Remembered(REMEMBERED, self._ids)

    def _ids(self, pretoken: str) -> bytes:
        """A pre-token that is a token counts as a whole, others are merged by the model."""
        data = pretoken.encode()
        whole = self.ranks.get(data)
        return struct.pack("<I", whole) if whole is not None else np.asarray(self.model.encode(as_stand_ins(data)), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))


class Decoder:
    """Turns ids back into bytes; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = sorted(ranks, key=ranks.get)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, made once."""
    return Encoder(read_ranks(path), pattern)


@lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _mapped(df: DataFrame, source: str, targets: dict[str, tuple[pa.DataType, str]], make) -> DataFrame:
    """``df`` with the columns ``targets`` made by ``make()(value)``, a tuple, from ``source``, which goes unless it is a target."""
    kept = [c for c in df.columns if c != source and c not in targets]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept),
                        *(f"`{c}` {kind}" for c, (_, kind) in targets.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in slices(batches):
            rows = [one(v.as_py()) for v in batch.column(source)]
            made = [pa.array([r[i] for r in rows], kind) for i, (kind, _) in enumerate(targets.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *targets])

    return small_batches(df).select(*kept, source).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian u32) in place of the text, and ``n_tokens``."""
    def make():
        ids_of = encoder(path, pattern).encode
        return lambda value: (lambda ids: (len(ids) // 4, ids))(ids_of(value))

    texts = docs.withColumn(text, whole_text(text))
    return _mapped(texts, text, {"n_tokens": (pa.int64(), "long"), "ids": (pa.binary(), "binary")}, make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (the bytes the ids stand for) in place of ``ids``."""
    def make():
        decoded = decoder(path).decode
        return lambda ids: (decoded(ids),)

    return _mapped(encoded, "ids", {"decoded": (pa.binary(), "binary")}, make)


def _round(path: str, pattern: str):
    """A text's ids, and the bytes that they decode to: encoded and decoded by one worker, one text at a time."""
    encoded, decoded = encoder(path, pattern).encode, decoder(path).decode

    def one(text: str) -> tuple[bytes, bytes]:
        ids = encoded(text)
        return ids, decoded(ids)

    return one


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of the bytes decoded from them."""
    def make():
        both = _round(path, pattern)

        def one(value: str):
            ids, decoded = both(value)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return one

    targets = {"n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
    return _mapped(docs.withColumn(text, whole_text(text)), text, targets, make)


def encode_checked(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As :func:`encode`, with ``decodes``: whether the ids decode to the text's bytes."""
    def make():
        both = _round(path, pattern)

        def one(value: str):
            ids, decoded = both(value)
            return len(ids) // 4, ids, decoded == value.encode()

        return one

    targets = {"n_tokens": (pa.int64(), "long"), "ids": (pa.binary(), "binary"), "decodes": (pa.bool_(), "boolean")}
    return _mapped(docs.withColumn(text, whole_text(text)), text, targets, make)
