"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

A rank file lists byte strings with their ranks.  Every byte is mapped to one character
(``chr(0x100 + byte)``: letters, so that nothing is white space to sentencepiece), and the
mapped strings become the pieces of a BPE model with score ``-rank`` and identity
normalisation.  Sentencepiece merges the adjacent pair of highest score, leftmost first,
which is the merge of lowest rank.  A piece's id is its rank.  Decoding maps the pieces of
the ids back to bytes.

A text is cut by the public pattern first and each match is encoded by itself.  A task
keeps the matches it has met in two generations of bounded size; results don't depend on
what is kept.

Defined results: a null text counts as empty (no ids, digests of nothing).  A very long
text is cut and hashed block by block, so only its own characters are held, and a very
long match is encoded but not kept.  Special-token strings are ordinary text.  Repeated
rows and ids give one row each; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratewise.llm.common import add_columns, only

KEPT = 400_000  # matches in a generation
LONG_MATCH = 64  # characters; longer matches are not kept
LONG_TEXT = 2_000_000  # characters; longer texts are cut and hashed block by block
BLOCK = 200_000  # matches in a block of a long text
FIRST = 0x100  # the character of byte 0

_CODECS: dict[str, Codec] = {}


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> rank; the ranks must be 0 to n-1 and hold every single byte."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}, each once")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: a single byte has no rank")
    return ranks


def mapped(data: bytes) -> str:
    """One character per byte."""
    return data.decode("latin-1").translate(_UP)


def unmapped(text: str) -> bytes:
    return text.translate(_DOWN).encode("latin-1")


_UP = {b: FIRST + b for b in range(256)}
_DOWN = {FIRST + b: b for b in range(256)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | bytes) -> bytes:
    """A protocol-buffer field: a whole number, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


# Field numbers and enum values of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, MODEL_BPE, VOCAB_SIZE = 3, 2, 4
NORMALIZER_NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank table: piece i has rank i; the last piece stands
    for the unknown and can't occur, since every byte has a piece."""
    if len(ranks) >= 1 << 24:
        raise ValueError("scores are single floats: fewer than 2^24 ranks are told apart")

    def piece(text: str, score: float, kind: int) -> bytes:
        score_field = _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
        return _field(PIECES, _field(PIECE_TEXT, text.encode()) + score_field + _field(PIECE_TYPE, kind))

    parts = [piece(mapped(data), -float(rank), NORMAL) for data, rank in sorted(ranks.items(), key=lambda x: x[1])]
    parts.append(piece("?", 0.0, UNKNOWN))
    parts.append(_field(TRAINER, _field(MODEL_TYPE, MODEL_BPE) + _field(VOCAB_SIZE, len(parts))))
    parts.append(_field(NORMALIZER, _field(NORMALIZER_NAME, b"identity") + _field(DUMMY_PREFIX, 0)
                        + _field(EXTRA_SPACES, 0) + _field(ESCAPE_SPACES, 0)))
    return b"".join(parts)


class Codec:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from sentencepiece import SentencePieceProcessor

        ranks = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=serialise(ranks))
        self.find = regex.compile(public_tokenizers.PATTERN)
        self.bytes_of = [unmapped(self.model.id_to_piece(i)) for i in range(len(ranks))]
        # A match that is a token as a whole is that token, also where merging ends elsewhere.
        whole = sorted(ranks, key=ranks.__getitem__)
        got = self.model.encode([mapped(x) for x in whole], num_threads=1)
        self.whole = {x: ranks[x] for x, ids in zip(whole, got, strict=True) if ids != [ranks[x]]}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> None:
        young, old, fresh = self.young, self.old, []
        for m in missing:
            if m in old:
                young[m] = old[m]
            else:
                fresh.append(m)
        data = [m.encode() for m in fresh]
        for m, x, ids in zip(fresh, data, self.model.encode([mapped(x) for x in data], num_threads=1), strict=True):
            ids = [self.whole[x]] if x in self.whole else ids
            young[m] = struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, matches: list[str]) -> bytes:
        missing = set(matches).difference(self.young)
        if missing:
            if len(self.young) + len(missing) > KEPT and self.young:
                self.old, self.young = self.young, {}
                missing = set(matches)
            self._learn(missing)
        out = b"".join(map(self.young.__getitem__, matches))
        for m in missing:
            if len(m) > LONG_MATCH:
                del self.young[m]
        return out

    def blocks(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, block by block."""
        if len(text) <= LONG_TEXT:
            yield self._encode(self.find.findall(text))
            return
        matches = (m.group() for m in self.find.finditer(text))
        while some := list(islice(matches, BLOCK)):
            yield self._encode(some)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.blocks(text or ""))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str | None = None) -> Codec:
    """One codec for each Python worker and file."""
    path = path or default_path()
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` plus the ids of a text column as array<int>; null text: no ids."""
    def make(batch: pa.RecordBatch) -> list:
        got = [codec(path).encode(t) for t in batch.column(text).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))
        return [pa.ListArray.from_arrays(pa.array(ends), ids)]

    return add_columns(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` plus the bytes that an array of ids stands for; null: no bytes.  An id outside
    the vocabulary stops the job."""
    def make(batch: pa.RecordBatch) -> list:
        return [[codec(path).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]]

    return add_columns(df, [T.StructField(out, T.BinaryType())], make)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: number of ids, digest of the ids, digest of the bytes that
    decoding the ids gives."""
    def make(batch: pa.RecordBatch) -> list:
        own, out = codec(path), ([], [], [])
        for text in batch.column("text").to_pylist():
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in own.blocks(text or ""):
                n += len(ids) // 4
                ids_hash.update(ids)
                text_hash.update(own.decode(ids))
            for x, v in zip(out, (n, ids_hash.hexdigest(), text_hash.hexdigest()), strict=True):
                x.append(v)
        return list(out)

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return add_columns(only(docs, "doc_id", "text"), fields, make).drop("text")
