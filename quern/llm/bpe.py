"""Byte-level BPE encoding and decoding through a serialised sentencepiece model (operator 4).

The rank file becomes a sentencepiece BPE model: byte b is written as the character U+0100 + b, a piece's score is its
negative rank, and normalisation is the identity. Pre-tokens are encoded apart, as the rank library does: a pre-token
that is itself in the vocabulary is one id. Decoding maps ids back to bytes through the inverse table.

Texts are read in pieces, each distinct piece of a batch encoded once (quern.llm.pieces).

Defined cases: null text is empty, empty text has no ids and hashes of nothing; texts are never shortened; repeated
rows are encoded each; columns besides those asked for are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import worker
from quern.llm.pieces import PieceCoder
from quern.session import prepare, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens, and pieces in each of two generations, that a worker remembers; bounds memory, not results.
REMEMBERED = 120_000
_SHIFT = {b: 0x100 + b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def mapped(raw: bytes) -> str:
    """Bytes as characters U+0100 to U+01FF."""
    return raw.decode("latin-1").translate(_SHIFT)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank table. Piece 0 is the unknown piece; rank r is piece r's place + 1."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [_field(1, _field(1, b"<unk>") + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _flag(3, 2))]
    for raw, rank in by_rank:
        pieces.append(_field(1, _field(1, mapped(raw).encode()) + struct.pack("<Bf", 2 << 3 | 5, -float(rank)) + _flag(3, 1)))
    trainer = _field(2, _flag(3, 2) + _flag(4, len(pieces)) + _flag(40, 0) + _varint(41 << 3) + _varint((1 << 64) - 1) + _varint(42 << 3) + _varint((1 << 64) - 1) + _varint(43 << 3) + _varint((1 << 64) - 1))
    normaliser = _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return b"".join(pieces) + trainer + normaliser


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.ordered = np.array([r for _, r in sorted(self.ranks.items(), key=lambda x: x[1])], dtype=np.uint32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern).findall
        self.bytes_of = {r: raw for raw, r in self.ranks.items()}
        self.whole = {raw: struct.pack("<I", r) for raw, r in self.ranks.items()}
        self.parts: dict[str, bytes] = {}
        self.encode_all = PieceCoder(self._learn, REMEMBERED).encode_all

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces: their pre-tokens by the vocabulary itself, else by the model, each distinct one once."""
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        cut = [self.split(p) for p in pieces]
        hard = []
        for t in {t for ts in cut for t in ts}:
            if t not in self.parts:
                one = self.whole.get(t.encode("utf-8", "surrogatepass"))
                if one is None:
                    hard.append(t)
                else:
                    self.parts[t] = one
        for t, ids in zip(hard, self.model.encode([mapped(t.encode("utf-8", "surrogatepass")) for t in hard], num_threads=1) if hard else []):
            self.parts[t] = self.ordered[np.array(ids, dtype=np.int64) - 1].tobytes()
        get = self.parts.__getitem__
        return [b"".join(map(get, ts)) for ts in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


worker.remembers(__name__, codec.cache_clear)


def codec_mapper(path: str | None, pattern: str | None, tokens: bool = False):
    """Arrow mapper over (doc_id, text): counts and digests, or with tokens also the ids themselves."""

    def run(batches):
        import public_tokenizers

        worker.begin(__name__)
        c = codec(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
        for b in batches:
            ids = c.encode_all(b.column("text").to_pylist())
            cols = [
                b.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for. path: the rank file, on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * tokens
    return docs.select("doc_id", "text").mapInArrow(codec_mapper(path, pattern, tokens), schema)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded."""
    return encode_documents(table(prepare(spark), sf_dir, "documents"))


QUERIES = {"op4_bpe_codec": op4_bpe_codec}
ORACLES: dict[str, str] = {}
