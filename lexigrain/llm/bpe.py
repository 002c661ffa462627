"""Byte-level BPE by a sentencepiece model that is written out from a vocabulary of ranks; nothing is trained.

Each token's bytes become characters (the usual printable byte mapping), its score is its negative rank, and the model
normalises nothing. Each match of the splitting pattern is encoded on its own, so merges by best score are merges by
lowest rank. Decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .memo import ChunkMemo, mapped

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited for bytes, 32-bit for a float, else a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 and rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(token) for token, n in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece i is tokens[i]; the unknown piece comes last."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """encode() and decode() for a list of texts by a rank file and a splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str = public_tokenizers.PATTERN):
        self.tokens = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        chars = byte_characters()
        self.mapping = {b: c for b, c in enumerate(chars)}
        self.memo = ChunkMemo(self.split, self._merge, limit=200_000)
        self.numbers = [str(i) for i in range(len(self.tokens))]

    def _merge(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode([mapped(x, self.mapping) for x in parts], num_threads=1) if parts else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.memo.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        numbers = self.numbers
        return ",".join([numbers[i] for i in ids.tolist()]).encode()


    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of decimal() and of decode(), a slice of the ids at a time."""
        text, raw = hashlib.sha256(), hashlib.sha256()
        for k in range(0, len(ids), DIGESTED):
            part = ids[k : k + DIGESTED]
            text.update(b"," * bool(k) + self.decimal(part))
            raw.update(self.decode(part))
        return text.hexdigest(), raw.hexdigest()


#: Ids that are turned into text at once.
DIGESTED = 1 << 18
_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) for docs(doc_id, text): a row for each input row; null text counts as empty.

    ranks_path names a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for b in batches:
            ids, ends = bpe.memo.encode(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(ids.astype("int32")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "ids"])

    small_batches(docs.sparkSession, size=4 << 20)  # a batch's chunks and places take some ten times its text
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text_bytes for encoded(doc_id, ids): what the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(ranks_path, public_tokenizers.PATTERN).tokens
        for b in batches:
            raw = [b"".join([tokens[i] for i in x or ()]) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "text_bytes"])

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() of every text in one pass over the rows.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes decoded from the ids, both in
    lower-case hex. with_ids adds ids: little-endian integers of 16 bits, or 32 for a larger vocabulary. Null text counts
    as empty; an empty table gives no rows; repeated rows give repeated rows.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        kind = "<u2" if len(bpe.tokens) <= 1 << 16 else "<u4"
        for b in batches:
            flat, ends = bpe.memo.encode(b.column("text"))
            ids = np.split(flat, ends[:-1])[: len(ends)]
            digests = [bpe.digests(x) for x in ids]
            columns = [
                b.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([d for d, _ in digests], pa.string()),
                pa.array([d for _, d in digests], pa.string()),
            ] + [pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession, size=4 << 20)  # a batch's chunks and places take some ten times its text
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
