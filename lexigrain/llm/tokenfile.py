"""Token-ID files: every id in the fewest bits that the vocabulary needs, in blocks that numpy unpacks at once.

File: header | packed blocks | footer | tail. Block k holds the ids k * BLOCK .. and starts at offsets[k], so any id or
document is found without reading what lies before it. The footer has the block offsets, the doc_ids, a null mark for
each and the end of each document among the file's ids. A dataset is a set of such files; its manifest, a Parquet table
written by Spark, lists those of successful tasks, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .common import small_batches
from .memo import ChunkMemo, mapped

MAGIC = b"LGIDS001"
HEAD = struct.Struct("<8sIIQQ")  # magic, bits, ids in a block, documents, ids
TAIL = struct.Struct("<QQ8s")  # footer offset, blocks, magic
BLOCK = 1 << 16


def bits_needed(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, least significant bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(planes.astype("u1").reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of packed bytes as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(raw, dtype="u1"), count=count * bits, bitorder="little").reshape(count, bits)
    return planes.astype("<u4") @ (np.uint32(1) << np.arange(bits, dtype="<u4"))


class Writer:
    """Writes one file; holds no more ids than a block and a document."""

    def __init__(self, out: BinaryIO, bits: int):
        self.out, self.bits, self.at = out, bits, HEAD.size
        self.rest, self.held = [], 0
        self.ids, self.offsets, self.docs, self.nulls, self.ends = 0, [], [], [], []
        out.write(HEAD.pack(MAGIC, bits, BLOCK, 0, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id is outside the vocabulary")
        self.ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            held = np.concatenate(self.rest)
            whole = len(held) // BLOCK * BLOCK
            for a in range(0, whole, BLOCK):
                self._block(held[a : a + BLOCK])
            self.rest, self.held = [held[whole:]], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        """Writes the rest, the footer with the counts, and the tail: a stream can't go back to its header."""
        if self.held:
            self._block(np.concatenate(self.rest))
        footer = HEAD.pack(MAGIC, self.bits, BLOCK, len(self.docs), self.ids) + np.asarray(self.offsets, "<u8").tobytes()
        footer += np.asarray(self.docs, "<i8").tobytes() + np.asarray(self.nulls, "u1").tobytes() + np.asarray(self.ends, "<u8").tobytes()
        self.out.write(footer + TAIL.pack(self.at, len(self.offsets), MAGIC))


class Reader:
    """Random access to one file: f needs seek() and read()."""

    def __init__(self, f: BinaryIO):
        self.f = f
        size = f.seek(0, 2) or f.tell()
        f.seek(size - TAIL.size)
        at, blocks, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token-ID file, or cut off")
        f.seek(at)
        raw = f.read(size - TAIL.size - at)
        _, self.bits, self.block, n, self.n_ids = HEAD.unpack_from(raw)
        p = HEAD.size
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks, p), np.uint64(at)).astype("i8")
        p += 8 * blocks
        docs = np.frombuffer(raw, "<i8", n, p)
        nulls = np.frombuffer(raw, "u1", n, p + 8 * n)
        self.docs = [None if z else int(d) for d, z in zip(docs, nulls, strict=True)]
        self.ends = np.frombuffer(raw, "<u8", n, p + 9 * n).astype("i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The file's ids from start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self.f.seek(int(self.offsets[first]))
        raw = self.f.read(int(self.offsets[last + 1] - self.offsets[first]))
        step = len(raw) if first == last else int(self.offsets[first + 1] - self.offsets[first])
        parts = [
            unpack(raw[(k - first) * step : (k - first + 1) * step], self.bits, min(self.block, self.n_ids - k * self.block))
            for k in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


_tokenizers: dict[str, ChunkMemo] = {}


def _encoder(path: str) -> ChunkMemo:
    """One byte-level tokenizer for each worker process; strings of special tokens are ordinary text.

    The library's model merges each pre-token; only what splits them is done here, by the pattern that the library's
    byte-level pre-tokenizer has, since its own makes an object for each pre-token of each text.
    """
    if path not in _tokenizers:
        tokenizer = Tokenizer.from_file(path)
        if type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space or tokenizer.normalizer:
            raise ValueError("a byte-level tokenizer without a prefix space and a normalizer is needed")
        tokenize, mapping = tokenizer.model.tokenize, dict(enumerate(byte_characters()))

        def merge(parts: list[str]) -> list[list[int]]:
            return [[t.id for t in tokenize(mapped(p, mapping))] for p in parts]

        _tokenizers[path] = ChunkMemo(regex.compile(public_tokenizers.PATTERN).findall, merge)
    return _tokenizers[path]


def write_dataset(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int, file_ids: int = 1 << 25) -> None:
    """Encodes docs(doc_id, text) by a byte-level tokenizer file and writes path/ids-* and path/manifest.

    Ids are in ascending doc_id order over the files in the manifest's order: ranges of doc_id, each sorted, null first,
    equal doc_ids by a hash of their text. Null text counts as empty; end_id follows each document. A file ends after
    the document that brings it to file_ids.
    """
    bits = bits_needed(max(vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fs_path = _encoder(tokenizer_path), pa.fs.FileSystem.from_uri(path)
        fs, at, part, seq = *fs_path, TaskContext.get().partitionId(), 0
        fs.create_dir(at, recursive=True)
        writer = out = name = None

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]}, schema=MANIFEST)

        for b in batches:
            end = np.asarray([end_id], dtype="<u4")
            flat, ends = encoder.encode(b.column("text"))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), np.split(flat, ends[:-1])[: len(ends)], strict=True):
                if writer is None:
                    name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(f"{at}/{name}")
                    writer = Writer(out, bits)
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.ids >= file_ids:
                    yield closed()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    small_batches(docs.sparkSession)
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)  # the hash parts rows of one doc_id, or of none
    ranged.mapInArrow(run, "part int, seq int, name string, n_docs long, n_ids long").write.parquet(f"{path}/manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_manifest(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name of each file and number of ids before it: a row for each file of 2**25 ids or task, not for each document."""
    rows = spark.read.parquet(f"{path}/manifest").orderBy("part", "seq").select("name", "n_ids").collect()
    starts = np.cumsum([0, *(r["n_ids"] for r in rows)]).tolist()
    return [(r["name"], s) for r, s in zip(rows, starts, strict=False)]


def read_documents(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (digest) or ids (array of long) of each document, from the files.

    start: ids of all documents before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """
    files = read_manifest(spark, path)
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(path)
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{at}/{name}") as f:
                    reader = Reader(f)
                    k = 0
                    while k < len(reader.docs):  # documents of about 16 blocks at a time
                        begin = int(reader.ends[k - 1]) if k else 0
                        upto = max(k + 1, int(np.searchsorted(reader.ends, begin + 16 * BLOCK, side="right")))
                        ids = reader.ids(begin, int(reader.ends[upto - 1]))
                        ends = reader.ends[k:upto] - begin
                        starts = np.concatenate([[0], ends[:-1]])
                        each = [ids[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                        values = [zlib.crc32(x.tobytes()) for x in each] if digest else [x.tolist() for x in each]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[k:upto], pa.int64()), pa.array(starts + begin + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(values, last[1])],
                            schema=schema,
                        )
                        k = upto

    slices = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(files, "name string, base long").repartition(slices)
    return listed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")
