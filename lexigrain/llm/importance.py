"""Importance resampling towards a target distribution over hashed n-gram features.

The features of documents are counted into buckets and kept as a sparse matrix of documents by buckets: blocks of
compressed sparse rows in a Parquet table. Column sums of the blocks give the corpus' distribution, those of the target's
blocks the target's; a bucket's gain is the logarithm of their smoothed ratio. A document's weight is its row times the
gains, and documents of the highest weight plus Gumbel noise are drawn, which is sampling without replacement in
proportion to exp(weight). Only sums by bucket (a number of rows fixed by a parameter) are gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

BUCKETS = 10_000
#: Cells from which a block is full, and blocks of a file: Parquet's readers and writers hold a file's blocks at once.
CELLS, BLOCKS_PER_FILE = 1 << 14, 128
#: Bytes of a text that are split at once; words that a worker remembers.
SLICE, REMEMBERED = 1 << 20, 300_000
#: The bytes that separate words; A-Z become a-z.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def word_slices(raw: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in lower case (A-Z), some at a time; a word is never cut.

    All bytes of characters beyond ASCII belong to words, so that bytes are split like characters.
    """
    begin = 0
    while begin < len(raw):
        part = raw[begin : begin + size].translate(_TABLE)
        begin += len(part)
        tail = part.rpartition(b" ")[2] if begin < len(raw) else b""
        while tail and begin < len(raw):  # the last word goes on
            more = raw[begin : begin + size].translate(_TABLE)
            rest, found, _ = more.partition(b" ")
            part += rest
            begin += len(rest)
            if found:
                break
        yield part.split()


class Buckets:
    """The buckets of the runs of low to high consecutive words of a text."""

    def __init__(self, low: int, high: int, buckets: int):
        self.low, self.high, self.buckets, self.known = low, high, buckets, {}

    def _of(self, features: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.buckets
        return [known[f] for f in features]

    def counts(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Buckets ascending, how many features each has, and the number of words."""
        total, n, last = np.zeros(0, dtype="i8"), 0, []
        for words in word_slices(raw):
            n += len(words)
            found = []
            for k in range(self.low, self.high + 1):
                w = last[len(last) - k + 1 :] + words if k > 1 else words
                found += self._of(w if k == 1 else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)])
            if found:
                seen = np.bincount(found, minlength=len(total))
                seen[: len(total)] += total
                total = seen
            last = (last + words)[-(self.high - 1) :] if self.high > 1 else last
        which = np.flatnonzero(total)
        return which, total[which], n


BLOCKS = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("indptr", pa.list_(pa.int32())), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]
)
BLOCK_TYPE = "part int, seq int, doc_id array<long>, n_words array<long>, indptr array<int>, bucket array<int>, n array<long>"


def count_matrix(docs: DataFrame, doc: str | None, text: str, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """docs as a table of blocks of compressed sparse rows, written: row k has the buckets indptr[k] to indptr[k + 1].

    A block ends with the document that brings it to CELLS cells, whatever the batches, and a file has few blocks, so what a
    task holds doesn't grow with its rows. (part, seq) names a block. Null text has no words.
    """

    def block(part: int, seq: int, docs: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = [
            pa.array([part], pa.int32()),
            pa.array([seq], pa.int32()),
            pa.array([docs], pa.list_(pa.int64())),
            pa.array([[n for _, _, n in rows]], pa.list_(pa.int64())),
            pa.array([np.cumsum([0, *(len(x) for x, _, _ in rows)])], pa.list_(pa.int32())),
            pa.array([np.concatenate([x for x, _, _ in rows])], pa.list_(pa.int32())),
            pa.array([np.concatenate([c for _, c, _ in rows])], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, part = Buckets(low, high, buckets), TaskContext.get().partitionId()
        seq, ids, rows, held = 0, [], [], 0
        for b in batches:
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                ids.append(doc)
                rows.append(features.counts(t.as_buffer().to_pybytes() if t.is_valid else b""))
                held += len(rows[-1][0]) + 1
                if held >= CELLS:
                    yield block(part, seq, ids, rows)
                    seq, ids, rows, held = seq + 1, [], [], 0
        if rows:
            yield block(part, seq, ids, rows)

    small_batches(docs.sparkSession)
    slim = docs.select((F.col(doc) if doc else F.lit(None)).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return written(slim.mapInArrow(run, BLOCK_TYPE), "counts", BLOCKS_PER_FILE)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all documents in each bucket that has any. A task sums its blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype="i8")
        for b in batches:
            for which, n in zip(b.column("bucket"), b.column("n"), strict=True):
                np.add.at(total, which.values.to_numpy(), n.values.to_numpy())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("i4")), pa.array(total[found])], ["bucket", "n"])

    return matrix.select("bucket", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = 1000) -> np.ndarray:
    """By bucket: floor(scale * ln of the target's share over the corpus' share), both with one more in each bucket.

    The driver gets the sums, a row for each bucket.
    """
    sums = []
    for t in (corpus, target):
        rows, n = t.collect(), np.zeros(buckets)
        n[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
        sums.append(n)
    s, t = sums
    return np.floor(scale * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype("i8")


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and place (part, seq, row): the matrix times the gains, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                get = lambda name: b.column(name)[k].values  # noqa: B023, E731
                indptr, n = get("indptr").to_numpy(), get("n").to_numpy()
                upto = np.concatenate([[0], np.cumsum(n * gain[get("bucket").to_numpy()])])
                features = np.concatenate([[0], np.cumsum(n)])
                rows = len(indptr) - 1
                columns = [
                    get("doc_id"),
                    get("n_words"),
                    pa.array(features[indptr[1:]] - features[indptr[:-1]], pa.int64()),
                    pa.array(upto[indptr[1:]] - upto[indptr[:-1]], pa.int64()),
                    pa.array(np.full(rows, b.column("part")[k].as_py()), pa.int32()),
                    pa.array(np.full(rows, b.column("seq")[k].as_py()), pa.int32()),
                    pa.array(np.arange(rows), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "part", "seq", "row"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, part int, seq int, row int")


def draw(weighted: DataFrame, least: int, percent: int, seed: int, scale: int = 1000) -> DataFrame:
    """weighted with score and rank: of the documents with at least `least` words, `percent` in a hundred are ranked from 1.

    score is weight plus scaled Gumbel noise from a hash of seed and doc_id; of equal scores the smaller doc_id comes
    first, null last, then the place in the matrix. Rows are ranked by ranges of that order, so no task sorts all.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-float(scale) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = written(weighted.withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), "part", "seq", "row"]
    ranged = scored.where(fit).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges").withColumn("_part", F.shiftright("_id", 33))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # a row for each partition
    every = Window.orderBy("_part")
    before = F.coalesce(F.sum("_c").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.expr(f"{percent} * sum(_c) OVER () div 100")
    placed = ranged.join(F.broadcast(counts.select(F.col("_part").alias("_p"), before.alias("_before"), most.alias("_most"))), F.col("_part") == F.col("_p"))
    rank = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    drawn = placed.select(*scored.columns, F.when(rank <= F.col("_most"), rank).alias("rank"))
    return drawn.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, least: int = 20, percent: int = 10, seed: int = 2024, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for docs(doc_id, text) towards target(text): a row for each row of docs.

    rank counts the drawn documents from 1, null for the others; see draw(). Null and empty texts have no features and
    weight 0; null doc_ids share one draw of noise, as repeated ids do. Rows that tie in everything are ranked in the
    matrix's order. Other columns are ignored. An empty table gives no rows; an empty target has no features.
    """
    matrix = count_matrix(docs, "doc_id", "text", low, high, buckets)
    goal = count_matrix(target, None, "text", low, high, buckets)
    found = weights(matrix, gains(column_sums(matrix, buckets), column_sums(goal, buckets), buckets))
    return draw(found, least, percent, seed).select("doc_id", "n_features", "weight", "score", "rank")
