"""Language-model scores: the marginal probability of a text over all segmentations into pieces of an existing vocabulary.

Words are segmented independently, so a text's log probability is the sum of its words'. Texts are coded by chunks: a
chunk has its own numbering of words, and only its different words, with counts, meet those of other chunks. Word
counts of the whole corpus, the lattice of each different word and the scores of all texts follow from three joins of
such slim rows; the coded texts are moved once.

The vocabulary gives the pieces. Its own scores are merge ranks, not probabilities, so each piece's log probability is
its relative frequency in the vocabulary's segmentation of the training words, smoothed as the word counts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .langid import fold_of

SPACE = "▁"
ADD = 0.1
CODED = "chunk long, doc_id long, held_out boolean, ids binary, word string, local int, n long"


def _code(docs: DataFrame, held_out: Column, most_tokens: int, most_words: int) -> DataFrame:
    """Rows of two kinds: texts (chunk, doc_id, held_out, ids) and words (chunk, word, local, n: count in training)."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64())])

    class Numbers(dict):
        """Numbers words in the order in which they come."""

        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, tokens = TaskContext.get().partitionId(), 0, 0
        number, texts = Numbers(), []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 32 | seq
            count = np.zeros(len(number), dtype="i8")
            for _, out, ids in texts:
                if not out:
                    count += np.bincount(ids, minlength=len(number)) if len(ids) > len(number) // 8 else 0
                    if len(ids) <= len(number) // 8:
                        np.add.at(count, ids, 1)
            for a in range(0, len(texts), 1000):
                some = texts[a : a + 1000]
                yield _batch(schema, chunk=[chunk] * len(some), doc_id=[t[0] for t in some], held_out=[t[1] for t in some], ids=[t[2].tobytes() for t in some])
            words = list(number)
            for a in range(0, len(words), 50_000):
                some = [w.decode("utf-8", "replace") for w in words[a : a + 50_000]]
                yield _batch(schema, chunk=[chunk] * len(some), word=some, local=np.arange(a, a + len(some), dtype="i4"), n=count[a : a + len(some)])

        for b in batches:
            for doc_id, out, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                texts.append((doc_id, out, np.asarray([number[w] for w in words], dtype="<i4")))
                tokens += len(words) + 1
                if tokens >= most_tokens or len(number) >= most_words:
                    yield from flush()
                    number, texts, tokens, seq = Numbers(), [], 0, seq + 1
        if texts:
            yield from flush()

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return slim.mapInArrow(run, CODED)


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class Vocabulary:
    """Pieces of a sentencepiece file, and the piece ids of words as the file's own model segments them."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, ids = self.model, range(self.model.get_piece_size())
        self.size, self.end = len(ids), m.eos_id()
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.pieces = {m.id_to_piece(i): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """piece, n: how often each piece occurs in the training words; a row for each piece and task before the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        total = np.zeros(v.size, dtype="i8")
        for b in batches:
            ids = v.model.encode(b.column("word").to_pylist(), num_threads=1)
            times = np.repeat(b.column("c").to_numpy(zero_copy_only=False), [len(x) for x in ids])
            np.add.at(total, np.asarray([i for x in ids for i in x], dtype="i8"), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["piece", "n"])

    found = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log probabilities (natural) of words over all segmentations; logp has one for each piece of the vocabulary."""

    BITS = 20

    def __init__(self, v: Vocabulary, logp: np.ndarray):
        self.v, self.logp = v, logp
        self.longest = max(map(len, v.pieces), default=1)
        codes = [np.frombuffer(p.encode("utf-32-le"), "<u4") for p in v.pieces]
        hashes = np.asarray([self._hash(c[None, :])[0] for c in codes], dtype="u8")
        ids = np.asarray(list(v.pieces.values()), dtype="i4")
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        self.tables = []  # each takes the pieces whose slot is free
        while len(ids):
            slot = self._slot(hashes, len(self.tables))
            keys, values = np.zeros(1 << self.BITS, dtype="u8"), np.full(1 << self.BITS, -1, dtype="i4")
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], values[slot[first]] = hashes[first], ids[first]
            self.tables.append((keys, values))
            rest = np.setdiff1d(np.arange(len(ids)), first)
            hashes, ids = hashes[rest], ids[rest]
        self.rare: dict[int, float] = {}

    @staticmethod
    def _grow(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h ^ (code.astype("u8") + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(29))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.full(len(codes), np.uint64(1))
        for k in range(codes.shape[1]):
            h = self._grow(h, codes[:, k])
        return h

    def _slot(self, h: np.ndarray, table: int) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * table)) >> np.uint64(64 - self.BITS)).astype("i8")

    def _piece(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, dtype="i4")
        for k, (keys, values) in enumerate(self.tables):
            slot = self._slot(h, k)
            hit = keys[slot] == h
            out[hit] = values[slot[hit]]
        return out

    def _by_bytes(self, code: int) -> float:
        """A character that is no piece, by the pieces of its bytes (or the unknown piece without those)."""
        if code not in self.rare:
            raw = chr(code).encode("utf-8", "surrogatepass")
            ids = [self.v.bytes.get(b) for b in raw]
            self.rare[code] = float(sum(self.logp[i] for i in ids)) if None not in ids else float(self.logp[self.v.model.unk_id()]) * len(raw)
        return self.rare[code]

    def same_length(self, codes: np.ndarray) -> np.ndarray:
        """Forward recursion in log space for (words, length) code points."""
        n, length = codes.shape
        h, by_size = np.full(codes.shape, np.uint64(1)), []
        for size in range(1, min(self.longest, length) + 1):
            h = self._grow(h[:, : length - size + 1], codes[:, size - 1 :])
            piece = self._piece(h)
            lp = np.where(piece >= 0, self.logp[piece], -np.inf)
            if size == 1 and (piece < 0).any():
                lp[piece < 0] = [self._by_bytes(c) for c in codes[piece < 0].tolist()]
            by_size.append(lp)
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            terms = np.stack([alpha[:, j - k - 1] + by_size[k][:, j - k - 1] for k in range(min(j, len(by_size)))])
            alpha[:, j] = np.logaddexp.reduce(terms, 0)
        return alpha[:, length]

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        lengths = np.asarray([len(w) for w in words]) + 1
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            step = max(1, 500_000 // length)
            for a in range(0, len(at), step):
                some = at[a : a + step]
                raw = "".join([SPACE + words[k] for k in some]).encode("utf-32-le", "surrogatepass")
                out[some] = self.same_length(np.frombuffer(raw, "<u4").reshape(len(some), length))
        return out


def _with_lattice(counts: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """word, c, lp: log10 of each word's marginal probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), logp)
        for b in batches:
            lp = lattice.words(b.column("word").to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp)], ["word", "c", "lp"])

    return counts.select("word", "c").mapInArrow(run, "word string, c long, lp double")


def score(docs: DataFrame, vocabulary_path: str, folds: int = 10, held_out: int = 0, most_tokens: int = 4_000_000, most_words: int = 400_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs(doc_id, text): a row for each input row.

    Tokens are the words of the whole text, A-Z lower-cased, and one end; null text has the end only. Learned from the
    rows whose crc32(doc_id as text) modulo folds isn't held_out (a null doc_id counts as empty text). base_score: sum
    of log10((c + 0.1) / (N + 0.1 * (V + 1))). score: log10 of the marginal probability of all words and the end. An
    empty table gives no rows. vocabulary_path names a sentencepiece file that every executor has.
    """
    coded = written(_code(docs, fold_of(F.col("doc_id"), folds) == held_out, most_tokens, most_words), "coded")
    texts = coded.where(F.col("word").isNull()).select("chunk", "doc_id", "held_out", "ids")
    words = coded.where(F.col("word").isNotNull()).select("chunk", "word", "local", "n")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    ends = texts.where(~F.col("held_out")).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = sums[0] + ends, sums[1] + bool(ends)
    v = vocabulary(vocabulary_path)
    pieces = np.zeros(v.size)
    for r in _piece_counts(counts, vocabulary_path).collect():  # one row for each piece at most
        pieces[r["piece"]] = r["n"]
    pieces[v.end] += ends
    logp = np.log(pieces + ADD) - np.log(pieces.sum() + ADD * (v.size + 1))
    scored = _with_lattice(counts, vocabulary_path, logp)
    known = words.join(scored, "word").select(F.col("chunk").alias("of"), "local", "c", "lp")
    bottom = total + ADD * (distinct + 1)
    end_base, end_lp, end_known = float(np.log10((ends + ADD) / bottom)), float(logp[v.end] / np.log(10)), int(ends > 0)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("local").to_numpy()
        c, lp = np.zeros(len(place), dtype="i8"), np.zeros(len(place))
        c[place], lp[place] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base = np.log10((c + ADD) / bottom)
        raw = left.column("ids").to_pylist()
        n = np.asarray([len(x) // 4 for x in raw], dtype="i8")
        ids, row = np.frombuffer(b"".join(raw), "<i4"), np.repeat(np.arange(len(n)), n)
        add = lambda x: np.bincount(row, weights=x[ids], minlength=len(n)) if len(ids) else np.zeros(len(n))
        values = [left.column("doc_id"), left.column("held_out"), n + 1, add(c > 0).astype("i8") + end_known, np.full(len(n), total, dtype="i8"), add(base) + end_base, add(lp) + end_lp]
        return pa.table({k: x if isinstance(x, pa.ChunkedArray) else pa.array(x) for k, x in zip(columns, values, strict=True)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = max(1, 2 * texts.select("chunk").distinct().count())  # a few chunks for each task at any size
    return texts.repartition(parts, "chunk").groupBy("chunk").cogroup(known.repartition(parts, "of").groupBy("of")).applyInArrow(run, schema)
