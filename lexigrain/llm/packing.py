"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition, in the order they come, are one stream of token ids. Windows may end at the end of a
document (free), at the end of a sentence or line (`cut`) or, where a sentence is long, at any `grid`-th id of it
(`hard`). The sum of padding, these penalties and `each` for every window is the least of all choices. A window is padded
to `window` ids unless its length is a power of two, so with f(j) the least cost up to boundary j at place p(j)

    f(j) = penalty(j) + each + min( min over i: f(i) + window - (p(j) - p(i)),  min over i with p(j) - p(i) a power of two >= shortest: f(i) )

The first minimum is over the sliding window of p(i) >= p(j) - window, held in a monotone queue of f(i) + p(i), the second
over at most a few exact hits, found beforehand by binary search. Nothing is shuffled, and a repeated task gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .common import small_batches
from .tokenfile import _encoder

#: Ids that are packed together at least (a few documents more), and boundaries of one run of the dynamic programming.
HELD_IDS, RUN = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Rules:
    """Longest window; penalties in ids of padding: a cut at a sentence, elsewhere in a text, and each window.

    shortest: the smallest power of two that is planned without padding; tiny windows are never aimed at.
    """

    window: int = 2048
    cut: int = 8
    hard: int = 32
    each: int = 32
    grid: int = 64
    shortest: int = 32


class Marks:
    """By id: whether a token ends like a sentence, begins with white space, ends with or begins with a new line."""

    def __init__(self, path: str):
        vocabulary, back = Tokenizer.from_file(path).get_vocab(), {c: b for b, c in enumerate(byte_characters())}
        size = max(vocabulary.values()) + 1
        self.stop, self.white, self.line, self.opens = (np.zeros(size, dtype=bool) for _ in range(4))
        for token, k in vocabulary.items():
            raw = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self.stop[k] = raw.rstrip(b"\"')]").endswith((b".", b"!", b"?"))
            self.white[k] = raw[:1].isspace()
            self.line[k], self.opens[k] = raw.endswith(b"\n"), raw.startswith(b"\n")


_marks: dict[str, Marks] = {}


def _marks_of(path: str) -> Marks:
    """The marks of a tokenizer file, once for each worker process."""
    if path not in _marks:
        _marks[path] = Marks(path)
    return _marks[path]


def boundaries(ids: np.ndarray, ends: np.ndarray, marks: Marks, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending up to the last end, and the penalty of each.

    ends: where each document's ids end, its end id included. No two neighbours are more than rules.grid apart.
    """
    a, b = ids[:-1], ids[1:]
    inner = (marks.stop[a] & marks.white[b]) | (marks.line[a] & ~marks.opens[b])
    inner[ends[:-1] - 1] = False  # that is a document's end
    inner[ends[ends > 1] - 2] = False  # no piece of the end id alone
    places = np.concatenate([np.flatnonzero(inner) + 1, ends])
    penalty = np.concatenate([np.full(len(places) - len(ends), rules.cut), np.zeros(len(ends), dtype=int)])
    order = np.argsort(places, kind="stable")
    places, penalty = places[order], penalty[order]
    begins = np.concatenate([[0], places[:-1]])
    more = (places - begins - 1) // rules.grid
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    places = np.concatenate([places, np.repeat(begins, more) + nth * rules.grid])
    penalty = np.concatenate([penalty, np.full(len(nth), rules.hard)])
    order = np.argsort(places, kind="stable")
    return places[order], penalty[order]


def best_cuts(places: np.ndarray, penalty: np.ndarray, rules: Rules) -> list[int]:
    """The indices of places where windows end, the last one included; windows begin at 0. Of equal costs the longest last window."""
    at = np.concatenate([[0], places])
    index = np.full(int(at[-1]) + 1, -1, dtype="i4")  # the boundary at each place
    index[at] = np.arange(len(at))
    to, of = [], []
    size = rules.shortest
    while size < rules.window:
        found = np.flatnonzero(at >= size)
        hit = index[at[found] - size]
        to.append(found[hit >= 0])
        of.append(hit[hit >= 0])
        size *= 2
    to, of = np.concatenate([*to, []]).astype(int), np.concatenate([*of, []]).astype(int)
    hits: dict[int, list[int]] = {}
    for j, i in zip(to.tolist(), of.tolist(), strict=True):
        hits.setdefault(j, []).append(i)
    at, window = at.tolist(), rules.window
    f, back, keys = [0] * len(at), [0] * len(at), [0] * len(at)  # keys: f + place, ascending along the queue
    queue, head = [0], 0
    pop, append, get = queue.pop, queue.append, hits.get
    for j, cost in enumerate((penalty + rules.each).tolist(), 1):
        place = at[j]
        low = place - window
        i = queue[head]
        while at[i] < low:
            head += 1
            i = queue[head]
        best = keys[i] - low
        for h in get(j, ()):
            if f[h] < best:
                i, best = h, f[h]
        best += cost
        f[j], back[j] = best, i
        key = keys[j] = best + place
        while keys[queue[-1]] > key and len(queue) > head + 1:
            pop()
        if keys[queue[-1]] > key:
            queue[-1] = j
        else:
            append(j)
    chosen, j = [], len(at) - 1
    while j:
        chosen.append(j - 1)
        j = back[j]
    return chosen[::-1]


def window_ends(ids: np.ndarray, ends: np.ndarray, marks: Marks, rules: Rules) -> np.ndarray:
    """Where the windows over ids end, in runs of at most RUN boundaries."""
    places, penalty = boundaries(ids, ends, marks, rules)
    out, begin = [], 0
    for k in range(0, len(places), RUN):
        p = places[k : k + RUN]
        out.append(p[best_cuts(p - begin, penalty[k : k + RUN], rules)])
        begin = int(p[-1])
    return np.concatenate(out)


PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])
SEQUENCES = pa.schema([("sequence_id", pa.int64()), ("length", pa.int64()), ("padded_length", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(PIECE))])


def sequence_batch(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, marks: Marks, rules: Rules, first_id: int) -> pa.RecordBatch:
    """The sequences over documents whose ids end at `ends`, numbered from first_id."""
    stops = window_ends(ids, ends, marks, rules)
    starts = np.concatenate([[0], stops[:-1]])
    upto = np.union1d(stops, ends)
    begins = np.concatenate([[0], upto[:-1]])
    doc, seq = np.searchsorted(ends, begins, side="right"), np.searchsorted(stops, begins, side="right")
    sizes = np.diff(ends, prepend=0)
    pieces = pa.StructArray.from_arrays(
        [
            pa.array(doc_ids, pa.int64()).take(pa.array(doc)),
            *(pa.array(x.astype("i8")) for x in (begins - (ends - sizes)[doc], upto - begins, sizes[doc], begins - starts[seq])),
        ],
        fields=list(PIECE),
    )
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(seq, np.arange(len(stops) + 1)).astype("i4")), pieces)
    lengths = stops - starts
    exempt = lengths & (lengths - 1) == 0
    raw = ids.astype("<u4").tobytes()
    packed = pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())
    columns = [pa.array(first_id + np.arange(len(stops)), pa.int64()), pa.array(lengths, pa.int64()), pa.array(np.where(exempt, lengths, rules.window), pa.int64()), packed, lists]
    return pa.RecordBatch.from_arrays(columns, schema=SEQUENCES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, rules: Rules = Rules()) -> DataFrame:
    """sequence_id, length, padded_length, ids, pieces: docs(doc_id, text) in sequences of at most rules.window ids.

    ids: little-endian unsigned 32-bit integers. pieces: doc_id, start (ids of its document before it), length,
    doc_tokens (ids of its document) and offset in the sequence, in order and without gaps. Every id of every document
    lies in exactly one piece; end_id follows each document. The order is that of docs' rows in each of their partitions,
    and no sequence crosses partitions. Null and empty text have the end id only, null and repeated doc_ids are packed as
    any others, other columns are ignored, an empty table gives no rows. A very long text is encoded in slices.
    sequence_id is unique and ascends in a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, marks, n = _encoder(tokenizer_path), _marks_of(tokenizer_path), TaskContext.get().partitionId() << 33
        docs_held, parts, sizes, held = [], [], [], 0
        end = np.asarray([end_id], dtype="<u4")

        def packed() -> pa.RecordBatch:
            return sequence_batch(docs_held, np.concatenate(parts), np.cumsum(sizes), marks, rules, n)

        for b in batches:
            flat, ends = encoder.encode(b.column("text"))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), np.split(flat, ends[:-1])[: len(ends)], strict=True):
                docs_held.append(doc_id)
                parts += [ids, end]
                sizes.append(len(ids) + 1)
                held += len(ids) + 1
                if held >= HELD_IDS:
                    out = packed()
                    n += out.num_rows
                    docs_held, parts, sizes, held = [], [], [], 0
                    yield out
        if held:
            yield packed()

    small_batches(docs.sparkSession)
    piece = "array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, f"sequence_id long, length long, padded_length long, ids binary, pieces {piece}")


def pieces(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of pack()'s sequences."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    raw = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return each.select("p.doc_id", "p.start", "p.length", F.crc32(raw).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
