"""Encoding with a memory of chunks and pre-tokens seen, for tokenizers that split text before merging.

Byte-level patterns attach a single space to what follows it, so a pre-token begins at every space that is followed by
something other than white space. Texts are cut there by Arrow, which also finds the different chunks of a batch; a
chunk not seen before is split by the pattern, a pre-token not seen before is merged by the tokenizer, and numpy gathers
the ids of all chunks.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Not white space for every library's version of Unicode: no cut is made before one of these.
UNSURE = frozenset("\u180e\u200b\u200c\u200d\u2060\ufeff")
#: Characters that patterns keep together after a word: no letter, number, white space or apostrophe.
ENDS = ".,;:!?"
#: Bytes of text that are encoded at once: places and chunks take some ten times as much.
SLICE = 4 << 20
#: A space that certainly begins a pre-token.
CUT = re.compile(r" (?=[^\s\u180e\u200b\u200c\u200d\u2060\ufeff])")


def sliced(text: str, size: int) -> list[str]:
    """text in slices of about `size` characters, cut where a pre-token certainly begins; longer where none does."""
    out, begin = [], 0
    while (found := CUT.search(text, begin + size)) is not None:
        out.append(text[begin : found.start()])
        begin = found.start()
    return [*out, text[begin:]]


def glued(chunks: list[str]) -> list[str]:
    """chunks of text.split(" "), each with its space again; one that no cut may precede is joined to the one before."""
    out = [chunks[0]]
    for c in chunks[1:]:
        if not c or c[0].isspace() or c[0] in UNSURE:
            out[-1] += " " + c
        else:
            out.append(" " + c)
    return out


def listed(chunks: pa.StringArray) -> list[str]:
    """The chunks, none with a space, as a list: one string that is split, as it is faster than an object for each."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
    return pc.binary_join(whole, " ")[0].as_py().split(" ") if len(chunks) else []


def mapped(part: str, mapping: dict[int, str]) -> str:
    """A pre-token's bytes as characters; of printable ASCII only the space has another one."""
    if part.isascii() and part.isprintable():
        return part.replace(" ", mapping[32])
    return part.encode("utf-8", "surrogatepass").decode("latin-1").translate(mapping)


class ChunkMemo:
    """split: a text to its pre-tokens; merge: pre-tokens to as many id lists.

    Beyond half of `limit` remembered chunks the memory starts anew and keeps what the next chunks meet again; beyond
    `limit` pre-tokens theirs starts anew. So both are bounded by the limit and what one call brings.
    """

    def __init__(self, split: Callable[[str], list[str]], merge: Callable[[list[str]], Iterable[Sequence[int]]], limit: int = 700_000):
        self.split, self.merge, self.limit = split, merge, limit
        self.chunks: dict[str, bytes | None] = {}  # without their space
        self.old: dict[str, bytes | None] = {}  # those before the memory last started anew; what is met again is kept
        self.parts: dict[str, bytes] = {}  # pre-tokens that are no word after a space

    def _merged(self, parts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.merge(parts)]

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """The joined ids of lists of pre-tokens."""
        parts = self.parts
        new = list({p for s in split for p in s if p not in parts})
        if len(parts) + len(new) > self.limit:
            parts.clear()
            new = list({p for s in split for p in s})
        parts.update(zip(new, self._merged(new), strict=True))
        return [parts[s[0]] if len(s) == 1 else b"".join([parts[p] for p in s]) for s in split]

    def _learn(self, missing: list[str]) -> list[bytes | None]:
        """Remembers the chunks; their ids, or None for one that no cut may precede: texts with it are glued.

        Words, and words before a sentence's marks, need no pattern: their pre-tokens are plain.
        """
        if len(self.chunks) + len(missing) > self.limit // 2:
            self.old, self.chunks = self.chunks, {}
        known = self.chunks
        words, marked, others = {}, [], []
        for c in missing:
            if c.isalpha():
                words[c] = None
            elif (w := c.rstrip(ENDS)).isalpha():
                marked.append((c, w))
                if w not in known:
                    words[w] = None
            elif c and not c[0].isspace() and c[0] not in UNSURE:
                others.append(c)
            else:
                known[c] = None
        known.update(zip(words, self._merged([" " + w for w in words]), strict=True))
        marks = {c[len(w) :] for c, w in marked}
        tails = dict(zip(marks, self._ids([[m] for m in marks]), strict=True))
        known.update([(c, known[w] + tails[c[len(w) :]]) for c, w in marked])
        known.update(zip(others, self._ids([self.split(" " + c) for c in others]), strict=True))
        return [known[c] for c in missing]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as unsigned 32-bit integers, and where those of each text end; null counts as empty.

        Texts are encoded SLICE bytes at a time, a longer text in slices, so that what is held grows with the ids alone.
        """
        collects = gc.isenabled()
        gc.disable()  # the many lists of a batch hold no cycles, and each full collection walks the memories
        try:
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
            if not len(upto) or upto[-1] <= SLICE:
                return self._encode(texts)
            parts, ends, at = [], [], 0
            while at < len(texts):
                before = upto[at - 1] if at else 0
                rows = int(np.searchsorted(upto, before + SLICE, side="right")) - at
                if rows:
                    ids, e = self._encode(texts.slice(at, rows))
                else:
                    rows = 1
                    ids = np.concatenate([self._encode(pa.array([s], pa.string()))[0] for s in sliced(texts[at].as_py(), SLICE)])
                    e = np.asarray([len(ids)])
                parts.append(ids)
                ends.append(e + (ends[-1][-1] if ends else 0))
                at += rows
            return np.concatenate(parts), np.concatenate(ends)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = cut.offsets.to_numpy().astype("i8")
        bounds -= bounds[0]
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype("i8")
        chunks = listed(coded.dictionary)
        get = self.chunks.get
        pieces = [get(c, chunks) for c in chunks]
        if self.old:
            get, known = self.old.get, self.chunks
            for k in [k for k, p in enumerate(pieces) if p is chunks]:
                if (p := get(chunks[k], chunks)) is not chunks:
                    pieces[k] = known[chunks[k]] = p
        missing = [k for k, p in enumerate(pieces) if p is chunks]
        for k, p in zip(missing, self._learn([chunks[k] for k in missing]), strict=True):
            pieces[k] = p
        unsafe = np.asarray([p is None for p in pieces])
        first = [chunks[k] for k in which[bounds[:-1]].tolist()]  # each text's head has no space before it
        pieces = [p or b"" for p in pieces] + self._ids([self.split(c) for c in first])
        unsafe = np.concatenate([unsafe, np.zeros(len(first), dtype=bool)])
        which[bounds[:-1]] = len(chunks) + np.arange(len(first))
        joined = pa.array(pieces, pa.large_binary()).take(pa.array(which))  # Arrow copies each chunk's ids
        _, upto, data = joined.buffers()
        upto = np.frombuffer(upto, "<i8", len(which) + 1) // 4
        ids = np.frombuffer(data, "<u4", int(upto[-1])) if data else np.empty(0, dtype="<u4")
        ends = upto[bounds[1:]]
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(unsafe[which]), side="right") - 1)
        return self._glue(texts, ids, ends, odd.tolist()) if len(odd) else (ids, ends)

    def _glue(self, texts: pa.StringArray, ids: np.ndarray, ends: np.ndarray, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The result with the texts of `odd` encoded from glued chunks."""
        each = np.split(ids, ends[:-1])
        for k in odd:
            whole = glued(texts[k].as_py().split(" "))
            each[k] = np.frombuffer(b"".join(self._ids([self.split(c) for c in whole])), dtype="<u4")
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, ends = self.encode(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1]) if len(texts) else []
