"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword of +1 and -1. For each bit a binary naive Bayes classifier over n-grams separates the
languages with +1 from those with -1; a text's margins are decoded to the codeword of least weighted loss. What is
learned is one table of n-gram counts by language, summed by Spark over all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Buckets for n-grams of 1, 2 and 3 bytes.
BUCKETS = (256, 4096, 8192)
STARTS = np.cumsum((0, *BUCKETS))
MULTIPLIERS = np.asarray([2654435761, 2246822519, 3266489917], dtype="u4")
#: A-Z to a-z, digits to 0, ASCII white space to a space; all other bytes stay.
FOLD = np.arange(256, dtype="u1")
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[ord("0") : ord("9") + 1] = ord("0")
FOLD[[9, 10, 11, 12, 13]] = 32


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def _slices(texts: pa.StringArray, docs: int = 128, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `docs` rows and about `size` bytes."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and (i - begin >= docs or held + n > size):
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def count_ngrams(texts: pa.StringArray, group: np.ndarray, groups: int) -> np.ndarray:
    """Counts (groups, buckets) of the n-grams of all whole texts, each counted for its text's group; null is empty."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, "<i8")[raw.offset : raw.offset + len(raw) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros((groups, int(STARTS[-1])), dtype="i8")
    b = FOLD[np.frombuffer(data, "u1")[bounds[0] : bounds[-1]]].astype("u4")
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    base = np.repeat(np.asarray(group, dtype="i8") * int(STARTS[-1]), lengths)
    total = np.bincount(base + b, minlength=groups * int(STARTS[-1]))
    mixed = b * MULTIPLIERS[0]
    for n in (2, 3):
        if len(b) < n:
            break
        mixed = (mixed[: len(b) - n + 1] ^ (mixed[: len(b) - n + 1] >> np.uint32(15))) * MULTIPLIERS[n - 1] + b[n - 1 :] * MULTIPLIERS[0]
        bits = int(np.log2(BUCKETS[n - 1]))
        place = ((mixed ^ (mixed >> np.uint32(16))) * MULTIPLIERS[1] >> np.uint32(32 - bits)).astype("i8")
        inside = row[: len(b) - n + 1] == row[n - 1 :]
        total += np.bincount((base[: len(b) - n + 1] + int(STARTS[n - 1]) + place)[inside], minlength=len(total))
    return total.reshape(groups, int(STARTS[-1]))


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """(k, bits) of +1 and -1. Up to 7 classes: every split in two, else the best of random codes by least distance."""
    if k <= 7:
        splits = np.arange(1, 1 << max(k - 1, 0))
        bits = (splits[None, :] >> np.arange(k)[:, None]) & 1
        return np.where(bits == 1, 1, -1).astype("f8")
    rng, length, best = np.random.default_rng(seed), int(np.ceil(12 * np.log2(k))), None
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (k, length))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code.shape[1] - code @ code.T) / 2
        least = apart[~np.eye(k, dtype=bool)].min()
        if best is None or least > best[0]:
            best = least, code
    return best[1]


@dataclass
class Model:
    """languages, code (languages, bits), table (buckets, bits), centre and scale of each bit's margin, bit weights."""

    languages: list[str]
    code: np.ndarray
    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray


def _shares(counts: np.ndarray) -> np.ndarray:
    """Share of each bucket among n-grams of its length; a row without any keeps zeros."""
    out = counts.astype("f8")
    for a, z in zip(STARTS[:-1], STARTS[1:], strict=True):
        out[:, a:z] /= np.maximum(out[:, a:z].sum(1, keepdims=True), 1)
    return out


def fit_table(languages: list[str], counts: np.ndarray) -> Model:
    """The classifiers of all bits from n-gram counts (languages, buckets); each language weighs the same."""
    code = codewords(len(languages))
    smooth = counts + 0.5
    p = _shares(smooth)
    plus, minus = (code > 0).astype("f8"), (code < 0).astype("f8")
    table = np.log(p.T @ plus / np.maximum(plus.sum(0), 1)) - np.log(p.T @ minus / np.maximum(minus.sum(0), 1)) if code.shape[1] else np.zeros((p.shape[1], 0))
    expected = p @ table
    low = np.where(code > 0, expected, np.inf).min(0, initial=np.inf)
    high = np.where(code < 0, expected, -np.inf).max(0, initial=-np.inf)
    scale = np.maximum((low - high) / 2, 1e-6)
    return Model(languages, code, table.astype("f4"), (low + high) / 2, scale, scale / max(scale.sum(), 1e-12) * len(scale))


def decode(model: Model, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language, score from 0 to 1 and lead over the runner-up (0 to 1) for rows of n-gram shares.

    Loss of a codeword: the weighted mean of log(1 + exp(-2 * bit * margin)), where a margin of 1 is what the closest
    language of that side has on average. Scores are the losses' softmax.
    """
    k, bits = model.code.shape
    if bits == 0:
        return np.zeros(len(shares), dtype=int), np.ones(len(shares)), np.ones(len(shares))
    margin = np.clip((shares.astype("f4") @ model.table - model.centre) / model.scale, -4, 4)
    loss = np.stack([np.logaddexp(0, -2 * model.code[c] * margin) @ model.weight for c in range(k)], 1)
    score = np.exp(loss.min(1, keepdims=True) - loss)
    score /= score.sum(1, keepdims=True)
    top = np.sort(score, 1)
    return loss.argmin(1), top[:, -1], top[:, -1] - top[:, -2]


def fit(docs: DataFrame, train: Column, most_languages: int = 256) -> Model:
    """Learns from text and lang of the rows where train holds and lang is not null: sums over all of them.

    More than most_languages different values of lang are an error: the column isn't what it should be, and the table of
    counts that the driver gets would have no bound.

    Each task returns its non-zero counts, Spark adds them by language and bucket, and the driver gets one row for each
    pair, a number that languages and buckets bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.asarray(b.column("lang").to_pylist(), dtype=object)
            text = b.column("text")
            for lang in dict.fromkeys(langs.tolist()):
                own = text.filter(pa.array(langs == lang))
                for a, z in _slices(own, docs=1 << 30):
                    found = count_ngrams(own.slice(a, z - a), np.zeros(z - a, dtype="i8"), 1)[0]
                    total[lang] = total[lang] + found if lang in total else found
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype("i4")), pa.array(counts[at])], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.where(train & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"lang has more than {most_languages} different values")
    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), int(STARTS[-1])))
    place = {x: i for i, x in enumerate(languages)}
    counts[found["lang"].map(place).to_numpy(dtype=int), found["bucket"].to_numpy(dtype=int)] = found["n"].to_numpy()
    return fit_table(languages, counts)


def predict(docs: DataFrame, model: Model, ambiguous_below: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for docs(doc_id, text): one row for each input row, from the whole text.

    Null text, text without a letter, or a model that saw no language: und with score 0. ambiguous: the lead over the
    runner-up is under ambiguous_below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.asarray(["und", *model.languages], dtype=object)
        for b in batches:
            text = b.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score, lead = np.zeros(len(text), dtype=int), np.zeros(len(text)), np.ones(len(text))
            if model.languages:
                for a, z in _slices(text):
                    counts = count_ngrams(text.slice(a, z - a), np.arange(z - a), z - a)
                    best[a:z], score[a:z], lead[a:z] = decode(model, _shares(counts))
            known = lettered & bool(model.languages)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(names[np.where(known, best + 1, 0)], pa.string()), pa.array(np.where(known, score, 0.0)),
                    pa.array(known & (lead < ambiguous_below)),
                ],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from the folds that are not held out, predicted for all."""
    model = fit(docs, fold_of(F.col("doc_id"), folds) != held_out)
    found = predict(docs, model)
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "ambiguous")
