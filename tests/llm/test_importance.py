"""Importance resampling against plain Python: odd texts, ties, repeated and missing ids, several n-gram sizes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, low, high):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, least, percent, seed, low, high, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [Counter(map(bucket, features(t, low, high))) for _, t in docs]
    s, t = Counter(), Counter(b for x in target for b in map(bucket, features(x, low, high)))
    for f in found:
        s.update(f)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for (d, text), f in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in f.items())
        rows.append([d, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)), None])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(([*r[:4], r[5]] for r in rows), key=repr)


TEXTS = [None, "", " ,.; ", "One two TWO three", "É école ÉCOLE 東京 x1y2", "a b c d", "the cat sat on the mat " * 9, "x" * 4000 + " y " * 30, " ".join(f"w{k % 50}" for k in range(900)), "A-B_C'd\x7fe\x00f"]


def rows():
    return [(k, TEXTS[k % len(TEXTS)]) for k in range(60)] + [(None, TEXTS[6]), (None, TEXTS[6]), (None, None), (3, TEXTS[8]), (3, TEXTS[8])]


@pytest.mark.parametrize(("low", "high", "percent"), [(1, 1, 40), (1, 2, 100), (2, 3, 50)])
def test_equals_brute_force(spark, low, high, percent):
    target = ["the cat sat", "on the MAT", None, "w1 w2 w3 école"]
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 4, percent, 7, low, high, 97)
    assert sorted(([*r] for r in got.collect()), key=repr) == brute(rows(), target, 4, percent, 7, low, high, 97)


def test_words_in_slices():
    for text in (t for t in TEXTS if t):
        for size in (1, 2, 3, 10, 1 << 20):
            assert [w.decode() for part in importance.word_slices(text.encode(), size) for w in part] == words(text)


@pytest.mark.parametrize("size", [1, 7, 50])
def test_counts_do_not_depend_on_slices(monkeypatch, size):
    monkeypatch.setattr(importance.word_slices, "__defaults__", (size,))
    for low, high in ((1, 1), (1, 3), (2, 2)):
        for text in (t for t in TEXTS if t):
            which, n, total = importance.Buckets(low, high, 97).counts(text.encode())
            assert dict(zip(which.tolist(), n.tolist(), strict=True)) == Counter(zlib.crc32(f.encode()) % 97 for f in features(text, low, high))
            assert total == len(words(text))


def test_blocks_are_the_counts(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "c a")], "doc_id long, text string").coalesce(1)
    (block,) = importance.count_matrix(docs, "doc_id", "text", buckets=11).collect()
    bucket = {w: zlib.crc32(w.encode()) % 11 for w in "abc"}
    assert block["doc_id"] == [1, 2, 3] and block["n_words"] == [3, 0, 2] and block["indptr"] == [0, 2, 2, 4]
    for k, text in ((0, "bab"), (2, "ca")):
        part = slice(block["indptr"][k], block["indptr"][k + 1])
        assert dict(zip(block["bucket"][part], block["n"][part], strict=True)) == Counter(bucket[c] for c in text)


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "w", 5)], "doc_id long, text string, weight long, bucket string, rank long")
    nothing = spark.createDataFrame([], "text string")
    got = importance.resample(docs, nothing, least=1, percent=100).first()
    gain = math.floor(1000 * math.log(1 * (2 + 10_000) / (2 * 10_000)))
    assert (got["n_features"], got["weight"], got["rank"]) == (2, 2 * gain, 1)
    assert importance.resample(docs.limit(0), nothing).count() == 0


def test_equal_rows_get_different_ranks(spark):
    """Rows without an id tie in everything; ranks are dealt over range partitions all the same."""
    docs = spark.range(5000).selectExpr("cast(null as long) AS doc_id", "'a b c' AS text").repartition(4)
    got = importance.resample(docs, docs.select("text").limit(3), least=1, percent=50).toPandas()
    assert sorted(got["rank"].dropna().astype(int)) == list(range(1, 2501))
    assert np.isnan(got["rank"]).sum() == 2500


def test_blocks_are_bounded_whatever_the_batches(spark, monkeypatch):
    """A block ends at CELLS cells and a file after BLOCKS_PER_FILE blocks, so no task holds a batch's or a file's cells at once."""
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(20)]).alias("text"))
    monkeypatch.setattr(importance, "CELLS", 100)
    monkeypatch.setattr(importance, "BLOCKS_PER_FILE", 4)
    matrix = importance.count_matrix(docs, "doc_id", "text")
    blocks = matrix.withColumn("file", F.input_file_name()).collect()
    assert sorted(d for b in blocks for d in b["doc_id"]) == list(range(300)) and all(len(b["bucket"]) <= 120 for b in blocks)
    assert max(sum(b["file"] == f for b in blocks) for f in {b["file"] for b in blocks}) <= 4
    assert len({(b["part"], b["seq"]) for b in blocks}) == len(blocks) and sum(importance.column_sums(matrix).toPandas()["n"]) == 300 * 20
