"""Language identification: counts, codes, held-out accuracy and odd rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_counts_are_of_whole_texts_and_do_not_cross_rows():
    texts = ["abcab", None, "", "é é", "A1\tb"]
    both = langid.count_ngrams(pa.array(texts), np.arange(5), 5)
    each = np.concatenate([langid.count_ngrams(pa.array([t], pa.string()), np.zeros(1, int), 1) for t in texts])
    assert (both == each).all()
    assert both.sum(1).tolist() == [5 + 4 + 3, 0, 0, 5 + 4 + 3, 4 + 3 + 2]


def test_codewords_are_apart():
    for k in (2, 3, 4, 7, 12):
        code = langid.codewords(k)
        assert code.shape[0] == k and len({tuple(c) for c in code.tolist()}) == k
    assert langid.codewords(1).shape == (1, 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert found.where("score < 0 or score > 1").count() == 0


def test_prediction_ignores_lang_and_ids(spark):
    docs = spark.read.parquet(DATA)
    model = langid.fit(docs, F.lit(True))
    plain = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("lang_pred"))
    assert {r["doc_id"] - 7: r["lang_pred"] for r in langid.predict(other, model).collect()} == plain


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat sat", "en", "x"), (3, "der hund ist", "de", "x"), (4, None, "de", "x"), (6, "123 !?", None, "x"), (None, "the", None, "x"), (8, "", "en", "x"), (1, "the cat sat", "en", "x")]
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 6, 8)} == {"und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] == 1] == ["en", "en"]
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
    (only,) = langid.identify(spark.createDataFrame([(1, "hello", None, "x")], schema)).collect()
    assert only["lang_pred"] == "und" and only["score"] == 0.0


def grams(text):
    """Counts of (n, bucket) of a text's n-grams of 1 to 3 bytes, one by one in plain integers."""
    b = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if 9 <= c <= 13 else c for c in (text or "").encode())
    m, full, out = [int(x) for x in langid.MULTIPLIERS], (1 << 32) - 1, Counter()
    for i in range(len(b)):
        out[1, b[i]] += 1
        h = b[i] * m[0] & full
        for n in (2, 3):
            if i + n > len(b):
                break
            h = ((h ^ h >> 15) * m[n - 1] + b[i + n - 1] * m[0]) & full
            out[n, ((h ^ h >> 16) * m[1] & full) >> 32 - (12 if n == 2 else 13)] += 1
    return out


def by_hand(train, texts):
    """(language, score) of each text: a naive Bayes for each split of the languages in two, losses summed in plain Python."""
    size, langs = {1: 256, 2: 4096, 3: 8192}, sorted({x for _, x in train})
    count = {x: sum((grams(t) for t, y in train if y == x), Counter()) for x in langs}
    of_size = {x: {n: sum(c for (k, _), c in count[x].items() if k == n) + 0.5 * size[n] for n in size} for x in langs}
    p = lambda x, g: (count[x][g] + 0.5) / of_size[x][g[0]]
    every = [(n, k) for n in size for k in range(size[n])]
    bits = []
    for k in range(1, 1 << len(langs) - 1):
        plus = [x for i, x in enumerate(langs) if k >> i & 1]
        minus = [x for x in langs if x not in plus]
        mean = lambda side, g: sum(p(x, g) for x in side) / len(side)
        table = {g: math.log(mean(plus, g)) - math.log(mean(minus, g)) for g in every}
        expected = {x: sum(p(x, g) * table[g] for g in every) for x in langs}
        low, high = min(expected[x] for x in plus), max(expected[x] for x in minus)
        bits.append((plus, table, (low + high) / 2, max((low - high) / 2, 1e-6)))
    whole, out = sum(b[3] for b in bits), []
    for t in texts:
        found, loss = grams(t), dict.fromkeys(langs, 0.0)
        totals = {n: max(1, sum(c for (k, _), c in found.items() if k == n)) for n in size}
        for plus, table, centre, scale in bits:
            margin = sum(c / totals[g[0]] * table[g] for g, c in found.items())
            margin = min(4.0, max(-4.0, (margin - centre) / scale))
            for x in langs:
                loss[x] += scale / whole * len(bits) * math.log1p(math.exp(-2 * (1 if x in plus else -1) * margin))
        best = min(langs, key=lambda x: loss[x])
        out.append((best, 1 / sum(math.exp(loss[best] - v) for v in loss.values())))
    return out


def test_against_plain_python(spark):
    words = {"en": "the cat sat on The mat 12", "de": "der hund ist über die Straße", "fr": "le chat était là où", "es": "el niño comió mañana"}
    rows = [(k, " ".join(itertools.islice(itertools.cycle(words[x].split()), k % 7, k % 7 + 3 + k % 5)), x) for k, x in enumerate([*words] * 6)]
    rows += [(90, "cat hund", None), (91, "mañana über", None), (92, "xyz", "en"), (93, "the " * 300_000, None), (94, "日本", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    out = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in rows}
    want = by_hand([(t, x) for k, t, x in rows if x and not out[k]], [t for _, t, _ in rows])
    for (k, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=2e-4) and got[k][2] == out[k]


def test_ties_and_too_many_languages(spark):
    rows = [(k, "same words here", x) for k, x in enumerate(["b", "a"] * 8)]  # languages that nothing tells apart
    got = {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 1
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(spark.createDataFrame([(k, "x", f"l{k}") for k in range(4)], "doc_id long, text string, lang string"), F.lit(True), most_languages=3)
