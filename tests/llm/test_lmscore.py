"""Language-model scores against plain counting and the sum over all segmentations."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from lexigrain.llm import lmscore

PATH = P.path("piece_bpe_32k.model")


def all_ways(v, logp, word):
    """Sum of the probabilities of all segmentations by recursion."""
    word = lmscore.SPACE + word

    def rest(k):
        if k == len(word):
            return 1.0
        total = 0.0
        for j in range(k + 1, len(word) + 1):
            s = word[k:j]
            if s in v.pieces:
                total += math.exp(logp[v.pieces[s]]) * rest(j)
            elif j == k + 1:
                total += math.exp(sum(logp[v.bytes[b]] for b in s.encode())) * rest(j)
        return total

    return math.log(rest(0))


def test_lattice_sums_all_segmentations():
    v = lmscore.vocabulary(PATH)
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(v.size)))
    words = ["the", "a", "internation", "naïve", "日本", "🙂x", "zzzzz", "▁x", "q"]
    got = lmscore.Lattice(v, logp).words(words)
    assert got == pytest.approx([all_ways(v, logp, w) for w in words], rel=1e-9)
    assert np.isfinite(lmscore.Lattice(v, logp).words(["x" * 5000])).all()


@pytest.mark.parametrize("most", [{}, {"most_tokens": 40, "most_words": 12}])
def test_scores(spark, most):
    rows = [(k, t) for k, t in enumerate(["The cat  sat", None, "", "the Dog É é", "rare " * 50, "\n", "a b c d e f g h", "cat cat"] * 5)] + [(None, "the cat"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = lmscore.score(df, PATH, **most).collect()
    train, docs = Counter(), []
    for k, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        out = zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
        docs.append((k, out, words))
        if not out:
            train.update(words)
    total, distinct = sum(train.values()), len(train)
    want = sorted(str((k, o, len(w), sum(train[x] > 0 for x in w), total, round(sum(math.log10((train[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6))) for k, o, w in docs)
    assert sorted(str((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == want
    by_words = {}
    for r in got:  # equal texts have equal scores, more words lower ones
        by_words.setdefault(r["n_tokens"], set()).add(round(r["score"], 6))
    assert len(by_words[51]) == 1 and all(r["score"] < 0 for r in got)


def test_score_is_the_sum_of_words_by_learned_pieces(spark):
    """From the vocabulary's segmentation of the training words to the sum over all segmentations, in plain Python."""
    rows = list(enumerate(["the cat sat", "The dog É", "", None, "naïve cats", "the 日本 q", "sat sat sat dog", "zq"] * 3))
    got = {r["doc_id"]: r["score"] for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()}
    v, pieces = lmscore.vocabulary(PATH), Counter()
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 10:
            for w in (t or "").encode().lower().split():
                pieces.update(v.model.encode(w.decode()))
            pieces[v.end] += 1
    total = sum(pieces.values()) + 0.1 * (v.size + 1)
    logp = np.asarray([math.log((pieces[i] + 0.1) / total) for i in range(v.size)])
    for k, t in rows:
        want = logp[v.end] + sum(all_ways(v, logp, w.decode()) for w in (t or "").encode().lower().split())
        assert got[k] == pytest.approx(want / math.log(10), rel=1e-9)


def test_long_words_and_long_texts(spark):
    """A word of 100,000 characters and a text of 300,000 words, whole: scores are finite and grow with the text."""
    rows = [(1, "the cat sat"), (2, "a" * 100_000), (3, "the cat " * 150_000), (4, "the cat")]
    got = {r["doc_id"]: r for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got[3]["n_tokens"] == 300_001 and got[2]["n_tokens"] == 2 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    end = got[4]["score"] - (got[3]["score"] - got[4]["score"]) / 149_999
    assert got[3]["score"] == pytest.approx(150_000 * (got[4]["score"] - end) + end, rel=1e-6)


def test_nothing(spark):
    assert lmscore.score(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
