"""Near duplicates by groups against all pairs and the scan in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.operators import cleaning, neargroups
from tests.test_cleaning import greedy


def corpus(seed, bases=20, copies=12, words=80):
    """Copies of base texts: some with words doubled (within a group), some with one, two or many words changed (between, apart)."""
    rng, texts = np.random.default_rng(seed), []
    for b in range(bases):
        base = rng.integers(0, words, rng.integers(8, 60))
        texts.append(base)
        for _ in range(rng.integers(0, copies)):
            copy = np.concatenate([base, base[rng.integers(0, len(base), rng.integers(0, 3))]])
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.integers(0, len(copy))] = rng.integers(0, words)
            texts.append(copy)
    texts = [texts[k] for k in rng.permutation(len(texts))]
    return [" ".join(f"w{k}" for k in t) for t in texts] + ["", "!!", "alone"]


def dense(texts):
    words = sorted({w for t in texts for w in t.split() if w != "!!"})
    tf = np.asarray([[t.split().count(w) for w in words] for t in texts], float)
    x = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id int, text_norm string").withColumn("grp", F.lit("x")).withColumn("doc", F.lit(0))


@pytest.mark.parametrize(("seed", "above", "rows"), [(0, 0.9, 2000), (1, 0.8, 2), (2, 0.6, 2000)])
def test_links_and_scan(spark, monkeypatch, seed, above, rows):
    monkeypatch.setattr(cleaning, "PREFIX_ROWS", rows)
    texts = corpus(seed)
    x = dense(texts)
    near = (x @ x.T > above) & ~np.eye(len(x), dtype=bool)
    df = frame(spark, texts)
    vectors = neargroups.word_vectors(df)
    found = neargroups.near_groups(vectors, above)
    assert found.sure.where("g <> h").count() and found.pairs.count()  # all three ways of a link occur
    counts = {r["doc"]: r["n_near"] for r in neargroups.link_counts(found).collect()}
    assert counts == {k: n for k, n in enumerate(near.sum(1).tolist()) if n}
    removed = {r["j"]: (r["i"], r["cosine"]) for r in neargroups.greedy_removal(found, vectors).collect()}
    want = greedy(x, above)
    assert {j: i for j, (i, _) in removed.items()} == want
    assert all(abs(c - x[i] @ x[j]) < 6e-4 for j, (i, c) in removed.items())
    # no pair is listed that a pair of groups stands for
    grp = {r["doc"]: r["grp"] for r in found.nodes.collect()}
    sure = {(r["g"], r["h"]) for r in found.sure.collect()}
    assert not any((grp[r["i"]], grp[r["j"]]) in sure for r in found.pairs.collect())


def cluster(n, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(100)]
    return [" ".join([*base, base[rng.integers(100)], base[rng.integers(100)]]) for _ in range(n)]


def test_copies_make_rows_in_proportion(spark):
    """2,000 near copies: rows of all relations grow with the copies, not with their 2,000,000 pairs."""
    sizes = {}
    for n in (500, 2000):
        df = frame(spark, cluster(n) + [f"x{k} y{k % 7} z{k % 11}" for k in range(50)])
        vectors = neargroups.word_vectors(df)
        found = neargroups.near_groups(vectors)
        sizes[n] = found.nodes.count() + found.sure.count() + found.pairs.count()
        assert neargroups.link_counts(found).agg(F.sum("n_near")).first()[0] == n * (n - 1)
        gone = neargroups.greedy_removal(found, vectors)
        assert gone.agg(F.count(F.lit(1)), F.max("i"), F.min("j")).first()[:] == (n - 1, 0, 1)
    assert sizes[2000] <= 1.1 * 2000 and sizes[500] <= 1.1 * 500 + 20


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "row_id int, text_norm string")
    kept, removed = neargroups.dedup_near(empty)
    assert kept.count() == 0 and removed.count() == 0
    rows = [(1, "a b c"), (2, None), (3, "c b a"), (4, ""), (5, "q"), (6, "Q!"), (7, "long " * 5000 + "a b c"), (8, "long " * 5001 + "a b c")]
    kept, removed = neargroups.dedup_near(spark.createDataFrame(rows, "row_id int, text_norm string"))
    assert {(r["j"], r["i"]) for r in removed.collect()} == {(3, 1), (6, 5), (8, 7)}
    assert {r["row_id"] for r in kept.collect()} == {1, 2, 4, 5, 7}
