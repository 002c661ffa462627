"""Filters, funnel and de-duplication: hand-written cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.operators import cleaning, neargroups


def test_language_and_staff(spark):
    df = spark.createDataFrame([("máy tốt",), ("san pham ok",), ("hello there",), ("",)], "t string")
    assert [r[0] for r in df.select(cleaning.is_vietnamese(F.col("t"))).collect()] == [True, True, False, False]
    texts = ["Dạ, Điện máy XANH xin chào", "  dmx cảm ơn", "tôi nghe điện máy xanh xin lỗi", "gặp Quản trị viên", "tốt"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cleaning.is_staff_reply(F.col("t"))).collect()] == [True, True, False, True, False]


def test_funnel_counts_what_is_left(spark):
    df = spark.createDataFrame([("",), ("a",), ("a b",), ("a b c",), (None,)], "t string")
    steps = [("null", F.col("t").isNull()), ("empty", F.col("t") == ""), ("short", F.length("t") < 3)]
    got = {r["step"]: (r["dropped"], r["remaining"]) for r in cleaning.funnel_counts(cleaning.funnel(df, steps), [s for s, _ in steps]).collect()}
    assert got == {"raw": (0, 5), "null": (1, 4), "empty": (1, 3), "short": (1, 2)}


def test_dedup_exact(spark):
    groups = {"one": ["N"], "two-one": ["P", "N", "P"], "tie": ["P", "N"], "221": ["A", "B", "A", "B", "C"], "211": ["B", "A", "A", "C"], "late": ["X", "Y", "Y"], "null": [None, None], "null-one": [None, "Q", None]}
    rows, k = [], 0
    for key, names in groups.items():
        for name in names:
            rows.append((k, key, name))
            k += 1
    kept, ties = cleaning.dedup_exact(spark.createDataFrame(rows, "row_id int, text_norm string, label_star string"))
    found = {r["text_norm"]: r["row_id"] for r in kept.collect()}
    assert {r[0] for r in ties.collect()} == {"tie", "221"}
    first = lambda key, name: next(i for i, g, x in rows if g == key and x == name)
    assert found == {"one": 0, "two-one": first("two-one", "P"), "211": first("211", "A"), "late": first("late", "Y"), "null": first("null", None), "null-one": first("null-one", "Q")}


def greedy(x, above):
    gone, pairs = set(), {}
    for i in range(len(x)):
        if i in gone:
            continue
        for j in range(i + 1, len(x)):
            if j not in gone and x[i] @ x[j] > above:
                gone.add(j)
                pairs[j] = i
    return pairs


@pytest.mark.parametrize(("seed", "rows"), [(0, 2000), (1, 2000), (2, 3)])
def test_dedup_near_is_the_greedy_scan(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(cleaning, "PREFIX_ROWS", rows)
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(25):
        base = rng.integers(0, 60, rng.integers(1, 25))
        texts.append(base)
        for _ in range(rng.integers(0, 4)):
            copy = base.copy()
            copy[rng.integers(0, len(copy))] = rng.integers(0, 60)
            texts.append(copy)
    texts = [" ".join(f"w{k}" for k in t) for t in texts] + ["", "!!"]
    words = sorted({w for t in texts for w in t.split() if w != "!!"})
    tf = np.asarray([[t.split().count(w) for w in words] for t in texts], float)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1
    x = tf * idf
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text_norm string")
    kept, removed = neargroups.dedup_near(df, above=0.8)
    want = greedy(x, 0.8)
    assert {r["j"]: r["i"] for r in removed.collect()} == want and want
    assert {r["row_id"] for r in kept.collect()} == set(range(len(texts))) - set(want)


def test_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(0, 1, 0.95), (1, 2, 0.95), (2, 3, 0.95), (5, 6, 0.92), (4, 6, 0.91)], "i int, j int, cosine double")
    assert {(r["j"], r["i"]) for r in cleaning.greedy_removal(pairs).collect()} == {(1, 0), (3, 2), (6, 4)}
    assert cleaning.greedy_removal(pairs.limit(0)).count() == 0


def test_leak_guard_and_first_by_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "a")], "k int, text_clean string")
    test = spark.createDataFrame([("a",), ("a",), (None,)], "text_clean string")
    assert {r["k"]: r["leaked"] for r in cleaning.leak_guard(df, test).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {r["k"] for r in cleaning.first_by_key(df, "text_clean", "k").collect()} == {1, 2, 3}
