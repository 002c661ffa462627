"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from lexigrain.llm import jaccard

from .test_vectors import reach


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, links = [shingle_set(t) for _, t in rows], []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links.append((b, a))
    root, n = reach(len(rows), links), np.zeros(len(rows), dtype=int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {rows[k][0]: (rows[root[k]][0], int(n[k])) for k in range(len(rows))}


def corpus(seed):
    rng, vocabulary = random.Random(seed), [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.5:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "  ", "\n"]).join(copy))
    texts += [None, "", " \n", "A b c", "a B c", "a b c d", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"bucket": 4, "tile": 5})])
def test_against_brute_force(spark, seed, more):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, cid string, copies int").repartition(5)
    got = jaccard.near_duplicates(df, **more).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in got)


def test_repeated_rows_nulls_and_nothing(spark):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None), (9, "a b c d e f")]
    got = sorted(map(str, map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(str, [(3, 3, 2, True), (3, 3, 2, True), (None, None, 0, False), (4, 4, 0, True), (9, 3, 2, False)]))


def test_repeated_ids_with_different_texts(spark):
    """Links are of rows; rows of one doc_id are one node of the classes."""
    words = [f"w{k}" for k in range(120)]
    a, b, c, d = (" ".join(x) for x in (words, [*words[:-1], "b"], ["c", *words[1:]], words[60:] + ["d"] * 9))
    rows = [(5, a), (5, b), (9, b), (6, c), (7, d), (5, d)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted([(5, 5, 3, True), (5, 5, 3, True), (9, 5, 3, False), (6, 5, 3, False), (7, 5, 1, False), (5, 5, 1, True)])


def near_group(n, seed=4):
    """n texts that each replace one or two words of the same 200."""
    rng = random.Random(seed)
    base = [f"g{k}" for k in range(200)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.choice([1, 2])):
            copy[rng.randrange(200)] = f"x{k}"
        out.append(" ".join(copy))
    return out


def made(spark, monkeypatch, texts):
    """Result, and the rows of the tables that buckets and splits write."""
    rows, f = {}, jaccard.written

    def spy(df, name):
        out = f(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    monkeypatch.setattr(jaccard, "written", f)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got}, rows


def test_a_large_group_of_near_copies_is_settled_once(spark, monkeypatch):
    sets = [shingle_set(t) for t in near_group(4000)]
    got, rows = made(spark, monkeypatch, near_group(4000))
    _, few = made(spark, monkeypatch, near_group(400))
    assert rows.get("live", 0) + rows.get("nodes", 0) <= 10 * (few.get("live", 0) + few.get("nodes", 0)) + 4000
    assert rows["met"] <= 11 * few["met"]
    assert {c for c, _ in got.values()} == {0}
    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for k in range(0, 4000, 400):
        common = np.zeros(4000)
        for x in sets[k]:
            common[index[x]] += 1
        size = np.asarray([len(s) for s in sets])
        want = np.count_nonzero(10 * common >= 8 * (size[k] + size - common)) - 1
        assert got[k][1] == want


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs with a similarity from 0.80 to 0.82, the hardest to find: at least 0.99 of them are linked."""
    rng, texts, want = random.Random(8), [], 0
    for k in range(700):
        base = [f"{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        copy = list(base)
        while True:
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(copy))
            near = len(a & b) / len(a | b)
            if near < 0.82:
                break
        if near >= 0.8:
            texts += [" ".join(base), " ".join(copy)]
            want += 1
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    found = sum(r["n_links"] for r in got) / 2
    assert want > 150 and 0.99 * want <= found <= want


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n).astype("u8")) for n in (0, 5, 30, 80, 80)]
    got = jaccard.common_counts(sets, columns=7)
    cross = jaccard.common_counts(sets[:2], sets[2:], columns=7)
    assert np.array_equal(cross, got[:2, 2:])
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(5) for j in range(i))


def test_runs():
    assert jaccard.runs_needed(0.8, 0.99, 1) == 5
    assert jaccard.runs_needed(0.8, 0.9999, 3) > jaccard.runs_needed(0.8, 0.99, 3)
