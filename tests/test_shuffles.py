"""Steps whose shuffles once grew beyond what the input needs: results on odd rows, and how often rows are exchanged."""

import numpy as np
from pyspark.sql import functions as F

from lexigrain.functions import text as tx
from lexigrain.operators import cleaning, features, metrics, sampling
from lexigrain.plans import grids


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("AdaptiveSparkPlan", 1)[-1].count("Exchange hashpartitioning")


def test_ngrams_are_shuffled_once_by_term_and_once_by_document(spark):
    rows = spark.createDataFrame([(1, "p", "a b a"), (1, "n", "a"), (2, "n", None), (3, "p", "b a b a c"), (None, "n", "a b")], "doc long, label string, text string")
    counts = features.known_counts(rows, "doc", "text", 1, 2, min_df=2, gather="label")
    got = {(r["doc"], r["term"]): (r["tf"], r["df"], sorted(r["labels"])) for r in counts.collect()}
    both, one = ["n", "p"], ["p"]
    assert got == {
        (1, "a"): (3, 3, both), (1, "b"): (1, 3, both), (1, "a b"): (1, 3, both), (1, "b a"): (1, 2, both), (3, "a"): (2, 3, one), (3, "b"): (2, 3, one), (3, "a b"): (1, 3, one), (3, "b a"): (2, 2, one),
        (None, "a"): (1, 3, ["n"]), (None, "b"): (1, 3, ["n"]), (None, "a b"): (1, 3, ["n"]),
    }
    assert exchanges(features.term_counts(rows, "doc", "text", 1, 2, min_df=2)) == 2  # texts by document, n-grams by term
    assert exchanges(features.weighted(counts, rows.agg(F.count(F.lit(1)).alias("n")))) == 3


def test_bootstrap_draws_every_row_of_every_resample(spark, monkeypatch):
    """As many draws as rows and resamples, joined by broadcast or shuffle alike."""
    rows = [(k, ["Negative", "Neutral", "Positive"][k % 3], None if k % 7 == 0 else ["Negative", "Positive"][k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "r long, label string, p string")
    slots = [(s["b"], s["row"]) for s in sampling.bootstrap_slots(spark, 40, 30).collect()]
    assert len(slots) == 1200
    f1 = []
    for b in range(30):
        drawn, per = [rows[r] for k, r in slots if k == b], []
        for x in ("Negative", "Neutral", "Positive"):
            both = sum(t == x for _, t, _ in drawn) + sum(p == x for _, _, p in drawn)
            per.append(2 * sum(t == p == x for _, t, p in drawn) / both if both else 0.0)
        f1.append(sum(per) / 3)
    want = tuple(round(float(x), 4) for x in np.percentile(f1, [2.5, 97.5]))
    for most in (1 << 21, 0):
        monkeypatch.setattr(metrics, "DRAW_ROWS", most)
        got = metrics.bootstrap_rows(df, "r", "label", ["p"], 30).first()
        assert (got["ci95_low"], got["ci95_high"]) == want


def test_grid_tables_share_one_row_for_each_document_and_term(spark):
    rows = spark.createDataFrame([(1, "train", "p", "a b a"), (2, "train", "n", "a c"), (3, "val", "p", "b a z")], "doc long, split string, label string, text string")
    wide = {(r["doc"], r["term"]): r["w"] for r in grids.wide_tables(rows).collect()}
    assert set(wide) == {(1, "a"), (1, "b"), (1, "a b"), (1, "b a"), (2, "a"), (2, "c"), (2, "a c"), (3, "b"), (3, "a"), (3, "b a")}
    assert wide[1, "a"][:4] == [2.0] * 4 and wide[1, "b"][:4] == [1.0, None, 1.0, None] and wide[1, "a b"][:4] == [None, None, 1.0, None]
    assert all(abs(sum(w[4] ** 2 for (d, _), w in wide.items() if d == doc) - 1) < 1e-9 for doc in (1, 2, 3))


def test_shared_steps_give_the_same_texts(spark):
    """A text cleaned and normalised once gives what each function gives alone; texts with and without old tone places."""
    texts = ["Hoà oẻ tuỳ quý Of The  IN THE of", "plain of the words sp!!!", "hoà thuý of the", None, "", "of", "in the of the end goooood"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    correct, join, t = tx.corrector({"sp": "sản phẩm"}), tx.joined_compounds(["of the", "in the"]), F.col("text")
    plain = tx.normalized(tx.cleaned(tx.nfc(F.coalesce("text", F.lit("")))))
    both = df.select("k", plain.alias("p"), tx.model_text(t, correct, join, ("end",)).alias("m"), tx.sequence_text(t, correct, join).alias("s"))
    got = both.select("k", "p", "m", "s", tx.words_text(F.col("p"), correct, join, ("end",)).alias("m2"), tx.running_text(F.col("p"), correct, join).alias("s2")).orderBy("k").collect()
    assert all((r["m"], r["s"]) == (r["m2"], r["s2"]) for r in got)
    assert got[0]["s"] == "Hòa ỏe tùy quý Of_The IN_THE of" and got[2]["s"] == "hòa thúy of_the" and got[6]["s"] == "in_the of_the end god"


def test_tfidf_vectors_shuffle_texts_once_and_terms_twice(spark):
    rows = [(1, "a b a"), (2, "b c"), (2, "c d"), (3, None), (None, "a"), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    vectors = cleaning.tfidf_vectors(df, "id", F.split("text", " "))
    assert exchanges(vectors) == 3  # texts by document, terms by term and by document
    got = {(r["doc"], r["term"]): r for r in vectors.where("term <> ''").collect()}
    idf = {t: np.log(7 / (1 + n)) + 1 for t, n in (("a", 2), ("b", 2), ("c", 1), ("d", 1))}
    raw = {1: {"a": 2 * idf["a"], "b": idf["b"]}, 2: {"b": idf["b"], "c": 2 * idf["c"], "d": idf["d"]}, None: {"a": idf["a"]}}
    assert {k: r["df"] for k, r in got.items()} == {(d, t): 2 if t in "ab" else 1 for d, ts in raw.items() for t in ts}
    for d, ts in raw.items():
        norm, rest = np.sqrt(sum(x * x for x in ts.values())), 0.0
        for t in sorted(ts, key=lambda t: (idf[t] < idf["c"], t), reverse=True):  # the most frequent term first
            rest += (ts[t] / norm) ** 2
            assert abs(got[d, t]["w"] - ts[t] / norm) < 1e-12 and abs(got[d, t]["rest"] - rest) < 1e-12


def test_only_vectors_of_paired_documents_are_joined(spark, monkeypatch):
    """The tables that cosines() writes first: pairs and their documents, whatever the number of other vectors."""
    tables, f = {}, cleaning.written
    monkeypatch.setattr(cleaning, "written", lambda df, name: tables.setdefault(name, f(df, name)))
    vectors = spark.createDataFrame([(d, t, 0.5**0.5) for d in range(50) for t in ("x", f"t{d % 25}")], "doc long, term string, w double")
    pairs = spark.createDataFrame([(1, 26), (1, 2), (1, 99)], "i long, j long")
    for most in (20_000, 0):
        tables.clear()
        monkeypatch.setattr(cleaning, "BROADCAST_DOCS", most)
        got = {(r["i"], r["j"]): round(r["cosine"], 9) for r in cleaning.cosines(pairs, vectors).collect()}
        assert got == {(1, 26): 1.0, (1, 2): 0.5}
        assert {r["_id"] for r in tables["ids"].collect()} == {1, 2, 26, 99}
