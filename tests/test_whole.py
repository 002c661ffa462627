"""Queries that do the whole job: against their SQL without the filters that cut its input."""

import inspect
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexigrain import edge_queries, queries  # noqa: F401 - registers more queries
from lexigrain.operators import metrics
from tests.test_queries import SF, normal


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def equals_whole(spark, duck, name, *cuts):
    sql = queries.SQL[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    got, want = normal(queries.QUERIES[name](spark, SF).toPandas()), normal(duck.execute(sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_seed_summary_reads_all_orders(spark, duck):
    equals_whole(spark, duck, "seed_summary", " WHERE o_orderkey % 3 = 0")


def test_seed_epochs(spark):
    history = {42: (0.8427, 0.8749, 0.8609, 0.8621), 43: (0.8439, 0.844, 0.8645, 0.8694), 44: (0.8765, 0.889, 0.8854, 0.8978), 45: (0.5, 0.5)}
    df = spark.createDataFrame([(s, e, v) for s, vs in history.items() for e, v in enumerate(vs, 1)], "seed int, epoch int, f1 double")
    runs = metrics.seed_epochs(df, "seed", "epoch", "f1")
    assert {tuple(r) for r in runs.collect()} == {(42, 0.8609, 0.8749, 2), (43, 0.8645, 0.8694, 4), (44, 0.8854, 0.8978, 4), (45, None, 0.5, 1)}
    three = runs.where("seed < 45").selectExpr("'all' AS g", "best", "value_at")
    assert tuple(metrics.seed_summary(three, "g", "best").first()) == ("all", 3, 0.8807, 0.0151)
    assert tuple(metrics.seed_summary(three, "g", "value_at").first()) == ("all", 3, 0.8703, 0.0132)


@pytest.mark.parametrize("name", ["label_adjudication", "agreement_summary"])
def test_every_review_is_adjudicated(spark, duck, name):
    equals_whole(spark, duck, name, " WHERE row_id % 3 = 0")


def test_validated_join_has_every_review(spark, duck):
    equals_whole(spark, duck, "validated_join", " WHERE a.row_id % 2 = 0")


def test_validated_join_checks_odd_rows_on_the_left(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "p", "Positive"), (1, "q", "Neutral"), (2, "p", "Positive")], "row_id long, product_id string, label_star string")
    monkeypatch.setattr(queries, "load_reviews", lambda *_: rows)
    monkeypatch.setattr(queries.joins, "one_to_one", lambda left, right, key: left)
    assert queries.validated_join(spark, SF).count() == 3


def test_key_overlap_covers_all_reviews(spark, duck):
    both = f"s AS ({queries.SQL['strat_split']}), t AS (SELECT product_id, split FROM reviews JOIN s USING (row_id))"
    k = "(SELECT product_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b FROM t GROUP BY product_id)"
    sql = f"WITH {queries.BASE}, {both} SELECT count(*) FILTER (a AND b), count(*) FILTER (a AND NOT b), count(*) FILTER (b AND NOT a), (SELECT count(DISTINCT product_id) FROM reviews) FROM {k}"
    *want, products = duck.execute(sql).fetchone()
    assert list(queries.key_overlap(spark, SF).first()) == want and sum(want) == products


def macro_f1(rows):
    """Of (truth, prediction, n) by plain counting."""
    out = []
    for label in ("Negative", "Neutral", "Positive"):
        tp, pp, sp = (sum(n for t, p, n in rows if f(t, p)) for f in (lambda t, p: t == p == label, lambda t, p: p == label, lambda t, p: t == label))  # noqa: B023
        out.append(2 * tp / (pp + sp) if pp + sp else 0.0)
    return sum(out) / 3


@pytest.mark.parametrize("n", [7, 300, 30_000])
def test_bootstrap_equals_brute_force(spark, n):
    """2,000 resamples as numbers of rows of each kind; as wide as an interval from drawn row numbers."""
    labels = "element_at(array('Negative', 'Neutral', 'Positive'), cast(id % 3 + 1 AS int))"
    df = spark.range(n).selectExpr("id AS r", f"{labels} AS label", f"IF(id % 4 = 0, 'Neutral', {labels}) AS p", "IF(id % 5 = 0, NULL, 'Positive') AS q").repartition(3)
    got = {r["model"]: (r["ci95_low"], r["ci95_high"]) for r in metrics.bootstrap_f1(df, "label", ["p", "q"]).collect()}
    rows = Counter(tuple(r) for r in df.select("label", "p", "q").collect())
    kinds = sorted(rows, key=lambda k: [(x is not None, x or "") for x in k])
    share = np.asarray([rows[k] for k in kinds]) / n
    drawn = [np.random.default_rng([42, b]).multinomial(n, share) for b in range(2000)]
    for j, model in ((1, "p"), (2, "q")):
        f1 = [macro_f1([(k[0], k[j], c) for k, c in zip(kinds, d, strict=True)]) for d in drawn]
        assert got[model] == tuple(round(float(x), 4) for x in np.percentile(f1, [2.5, 97.5]))
    rng, table = np.random.default_rng(0), [k for k in kinds for _ in range(rows[k])]
    if n == 300:
        f1 = [macro_f1([(k[0], k[1], 1) for k in (table[i] for i in rng.integers(0, n, n))]) for _ in range(2000)]
        assert np.abs(np.percentile(f1, [2.5, 97.5]) - got["p"]).max() < 0.01


def test_robustness_table(spark):
    rows = [(k, ["Negative", "Neutral", "Positive"][k % 3], ["Negative", "Neutral", "Positive"][k % 3 if k % 5 else 0]) for k in range(90)]
    df = spark.createDataFrame(rows, "row long, label string, m string")
    rater = df.where("row % 2 = 0").select("row", F.when(F.col("row") % 4 == 0, F.col("label")).alias("r"))
    got = {r["model"]: r for r in metrics.robustness(df, "label", ["m"], "row", rater, "r", "m", resamples=50).collect()}
    assert got["gold"]["is_reference"] and got["gold"]["macro_f1"] is None and got["gold"]["ci95_low"] is None and got["gold"]["rater_accuracy"] == 1.0
    assert got["m"]["rater_n"] == got["gold"]["rater_n"] == 23 and got["m"]["ci95_low"] <= got["m"]["macro_f1"] <= got["m"]["ci95_high"]


def test_split_numbers_only_the_rows_at_the_boundary(spark):
    from lexigrain.operators import sampling

    df = spark.range(5000).selectExpr("id AS k", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS s")
    split = sampling.stratified_split(df, "s", "k")
    assert split.where("split = 'val'").count() == 750 and split.count() == 5000
    counts = {r["s"]: r["n"] for r in split.where("split = 'val'").groupBy("s").agg({"*": "count"}).toDF("s", "n").collect()}
    assert counts == {None: 75, "a": 225, "b": 450}


def test_word_vectors_have_the_operators_size_and_epochs(spark, monkeypatch):
    used, f = {}, queries.models.word_vectors

    def spy(*args, **kwargs):
        call = inspect.signature(f).bind(*args, **kwargs)
        call.apply_defaults()
        used.update(call.arguments)
        return f(*args, **kwargs)

    monkeypatch.setattr(queries.models, "word_vectors", spy)
    assert len(queries.w2v_features(spark, SF).first()["vector"]) == 200 and (used["size"], used["epochs"]) == (200, 20)



def test_ablation_compares_both_texts(spark):
    rows = {r["stop_words"]: r for r in queries.QUERIES["stopword_ablation"](spark, SF).collect()}
    assert set(rows) == {"kept", "removed"} and all(0 <= r["macro_f1"] <= 1 and r["alpha"] for r in rows.values()) and len({r["feature"] for r in rows.values()}) == 1


def test_percentiles_of_many_different_doubles(spark):
    from lexigrain.operators import quantiles

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=60_000), "b": np.exp(rng.normal(size=40_000) * 12), "c": np.asarray([3.0]), "d": np.asarray([1.0, 1.0, 2.0]), None: np.asarray([-1e308, 1e308, 5.0, 5.0])}
    frame = pd.DataFrame([(g, float(v)) for g, x in values.items() for v in x], columns=["g", "x"])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, x double").unionByName(spark.createDataFrame([("e", None), ("a", None), ("d", float("nan"))], "g string, x double"))
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in quantiles.exact_percentiles(df.repartition(4), "g", "x", qs).collect()}
    assert got.pop("e") == [None] * 5 and set(got) == set(values)
    for g, x in values.items():
        assert got[g] == pytest.approx(np.quantile(x, qs).tolist(), rel=1e-12)
    assert quantiles.exact_percentiles(df.limit(0), "g", "x", qs).count() == 0


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_gold_sample_in_chunks(spark, monkeypatch, chunk):
    """Equal to the scan row by row, with a product that holds nearly all rows."""
    from lexigrain.operators import sampling

    monkeypatch.setattr(sampling, "CHUNK", chunk)
    df = spark.range(3000).selectExpr("id AS row_id", "cast((id + id div 10) % 5 + 1 AS int) AS star", "CASE WHEN id % 10 > 0 THEN 'big' WHEN id % 7 = 0 THEN NULL ELSE concat('p', id % 370) END AS product_id")
    quota = {1: 12, 2: 5, 3: 9, 5: 14}
    rows = df.select("row_id", "star", "product_id", sampling.hash_order("row_id").alias("h")).orderBy("h", "row_id").collect()
    room, used, want = dict(quota), Counter(), set()
    for r in rows:
        if room.get(r["star"], 0) and used[r["product_id"]] < 6:
            want.add(r["row_id"])
            room[r["star"]] -= 1
            used[r["product_id"]] += 1
    got = sampling.sample_gold(df, quota, 6).collect()
    assert {r["row_id"] for r in got} == want and sorted(r["gold_id"] for r in got) == [f"G{k:03d}" for k in range(1, 41)]
    with pytest.raises(ValueError, match="quota"):
        sampling.sample_gold(df, {1: 10_000}, 6)


def scans(df, what):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def test_texts_are_read_once(spark):
    """The plans that remain have no second pass over documents, and composed text leaves the JVM once at most."""
    assert scans(queries.funnel_counts(spark, SF), "documents.parquet") == 0  # its counts are a table
    assert scans(queries.bow_counts(spark, SF), "documents.parquet") == 0
    assert scans(queries.exact_dedup(spark, SF), "documents.parquet") == 0
