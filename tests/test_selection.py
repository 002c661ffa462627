"""Ranking, sampling, labels and metrics: hand-written cases and plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrain.operators import aggregates, labels, metrics, ranking, sampling


def test_candidate_order(spark):
    rows = [("c", "a", 4.9, 5.0), ("c", "b", 4.4, 1.0), ("c", "d", None, 9.0), ("c", "e", 4.6, 2.0), ("c", "f", 4.8, 2.0), ("c", "g", 4.9, 1.0)]
    got = ranking.candidate_order(spark.createDataFrame(rows, "category string, url string, vote double, sold double")).orderBy("place").collect()
    assert [(r["url"], r["pick"]) for r in got] == [("b", "low_vote"), ("d", "top_sold"), ("e", "low_rank"), ("a", "top_sold"), ("f", "low_rank"), ("g", "top_sold")]


def test_round_robin(spark):
    rows = [("x", 1, "u"), ("x", 2, "v"), ("y", 1, "u"), ("y", 2, "w")]
    got = ranking.round_robin(spark.createDataFrame(rows, "category string, place int, url string"), "category", "category").orderBy("turn").collect()
    assert [r["url"] for r in got] == ["u", "v", "w"]


def test_page_caps(spark):
    rows = [("p", 5, k // 20 + 1, k) for k in range(70)] + [("p", 1, 1, 100 + k) for k in range(5)]
    df = spark.createDataFrame(rows, "product_id string, star int, page int, item int")
    got = ranking.page_caps(df, cap=30, product_cap=300).collect()
    assert Counter(r["star"] for r in got) == {5: 40, 1: 5} and {r["crawled"] for r in got if r["star"] == 5} == {40}
    assert ranking.page_caps(df, cap=30, product_cap=42).count() == 42


def test_best_top_strided(spark):
    df = spark.createDataFrame([("a", 0.5, 2), ("a", 0.5, 1), ("b", 0.1, 3)], "g string, s double, o int")
    assert {(r["g"], r["o"]) for r in ranking.best_rows(df, ["g"], "s", "o").collect()} == {("a", 1), ("b", 3)}
    assert ranking.top_per_group(df, "g", "s", "o", 1).count() == 2
    n = spark.range(20)
    assert [r["id"] for r in ranking.strided(n, "id", 8).orderBy("id").collect()] == [0, 2, 4, 6, 8, 10, 12, 14]


def test_stratified_split_has_exact_sizes(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", None])) for k in range(487)]
    df = spark.createDataFrame(rows, "k int, y string")
    got = sampling.stratified_split(df, "y", "k").collect()
    val = Counter(r["y"] for r in got if r["split"] == "val")
    assert len(got) == 487 and sum(val.values()) == math.ceil(0.15 * 487)
    assert all(abs(val[y] - 0.15 * n) <= 1 for y, n in Counter(y for _, y in rows).items())
    assert sampling.stratified_split(df.repartition(7), "y", "k").where("split = 'val'").select("k").exceptAll(spark.createDataFrame([r for r in got if r["split"] == "val"], "k int, y string, split string").select("k")).count() == 0


def test_gold_sample(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(1, 5), f"p{rng.randint(0, 9)}") for k in range(600)]
    df = spark.createDataFrame(rows, "row_id long, star int, product_id string")
    quota = {1: 5, 2: 7, 3: 9, 4: 3, 5: 6}
    got = sampling.sample_gold(df, quota, per_product=4).collect()
    assert Counter(r["star"] for r in got) == quota and max(Counter(r["product_id"] for r in got).values()) <= 4
    assert sorted(r["gold_id"] for r in got) == [f"G{k:03d}" for k in range(1, 31)]
    room, used, want = dict(quota), Counter(), set()
    order = {r["row_id"]: r["h"] for r in df.select("row_id", sampling.hash_order("row_id").alias("h")).collect()}
    for k, s, p in sorted(rows, key=lambda r: (order[r[0]], r[0])):
        if room[s] > 0 and used[p] < 4:
            room[s] -= 1
            used[p] += 1
            want.add(k)
    assert {r["row_id"] for r in got} == want
    with pytest.raises(PySparkException):
        sampling.sample_gold(df, {1: 500}).collect()


def test_bootstrap_slots_are_paired_and_uniform(spark):
    slots = sampling.bootstrap_slots(spark, 7, 50)
    assert slots.count() == 350 and slots.where("row < 0 or row > 6").count() == 0
    assert slots.exceptAll(sampling.bootstrap_slots(spark, 7, 50)).count() == 0


def test_batches(spark):
    got = labels.batches(spark.range(120).withColumn("k", F.format_string("%03d", "id")).repartition(5), "k").orderBy("k").collect()
    assert [r["id"] for r in got] == [f"P{k:04d}" for k in range(1, 121)] and [r["batch"] for r in got] == [k // 50 + 1 for k in range(120)]


def test_answers(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "id string")
    good = spark.createDataFrame([("a", "pos", "High", ""), ("b", "NEG", "low", "")], "id string, label_llm string, confidence string, reason string")
    assert {r["label_llm"] for r in labels.merge_answers(expected, good).collect()} == {"Positive", "Negative"}
    assert labels.batch_problems(expected, good).agg(F.sum("n")).first()[0] == 0
    bad = good.unionByName(good.limit(1))
    with pytest.raises(PySparkException):
        labels.merge_answers(expected, bad).collect()


def test_crosstabs(spark):
    df = spark.createDataFrame([("Negative", "Positive"), ("Negative", "Negative"), ("Positive", "Positive"), ("Positive", None)], "label_star string, label string")
    got = {r["label_star"]: r.asDict() for r in labels.with_margins(df, "label_star", "label").collect()}
    assert got["Total"]["Total"] == 3 and got["Negative"] == {"label_star": "Negative", "Negative": 1, "Neutral": 0, "Positive": 1, "Total": 2}
    wide = {r["label_star"]: r["Neutral"] for r in labels.confusion(df, "label_star", "label").collect()}
    assert wide == {"Negative": 0, "Positive": 0}


def test_kappa(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string")
    r = labels.agreement(make([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y"), (None, "x")]), "a", "b").first()
    assert (r["n"], r["raw"], r["kappa"]) == (4, 0.75, 0.5)
    assert labels.agreement(make([("x", "x"), ("x", "x")]), "a", "b").first()["kappa"] is None


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([("Negative", "Negative"), ("Negative", "Positive"), ("Negative", "Negative")], "label string, pred string")
    s = metrics.scores(df, "label", "pred").first()
    assert (s["n"], s["accuracy"], s["macro_f1"]) == (3, 0.6667, round(0.8 / 3, 4))
    report = {r["label"]: r for r in metrics.classification_report(df, "label", "pred").collect()}
    assert report["Neutral"]["f1"] == 0.0 and report["Positive"]["recall"] == 0.0 and report["Negative"]["support"] == 3
    rates = {(r["t"], r["p"]): r["rate"] for r in metrics.confusion_rates(df, "label", "pred").collect()}
    assert len(rates) == 9 and rates["Negative", "Positive"] == 0.3333 and rates["Neutral", "Neutral"] == 0.0


def test_bootstrap_of_perfect_predictions(spark):
    rows = [(k, ["Negative", "Neutral", "Positive"][k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "r long, label string").withColumn("same", F.col("label"))
    r = metrics.bootstrap_f1(df, "label", ["same"], 50).first()
    assert (r["ci95_low"], r["ci95_high"]) == (1.0, 1.0)


def test_derived_star(spark):
    df = spark.createDataFrame([(1, 2, None, 4, 5, 20), (None, None, 1, 1, 1, 9), (9, 9, None, 9, 9, 5)], "a int, b int, c int, d int, e int, n int")
    star, count = aggregates.derived_star_count([F.col(c) for c in "abcde"], F.col("n"))
    assert [tuple(r) for r in df.select(star, count).collect()] == [(3, 8), (None, None), (3, 0)]
    assert spark.range(1).select(aggregates.extrapolated_count(F.lit(4), F.lit(7))).first()[0] == 67


def test_checked_joins(spark):
    from lexigrain.operators import joins

    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (None, "w")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "k int, u string")
    assert joins.one_to_one(a, b.where("u <> 'r'"), "k").count() == 2
    with pytest.raises(PySparkException):
        joins.one_to_one(a, b, "k").collect()
    assert joins.complete_lookup(a.where("k = 1").select("k"), b, "k").first()["u"] == "p"
    with pytest.raises(PySparkException):
        joins.complete_lookup(a.select("k"), b.where("k = 1"), "k").collect()
    assert joins.without(a, b.where("k = 1"), "k").count() == 3
    assert tuple(joins.overlap(a.where("k is not null"), b.where("k = 1"), "k").first()) == (1, 1, 0)
