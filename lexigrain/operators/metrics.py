"""Evaluation tables of classifiers: all from grouped counts, never from collected rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LABELS
from ..storage import written


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cells(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """by, t, p, n: the confusion counts everything here is made from."""
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """by, label, precision, recall, f1, support for each label, present or not; 0 where a ratio has no denominator."""
    total, parts = [F.sum("n").alias("rows")], []
    for k, label in enumerate(labels):
        n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
        total += [n((F.col("t") == label) & (F.col("p") == label)).alias(f"tp{k}"), n(F.col("p") == label).alias(f"pp{k}"), n(F.col("t") == label).alias(f"sp{k}")]
        tp, pp, sp = (F.col(f"{x}{k}") for x in ("tp", "pp", "sp"))
        parts.append(F.struct(F.lit(label).alias("label"), _ratio(tp, pp).alias("precision"), _ratio(tp, sp).alias("recall"), _ratio(2 * tp, pp + sp).alias("f1"), sp.alias("support"), tp.alias("tp")))
    # one pass for all labels: a union would count once for each
    wide = counts.groupBy(*by).agg(*total)
    return wide.select(*by, F.explode(F.array(*parts)).alias("_of"), "rows").select(*by, "_of.*", "rows")


def classification_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """class_report rounded to four decimals."""
    r = class_report(cells(df, truth, pred, by), by)
    return r.select(*by, "label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, accuracy, macro_precision, macro_recall, macro_f1 over all labels, present or not."""
    r = class_report(cells(df, truth, pred, by), by)
    macro = [F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return r.groupBy(*by).agg(F.first("rows").alias("n"), F.round(_ratio(F.sum("tp"), F.first("rows")), 4).alias("accuracy"), *macro)


def second_rater_scores(df: DataFrame, rater: DataFrame, row: str, truth: str, model: str, pred: str, label: str, gold: str = "gold") -> DataFrame:
    """model, n, accuracy, macro_f1 of df(row, truth, model, pred) against rater(row, label) where that has a label.

    A row named by `gold` compares the truth itself with the rater.
    """
    given = rater.where(F.col(label).isNotNull()).select(F.col(row).alias("_row"), F.col(label).alias("_label"))
    both = df.join(given, F.col(row) == F.col("_row")).select("_row", "_label", F.col(truth).alias("_truth"), F.col(model).alias("model"), F.col(pred).alias("_pred"))
    truths = both.dropDuplicates(["_row"]).select("_label", F.lit(gold).alias("model"), F.col("_truth").alias("_pred"))
    every = both.select("_label", "model", "_pred").unionByName(truths)
    return scores(every, "_label", "_pred", ("model",)).select("model", "n", "accuracy", "macro_f1")


def robustness(df: DataFrame, truth: str, preds: Sequence[str], row: str, rater: DataFrame, label: str, reference: str, gold: str = "gold", resamples: int = 2000, seed: int = 42) -> DataFrame:
    """model, is_reference, macro_f1, ci95_low, ci95_high, rater_n, rater_accuracy, rater_macro_f1 of df's columns preds.

    Each model against the truth, with the interval of bootstrap_f1, and against rater(row, label). A row named by gold
    compares the truth itself with the rater; it is a reference and has no score and no interval.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("_p")) for p in preds]))
    long = df.select(row, F.col(truth).alias("_truth"), pairs.alias("_m")).select(row, "_truth", "_m.model", "_m._p")
    own = scores(long, "_truth", "_p", ("model",)).select("model", "macro_f1")
    interval = bootstrap_f1(df, truth, preds, resamples, seed)
    second = second_rater_scores(long, rater, row, "_truth", "model", "_p", label, gold)
    second = second.select("model", F.col("n").alias("rater_n"), F.col("accuracy").alias("rater_accuracy"), F.col("macro_f1").alias("rater_macro_f1"))
    out = second.join(own, "model", "full").join(interval, "model", "left")
    return out.select("model", F.col("model").isin(reference, gold).alias("is_reference"), "macro_f1", "ci95_low", "ci95_high", "rater_n", "rater_accuracy", "rater_macro_f1")


def beside(val: DataFrame, test: DataFrame, truth: str, pred: str, model: str) -> DataFrame:
    """model, val_macro_f1, test_macro_f1, test_accuracy: what models reach on two sets; null where one lacks a model."""
    v = scores(val, truth, pred, (model,)).select(F.col(model), F.col("macro_f1").alias("val_macro_f1"))
    t = scores(test, truth, pred, (model,)).select(F.col(model), F.col("macro_f1").alias("test_macro_f1"), F.col("accuracy").alias("test_accuracy"))
    return v.join(t, model, "full")


def confusion_rates(df: DataFrame, truth: str, pred: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """t, p, n, rate of each pair of labels; rate is of the row, 0 for an empty row."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "t string, p string")
    found = cells(df, truth, pred).select(F.col("t").alias("t2"), F.col("p").alias("p2"), "n")
    full = grid.join(found, (F.col("t") == F.col("t2")) & (F.col("p") == F.col("p2")), "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))
    rows = full.groupBy(F.col("t").alias("r")).agg(F.sum("n").alias("total"))
    return full.join(rows, F.col("t") == F.col("r")).select("t", "p", "n", F.round(F.col("n") / F.greatest("total", F.lit(1)), 4).alias("rate"))


def bootstrap_f1(df: DataFrame, truth: str, preds: Sequence[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """model, ci95_low, ci95_high: percentiles of macro-F1 over paired resamples of df's rows, with replacement.

    Rows with the same truth and predictions are alike, so a resample is the number of rows of each of these kinds:
    multinomial, as drawing row after row makes them. That costs the same at any number of rows; resample b is drawn by
    numpy's generator of (seed, b) from the kinds in the order of their labels.
    """
    kinds = df.groupBy(F.col(truth).alias("_t"), *preds).agg(F.count(F.lit(1)).alias("n"))
    return _percentiles(resampled_counts(kinds, resamples, seed), preds)


#: Rows whose kind is broadcast to the draws, a number each; of more rows the draws are shuffled.
DRAW_ROWS = 1 << 21


def bootstrap_rows(df: DataFrame, row: str, truth: str, preds: Sequence[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """bootstrap_f1 by row numbers: every row of every resample is drawn, by a hash that SQL has too.

    df's rows are numbered 0 .. n - 1 by `row`. resamples times n draws are counted where they are made: by resample and kind
    of row (its truth and predictions).
    """
    from .sampling import bootstrap_slots

    kinds = written(df.select(F.col(truth).alias("_t"), *preds).distinct().withColumn("_kind", F.monotonically_increasing_id()), "kinds")  # a row for each combination of labels
    same = F.col(truth).eqNullSafe(F.col("_t"))
    for p in preds:
        same = same & F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    named = kinds.select("_t", "_kind", *[F.col(p).alias(f"_p_{p}") for p in preds])
    known = written(df.join(F.broadcast(named), same).select(F.col(row).alias("_row"), "_kind"), "rows")
    n = known.count()
    draws = bootstrap_slots(df.sparkSession, n, resamples, seed)
    known = F.broadcast(known) if n <= DRAW_ROWS else known.hint("shuffle_hash")
    drawn = draws.join(known, F.col("row") == F.col("_row")).groupBy("b", "_kind").agg(F.count(F.lit(1)).alias("n"))
    return _percentiles(drawn.join(F.broadcast(kinds), "_kind").select("b", "_t", *preds, "n"), preds)


def resampled_counts(kinds: DataFrame, resamples: int, seed: int) -> DataFrame:
    """b and the columns of kinds, whose n becomes the count that resample b draws: a row for each b and kind drawn.

    The driver gets kinds, a row for each combination of labels.
    """
    labels = [c for c in kinds.columns if c != "n"]
    rows = kinds.orderBy(*labels).toPandas()
    total = int(rows["n"].sum())
    share = rows["n"].to_numpy() / max(total, 1)

    def draw(batches):
        for batch in batches:
            for b in batch["b"]:
                drawn = rows.assign(b=b, n=np.random.default_rng([seed, int(b)]).multinomial(total, share))
                yield drawn[drawn["n"] > 0][["b", *rows.columns]]

    schema = "b long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema)
    return kinds.sparkSession.range(resamples).withColumnRenamed("id", "b").mapInPandas(draw, schema)


def _percentiles(counts: DataFrame, preds: Sequence[str]) -> DataFrame:
    """model, ci95_low, ci95_high from counts(b, _t, preds, n)."""
    stack = F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("p")) for p in preds]))
    long = counts.select("b", F.col("_t").alias("t"), "n", stack.alias("m")).select("b", "m.model", "t", "m.p", "n")
    f1 = class_report(long, ("b", "model")).groupBy("b", "model").agg(F.avg("f1").alias("f1"))
    low, high = (F.round(F.percentile("f1", F.lit(q)), 4) for q in (0.025, 0.975))
    return f1.groupBy("model").agg(low.alias("ci95_low"), high.alias("ci95_high"))


def accuracy_by_star(df: DataFrame, truth: str, pred: str, star: str = "star") -> DataFrame:
    """star 1 to 5 and accuracy, null for a star without rows."""
    stars = df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star"))
    found = df.groupBy(F.col(star).cast("int").alias("_s")).agg(F.round(F.avg((F.col(truth) == F.col(pred)).cast("double")), 4).alias("accuracy"))
    return stars.join(found, F.col("star") == F.col("_s"), "left").select("star", "accuracy")


def seed_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, std (sample; null for one) over seeds."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"))


def seed_epochs(df: DataFrame, seed: str, epoch: str, value: str, at: int = 3) -> DataFrame:
    """seed, value_at, best, best_epoch: each seed's value at one epoch (null if it has none), its best and the first epoch of it."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e")))
    by_seed = df.where(F.col(value).isNotNull()).groupBy(seed).agg(F.max(F.when(F.col(epoch) == at, F.col(value))).alias("value_at"), best.alias("b"))
    return by_seed.select(seed, "value_at", F.col("b.v").alias("best"), (-F.col("b.e")).alias("best_epoch"))


def error_samples(df: DataFrame, row: str, truth: str, first: str, second: str, k: int = 15, seed: int = 42) -> DataFrame:
    """model, row, truth, pred, other_pred, both_wrong: k errors of each model, the second's without the first's rows."""
    from .sampling import sample_rows

    def wrong(model: str, other: str) -> DataFrame:
        w = df.where(F.col(truth) != F.col(model))
        return w.select(F.lit(model).alias("model"), row, truth, F.col(model).alias("pred"), F.col(other).alias("other_pred"), (F.col(truth) != F.col(other)).alias("both_wrong"))

    a = sample_rows(wrong(first, second), k, row, seed)
    b = sample_rows(wrong(second, first).join(a.select(row), row, "left_anti"), k, row, seed)
    return a.unionByName(b)


def wide_predictions(df: DataFrame, row: str, truth: str, model: str, pred: str, models: Sequence[str], names: Sequence[str]) -> DataFrame:
    """row, truth and a pred_<name> column for each model."""
    wide = df.groupBy(row, truth).pivot(model, list(models)).agg(F.first(pred))
    return wide.select(row, truth, *[F.col(f"`{m}`").alias(f"pred_{n}") for m, n in zip(models, names, strict=True)])
