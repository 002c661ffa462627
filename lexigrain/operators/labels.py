"""Label batches: validation, merging, adjudication, agreement, noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LABELS, label_origin, numbered_id, parsed_confidence, parsed_label
from .ranking import numbered


def batches(df: DataFrame, order: str, size: int = 50, prefix: str = "P", width: int = 4) -> DataFrame:
    """df with id and batch: numbered in order, `size` rows to a batch."""
    n = F.col("_number")
    out = numbered(df, "_number", order).withColumn("id", numbered_id(prefix, width, n))
    return out.withColumn("batch", (F.floor((n - 1) / size) + 1).cast("int")).drop("_number")


def batch_problems(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """problem, n: bad labels, bad confidences, missing, extra and repeated ids of answers(id, label_llm, confidence)."""
    ids = answers.select("id")
    checks = {
        "bad_label": answers.where(~F.coalesce(F.lower(F.trim("label_llm")).isin("pos", "positive", "neu", "neutral", "neg", "negative"), F.lit(False))),
        "bad_confidence": answers.where(~F.coalesce(parsed_confidence(F.col("confidence")).isin("high", "low"), F.lit(False))),
        "missing_id": expected.select("id").join(ids, "id", "left_anti"),
        "extra_id": ids.join(expected.select("id"), "id", "left_anti"),
        "repeated_id": ids.groupBy("id").count().where("count > 1"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def merge_answers(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """expected joined with parsed answers; any problem of batch_problems is an error when the result is read."""
    total = batch_problems(expected, answers).agg(F.sum("n").alias("_problems"))
    parsed = answers.select("id", parsed_label(F.col("label_llm")).alias("label_llm"), parsed_confidence(F.col("confidence")).alias("confidence"), "reason")
    joined = expected.join(parsed, "id").crossJoin(F.broadcast(total))
    ok = F.when(F.col("_problems") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("the answers have problems")).cast("boolean"))
    return joined.where(ok).drop("_problems")


def review_flag(label: str = "label_llm", star_label: str = "label_star", confidence: str = "confidence") -> Column:
    """Whether a person should look: the labels differ or the confidence is low."""
    return (F.col(label) != F.col(star_label)) | (F.col(confidence) == "low")


def adjudicate(gold: DataFrame, llm: DataFrame, reviewed: DataFrame, second: DataFrame) -> DataFrame:
    """gold(gold_id, ...) with label_llm, confidence, reason, label_human, label_human_2, label and label_source.

    label is the person's where there is one. reviewed has id, label_human and perhaps nguon_nhan; second has id and
    label_human_2.
    """
    if "nguon_nhan" not in reviewed.columns:
        reviewed = reviewed.withColumn("nguon_nhan", F.lit("nguoi"))
    r = reviewed.select(F.col("id").alias("_r"), parsed_label(F.col("label_human")).alias("label_human"), "nguon_nhan")
    s = second.select(F.col("id").alias("_s"), parsed_label(F.col("label_human_2")).alias("label_human_2"))
    m = llm.select(F.col("id").alias("_m"), "label_llm", "confidence", "reason")
    out = gold.join(m, F.col("gold_id") == F.col("_m")).join(r, F.col("gold_id") == F.col("_r"), "left").join(s, F.col("gold_id") == F.col("_s"), "left")
    label = F.coalesce("label_human", "label_llm")
    return out.withColumn("label", label).withColumn("label_source", label_origin(F.col("nguon_nhan"))).drop("_m", "_r", "_s", "nguon_nhan")


def unfilled(reviewed: DataFrame, column: str) -> DataFrame:
    """Rows whose label nobody filled in."""
    return reviewed.where(parsed_label(F.col(column)).isNull())


def confusion(df: DataFrame, rows: str, cols: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """rows and a count for each label, 0 where none."""
    return df.groupBy(rows).pivot(cols, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))


def noise_by_star(df: DataFrame, star: str = "star", label: str = "label", star_label: str = "label_star") -> DataFrame:
    """star, a count for each label, n, pct_differs: how often the label isn't the star's."""
    n = lambda x: F.count_if(F.col(label) == x).alias(x)
    differs = F.avg((F.col(label) != F.col(star_label)).cast("double"))
    return df.where(F.col(label).isNotNull()).groupBy(star).agg(*[n(x) for x in LABELS], F.count(F.lit(1)).alias("n"), F.round(100 * differs, 1).alias("pct_differs"))


def with_margins(df: DataFrame, rows: str, cols: str, labels: Sequence[str] = LABELS, total: str = "Total") -> DataFrame:
    """Counts of rows by cols with a total row and column."""
    counts = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull()).cube(rows, cols).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name = lambda c, bit: F.when(F.col("g").bitwiseAND(bit) > 0, total).otherwise(F.col(c))
    named = counts.select(name(rows, 2).alias(rows), name(cols, 1).alias(cols), "n")
    return named.groupBy(rows).pivot(cols, [*labels, total]).agg(F.sum("n")).na.fill(0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, raw, kappa of two raters on the rows that both labelled; kappa is null if chance agrees always."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    pa = cells.groupBy("a").agg(F.sum("n").alias("na"))
    pb = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = pa.join(pb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("ab"))
    po, pe = F.col("same") / F.col("total"), F.col("ab") / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), F.round(po, 4).alias("raw"), F.round(F.try_divide(po - pe, 1 - pe), 4).alias("kappa"))


def agreement_summary(gold: DataFrame) -> DataFrame:
    """One row: n, counts by label source, how many reviewed labels a person changed and their share (null: none reviewed)."""
    human = F.col("label_human").isNotNull()
    changed = human & (F.col("label_human") != F.col("label_llm"))
    return gold.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label_source") == s).alias(f"n_{s}") for s in ("human", "llm_accepted", "llm")],
        F.count_if(human).alias("n_reviewed"), F.count_if(changed).alias("n_changed"), F.round(F.try_divide(F.count_if(changed), F.count_if(human)), 4).alias("changed_rate"),
    )
