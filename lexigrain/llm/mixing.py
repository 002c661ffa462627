"""Mixing sources to target weights by Pareto order sampling. Only DataFrame functions.

Targets come from one row for each source. A source's whole copies are certain; what is left of its target is a
fixed-size Pareto sample with unequal probabilities. A document's inclusion probability is proportional to its words and
such that the expected words are what is left; documents that it would make certain are taken out first. The others are
taken in the order of random odds over inclusion odds, up to the document whose middle reaches the rest. The cut is found
on summed buckets of the order and then, in a single bucket of 4096, exactly, so no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, n_words, written

BUCKETS = 4096


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) with 52 bits, the same in every run, from the md5 of seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n (documents), target: one row for each source, null included.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; no target is above
    `most` times its source's size, and what is above goes to the others by weight. Water level: sources in the order
    of limit over weight are full as long as their limit is under the level of those that follow. Windows without a
    partition run over the sources' rows only.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighted = totals.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), nth % len(weights))).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.sum("source_size").over(every) * share
    level = (asked - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = weighted.select("source", "source_size", "n", "w", "cap", asked.alias("asked"), (F.col("cap") / F.col("w") <= level).alias("full"))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    rest = F.col("asked") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    return full.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.try_divide(rest, open_w)).cast("double").alias("target"))


def inclusion(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, scale, top, sure: how the documents of each source of goals(source, rest) are included.

    A document of `size` words is included with probability scale * size, so that the expected words are `rest`. Those
    above `top` words would have a probability of 1 or more: they are certain, `sure` words in all, and taken out first.
    The sums are over the different sizes of a source, of which there are never more than its longest document has words;
    they are exact integers, so every run finds the same numbers.
    """
    exact = F.col("size").cast("decimal(19,0)")
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("words"))
    before = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("words") * exact
    rest = F.sum(square).over(Window.partitionBy("source")) - F.coalesce(F.sum(square).over(before), F.lit(0))  # a frame to the end would be quadratic
    sums = by_size.select(F.col("source").alias("_s"), "size", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("double").alias("sure"), rest.cast("double").alias("squares"))
    scaled = sums.join(goals.select("source", "rest"), F.col("_s").eqNullSafe(F.col("source"))).withColumn("scale", (F.col("rest") - F.col("sure")) / F.col("squares"))
    fits = scaled.where("rest > 0 AND scale * size < 1").groupBy("source").agg(F.max(F.struct(F.col("size").alias("top"), "scale", "sure")).alias("m"))
    return fits.select("source", "m.scale", "m.top", "m.sure")


def _rank(u: Column, pi: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u / (1 - u)) / (pi / (1 - pi))


def _bucket(q: Column) -> Column:
    """A number below BUCKETS in the order of q; where the sample ends, near odds of 1, buckets are even."""
    return F.least(F.floor(q / (1 + q) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def mixing_plan(sizes: DataFrame, **targets) -> DataFrame:
    """source, source_size, target, n, certain (whole copies), scale, top, whole and cut (where the sample ends, or null).

    sizes has doc_id, source, size, u. A document above `top` words gets one more copy for certain; another belongs to
    the sample of its source if its bucket is not above `whole` or (q, doc_id, size) not above `cut`, so that the
    decision joins documents with sources, never with documents.
    """
    goals = source_targets(sizes, **targets)
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    goals = goals.select("source", "source_size", "n", "target", F.floor(ratio).cast("long").alias("certain"), (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("rest"))
    scales = inclusion(sizes, goals).select(F.col("source").alias("_i"), "scale", "top", "sure")
    goals = goals.join(scales, F.col("source").eqNullSafe(F.col("_i")), "left")
    goals = written(goals.select("source", "source_size", "target", "n", "certain", "scale", "top", (F.col("rest") - F.col("sure")).alias("rest")), "goals")
    slim = written(goals.where("scale IS NOT NULL").select(F.col("source").alias("_s"), "n", "scale", "top", "rest"), "scales")
    open_ = join_hot(sizes.where("size > 0"), slim, "source", "_s", "n", "scales").where("size <= top").withColumn("q", _rank(F.col("u"), F.col("scale") * F.col("size")))
    open_ = open_.select("source", "doc_id", "size", "n", "rest", "q", _bucket(F.col("q")).alias("bucket"))
    sums = open_.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("n").alias("n"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    edges = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (upto - F.col("words")).alias("before"), upto.alias("upto"), F.col("rest").alias("_rest"), F.col("n").alias("_n"))
    edges = written(edges, "edges")
    whole = edges.where("upto <= _rest").groupBy("_s").agg(F.max("_b").alias("whole"))
    partly = edges.where("before <= _rest AND upto > _rest").select("_s", "_b", "before", "_n")
    near = join_hot(open_, partly, "source", "_s", "_n", "partly").where("bucket = _b")
    key = F.struct("q", "doc_id", "size")
    run = F.sum("size").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    taken = near.select("source", key.alias("key"), (F.col("before") + run - F.col("size") / 2 <= F.col("rest")).alias("ok"))
    cut = taken.where("ok").groupBy("source").agg(F.max("key").alias("cut"))
    out = goals.join(whole.select(F.col("_s").alias("_w"), "whole"), F.col("source").eqNullSafe(F.col("_w")), "left")
    out = out.join(cut.select(F.col("source").alias("_c"), "cut"), F.col("source").eqNullSafe(F.col("_c")), "left")
    return out.select("source", "source_size", "target", "n", "certain", "scale", "top", "whole", "cut")


#: Numbers of one block of equal rows.
NUMBERED = 4096


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest (md5 of the text), size (words; 0 for null text), n: written, a row for all that are equal."""
    slim = docs.select("doc_id", "source", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), n_words(F.col("text")).alias("size"))
    return written(slim.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")


def draws(sizes: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, digest, size, u: a row for each document of document_sizes(), equal ones with draws of their own.

    Equal rows are numbered by counting, those of many in blocks that are dealt out, so no task makes all of them.
    """
    few, many = sizes.where(F.col("n") <= NUMBERED), sizes.where(F.col("n") > NUMBERED)
    first = many.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / NUMBERED)))).repartition("doc_id", "source", "digest", "_b")
    at = first.withColumn("_from", F.col("_b") * NUMBERED)
    each = [
        few.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))),
        at.withColumn("nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + NUMBERED, F.col("n")) - 1))),
    ]
    both = each[0].select("doc_id", "source", "digest", "size", "nth").unionByName(each[1].select("doc_id", "source", "digest", "size", "nth"))
    return both.withColumn("u", uniform(seed, "doc_id", "source", "digest", "nth")).drop("nth")


def copies(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """sizes with source_size, target, copies: how often the mix takes each document."""
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "n", "certain", "scale", "top", "whole", "cut")
    joined = join_hot(sizes, p, "source", "_s", "n", "plan")
    q = _rank(F.col("u"), F.col("scale") * F.col("size"))
    sample = F.when((F.col("size") > 0) & (F.col("size") <= F.col("top")), (_bucket(q) <= F.col("whole")) | F.coalesce(F.struct(q.alias("q"), "doc_id", "size") <= F.col("cut"), F.lit(False)))
    drawn = F.coalesce(F.col("size") > F.col("top"), F.lit(False)) | F.coalesce(sample, F.lit(False))
    return joined.select(*sizes.columns, "source_size", "target", (F.col("certain") + drawn.cast("long")).alias("copies"))


def mix(docs: DataFrame, seed: int = 17, **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for docs(doc_id, text, source): a row for each input row.

    Null source is a source of its own; null text has size 0 and adds nothing. The draw is a hash of doc_id, source and
    text; rows without or with repeated ids have draws by their text, and rows equal in all three are numbered, each with
    a draw of its own. The same input and seed give the same mix. An empty table gives no rows.
    """
    drawn = written(draws(document_sizes(docs), seed), "draws")
    return copies(drawn, mixing_plan(drawn, **targets)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, seed: int = 17, **targets) -> DataFrame:
    """The rows of docs as often as mix() takes them, with their columns. Texts are read twice and not shuffled.

    Of rows that are equal in doc_id, source and text, one stands for all: it comes as often as they do together.
    """
    sizes = document_sizes(docs)
    drawn = written(draws(sizes, seed), "draws")
    plan = mixing_plan(drawn, **targets)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    whole = docs.select("doc_id", "source", digest.alias("digest"), n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("_row"))  # no column can clash
    several = sizes.where("n > 1")
    once = whole
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "source", "digest")]).cast("binary"))
    taken = []
    if not several.isEmpty():
        equal = written(several.select(key.alias("_key"), F.col("n").alias("_n")), "equal")
        together = copies(drawn, plan).withColumn("_key", key).groupBy("_key").agg(F.sum("copies").alias("copies"))
        marked = join_hot(whole.withColumn("_own", key), equal, "_own", "_key", "_n", "equal", "left")
        once = marked.where("_n IS NULL").select(*whole.columns)
        group = marked.where("_n IS NOT NULL").groupBy("_own").agg(F.first("_row").alias("_row"))
        taken.append(group.join(together, F.col("_own") == F.col("_key")).select("_row", "copies"))
    once = once.withColumn("nth", F.lit(0)).withColumn("u", uniform(seed, "doc_id", "source", "digest", "nth"))
    every = copies(once, plan).select("_row", "copies")
    for t in taken:
        every = every.unionByName(t)
    return every.where("copies > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
