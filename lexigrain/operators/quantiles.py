"""Exact percentiles by rounds of histograms: no buffer and no task holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Buckets of a round; the largest double, for infinite values.
BUCKETS, LARGEST = 1024, 1.7976931348623157e308


def order_statistics(df: DataFrame, by: str, value: str, ranks: DataFrame) -> DataFrame:
    """by, k, v: the k-th smallest value (from 0) of each group, for ranks(by, k, lo, hi) with the group's range.

    Each round counts the values between a rank's bounds in equal buckets, all groups and ranks together, and narrows the
    bounds to the smallest and largest value of the bucket that holds the rank, until they are equal. Counts are summed
    before the shuffle, so a task holds at most BUCKETS counts for each rank. df is read once a round: pass a table.
    """
    closed, left = [], written(ranks.withColumn("below", F.lit(0).cast("long")), "ranks")
    while True:
        closed.append(left.where("lo = hi").select(by, "k", F.col("lo").alias("v")))
        left = left.where("lo < hi")
        if left.isEmpty():
            break
        mine = left.select(F.col(by).alias("_by"), "k", "lo", "hi", "below")
        met = df.select(by, F.col(value).alias("_v")).join(mine, F.col(by).eqNullSafe(F.col("_by")) & F.col("_v").between(F.col("lo"), F.col("hi")))
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as the range may be more than a double holds
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        counts = met.groupBy("_by", "k", "below", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy("_by", "k").orderBy("bucket"))  # over the buckets
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
        left = written(found.select(F.col("_by").alias(by), "k", "lo", "hi", (F.col("upto") - F.col("c")).alias("below")), "ranks")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def exact_percentiles(df: DataFrame, by: str, value: str | Column, qs: Sequence[float]) -> DataFrame:
    """by and an array q of the percentiles qs of each group, interpolated between neighbours as at place q (n - 1).

    Null and not-a-number values don't count; a group without others has nulls; null is a group of its own. Infinite
    values count as the largest doubles. Equal to percentile(), whose buffer holds every different value of a group.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    finite = F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)))
    slim = written(df.select(F.col(by).alias("g"), finite.alias("v")), "values")
    known = slim.where("v IS NOT NULL")
    groups = written(known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("p")) for i, q in enumerate(qs)]))
    places = groups.select("g", "lo", "hi", place.alias("s")).select("g", "lo", "hi", "s.i", F.floor("s.p").alias("k"), F.ceil("s.p").alias("k2"), (F.col("s.p") - F.floor("s.p")).alias("part"))
    ranks = places.select("g", F.explode(F.array("k", "k2")).alias("k"), "lo", "hi").distinct()
    at = written(order_statistics(known, "g", "v", ranks), "found")
    first, second = (at.select(F.col("g").alias(f"g{j}"), F.col("k").alias(f"k{j}_"), F.col("v").alias(f"v{j}")) for j in (1, 2))
    both = places.join(first, F.col("g").eqNullSafe(F.col("g1")) & (F.col("k") == F.col("k1_"))).join(second, F.col("g").eqNullSafe(F.col("g2")) & (F.col("k2") == F.col("k2_")))
    each = both.select("g", "i", F.when(F.col("part") == 0, F.col("v1")).otherwise(F.col("v1") * (1 - F.col("part")) + F.col("v2") * F.col("part")).alias("q"))
    found = each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    every = slim.groupBy(F.col("g").alias("_g")).agg(F.lit(1).alias("one"))
    return every.join(found, F.col("_g").eqNullSafe(F.col("g")), "left").select(F.col("_g").alias(by), F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), len(qs))).alias("q"))
