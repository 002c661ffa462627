"""Ordered picks: candidate order, round robin, page caps, arg-max, running remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a number from 1 in the given order (ascending, nulls first), without one task that sorts all rows.

    A row's number is its place in its range partition plus the rows of the ranges before. The order should be unique:
    rows that tie may change places between runs.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # written, since ranges drawn anew for a second use need not be the same
    local = written(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranges")
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    so_far = F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(so_far, F.lit(0)).alias("_b"))  # a row for each partition
    out = local.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return out.withColumn(name, (F.col("_n") + F.col("_b")).cast("long")).drop("_part", "_n", "_p", "_b")


def candidate_order(df: DataFrame, by: str = "category", url: str = "url", vote: str = "vote", sold: str = "sold", low: float = 4.5, least: int = 3) -> DataFrame:
    """df with pick and place: products of low votes take turns with best-sellers in each category.

    With fewer than `least` low votes the lowest of the other rated ones fill up (low_rank). All others, unrated ones
    too, are best-sellers by what they sold. Ties go by url.
    """
    down = F.desc(sold)
    is_low = F.coalesce(F.col(vote) < low, F.lit(False))
    n_low = F.sum(is_low.cast("int")).over(Window.partitionBy(by))
    rated_rest = F.col(vote).isNotNull() & ~is_low
    fill = F.row_number().over(Window.partitionBy(by, rated_rest).orderBy(vote, down, url))
    ranked = df.withColumn("_low", is_low).withColumn("_fill", rated_rest & (fill <= F.lit(least) - n_low))
    pick = F.when(F.col("_low"), "low_vote").when(F.col("_fill"), "low_rank").otherwise("top_sold")
    out = ranked.withColumn("pick", pick).withColumn("_side", (pick == "top_sold").cast("int"))
    first = [F.when(F.col("pick") == "low_rank", 1).otherwise(0), F.when(F.col("pick") == "low_rank", F.col(vote)), down, F.col(url)]
    turn = F.row_number().over(Window.partitionBy(by, "_side").orderBy(*first))
    out = out.withColumn("_turn", turn)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_turn", "_side"))).drop("_low", "_fill", "_side", "_turn")


def round_robin(df: DataFrame, by: str, by_order: str, place: str = "place", key: str = "url") -> DataFrame:
    """df with turn: first places of all categories, then second ones, ...; a key seen before is left out."""
    once = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(place, by_order))).where("_n = 1").drop("_n")
    return numbered(once, "turn", place, by_order)


def page_caps(df: DataFrame, cap: int, product_cap: int = 300) -> DataFrame:
    """Rows (product_id, star, page, item) up to the page in which a product's star reaches the cap, then product_cap.

    The page in which the cap is reached counts whole. crawled is the number per product and star before the product's
    cap cuts.
    """
    star = Window.partitionBy("product_id", "star")
    upto = F.count(F.lit(1)).over(star.orderBy("page"))
    here = F.count(F.lit(1)).over(Window.partitionBy("product_id", "star", "page"))
    got = df.withColumn("_before", upto - here).where(F.col("_before") < cap).drop("_before")
    got = got.withColumn("crawled", F.count(F.lit(1)).over(star))
    return got.withColumn("_n", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("star"), "page", "item"))).where(F.col("_n") <= product_cap).drop("_n")


def best_rows(df: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score in each group; of equal ones the first in order."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_rows(df: DataFrame, order: str, k: int = 100) -> DataFrame:
    """The k first rows in order: what a second rater labels too."""
    return df.orderBy(order).limit(k)


def top_per_group(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def strided(df: DataFrame, order: str, picks: int = 8) -> DataFrame:
    """About `picks` rows at equal distances: every max(1, n / picks)-th, the first `picks` of them."""
    n = df.agg(F.greatest(F.floor(F.count(F.lit(1)) / picks), F.lit(1)).alias("_k"))
    placed = numbered(df, "_i", order).crossJoin(F.broadcast(n)).withColumn("_i", F.col("_i") - 1)
    return placed.where((F.col("_i") % F.col("_k") == 0) & (F.col("_i") / F.col("_k") < picks)).drop("_i", "_k")
