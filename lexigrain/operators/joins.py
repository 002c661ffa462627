"""Joins that check what they assume, set comparisons, status columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique(df: DataFrame, key: str) -> DataFrame:
    """df; a key that occurs twice (nulls aside) is an error when the result is read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bad = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string"))).cast("boolean")
    return df.withColumn("_ok", F.when(F.col(key).isNull() | (n == 1), F.lit(True)).otherwise(bad)).where("_ok").drop("_ok")


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on a key that must be unique on both sides; the other columns' names must differ."""
    return unique(left, key).join(unique(right, key), key, how)


def complete_lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """keys with the table's columns; a key that the table lacks is an error when the result is read."""
    marked = table.withColumn("_hit", F.lit(True))
    bad = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.col(key).cast("string"))).cast("boolean")
    return keys.join(marked, key, "left").where(F.when(F.col("_hit"), F.lit(True)).otherwise(bad)).drop("_hit")


def without(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the used ones; a null key stays."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def members(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the allowed ones; a null key isn't."""
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def looked_up(df: DataFrame, **values) -> DataFrame:
    """Rows with the given values, which reach the plan as literals; None asks for null."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All rows of all parts, with the part's name."""
    out = None
    for name, part in parts.items():
        one = part.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of both, only of a, only of b."""
    keys = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return keys.agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def product_status(n: Column, least: int = 30) -> Column:
    """ok, or few:<n> for a product with too few reviews."""
    return F.when(n >= least, "ok").otherwise(F.concat(F.lit("few:"), n.cast("string")))


def unseen(rows: DataFrame, seen: DataFrame, asked_star: str = "asked", keys: tuple[str, ...] = ("product_id", "rid")) -> DataFrame:
    """Rows of the star that was asked for, with a text, each key once (the first by page and item) and not seen before."""
    good = rows.where((F.col("star") == F.col(asked_star)) & (F.coalesce("text", F.lit("")) != ""))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("page", "item"))
    return good.withColumn("_n", first).where("_n = 1").drop("_n").join(seen.select(*keys).distinct(), list(keys), "left_anti")
