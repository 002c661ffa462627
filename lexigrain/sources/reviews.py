"""Labelled reviews from a document table and its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_id, star_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews_view(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, review_id, product_id, category, star, label_star, text, label (null where nobody labelled)."""
    marks = labels.select(F.col("doc_id").alias("_l"), "quality", "toxic")
    star = ((F.col("doc_id") * 7 + 3) % 5 + 1).cast("int")
    label = F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Neutral")
    joined = documents.join(marks, F.col("doc_id") == F.col("_l"), "left")
    return joined.select(
        F.col("doc_id").alias("row_id"), content_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("review_id"), F.col("source").alias("product_id"),
        F.col("lang").alias("category"), star.alias("star"), star_label(star).alias("label_star"), "text", label.alias("label"),
    )


def load_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_view(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
