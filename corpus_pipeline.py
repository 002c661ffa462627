"""A corpus pipeline in five stages: quality rules, line de-duplication, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import bpe, jaccard, linededup, mixing, quality
from lexigrain.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules nor their host's verdict reject; each row is judged, repeated ones alike."""
    return quality.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the text."""
    slim = docs.select(*COLUMNS)
    kept = linededup.apply_bitmaps(slim, linededup.drop_bitmaps(slim))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest doc_id, once. Rows without an id stay.

    Rows that share a doc_id are one document; of equal ones among them one stays, which one makes no difference.
    """
    found = written(jaccard.near_duplicates(docs), "near")
    keep = written(found.where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")), "keep")
    once = docs.select(*COLUMNS).hint("merge").join(keep, F.col("doc_id") == F.col("_id"), "left_semi")
    if not keep.where("_n > 1").isEmpty():
        once = once.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)
    return once.unionByName(docs.select(*COLUMNS).where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of rows equal in doc_id, source and text one comes for all."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes of each row; repeated rows give repeated rows."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.DEFAULT_RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: SQL has no byte-level BPE; tests/llm/test_pipeline.py holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k + 1}")
    return docs
