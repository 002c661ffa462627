"""Line de-duplication across documents, returned as per-document bitmaps instead of text.

Hashes of long lines are written once. They are uniform, so equal ranges of them are equal partitions and nothing is
sampled; within a range lines are sorted by key, document and position, and a pass in this order tells each key's first
(largest) document and how many hold it. Keys with too many lines for a task are found from a histogram of the hashes'
top bits; their documents are counted by an aggregation and their lines decided by a broadcast, never sorted. What comes
out is a compressed bitmap of kept lines for each document that loses some. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import WHITE, ascii_lower, let, written

#: Lines from which a key is hot, unless a greater share of all lines is needed to bound the number of hot keys.
HOT_LINES = 2_000
#: Lines of a range, about 40 bytes each.
RANGE_LINES = 4_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (128 bits of the key), doc_id, body, pos of each line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    bare = lines.select("doc_id", "body", "pos", F.btrim("line", F.lit(WHITE)).alias("bare")).where(F.length("bare") >= min_chars)
    keys = bare.select("doc_id", "body", "pos", ascii_lower(F.col("bare")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "body", "pos")


def hot_keys(lines: DataFrame, top: DataFrame, limit: int) -> DataFrame:
    """k1, k2, n_docs, first_doc of the keys with more than `limit` lines: fewer than the lines over `limit`.

    top counts lines by the top 16 bits of h1. Only buckets with half of `limit` more than the average are looked at; a
    hot key that hides in another is sorted with the rest.
    """
    average = top.agg(F.avg("n").alias("average"))
    full = top.crossJoin(F.broadcast(average)).where(F.col("n") > F.col("average") + limit / 2).select("top")
    near = lines.join(F.broadcast(full), F.shiftrightunsigned("h1", 48) == F.col("top"), "left_semi")  # 65,536 rows at most
    once = near.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    found = once.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("first_doc"), F.sum("n").alias("n"))
    return found.where(F.col("n") > limit).drop("n")


def sorted_runs(lines: DataFrame, ranges: int) -> DataFrame:
    """lines with part, in `ranges` partitions by equal ranges of h1, sorted by key, document (largest first) and position."""
    part = F.shiftrightunsigned(F.shiftrightunsigned("h1", 33) * ranges, 31).cast("int")
    order = ("part", "h1", "h2", F.desc_nulls_last("doc_id"), "body", "pos")
    return lines.withColumn("part", part).repartitionById(ranges, "part").sortWithinPartitions(*order)


def streamed(runs: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, body, pos of the lines that go, from one pass over sorted runs: no exchange and no sort of its own."""
    order = Window.partitionBy("part", "h1", "h2").orderBy(F.desc_nulls_last("doc_id"))
    seen = runs.withColumn("nth", F.dense_rank().over(order)).withColumn("n_docs", F.max("nth").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return seen.where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)).select("doc_id", "body", "pos")


def run_ends(dropped: Column) -> Column:
    """The keep bitmap with these places (sorted, each once) dropped, as the ends of its runs: kept, dropped, kept, ..."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    lasts = F.filter(dropped, lambda x, i: F.coalesce(F.get(dropped, i + 1) != x + 1, F.lit(True)))
    return F.flatten(F.zip_with(starts, lasts, lambda a, z: F.array(a, z + 1)))


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, body (hash of the text), n_dropped, keep: one row for each document that loses lines.

    keep is the bitmap of kept lines, run-length coded: lines before keep[0] stay, those from keep[0] to before keep[1]
    go, and so on in turn; lines from the last end on stay. A key of at least min_chars code points found in at least
    min_docs documents loses all its lines except in the largest doc_id that holds it, where all stay. A null doc_id
    counts as one document, below all others; rows with one doc_id are one document. Equal rows share a bitmap. Empty
    tables give no row.
    """
    lines = written(hashed_lines(docs, min_chars), "lines")
    top = lines.groupBy(F.shiftrightunsigned("h1", 48).alias("top")).agg(F.count(F.lit(1)).alias("n"))
    top = written(top, "histogram")
    total, most = top.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(HOT_LINES, total // max(1, common.BROADCAST_ROWS))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_LINES))
    if most <= limit:
        gone = streamed(sorted_runs(lines, ranges), min_docs)
    else:
        hot = F.broadcast(written(hot_keys(lines, top, limit), "hot"))  # limit bounds its rows
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
        cold = lines.join(hot, same, "left_anti")
        often = lines.join(hot, same).where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        gone = streamed(sorted_runs(cold, ranges), min_docs).unionByName(often.select("doc_id", "body", "pos"))
    by_doc = gone.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return by_doc.select("doc_id", "body", F.size("dropped").cast("long").alias("n_dropped"), let(F.col("dropped"), run_ends).alias("keep"))


def kept_lines(text: Column, keep: Column) -> Column:
    """The text without the lines that a keep bitmap drops."""

    def joined(lines: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(keep), 1)),
            lambda k: let(
                F.coalesce(F.get(keep, 2 * k - 1), F.lit(0)),
                lambda a: F.slice(lines, a + 1, F.coalesce(F.get(keep, 2 * k), F.size(lines)) - a),
            ),
        )
        return F.array_join(F.flatten(runs), "\n")

    return let(_lines(text), joined)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped; one row for each input row. Null text becomes an empty one."""
    marks = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), F.col("n_dropped").alias("_n"), F.col("keep").alias("_keep"))
    joined = docs.withColumn("_hash", F.xxhash64("text")).join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_body")), "left")
    text = F.coalesce("text", F.lit(""))
    return joined.select(
        *docs.columns,
        F.when(F.col("_keep").isNull(), text).otherwise(kept_lines(F.col("text"), F.col("_keep"))).alias("kept_text"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped of docs(doc_id, text); see drop_bitmaps. Other columns are left out."""
    slim = docs.select("doc_id", "text")
    return apply_bitmaps(slim, drop_bitmaps(slim, min_chars, min_docs)).select("doc_id", "kept_text", "n_lines", "n_dropped")
