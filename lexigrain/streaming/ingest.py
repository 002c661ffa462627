"""Append-only review files as a stream: each review once, the text functions row by row, batches to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import mask_phones, raw_text


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once_each(stream: DataFrame, key: str = "review_id", time: str | None = "crawled_at", late: str = "7 days") -> DataFrame:
    """The first of the rows of each key: a crawl that saves its state after its rows repeats them after a crash.

    With a time column keys are forgotten after `late`, so that the state stays bounded.
    """
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def prepared(stream: DataFrame, text: str = "text") -> DataFrame:
    return stream.withColumn(text, mask_phones(raw_text(F.col(text))))


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, by, n in event time; late rows within the bound still count."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs what is there and ends: rows to Parquet exactly once, or each micro-batch to a function."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)).start()
