"""Readers and writers of the edge formats; between stages tables are Parquet."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header in the given column order, all strings unless typed.

    A byte order mark and surplus fields at the ends of rows are ignored; an empty field is null, whatever the column.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_surplus"]])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    df = reader.csv(path)
    kinds = types or {}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns])


def read_csv_if_there(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """read_csv, or no rows where the file is optional and missing."""
    if path_exists(spark, path):
        return read_csv(spark, path, columns)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def ingested(df: DataFrame, column: str = "ingested_at") -> DataFrame:
    """df with the time of the run, one for all rows."""
    return df.withColumn(column, F.current_timestamp())


def read_csv_set(spark: SparkSession, glob: str, columns: Sequence[str]) -> DataFrame:
    """All files of a pattern, with the name of the file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(glob)
    return df.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0))


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """Lines of a list without blanks and comments, in order; lists are small by nature."""
    rows = spark.read.text(path, wholetext=True).first()
    lines = (rows["value"] if rows else "").lstrip(BOM).splitlines()
    return [x.strip() for x in lines if x.strip() and not x.startswith("#")]


def read_word_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Key and value of each line, parted by a tab."""
    return dict(x.split("\t", 1) for x in read_word_list(spark, path))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; bom puts a mark before each file's first column name, for spreadsheets."""
    out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").options(header=True, escape='"', emptyValue="", **keep).csv(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """A folder of CSV for each batch; batches that are there already stay as they are."""
    spark = df.sparkSession
    done = spark.read.option("header", True).csv(path).select(F.col(batch).cast("int").alias("_done")).distinct() if path_exists(spark, path) else None
    todo = df if done is None else df.join(done, F.col(batch) == F.col("_done"), "left_anti")
    todo.write.mode("append").option("header", True).partitionBy(batch).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def nested_json(df: DataFrame, keys: Sequence[str], value: str) -> str:
    """A small tidy table as pretty nested JSON; numbers that JSON lacks become null."""
    out: dict = {}
    for r in df.collect():
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(r[k]), {})
        v = r[value]
        at[str(r[keys[-1]])] = None if isinstance(v, float) and v != v else v
    return json.dumps(out, ensure_ascii=False, indent=2)
