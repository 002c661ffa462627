"""Shared helpers: the cluster's shared folder, written intermediate tables and small expression tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local master may leave it unset (tests): a folder of our own is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lexigrain-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lexigrain-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, survives lost executors, is computed once.

    rows_per_file (0: any number) is for rows that are large, as a reader's batch may hold all rows of a file.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote. Only for tables whose every use has itself been written."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_RUN)),
    )


def n_words(text: Column) -> Column:
    """Number of words, without keeping them: each becomes one character, and white space goes."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.octet_length(F.regexp_replace(marks, WHITE_RUN, "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one-byte characters take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 16 << 20) -> None:
    """Arrow batches of at most `rows` rows and about `size` bytes (or one row), so that long texts don't fill a worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")) > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: Rows up to which a table of slim rows may be broadcast.
BROADCAST_ROWS = 20_000
#: Rows beyond which a key is hot, where more than BROADCAST_ROWS keys are joined.
HOT_ROWS = 1_000


def join_hot(big: DataFrame, small: DataFrame, key: str, small_key: str, rows: str, name: str, how: str = "inner") -> DataFrame:
    """big joined with small, which has a slim row for each key (null equals null); a key may hold much of big.

    small's column `rows` has the number of big's rows with that key. small is written and counted: up to BROADCAST_ROWS
    rows it is broadcast. Beyond them only its hot keys are, those with more than HOT_ROWS rows and more than one in
    BROADCAST_ROWS of all rows (so fewer than BROADCAST_ROWS keys can be hot at any size); the others are shuffled. how
    is inner or left; for left, small should have big's hot keys, matched or not (null apart).
    """
    side = small if hasattr(small, "written_to") else written(small, name)
    same = F.col(key).eqNullSafe(F.col(small_key))
    n, total = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(rows), F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(side), same, how)
    most = max(HOT_ROWS, int(total) // max(1, BROADCAST_ROWS))
    hot, cold = side.where(F.col(rows) > most), side.where(F.col(rows) <= most)
    rest = big.join(F.broadcast(hot.select(small_key)), same, "left_anti")
    none = F.col(key).isNull()
    nulls = rest.where(none).join(F.broadcast(cold.where(F.col(small_key).isNull())), F.lit(True), how)
    others = rest.where(~none).join(cold, F.col(key) == F.col(small_key), how)
    return big.join(F.broadcast(hot), same).unionByName(others).unionByName(nulls)
