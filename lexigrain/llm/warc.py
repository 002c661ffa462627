"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join.

An archive is two tables. headers: a row for each record with the exact bytes before its payload (the WARC header and
the HTTP header of a response or revisit). payloads: a row for each different payload under its SHA-256, with the
SHA-1 that WARC headers name. Readers compute both digests anew from the stored bytes and fail on any difference.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, scratch, small_batches, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: WARC-Date of records made here: rows have no fetch time, and reruns give the same bytes.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_of_hex(digest: Column) -> Column:
    """Base32 (upper case, no padding) of a digest of 160 bits in hex: 40 bits at a time are 8 characters."""
    part = lambda k: F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(*cols: Column) -> Column:
    """A record id from the md5 of what identifies a record: the same in every run."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))


def _body(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))


def record_table(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, sha256, sha1, n_bytes, nth, copies, r_page, r_url, is_response for pages(page_id, url, html).

    Null html counts as empty. Of the rows with one payload of at least min_revisit_bytes, that with the largest page_id
    (null below all; then the largest url; of equal rows the first) is the response and the others revisit it; smaller
    payloads are all responses. Only digests are shuffled. They are summed first, so a payload of a third of all pages
    costs a row for each task in the sums, and the join's large partitions can be split.
    """
    rows = (
        _body(pages)
        .select("page_id", "url", F.sha2("body", 256).alias("sha256"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n_bytes"))
        .groupBy("page_id", "url", "sha256", "sha1", "n_bytes")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = written(rows, "digests")
    # a table, so that both sides of the join are dealt for it and a hot payload's rows can be split
    best = written(rows.groupBy(F.col("sha256").alias("r_sha")).agg(F.max(F.struct("page_id", "url")).alias("best")), "best")
    each = rows.join(best, F.col("sha256") == F.col("r_sha")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    is_best = F.struct("page_id", "url").eqNullSafe(F.col("best")) & (F.col("nth") == 1)
    return each.select(
        "page_id", "url", "sha256", "sha1", "n_bytes", "nth", "copies", F.col("best.page_id").alias("r_page"), F.col("best.url").alias("r_url"),
        (is_best | (F.col("n_bytes") < min_revisit_bytes)).alias("is_response"), is_best.alias("is_best"),
    )


def _target(url: Column, page_id: Column) -> Column:
    """The URL on one line; rows without one get a urn of their page_id."""
    given = F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.replace(F.replace(given, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_headers(records: DataFrame) -> DataFrame:
    """sha256, head: the exact bytes of each record before its payload, which a revisit doesn't repeat."""
    c, lit = F.col, F.lit
    http = F.concat(lit(HTTP), c("n_bytes").cast("string"), lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(c("is_response"), c("n_bytes")).otherwise(0)
    refers = F.concat(
        lit("WARC-Refers-To: "), _uuid(c("r_page"), c("r_url"), c("sha256"), lit(1)), lit("\r\nWARC-Refers-To-Target-URI: "), _target(c("r_url"), c("r_page")),
        lit("\r\nWARC-Profile: " + REVISIT_PROFILE + "\r\n"),
    )
    head = F.concat(
        lit("WARC/1.1\r\nWARC-Type: "), F.when(c("is_response"), "response").otherwise("revisit"),
        lit("\r\nWARC-Record-ID: "), _uuid(c("page_id"), c("url"), c("sha256"), c("nth")),
        lit("\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), _target(c("url"), c("page_id")),
        lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(c("sha1")), lit("\r\n"),
        F.when(c("is_response"), "").otherwise(refers),
        F.coalesce(F.concat(lit("X-Page-ID: "), c("page_id").cast("string"), lit("\r\n")), lit("")),
        lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), lit("\r\n\r\n"), http,
    )
    return records.select("sha256", F.encode(head, "UTF-8").alias("head"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes pages(page_id, url, html) as path/records (slim), path/headers and path/payloads; see record_table."""
    spark = pages.sparkSession
    record_table(pages, min_revisit_bytes).write.option("compression", "zstd").parquet(f"{path}/records")
    records = spark.read.parquet(f"{path}/records")
    record_headers(records).write.option("compression", "zstd").parquet(f"{path}/headers")
    best = records.where("is_best").select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("sha256").alias("_s"), "copies")
    keyed = _body(pages).withColumn("sha256", F.sha2("body", 256))
    same = (F.col("sha256") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u"))
    found = keyed.join(best, same).select("sha256", "body", "copies")
    single = found.where("copies = 1").select("sha256", "body")
    repeated = found.where("copies > 1").groupBy("sha256").agg(F.first("body").alias("body"))
    single.unionByName(repeated).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _named(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, f"(?:^|\\n){name}: ?([^\\r\\n]*)", 1), F.lit(""))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, body, of path/payloads; a payload that isn't what its digest says is an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest "), "sha256"))
    return stored.select("sha256", F.when(F.sha2("body", 256) == F.col("sha256"), F.col("body")).otherwise(bad.cast("binary")).alias("body"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to of each record.

    Everything is parsed from the exact headers, checked against digest and length of the stored payload, and refers_to
    is the page_id of the record that a revisit names. Payloads are read once each and not copied to their records.
    """
    text = F.decode("head", "UTF-8")
    heads = spark.read.parquet(f"{path}/headers").select("sha256", text.alias("h")).select(
        "sha256", _named(F.col("h"), "X-Page-ID").cast("long").alias("page_id"), _named(F.col("h"), "WARC-Record-ID").alias("record_id"),
        _named(F.col("h"), "WARC-Type").alias("record_type"), _named(F.col("h"), "WARC-Target-URI").alias("target_uri"),
        F.substring(_named(F.col("h"), "WARC-Payload-Digest"), 6, 32).alias("payload_digest"), _named(F.col("h"), "WARC-Refers-To").alias("refers_id"),
        F.regexp_extract(F.col("h"), "Content-Length: ([0-9]+)\\r\\n\\r\\n$", 1).cast("long").alias("said_bytes"),
    )
    facts = read_payloads(spark, path).select(F.col("sha256").alias("p_sha"), F.octet_length("body").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("body")).alias("p_digest"))
    joined = heads.join(facts, F.col("sha256") == F.col("p_sha"), "left")
    good = (F.col("payload_bytes") == F.col("said_bytes")) & (F.col("p_digest") == F.col("payload_digest"))
    joined = joined.withColumn("payload_bytes", F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a header differs from its payload")).cast("long")))
    named = heads.where("record_type = 'response'").select(F.col("record_id").alias("n_id"), F.col("page_id").alias("refers_to"))
    revisits = joined.where("record_type = 'revisit'").join(named, F.col("refers_id") == F.col("n_id"), "left")
    others = joined.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    cols = ["page_id", "record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to"]
    return others.select(cols).unionByName(revisits.select(cols))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """head, payload (null for a revisit) of each record: joined they are the record without its closing line ends."""
    heads = spark.read.parquet(f"{path}/headers")
    stored = read_payloads(spark, path).select(F.col("sha256").alias("_s"), "body")
    is_revisit = F.decode("head", "UTF-8").contains("\r\nWARC-Refers-To: ")
    full = heads.where(~is_revisit).join(stored, F.col("sha256") == F.col("_s")).select("head", F.col("body").alias("payload"))
    return full.unionByName(heads.where(is_revisit).select("head", F.lit(None).cast("binary").alias("payload")))


def export_warc(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the archive's records as out/*.warc.gz, a gzip member for each; returns name, n_records of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(out)
        fs.create_dir(at, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
            for b in batches:
                for head, payload in zip(b.column("head").to_pylist(), b.column("payload").to_pylist(), strict=True):
                    f.write(gzip.compress(head + (payload or b"") + b"\r\n\r\n", 6, mtime=0))
                    n += 1
        yield pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([n], pa.int64())})

    small_batches(spark)
    read_records(spark, path).mapInArrow(run, "name string, n_records long").write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def parse_warc(f: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of an open .warc.gz file."""
    with gzip.open(f) as z:
        while line := z.readline():
            if not line.strip():
                continue
            head = [line]
            while (line := z.readline()).strip():
                head.append(line)
            head.append(line)
            size = next(int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:"))
            block = z.read(size)
            if len(block) < size:
                raise EOFError("the file ends within a record")
            yield b"".join(head), block


RECORD = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "payload_digest", "refers_id")] + [(c, pa.int64()) for c in ("page_id", "said_bytes", "payload_bytes")]
)


def _facts(head: bytes, block: bytes) -> dict:
    """What one parsed record says; a response whose payload differs from its digest or length is an error."""
    lines = [x.split(b":", 1) for x in head.split(b"\r\n") if b":" in x]
    named = {k.decode().lower(): v.strip().decode() for k, v in lines}
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest, is_response = named.get("warc-payload-digest", "").removeprefix("sha1:"), named["warc-type"] == "response"
    if is_response and (len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {named['warc-record-id']} differs from its header")
    return {
        "record_id": named["warc-record-id"], "record_type": named["warc-type"], "target_uri": named.get("warc-target-uri"), "payload_digest": digest, "refers_id": named.get("warc-refers-to"),
        "page_id": int(named["x-page-id"]) if "x-page-id" in named else None, "said_bytes": said, "payload_bytes": len(payload) if is_response else None,
    }


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The facts of each record in the files of export_warc (columns of RECORD), a record at a time: a task for each file.

    Length and SHA-1 are of the bytes found behind a response's headers. A file with more or fewer records than its
    manifest says is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(out)
        for b in batches:
            for name, n in zip(b.column("name").to_pylist(), b.column("n_records").to_pylist(), strict=True):
                with fs.open_input_file(f"{at}/{name}") as f:
                    rows, seen = [], 0
                    for head, block in parse_warc(f):
                        rows.append(_facts(head, block))
                        seen += 1
                        if len(rows) == 4000:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows = []
                    if seen != n:
                        raise ValueError(f"{name} has {seen} records, its manifest says {n}")
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    files = spark.read.parquet(f"{out}/manifest")
    return files.repartition(max(1, files.count())).mapInArrow(
        run, "record_id string, record_type string, target_uri string, payload_digest string, refers_id string, page_id long, said_bytes long, payload_bytes long"
    )


def warc_index(records: DataFrame) -> DataFrame:
    """page_id, record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to of read_warc's records.

    A revisit takes payload_bytes and refers_to from the response that it names; without one, or with another digest or
    length there, it is an error. Revisits are counted by response first, so a page with very many copies isn't one task.
    """
    records = written(records, "parsed")
    revisits = records.where("record_type = 'revisit'")
    counts = revisits.groupBy(F.col("refers_id").alias("r_id")).agg(F.count(F.lit(1)).alias("n_revisits"))
    found = records.where("record_type = 'response'").select("record_id", F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes"))
    named = counts.join(found, F.col("r_id") == F.col("record_id"), "left").drop("record_id")
    joined = join_hot(revisits, named, "refers_id", "r_id", "n_revisits", "named", how="left")
    good = (F.col("r_digest") == F.col("payload_digest")) & (F.col("r_bytes") == F.col("said_bytes"))
    bad = F.raise_error(F.concat(F.lit("no such payload for "), "record_id")).cast("long")
    size, cols = F.when(F.coalesce(good, F.lit(False)), F.col("r_bytes")).otherwise(bad), ["page_id", "record_id", "record_type", "target_uri", "payload_digest"]
    others = records.where("record_type <> 'revisit'").select(*cols, "payload_bytes", F.lit(None).cast("long").alias("refers_to"))
    return others.unionByName(joined.select(*cols, size.alias("payload_bytes"), F.col("r_page").alias("refers_to")))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """warc_index of pages(page_id, url, html): archived by content, rebuilt by joins, written as WARC files, parsed again.

    See record_table for null html, repeated rows and ties. Null page_ids have records of their own, without an X-Page-ID.
    """
    spark = pages.sparkSession
    archive, files = scratch(spark, "warc"), scratch(spark, "warc-files")
    write_archive(pages, archive, min_revisit_bytes)
    export_warc(spark, archive, files)
    return warc_index(read_warc(spark, files))
