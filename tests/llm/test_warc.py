"""The WARC archive against a plain reading of its rules."""

import base64
import hashlib

import pyarrow.fs
import pytest

from lexigrain.llm import warc
from lexigrain.llm.common import scratch

ROWS = [
    (1, "http://a/1", "same", "x"), (7, "http://a/7", "same", "x"), (3, None, "same", "x"), (4, "http://b\r\nx: y", "only é", "x"), (5, "u", None, "x"),
    (6, "v", "", "x"), (9, "w", "twice", "x"), (9, "w", "twice", "x"), (None, "n", "same", "x"), (None, "n", "alone", "x"), (2, "l", "long " * 5000, "x"),
]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string")


def test_index(spark):
    path = scratch(spark, "t")
    warc.write_archive(frame(spark), path)
    got = warc.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for i, (page, _, html, _) in enumerate(ROWS):
        same = [(p is not None, p or 0, -k, p) for k, (p, _, h, _) in enumerate(ROWS) if (h or "") == (html or "")]
        best = max(same)
        response = best[2] == -i
        want.append((page, len((html or "").encode()), sha(html), "response" if response else "revisit", None if response else best[3]))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h, _ in ROWS})


def test_small_payloads_are_responses(spark):
    path = scratch(spark, "t")
    warc.write_archive(frame(spark), path, min_revisit_bytes=5)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.read_index(spark, path).collect()}
    assert (1, "response") in kinds and (7, "response") in kinds and (9, "revisit") in kinds


def test_files_round_trip(spark):
    path, out = scratch(spark, "t"), scratch(spark, "files")
    warc.write_archive(frame(spark), path)
    names = warc.export_warc(spark, path, out).collect()
    fs, at = pyarrow.fs.FileSystem.from_uri(out)
    found = []
    for r in names:
        with fs.open_input_file(f"{at}/{r['name']}") as f:
            found += list(warc.parse_warc(f))
    assert len(found) == len(ROWS) == sum(r["n_records"] for r in names)
    payloads = sorted(b.split(b"\r\n\r\n", 1)[1] for h, b in found if b"WARC-Type: response" in h)
    assert payloads == sorted({(h or "").encode() for _, _, h, _ in ROWS})
    ids = {h.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for h, _ in found}
    assert len(ids) == len(ROWS)
    named = {h.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for h, _ in found if b"WARC-Refers-To: " in h}
    assert named <= ids and not any(b"\nx: y" in h for h, _ in found)


def test_empty(spark):
    path = scratch(spark, "t")
    warc.write_archive(frame(spark, []), path)
    assert warc.read_index(spark, path).count() == 0
    assert warc.round_trip(frame(spark, [])).count() == 0


@pytest.mark.parametrize("least", [0, 5])
def test_files_say_what_the_index_says(spark, least):
    """Records rebuilt by the join, written as WARC and parsed, against the index of the stored tables."""
    path = scratch(spark, "t")
    warc.write_archive(frame(spark), path, least)
    cols = ["page_id", "record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to"]
    rows = lambda df: sorted(map(str, df.select(cols).collect()))
    assert rows(warc.round_trip(frame(spark), least)) == rows(warc.read_index(spark, path))


def test_records_are_the_bytes_they_were(spark):
    """Each response's record, byte for byte: its exact header and the page's own bytes."""
    path, out = scratch(spark, "t"), scratch(spark, "files")
    warc.write_archive(frame(spark), path)
    heads = {bytes(r["head"]) for r in spark.read.parquet(f"{path}/headers").collect()}
    fs, at = pyarrow.fs.FileSystem.from_uri(out)
    got = []
    for r in warc.export_warc(spark, path, out).collect():
        with fs.open_input_file(f"{at}/{r['name']}") as f:
            got += list(warc.parse_warc(f))
    body = {p: (h or "").encode() for p, _, h, _ in ROWS if p is not None}
    for head, block in got:
        http, _, payload = block.partition(b"\r\n\r\n")
        assert head + http + b"\r\n\r\n" in heads
        if b"WARC-Type: response" in head and b"X-Page-ID: " in head:
            assert payload == body[int(head.split(b"X-Page-ID: ")[1].split(b"\r\n")[0])]


def test_hot_payload_and_broken_files(spark, monkeypatch):
    monkeypatch.setattr("lexigrain.llm.common.BROADCAST_ROWS", 2)
    monkeypatch.setattr("lexigrain.llm.common.HOT_ROWS", 3)
    rows = [(k, f"u{k}", f"page {k % 7 if k % 3 else 0}", "x") for k in range(60)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(frame(spark, rows)).collect()}
    best = {h: p for p, _, h, _ in rows}
    assert got == {p: ("response", None) if best[h] == p else ("revisit", best[h]) for p, _, h, _ in rows}
    with pytest.raises(ValueError, match="differs"):
        warc._facts(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:A\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")
    lost = warc.warc_index(spark.createDataFrame([("a", "revisit", "u", "D", "gone", 1, 2, None)], "record_id string, record_type string, target_uri string, payload_digest string, refers_id string, page_id long, said_bytes long, payload_bytes long"))
    with pytest.raises(Exception, match="no such payload"):
        lost.collect()
