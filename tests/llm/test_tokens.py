"""Token-ID files and byte-level BPE against the libraries themselves."""

import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrain.llm import bpe, tokenfile
from lexigrain.llm.common import scratch

TEXTS = [
    None, "", " ", "   ", "a", "Hello, world!  Two  spaces", "tab\t \n x \n\n y", "it's we'll don't 123 4567", "naïve Straße ñandú 中文字符 🙂🙂",
    "<|endoftext|> is text", "trailing ", " leading", "a b   c", "x" * 3000, "word " * 2000, "​zero ​ width", "a \x1c b\x85c ᠎ d", "é" * 50 + " " * 40 + "z",
]
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.DEFAULT_RANKS), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
HF.encode_special_tokens = True
OWN = bpe.ByteBpe(P.path(bpe.DEFAULT_RANKS))


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3, t, "extra", i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabé1.  "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_sentencepiece_agrees_with_tiktoken(text):
    (ids,) = OWN.encode([text])
    assert ids.tolist() == TIK.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabé1.  "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_agree_with_tokenizers(text):
    (ids,) = tokenfile._encoder(P.path("byte_bpe_50k.json")).ids([text])
    assert ids.tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype="u8").astype("<u4")
    raw = tokenfile.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (tokenfile.unpack(raw, bits, 1001) == ids).all()


def test_file_random_access(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 8)
    out, rng = io.BytesIO(), np.random.default_rng(1)
    docs = [rng.integers(0, 2000, n).astype("<u4") for n in (0, 5, 30, 1, 0, 8, 3)]
    w = tokenfile.Writer(out, 11)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    r = tokenfile.Reader(io.BytesIO(out.getvalue()))
    assert r.docs == [None, 1, 2, 3, 4, 5, 6]
    assert all((r.document(i) == d).all() and len(r.document(i)) == len(d) for i, d in enumerate(docs))
    assert (r.ids(6, 20) == np.concatenate(docs)[6:20]).all()


def test_dataset_matches_the_library(spark):
    path = scratch(spark, "test-ids")
    tokenfile.write_dataset(rows(spark).repartition(3), path, P.path("byte_bpe_50k.json"), 2, 50257, file_ids=500)
    got = {r["doc_id"]: r for r in tokenfile.read_documents(spark, path).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*HF.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[3 * i]) == (3 * i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_dataset_of_nothing_and_of_null_ids(spark):
    path = scratch(spark, "test-ids")
    tokenfile.write_dataset(rows(spark, []), path, P.path("byte_bpe_50k.json"), 2, 50257)
    assert tokenfile.read_documents(spark, path).count() == 0
    path = scratch(spark, "test-ids")
    df = spark.createDataFrame([(5, "b"), (None, "a"), (5, "b"), (5, "c")], "doc_id long, text string")
    tokenfile.write_dataset(df, path, P.path("byte_bpe_50k.json"), 2, 50257)
    got = sorted(tokenfile.read_documents(spark, path, digest=False).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 5, 5, 5] and [r["start"] for r in got] == [0, 2, 4, 6]
    assert got[0]["ids"][-1] == 2


def test_round_trip_query(spark):
    got = {r["doc_id"]: r for r in bpe.round_trip(rows(spark), P.path(bpe.DEFAULT_RANKS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = TIK.encode_ordinary(t or "")
        assert got[3 * i]["n_tokens"] == len(ids)
        assert got[3 * i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[3 * i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(rows(spark), P.path(bpe.DEFAULT_RANKS)), P.path(bpe.DEFAULT_RANKS)).collect()
    assert {r["doc_id"]: bytes(r["text_bytes"]).decode() for r in back} == {3 * i: t or "" for i, t in enumerate(TEXTS)}


def test_rows_without_ids_are_dealt_to_several_files(spark):
    path = scratch(spark, "t")
    texts = [f"text number {k}" for k in range(3000)] + ["twice"] * 40
    df = spark.createDataFrame([(None if k % 3 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    tokenfile.write_dataset(df, path, P.path("byte_bpe_50k.json"), end_id=2, vocabulary=50257)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tokenfile.read_manifest(spark, path)) > 2
    got = sorted(tokenfile.read_documents(spark, path, digest=False).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [None] * sum(k % 3 > 0 for k in range(3040)) + [7] * sum(k % 3 == 0 for k in range(3040))
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted((*HF.encode(t, add_special_tokens=False).ids, 2) for t in texts)
