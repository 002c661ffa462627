"""Each stage of the pipeline on what its predecessor kept, against the SQL of its operator or the tiktoken library."""

import base64
import hashlib
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from lexigrain.llm.queries import SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


def ruled(name, docs):
    con = duckdb.connect()
    con.register("docs_frame", docs)
    con.execute("CREATE TABLE documents AS SELECT * FROM docs_frame")
    return con.execute(SQL[name]).df().set_index("doc_id") if docs.doc_id.is_unique else con.execute(SQL[name]).df()


def test_stages(spark, tmp_path):
    docs, frames = spark.read.parquet(f"{SF}/documents.parquet"), []
    frames.append(docs.toPandas())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(docs.toPandas())
    raw, good, lined, single, mixed, coded = frames
    assert all(list(f.columns) == list(corpus_pipeline.COLUMNS) for f in frames[:-1])
    kept = ruled("op8_quality_rules", raw).kept
    assert set(good.doc_id) == set(kept[kept].index) and 0 < len(good) < len(raw)
    lines = ruled("op4_line_dedup", good)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in lined.itertuples()} == lines.kept_sha256.to_dict()
    assert (lined.text.str.len() == lined.n_chars).all() and (lines.n_dropped > 0).any()
    near = ruled("op3_ngram_jaccard", lined)
    assert sorted(single.doc_id) == sorted(near[near.kept].index) and len(single) < len(lined)
    taken = ruled("op10_mixing", single)
    counts, size = Counter(mixed.doc_id), taken["size"].to_dict()
    assert {d: counts[d] * n for d, n in size.items()} == taken.taken.to_dict()
    texts = dict(zip(single.doc_id, single.text, strict=True))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(coded.doc_id) == counts
    for r in coded.itertuples():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u2").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_of_nothing_and_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    good = " ".join(f"w{k}" for k in range(20))
    odd = spark.createDataFrame([(None, good, None, None, None), (1, good + " x", None, None, 3), (1, good + " x", None, None, 3), (2, None, "en", "s", 0)], docs.schema)
    for frame, n in ((docs, 0), (odd, 2)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, frame, SF).write.parquet(str(tmp_path / f"{n}-{k}"))
            frame = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            if k == 2:
                assert frame.count() == n
