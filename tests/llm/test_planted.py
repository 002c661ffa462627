"""Registered queries against their SQL on tables in which copies, bad hosts, shared lines and near vectors are planted."""

import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexigrain.llm import queries
from tests.test_queries import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("planted")), random.Random(11)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    words = [f"w{k}" for k in range(3000)]
    more = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        lines = [f"Shared footer number {group % 3} of the site"] * (group % 2)
        for _ in range(rng.randint(2, 15)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            more.append((" ".join(copy[:30]) + "\n" + "\n".join([*lines, " ".join(copy[30:])]), f"host{group}"))
    more += [("buy now", "spam.example")] * 60 + [("good words " + " ".join(words[k : k + 40]), "spam.example") for k in range(5)]
    rows = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(more)), "text": [t for t, _ in more], "lang": "en", "source": [s for _, s in more], "n_chars": [len(t) for t, _ in more]})
    every = pd.concat([docs, rows.astype(docs.dtypes.to_dict())])
    every.to_parquet(f"{path}/documents.parquet")
    # rows without ids, and rows that are there several times, for the operator that allows them
    (tmp := f"{path}-repeats") and os.makedirs(tmp)
    odd = pd.concat([every.astype({"doc_id": "Int64"}), every.head(150).astype({"doc_id": "Int64"}).assign(doc_id=pd.NA), *[every.tail(40).astype({"doc_id": "Int64"})] * 5])
    odd.to_parquet(f"{tmp}/documents.parquet")
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    copies = pages.sample(40, replace=True, random_state=1).assign(page_id=range(10**6, 10**6 + 40))
    empty = pages.head(4).assign(page_id=range(2 * 10**6, 2 * 10**6 + 4), html=["", None, "", "é"])
    pd.concat([pages, copies, empty]).astype({"page_id": pages["page_id"].dtype}).to_parquet(f"{path}/pages.parquet")
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet")
    near = vectors.sample(80, replace=True, random_state=2).reset_index(drop=True)
    noise = np.random.default_rng(3)
    scale = [0.0, 0.005, 0.02, 0.03]
    near["embedding"] = [np.asarray(v + noise.normal(size=len(v)) * scale[k % 4], "f4") for k, v in enumerate(near["embedding"])]
    near["vec_id"] = np.arange(10**6, 10**6 + 80)
    pd.concat([vectors, near]).astype({"vec_id": vectors["vec_id"].dtype}).to_parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def duck(planted):
    con = duckdb.connect()
    for name in os.listdir(planted):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{planted}/{name}'")
    return con


#: What must occur in a result for the tables to prove anything.
SHOWS = {
    "op2_warc_archive": lambda r: (r["record_type"] == "revisit").sum() >= 40,
    "op3_ngram_jaccard": lambda r: (r["n_links"] > 3).sum() >= 20 and (~r["kept"]).sum() >= 40,
    "op4_line_dedup": lambda r: (r["n_dropped"] > 0).sum() >= 20,
    "op6_embedding_dedup": lambda r: (r["n_links"] > 0).sum() >= 60,
    "op8_quality_rules": lambda r: (~r["kept"] & ~r["base_failed"]).sum() >= 5,
    "op10_mixing": lambda r: (r["taken"] == 2 * r["size"]).any() and (r["taken"] == 0).any(),
}


@pytest.mark.parametrize("name", sorted(SHOWS))
def test_query_equals_sql(spark, planted, duck, name):
    got, want = queries.QUERIES[name](spark, planted).toPandas(), duck.execute(queries.SQL[name]).df()
    assert SHOWS[name](got)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def test_mixing_of_repeated_rows_equals_sql(spark, planted):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{planted}-repeats/documents.parquet'")
    got, want = queries.op10_mixing(spark, f"{planted}-repeats").toPandas(), con.execute(queries.SQL["op10_mixing"]).df()
    assert got.doc_id.isna().sum() == 150
    key = ["doc_id", "size", "source_size", "target", "taken"]
    pd.testing.assert_frame_equal(*[normal(x[key]) for x in (got, want)], check_dtype=False)
