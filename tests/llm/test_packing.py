"""Packing: costs against exhaustive search, ids against the tokenizers library, odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lexigrain.llm import memo, packing, queries, tokenfile

PATH = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def padding(n, rules):
    return 0 if n & (n - 1) == 0 and rules.shortest <= n <= rules.window else rules.window - n


def cost(places, penalty, chosen, rules):
    total, begin = 0, 0
    for k in chosen:
        n = int(places[k]) - begin
        assert 0 < n <= rules.window
        total += int(penalty[k]) + rules.each + padding(n, rules)
        begin = int(places[k])
    return total


def least(places, penalty, rules):
    """By all transitions."""
    at, best = [0, *places.tolist()], [0]
    for j in range(1, len(at)):
        steps = [(best[i], at[j] - at[i]) for i in range(j) if at[j] - at[i] <= rules.window]
        best.append(min(f + padding(n, rules) for f, n in steps) + int(penalty[j - 1]) + rules.each)
    return best[-1]


@pytest.mark.parametrize("window", [8, 16, 64, 100])
def test_least_cost(window):
    rng = np.random.default_rng(window)
    for _ in range(60):
        rules = packing.Rules(window=window, cut=int(rng.integers(0, 9)), hard=20, each=int(rng.integers(0, 5)), grid=5, shortest=int(rng.choice([1, 4, 16])))
        places = np.cumsum(rng.integers(1, 6, size=rng.integers(1, 80)))
        penalty = rng.choice([0, rules.cut, rules.hard], size=len(places))
        chosen = packing.best_cuts(places, penalty, rules)
        assert chosen[-1] == len(places) - 1
        assert cost(places, penalty, chosen, rules) == least(places, penalty, rules)


def test_boundaries():
    rules, marks = packing.Rules(grid=16), packing.Marks(PATH)
    text = "One sentence. And (another!) one\nA line " + "word" * 60
    ids = np.asarray([*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1, 1], dtype="u4")
    places, penalty = packing.boundaries(ids, np.asarray([len(ids) - 1, len(ids)]), marks, rules)
    assert penalty.tolist()[-2:] == [0, 0] and np.diff(places, prepend=0).max() <= 16
    show = Tokenizer.from_file(PATH).decode
    sentences = [show(ids[:p].tolist()) for p, k in zip(places, penalty, strict=True) if k == rules.cut]
    assert sentences == ["One sentence.", "One sentence. And (another!)", "One sentence. And (another!) one\n"]


def check(spark, rows, frame=None, rules=packing.Rules()):
    """The sequences of rows(doc_id, text) have each id of each document once, in order and without gaps."""
    df = spark.createDataFrame(rows, "doc_id long, text string") if frame is None else frame
    sequences = packing.pack(df, PATH, 1, rules).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = sorted(((d is None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows), key=repr)
    parts, got, ids_seen = {}, [], set()
    for s in sequences:
        ids = np.frombuffer(s["ids"], "<u4").tolist()
        assert len(ids) == s["length"] <= rules.window and s["sequence_id"] not in ids_seen
        ids_seen.add(s["sequence_id"])
        assert s["padded_length"] == (s["length"] if s["length"] & (s["length"] - 1) == 0 else rules.window)
        at = 0
        for p in s["pieces"]:
            assert p["offset"] == at
            if p["start"] == 0:
                current = []
            assert len(current) == p["start"]
            current += ids[at : at + p["length"]]
            at += p["length"]
            if len(current) == p["doc_tokens"]:
                got.append((p["doc_id"] is None, p["doc_id"] or 0, current))
        assert at == len(ids)
    assert sorted(got, key=repr) == want
    return sequences


ODD = [
    (1, None), (2, ""), (2, ""), (None, "no id. " * 30), (3, " \n\n "), (4, "tab\tand  spaces   here. Yes"), (5, "日本語。テキスト！ é​ x"), (6, "<|endoftext|> is text"), (7, "a" * 5000),
    (8, "Some sentence of words. " * 2000), (9, "x y " * 3000), (None, None), (10, "\n".join(f"line {k}" for k in range(900))),
]


def test_round_trip(spark):
    check(spark, ODD)
    check(spark, ODD, rules=packing.Rules(window=64, grid=8))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 1).count() == 0


def test_short_runs_and_few_held_ids(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["word.", "other", "x\n", "And"]) for _ in range(rng.randint(0, 400)))) for k in range(60)]
    packed = packing.HELD_IDS, packing.RUN
    try:
        packing.HELD_IDS, packing.RUN = 3000, 40
        marks, encoder = packing.Marks(PATH), tokenfile._encoder(PATH)
        ids = [np.append(x, np.uint32(1)) for x in encoder.ids([t for _, t in rows])]
        batch = packing.sequence_batch([d for d, _ in rows], np.concatenate(ids), np.cumsum([len(x) for x in ids]), marks, packing.Rules(window=128), 7)
    finally:
        packing.HELD_IDS, packing.RUN = packed
    assert batch.column("sequence_id").to_pylist() == list(range(7, 7 + batch.num_rows))
    assert b"".join(batch.column("ids").to_pylist()) == np.concatenate(ids).astype("<u4").tobytes()


def test_clashing_columns(spark):
    rows = [(1, "a b c."), (2, None)]
    frame = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "doc_id long, text string, ids string, pieces int, sequence_id string")
    check(spark, rows, frame)


def test_query_on_whole_table(spark):
    """Digests against the library; little padding."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = queries.op11_packing(spark, SF).toPandas().sort_values(["doc_id", "start"])
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    ids = {d: np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert set(got.doc_id) == set(ids)
    for d, g in got.groupby("doc_id"):
        assert (g.start.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() == len(ids[d]) and (g.doc_tokens == len(ids[d])).all()
        assert [zlib.crc32(ids[d][s : s + n].tobytes()) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    lengths = got.groupby("sequence_id").length.sum()
    padding = lengths[(lengths & (lengths - 1)) != 0].map(lambda n: 2048 - n).sum()
    assert lengths.max() <= 2048 and padding < 0.01 * lengths.sum()


def test_long_texts_in_slices(monkeypatch):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = ["short", "a  b​ c ​d\n e" * 200, "", "x" * 900 + " y", "word, and more. " * 300, "last  "]
    monkeypatch.setattr(memo, "SLICE", 64)
    assert [x.tolist() for x in tokenfile._encoder(PATH).ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert "".join(memo.sliced(texts[1], 10)) == texts[1] and max(map(len, memo.sliced(texts[4], 64))) < 100
