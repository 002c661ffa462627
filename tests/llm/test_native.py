"""Quality rules, line de-duplication and mixing against plain Python, with odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import common, linededup, mixing, quality

WHITE = common.WHITE


def words(text):
    return (text or "").encode().split()


def repeats(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    return len({k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)})


TEXTS = [
    None, "", " \n\t ", "one two three", "a b c d e f g h i j k", "a b c d e " * 2, "a b c d e " * 9 + "x", "x " * 40, "é è #*$%&|<> \x0b z", "same line\nsame line\n\nother\n \nsame line",
    "1 2 3 4 5 6 1 2 3 4 5 7 8 9 10 11", " a b c ", "w" * 5000, " ".join(f"t{k % 37}" for k in range(3000)),
]


def stats_frame(spark):
    rows = [(k, t, ["h1", "h2", None][k % 3], "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string").repartition(4)


def test_document_statistics(spark):
    got = {r["doc_id"]: r for r in quality.judge(stats_frame(spark)).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        w, r = words(t), got[k]
        lines = [x for x in (t or "").split("\n") if x.strip(WHITE)]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeats(w))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert r["base_failed"] == (len(w) < 10 or 100 * repeats(w) > 20 * len(w))


@pytest.mark.parametrize("most", [20_000, 0])
def test_host_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, good, f"good{k % 5}") for k in range(200)] + [(k, "short", "bad") for k in range(200, 260)] + [(300, good, "bad"), (301, "short", "one"), (302, good, "one"), (303, good, None), (303, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = Counter(r["doc_id"] for r in quality.judge(df).where("kept").collect())
    assert kept == Counter([*range(200), 302, 303, 303])  # a host with one bad and one good page is shrunk to the others
    verdicts = {r["host"]: r for r in quality.host_verdicts(quality.document_stats(df)).collect()}
    assert verdicts["bad"]["rejected"] and not verdicts["one"]["rejected"] and None not in verdicts
    assert quality.judge(df.where("doc_id < 0")).count() == 0


def line_rule(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WHITE).translate(low)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    order = lambda d: (d is not None, d or 0)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or d == max(holders[key(x)], key=order)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [10_000, 5])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_LINES", hot)
    rng = random.Random(4)
    pool = ["Shared line number one of all", "  shared LINE number one of all\t", "ÉÈ a line with accents in it", "éÈ a line with accents in it", "short", "", "x" * 19, "y" * 20]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.random()} of its own kind" for _ in range(rng.choice([0, 1, 3, 70, 200])))) for k in range(40)]
    rows += [(100, None), (101, ""), (None, "y" * 20), (None, "y" * 20), (39, rows[39][1]), (7, "Shared line number one of all\nmore"), (102, "\n\n"), (103, "Shared line number one of all")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, bits string, n_dropped int").repartition(5)
    got = linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("h")).collect()
    assert sorted(str(tuple(r)) for r in got) == line_rule(rows)
    assert linededup.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_lines_are_exchanged_once_and_streamed(spark):
    """The pass over the sorted runs needs no exchange and no sort beyond those that made them."""
    lines = linededup.hashed_lines(spark.createDataFrame([(1, "x" * 30)], "doc_id long, text string"), 20)
    plan = linededup.streamed(linededup.sorted_runs(lines, 4), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_keep_bitmaps_are_run_length_coded(spark):
    rows = [([0, 1, 2], [0, 3]), ([5], [5, 6]), ([0, 2, 3, 9], [0, 1, 2, 4, 9, 10])]
    for dropped, want in rows:
        df = spark.createDataFrame([(dropped, "\n".join(f"l{k}" for k in range(10)))], "dropped array<int>, text string")
        got = df.select(linededup.run_ends(F.col("dropped")).alias("keep"), "text").select("keep", linededup.kept_lines(F.col("text"), F.col("keep")).alias("kept")).first()
        assert got["keep"] == want and got["kept"] == "\n".join(f"l{k}" for k in range(10) if k not in dropped)


def targets(sizes, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, spill = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            out[s] += left * w[s] / total
            if out[s] >= 2 * sizes[s]:
                spill += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = spill
    return out


@pytest.mark.parametrize("most", [20_000, 0])
def test_mixing(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    rows = [(k, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "a", "b", "c", "é", None, "z"])) for k in range(900)]
    rows += [(1000, None, "a"), (1001, "w", "alone"), (1002, "", "empty"), (None, "w w", "b"), (5, "w w w", "c"), (5, "w w w", "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, goal, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    assert {s: pytest.approx(t) for s, t in targets(dict(sizes)).items()} == goal
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    again = Counter(map(str, mixing.mix(df.repartition(7)).collect()))
    assert again == Counter(map(str, got))
    mixed = Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert mixed == +want
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


def test_inclusion_frequencies(spark):
    """400 sources with the same sizes: how often each size is taken is its inclusion probability; the largest is certain."""
    sizes = [1, 2, 3, 5, 8, 8, 13, 21, 34, 400]
    rows = [(1000 * s + k, " ".join(["w"] * n), f"s{s:03d}") for s in range(400) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1,), share=0.9).collect()
    rest, below = 0.9 * sum(sizes) - 400, sizes[:-1]
    want = {n: min(1.0, rest / sum(x * x for x in below) * n) for n in below} | {400: 1.0}
    assert all(p < 1 for n, p in want.items() if n < 400)
    for n in set(sizes):
        share = [r["copies"] for r in got if r["size"] == n]
        assert abs(sum(share) / len(share) - want[n]) < 0.09
    assert abs(sum(r["size"] * r["copies"] for r in got) / (400 * 0.9 * sum(sizes)) - 1) < 0.02


@pytest.mark.parametrize(("ids", "texts"), [("none", "same"), ("none", "own"), ("one", "same"), ("two", "sizes")])
def test_rows_without_or_with_repeated_ids_reach_the_target(spark, monkeypatch, ids, texts):
    """1,000 rows of one source: each has its own draw, whatever it shares with others."""
    monkeypatch.setattr(mixing, "NUMBERED", 64)
    doc = {"none": lambda k: None, "one": lambda k: 7, "two": lambda k: k % 2}[ids]
    text = {"same": lambda k: "a b c", "own": lambda k: f"a b c{k}", "sizes": lambda k: "w " * (1 + k % 9)}[texts]
    rows = [(doc(k), text(k), "s", k) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    got = mixing.mix(df).collect()
    goal, largest = 1.5 * sum(r["size"] for r in got), max(r["size"] for r in got)
    assert len(got) == 1000 and abs(sum(r["size"] * r["copies"] for r in got) - goal) <= largest
    assert {r["copies"] for r in got} == {1, 2}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = mixed.selectExpr("sum(size(split(trim(text), ' '))) AS n").first()["n"]
    assert words == sum(r["size"] * r["copies"] for r in got)


def test_a_very_long_text_is_mixed(spark):
    rows = [(k, "w " * (3_000_000 if k == 5 else 10), "a") for k in range(20)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[5]["size"] == 3_000_000 and got[5]["source_size"] == 3_000_190
