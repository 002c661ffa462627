"""Merkle manifest against plain Python: groups of many sizes, odd rows, both ways of joining the runs."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lexigrain.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root, and for each node its siblings as (before, after) by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            steps[k].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], steps


def ascii_lower(t):
    return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for r in rows:
        leaf = h(*map(enc, r))
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf, r))
    tops = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in tops:
        groups[lang].sort(key=lambda x: x[:3])
        trees[lang] = climb([x[2] for x in groups[lang]])
    root, upper = climb([trees[lang][0] for lang in tops])
    out = []
    for lang, up in zip(tops, upper, strict=True):
        for (_, _, leaf, r), own in zip(groups[lang], trees[lang][1], strict=True):
            steps = own + up
            start = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                start = h(*map(enc, (*r[:4], ascii_lower(r[4]))))
            for before, after in steps:
                start = h(before, start, after)
            out.append((r[0], leaf, trees[lang][0], root, h(*[x for s in steps for x in s]), start, start == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def planted():
    rows, k = [], 0
    for lang, n in (("one", 1), ("eight", 8), ("nine", 9), ("e64", 64), ("e65", 65), ("é", 130), (None, 20), ("", 3), ("Z", 2), ("a", 5), ("ｚ", 1), ("big", 700)):
        for _ in range(n):
            k += 7
            rows.append((k if k % 5 else -k, f"s{k % 3}" if k % 4 else None, lang, k if k % 6 else None, ["Some Text", None, "", "É:Ü lower", "1:x\n"][k % 5]))
    return rows + [(None, None, "one", None, None), (None, "s", "nine", 1, "A"), (5, "s", "nine", 1, "B"), (5, "s", "nine", 1, "B"), (5, "t", "nine", 1, "B"), (None, None, "one", None, None)]


@pytest.mark.parametrize("most", [20_000, 0])
def test_proofs(spark, monkeypatch, most):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", most)
    rows = planted()
    got = [tuple(r) for r in merkle.verified_proofs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == want
    assert {r[-1] for r in got} == {True, False}


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_proofs(empty).count() == 0 and merkle.manifest(empty).root() is None
    row = (3, "s", None, 1, "T")
    got = merkle.verified_proofs(spark.createDataFrame([row], SCHEMA)).first()
    leaf = h(*map(enc, row))
    assert (got["leaf"], got["subroot"], got["root"], got["proof_sha256"]) == (leaf, leaf, leaf, h())


def test_other_fields_and_clashing_columns(spark):
    """The general interface: other fields, groups and keys; columns named like the operator's own."""
    rows = [(k, f"g{k % 2}", "x" * k, k, "y", k) for k in range(20)]
    df = spark.createDataFrame(rows, "index long, digest string, nodes string, size long, root string, level long")
    found = merkle.manifest(df, fields=("index", "nodes"), group="digest", key="index")
    subroots = {g: climb([h(enc(k), enc("x" * k)) for k in range(20) if f"g{k % 2}" == g])[0] for g in ("g0", "g1")}
    assert found.root() == h(subroots["g0"], subroots["g1"])
    assert {(r["group"], r["subroot"]) for r in found.proofs().collect()} == set(subroots.items())


def test_long_text(spark):
    rows = [(k, "s", "en", 1, "Ab é " * 400_000 if k == 3 else "t") for k in range(10)]
    assert sorted((tuple(r) for r in merkle.verified_proofs(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_coordinates(spark):
    runs = spark.createDataFrame([("g", 0, r, 600) for r in range(75)] + [("k", 0, 0, 8)], "group string, level int, run long, n long")
    got = sorted((r["run"], r["level"], r["up"], r["position"]) for r in merkle.coordinates(runs, 4).collect())
    assert got == sorted((r, k, r // 8**k, r // 8 ** (k - 1) % 8) for r in range(75) for k in (1, 2, 3))


def test_registered():
    assert queries.SQL["op12_merkle_manifest"]
