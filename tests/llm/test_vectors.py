"""Components and the vector join against brute force."""

import numpy as np
import pytest

from lexigrain.llm import egojoin, graph


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = reach(400, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    i, j = np.asarray([x for x in links]).T
    assert graph.forest(400, i, j).tolist() == want


@pytest.mark.parametrize("at_once", [True, False])
def test_few_links_take_two_tables(spark, monkeypatch, at_once):
    """A path of 500 nodes in many partitions: steps of few edges don't each take a table and its tasks."""
    tables, f = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, *a: tables.append(name) or f(df, name, *a))
    if not at_once:
        monkeypatch.setattr(graph, "CONTRACTED_ROWS", 100)
    rows = [((k * 7) % 500, (k * 7 + 7) % 500) for k in range(499)] + [(k, k - 1) for k in range(1000, 1300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(rows, "a long, b long").repartition(16)).collect()}
    assert got == {k: 0 for k in range(500)} | {k: 999 for k in range(999, 1300)}
    assert (len(tables) == 2) == at_once


def brute(rows, threshold):
    def ok(r):
        _, label, e = r
        return label is not None and r[0] is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    n, links = len(rows), []
    for a in range(n):
        for b in range(a):
            x, y = rows[a], rows[b]
            if ok(x) and ok(y) and x[1] == y[1] and len(x[2]) == len(y[2]):
                u, v = np.asarray(x[2], "f4").astype("f8"), np.asarray(y[2], "f4").astype("f8")
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                    links.append((a, b))
    root = reach(n, links)
    return {rows[i][0]: (sum(i in p for p in links), rows[root[i]][0]) for i in range(n)}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(300):
        v = centres[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.05, 0.12])
        rows.append((k, int(k % 3), [float(np.float32(x)) for x in v]))
    rows += [(400 + k, 1, rows[1][2]) for k in range(30)]  # equal vectors
    rows += [(500, None, rows[1][2]), (501, 1, None), (502, 1, []), (503, 1, [0.0] * 16), (504, 1, [float("nan")] * 16), (505, 1, [None] * 16), (506, 1, [1.0, 2.0]), (507, 1, [2.0, 4.0]), (508, 1, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, cid string, copies int").repartition(5)
    got = {r["vec_id"]: r for r in egojoin.near_vectors(df, 0.98, block=32).collect()}
    want = brute(rows, 0.98)
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())
    assert max(n for n, _ in want.values()) > 30


def test_near_vectors_of_nothing(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert egojoin.near_vectors(spark.createDataFrame([], schema)).count() == 0
    (row,) = egojoin.near_vectors(spark.createDataFrame([(None, 1, [1.0])], schema)).collect()
    assert tuple(row) == (None, 0, None, False)


def test_repeated_ids_with_different_vectors(spark):
    """Links are of rows; rows of one vec_id are one node of the components."""
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [0.0, 1.0]), (3, 1, [1.0, 0.01])]
    got = egojoin.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_many_groups_and_repeated_rows(spark, monkeypatch):
    """Blocks of 4 in groups of 2, so that many tiles meet; repeated ids with equal and with other vectors."""
    monkeypatch.setattr(egojoin, "GROUP", 2)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 12))
    rows = [(k % 350, 1, [float(x) for x in np.float32(centres[k % 30] + rng.normal(size=12) * 0.08)]) for k in range(360)]
    rows += rows[:3]
    got = egojoin.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3), block=4).collect()
    units = np.asarray([r[2] for r in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = (units @ units.T >= 0.98) & ~np.eye(len(rows), dtype=bool)
    ids = np.asarray([r[0] for r in rows])
    root = np.asarray(reach(len(rows), [*zip(*np.nonzero(near), strict=True), *zip(*np.nonzero(ids[:, None] == ids[None, :]), strict=True)]))
    first = {r: ids[root == r].min() for r in set(root.tolist())}
    want = sorted((int(i), int(n.sum()), int(first[r])) for i, n, r in zip(ids, near, root.tolist(), strict=True))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
