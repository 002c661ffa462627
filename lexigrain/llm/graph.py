"""Connected components of links by alternating large-star and small-star steps, each a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_hot, written

#: Edges that one task may contract: a row for each end at most fits a broadcast.
CONTRACTED_ROWS = BROADCAST_ROWS // 2


def _contracted(edges: DataFrame) -> DataFrame:
    """u, v: each node of a few edges (u, v) and the smallest node of its component, found in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(c).to_numpy() for c in "uv"]) for b in batches]
        if held:
            nodes, at = np.unique(np.concatenate(held, 1), return_inverse=True)
            u, v = at.reshape(2, -1)
            root = forest(len(nodes), u, v)
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct edges (u, v) with u > v."""

    def joined(rows: DataFrame, low: DataFrame) -> DataFrame:
        return join_hot(rows, low, "u", "k", "n", "low")

    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    large = joined(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = joined(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for each node of links(a, b), two longs.

    Nulls and links from a node to itself are left out; a node without another link has no row. The number of steps
    grows with the logarithm of the longest path; every step is a table in the shared folder. Steps of few edges would
    take as many tasks as those of many, so up to CONTRACTED_ROWS edges are contracted at once.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(pairs, "links"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == before or not mark[0]:
            break
        done, before, few = edges, mark, mark[0] <= CONTRACTED_ROWS
        edges = written(_contracted(edges) if few else _stars(edges), "links")
        discard(done)
        if few:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def same_id_links(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """a, b: links between the classes (key, cid) of rows(id, key) that share an id; None if no id has two keys."""
    by_id = rows.groupBy(F.col("id").alias("i")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"))
    several = written(by_id.where("low <> high").select("i", "n"), "several")
    if several.isEmpty():
        return None
    of = join_hot(rows, several, "id", "i", "n", "several").select("id", "key").distinct()
    of = written(of.join(classes.select(F.col("key").alias("k"), "cid"), F.col("key") == F.col("k")).select("id", "cid"), "of")
    first = of.groupBy(F.col("id").alias("i")).agg(F.min("cid").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(of, first, "id", "i", "n", "first").select(F.col("cid").alias("a"), F.col("m").alias("b"))


def least_ids(comps: DataFrame, classes: DataFrame) -> DataFrame:
    """node, least: the smallest first_id of the classes (cid, first_id) in the component of each node of comps."""
    of = comps.join(classes.select("cid", "first_id"), F.col("node") == F.col("cid")).select("node", "component", "first_id")
    low = of.groupBy(F.col("component").alias("c")).agg(F.min("first_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_hot(of, low, "component", "c", "n", "least").select("node", "least")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n local nodes the smallest node that the links i-j connect it with."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root
