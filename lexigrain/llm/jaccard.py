"""N-gram Jaccard join by chosen paths: documents whose sets of word shingles have a similarity of at least 0.8.

Documents with one shingle set are one class. Each class has a signature of min-hashes; a run splits classes again and
again on sampled signature places with equal values (a path), compares those that share a bucket once it is small, and
runs with other samples follow until a pair at the threshold is found with the target probability.

Splitting cannot break up a group of near copies, so such a group is settled where it is first met: in each bucket of the
first split every class is compared with the bucket's smallest class, and the components of these links are groups. A
bucket of one group is done. In any other only pairs across groups are open: where few classes are outside the bucket's
largest group they are compared with all others, in parts, and the bucket is done too; else it is split on.

What is compared at first are signatures; pairs that come near connect classes to clusters, and in a cluster all pairs
are verified exactly on the full shingle sets of whole texts. Links are counted where they are found, never listed. Large
clusters are cut into tiles; their members that differ from the cluster's first class in so little that any two of them
must link are counted together without being compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import discard, join_hot, small_batches, written

WIDTH = 5
PLACES = 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of texts; words are remembered up to a limit."""

    def __init__(self, width: int = WIDTH, limit: int = 200_000):
        self.width, self.limit, self.known = width, limit, {}

    def words(self, text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and [\\x20\\x09-\\x0D]
        known = self.known
        new = [w for w in set(tokens) if w not in known]
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(tokens)
            for w in new:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.asarray([known[w] for w in tokens], dtype="u8")

    def shingles(self, text: str | None) -> np.ndarray:
        """Texts of 1 to width - 1 words have one shingle of all their words; null and texts without words have none."""
        w = self.words(text or "")
        if not len(w):
            return w
        n = max(1, len(w) - self.width + 1)
        h = np.full(n, np.uint64(min(len(w), self.width)))
        for k in range(min(self.width, len(w))):
            h = mixed(h * MIX[0] + w[k : k + n])
        return np.unique(h)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A min-hash of 64 bits at each of len(seeds) places (a power of two): a fast similarity sketch.

    In each round every shingle falls into one place, whose value is the least of its hashes in the first round that
    brings any. Round 0 uses the sorted hashes themselves; long texts end after two rounds. After as many rounds as
    places, a place that is still empty takes the least hash of all shingles, so signatures of any two sets compare.
    """
    places = len(seeds)
    shift = np.uint64(64 - (places.bit_length() - 1))
    starts = np.arange(places, dtype="u8") << shift
    at = np.minimum(np.searchsorted(shingles, starts), len(shingles) - 1)
    out = shingles[at]
    empty = (out >> shift) != np.arange(places, dtype="u8")
    for r in range(1, places):
        if not empty.any():
            break
        h = mixed(shingles ^ seeds[r])
        place = (h >> shift).astype("i8")
        fits = empty[place]
        h, place = h[fits], place[fits]
        order = np.argsort(h)
        filled, first = np.unique(place[order], return_index=True)
        out[filled] = h[order][first] + np.uint64(r)
        empty[filled] = False
    for k in np.flatnonzero(empty):
        out[k] = mixed(shingles ^ ~seeds[k]).min()
    return mixed(out)


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a bucket of each depth with probability `recall`.

    A node's children are Poisson places, 1 / threshold of them on average, and a place agrees with probability
    threshold: a critical branching process, whose survival is 1 - exp(-survival of one level less).
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _spread(places: int) -> np.ndarray:
    return mixed(np.arange(1, places + 1, dtype="u8") * MIX[1])


def _sampled(path: np.ndarray, threshold: float, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of path, place) of the places that each node samples: each with probability 1 / (threshold * places).

    They depend on the path alone, so all classes of a node share them.
    """
    limit = np.uint64(min(int(2**64 / (threshold * places)), 2**64 - 1))
    return np.nonzero(mixed(path[:, None] ^ _spread(places)) < limit)


def _describe(docs: DataFrame, places: int, runs: int, threshold: float) -> DataFrame:
    """doc_id, set_hash (16 bytes, null without shingles), sig (16 bits for each place), paths: reads whole texts once.

    paths are the children of the runs' roots, the first split: by 64 bits of the sampled places' values.
    """
    seeds, at = mixed(np.arange(1, places + 1, dtype="u8")), _spread(places)
    roots = mixed(np.arange(1, runs + 1, dtype="u8") * MIX[2])
    run_of, place = _sampled(roots, threshold, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, start = Shingler(), mixed(roots[run_of] + at[place])
        for b in batches:
            keys, sigs, paths = [], [], []
            for text in b.column("text").to_pylist():
                s = shingler.shingles(text)
                if not len(s):
                    keys, sigs, paths = [*keys, None], [*sigs, None], [*paths, None]
                    continue
                sig = signature(s, seeds)
                keys.append(_hash(s))
                sigs.append((sig >> np.uint64(48)).astype("<u2").tobytes())
                paths.append(mixed(start + sig[place]).view("i8"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "set_hash", "sig", "paths"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, set_hash binary, sig binary, paths array<long>")


def _met(rows: DataFrame, least: int, places: int) -> DataFrame:
    """path, cid, rep, near, sig: whether a class's signature agrees with its bucket's representative's in `least` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rep = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, places) for c in ("sig", "rep_sig"))
            near = np.count_nonzero(own == rep, axis=1) >= least
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("cid"), b.column("rep"), pa.array(near), b.column("sig")], ["path", "cid", "rep", "near", "sig"])

    return rows.select("path", "cid", "rep", "sig", "rep_sig").mapInArrow(run, "path long, cid long, rep long, near boolean, sig binary")


def _children(nodes: DataFrame, threshold: float, places: int) -> DataFrame:
    """path, cid, comp, sig one level deeper than nodes: classes split by their values at sampled places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _spread(places)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, places)
            path = b.column("path").to_numpy(zero_copy_only=False).view("u8")
            row, place = _sampled(path, threshold, places)
            child = mixed(mixed(path[row] + at[place]) + sig[row, place])
            same = [b.column(c).take(pa.array(row)) for c in ("cid", "comp", "sig")]
            yield pa.RecordBatch.from_arrays([pa.array(child.view("i8")), *same], ["path", "cid", "comp", "sig"])

    return nodes.select("path", "cid", "comp", "sig").mapInArrow(run, "path long, cid long, comp long, sig binary")


def _open(rows: DataFrame) -> DataFrame:
    """rows(path, cid, comp, sig) of buckets with two groups or more, with core (in the bucket's largest group), n_core, n_rest."""
    by_group = rows.groupBy("path", "comp").agg(F.count(F.lit(1)).alias("n"))
    by_path = by_group.groupBy(F.col("path").alias("p")).agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"))
    buckets = by_path.select("p", "size", F.col("top.comp").alias("top"), F.col("top.n").alias("n_core"), (F.col("size") - F.col("top.n")).alias("n_rest")).where("n_rest > 0")
    joined = join_hot(rows, buckets, "path", "p", "size", "buckets")
    return joined.select("path", "cid", "comp", "sig", (F.col("comp") == F.col("top")).alias("core"), "n_core", "n_rest")


def _tiled(rows: DataFrame, tile: int, spread: Column) -> DataFrame:
    """rows, whose group has n_core rows that are core and n_rest others, with low and high (the parts that a tile has) and own.

    A group of up to `tile` rows has one tile. In a larger one core rows and others are cut into parts of about `tile`
    rows, and there is a tile for each pair of parts of which one at least isn't core: all pairs meet but those within
    the core, and a task gets two parts at most.
    """
    one = F.col("n_core") + F.col("n_rest") <= tile
    p_core = F.when(one, 0).otherwise(F.ceil(F.col("n_core") / tile)).cast("int")
    p_rest = F.when(one, 1).otherwise(F.ceil(F.col("n_rest") / tile)).cast("int")
    part = lambda n: F.pmod(spread, F.greatest(n, F.lit(1))).cast("int")
    own = F.when(one, 0).when(F.col("core"), part(p_core)).otherwise(p_core + part(p_rest))
    first = F.when(F.col("core"), p_core).otherwise(0)
    with_parts = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, p_core + p_rest - 1)))
    return with_parts.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], cols: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches by key: (key, lists of the columns)."""
    held, now = [[] for _ in cols], None
    for b in batches:
        for k, *row in zip(zip(*(b.column(c).to_pylist() for c in key), strict=True), *(b.column(c).to_pylist() for c in cols), strict=True):
            if k != now:
                if now is not None and held[0]:
                    yield now, held
                held, now = [[] for _ in cols], k
            for h, x in zip(held, row, strict=True):
                h.append(x)
    if now is not None and held[0]:
        yield now, held


def _near_signatures(tiles: DataFrame, least: int, places: int) -> DataFrame:
    """a, b: a forest that connects the classes of a tile whose signatures agree in at least `least` places.

    Pairs of one group and pairs within the core are left out. Rows come sorted by tile, the core last. A batch's tiles
    are compared together, each row with those up to the longest tile after it; a tile has two parts at most.
    """

    def links(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, comp: np.ndarray, core: np.ndarray) -> pa.RecordBatch:
        found_i, found_j = [np.empty(0, dtype="i8")], [np.empty(0, dtype="i8")]
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        ends = np.repeat(np.append(start[1:], len(ids)), np.diff(np.append(start, len(ids))))
        left = np.where(core, 0, ends - np.arange(len(ids)) - 1)  # rows of the tile that follow
        d = 1
        while len(at := np.flatnonzero(left >= d)):
            at = at[comp[at] != comp[at + d]]
            near = at[np.count_nonzero(sig[at] == sig[at + d], axis=1) >= least]
            found_i.append(near)
            found_j.append(near + d)
            d += 1
        root = graph.forest(len(ids), np.concatenate(found_i), np.concatenate(found_j))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            cid, comp, core = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "comp", "core"))
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in keys], 1)
            now = [key, cid, np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, places), comp, core]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.flatnonzero((now[0] != now[0][-1]).any(1))[-1]) + 1 if (now[0][0] != now[0][-1]).any() else 0
            if cut:
                yield links(*[x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if rest is not None and len(rest[0]):
            yield links(*rest)

    keys = ["path", "low", "high"]
    dealt = tiles.select(*keys, "cid", "comp", "core", "sig").repartition(*keys).sortWithinPartitions(*keys, "core", "cid")
    return dealt.mapInArrow(run, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted sets, all of left with all of right (or of left itself).

    Incidence matrices of some columns at a time are multiplied.
    """
    sets, n = left + (right or []), len(left)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n if right is None else len(right)), dtype="f4")
    for a in range(0, int(shared.sum()), columns):
        s, e = np.searchsorted(column, [a, a + columns])
        x = np.zeros((len(sets), columns), dtype="f4")
        x[owner[s:e], column[s:e] - a] = 1
        out += x[:n] @ (x if right is None else x[n:]).T
    return out.astype("i8")


def _hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(texts: DataFrame) -> DataFrame:
    """cid, cluster, size, copies, shingles (8 bytes each) of texts(key, text, ...) whose shingles have that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            sets = [shingler.shingles(t) for t in b.column("text").to_pylist()]
            own = [k for k, (s, h) in enumerate(zip(sets, b.column("key").to_pylist(), strict=True)) if _hash(s) == h]
            same = [b.column(c).take(pa.array(own, pa.int64())) for c in ("cid", "cluster", "size", "copies")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([sets[k].tobytes() for k in own], pa.binary())], ["cid", "cluster", "size", "copies", "shingles"])

    slim = texts.select("key", "text", "cid", "cluster", "size", "copies")
    return slim.mapInArrow(run, "cid long, cluster long, size long, copies long, shingles binary")


def _cores(sets: DataFrame, percent: int, part: int = 4096) -> DataFrame:
    """sets of large clusters with core: any two core members of a cluster link.

    The cluster's first class is the pivot p. Two sets share at least |a and p| + |b and p| - |p| shingles, so they link
    if twice the least that each brings, less its share of what a link takes, isn't negative for either. Parts of a
    cluster meet a copy of its pivot each.
    """
    parts = F.ceil(F.col("size") / part).cast("int")
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).withColumn("member", F.lit(True))
    pivots = sets.where("cid = cluster").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("member", F.lit(False))
    both = dealt.unionByName(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, dtype="<u8")
        for b in batches:
            keep, core = [], []
            for k, (member, raw) in enumerate(zip(b.column("member").to_pylist(), b.column("shingles").to_pylist(), strict=True)):
                s = np.frombuffer(raw, "<u8")
                if not member:
                    pivot = s
                    continue
                at = np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)
                common = int(np.count_nonzero(pivot[at] == s))
                keep.append(k)
                core.append((100 + percent) * (2 * common - len(pivot)) >= 2 * percent * len(s))
            same = [b.column(c).take(pa.array(keep, pa.int64())) for c in ("cid", "cluster", "copies", "shingles")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(core, pa.bool_())], ["cid", "cluster", "copies", "shingles", "core"])

    keys = ["cluster", "part"]
    sorted_ = both.select(*keys, "member", "cid", "copies", "shingles").repartition(*keys).sortWithinPartitions(*keys, "member")
    return sorted_.mapInArrow(run, "cid long, cluster long, copies long, shingles binary, core boolean")


def _verified(tiles: DataFrame, percent: int) -> DataFrame:
    """cid, links, root: links of each class within a tile, copies counted, from the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), (cids, copies, own, raw) in _groups(batches, ["cluster", "low", "high"], ["cid", "copies", "own", "shingles"]):
            sets = [np.frombuffer(x, "<u8") for x in raw]
            ids, n, part, size = np.asarray(cids), np.asarray(copies), np.asarray(own), np.asarray([len(s) for s in sets])
            a, b = np.flatnonzero(part == low), np.flatnonzero(part == high)
            if not len(a) or not len(b) or len(ids) < 2:
                continue
            both = common_counts([sets[k] for k in a], None if low == high else [sets[k] for k in b])
            linked = (100 + percent) * both >= percent * (size[a][:, None] + size[b][None, :])
            if low == high:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(ids), dtype="i8")
            links[a] = linked @ n[b]
            if low != high:
                links[b] = linked.T @ n[a]
            i, j = np.nonzero(linked)
            root = graph.forest(len(ids), a[i], b[j])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["cid", "links", "root"])

    keys = ["cluster", "low", "high"]
    sorted_ = tiles.select(*keys, "cid", "copies", "own", "shingles").repartition(*keys).sortWithinPartitions(*keys, "cid")
    return sorted_.mapInArrow(run, "cid long, links long, root long")


def _candidates(classes: DataFrame, threshold: float, depth: int, bucket: int, tile: int, least: int, places: int) -> DataFrame:
    """node, component: clusters of the classes (cid, sig, paths) whose signatures come near in some bucket."""
    sigs = classes.select(F.col("cid").alias("s_cid"), F.col("sig"))
    first = classes.select(F.explode("paths").alias("path"), "cid")
    heads = first.groupBy(F.col("path").alias("p")).agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("rep")).where("size > 1")
    heads = heads.join(sigs.withColumnRenamed("sig", "rep_sig"), F.col("rep") == F.col("s_cid")).drop("s_cid")
    shared = join_hot(first, heads, "path", "p", "size", "heads").join(sigs, F.col("cid") == F.col("s_cid"))
    met = written(_met(shared, least, places), "met")
    groups = written(graph.components(met.where("near").select(F.col("cid").alias("a"), F.col("rep").alias("b"))), "groups")
    marked = met.join(groups, F.col("cid") == F.col("node"), "left").select("path", "cid", F.coalesce("component", "cid").alias("comp"), "sig")
    found, used = groups.select(F.col("node").alias("a"), F.col("component").alias("b")), [met]
    for level in range(depth):
        live = written(_open(marked), "live")
        used.append(live)
        last = level == depth - 1
        done = F.lit(True) if last else (F.col("n_core") + F.col("n_rest") <= bucket) | (F.col("n_rest") <= bucket)
        tiles = _tiled(live.where(done), 8 * tile, F.xxhash64("cid"))
        found = found.unionByName(_near_signatures(tiles, least, places))
        if not last:
            marked = written(_children(live.where(~done), threshold, places), "nodes")
            used.append(marked)
    clusters = written(graph.components(found), "clusters")
    discard(*used)
    return clusters


def _links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int, tile: int, repeated: bool) -> DataFrame:
    """cid, links, root: exact links of the classes, summed in parts."""
    sizes = written(clusters.groupBy(F.col("component").alias("cluster")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    of = join_hot(clusters, sizes, "component", "cluster", "size", "sizes").join(classes.select("cid", "key", "copies", "first_id"), F.col("node") == F.col("cid"))
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").cast("string").alias("text"))
    sets = _sets(texts.hint("merge").join(of, F.col("t_id") == F.col("first_id")))  # the same plan at every size
    sets = written(sets.dropDuplicates(["cid"]) if repeated else sets, "sets")
    small = sets.where(F.col("size") <= tile).withColumn("own", F.lit(0)).withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    if sizes.where(F.col("size") > tile).isEmpty():
        checked = written(_verified(small, percent), "checked")
        discard(sets, sizes)
        return checked
    large = written(_cores(sets.where(F.col("size") > tile), percent), "large")
    n = lambda cond: F.count_if(cond)
    counts = large.groupBy(F.col("cluster").alias("c")).agg(
        n(F.col("core")).alias("n_core"), n(~F.col("core")).alias("n_rest"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("w_core"), F.count(F.lit(1)).alias("n")
    )
    marked = join_hot(large, counts, "cluster", "c", "n", "counts")
    settled = marked.where("core").select("cid", (F.col("w_core") - F.col("copies")).alias("links"), F.col("cluster").alias("root"))
    tiles = _tiled(marked.where("n_rest > 0"), tile, F.xxhash64("cid")).select(*small.select("cluster", "low", "high", "cid", "copies", "own", "shingles").columns)
    tiles = tiles.unionByName(small.select(*tiles.columns))
    checked = written(_verified(tiles, percent).unionByName(settled), "checked")
    discard(sets, sizes, large)
    return checked


def near_duplicates(
    docs: DataFrame, percent: int = 80, recall: float = 0.999, depth: int = 3, bucket: int = 256, tile: int = 512, places: int = PLACES
) -> DataFrame:
    """doc_id, class_id, n_links, kept for docs(doc_id, text): one row for each input row.

    Two rows link if the Jaccard similarity of their sets of 5-word shingles (A-Z lower-cased, whole texts) is at least
    percent / 100. n_links is the number of other rows linked directly, copies counted. class_id is the smallest doc_id
    reachable by links, where rows that share a doc_id are one node, and kept says that it is the row's own. Texts of 1
    to 4 words have one shingle; null and texts without words link with nothing. A null doc_id links with nothing, has a
    null class and isn't kept. Ties can't arise: nothing is ranked. An empty table gives no rows. Extra columns are left
    out.
    """
    threshold = percent / 100
    runs = runs_needed(threshold, recall, depth)
    least = max(1, int(places * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / places))))
    described = written(_describe(docs, places, runs, threshold), "signatures")
    member = F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()
    rows = described.where(member).select(F.col("doc_id").alias("id"), F.col("set_hash").alias("key"))
    grouped = described.where(member).groupBy(F.col("set_hash").alias("key"))
    classes = grouped.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    repeated = not rows.groupBy("id").count().where("count > 1").isEmpty()
    same = graph.same_id_links(rows, classes) if repeated else None
    clusters = _candidates(classes, threshold, depth, bucket, tile, least, places)
    checked = _links(docs, classes, clusters, percent, tile, repeated)
    edges = checked.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    comps = written(graph.components(edges if same is None else edges.unionByName(same)), "components")
    sums = checked.groupBy(F.col("cid").alias("c_id")).agg(F.sum("links").alias("links"))
    known = classes.select(F.col("key").alias("k"), "cid", "copies", "first_id").join(sums, F.col("cid") == F.col("c_id"), "left")
    known = known.join(graph.least_ids(comps, classes), F.col("cid") == F.col("node"), "left")
    known = known.select("k", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "first_id").alias("c"))
    out = join_hot(rows, known, "key", "k", "copies", "known").select(F.col("id").alias("doc_id"), F.col("c").alias("class_id"), F.col("n").cast("long").alias("n_links"))
    discard(classes, clusters, checked, comps)  # what is known of the classes is a table of its own
    alone = described.where(~member).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
