"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on leading principal dimensions and sorted by the cells of a grid whose side is the link
distance. The sorted sequence is cut into blocks, and runs of blocks are groups, all with bounding boxes in the projection
and the length of what it leaves out. Pairs of intervals (ranges, groups, blocks, then halves of blocks) are joined
recursively, and a pair whose boxes are farther apart than the link distance is skipped: neither projections nor lengths
of remainders bring vectors farther apart than they are, so no link is lost. What is left is compared exactly in double
precision. A task joins two groups, so a block travels once for each pair of groups and not for each pair of blocks.
Equal vectors are one class from the start. The basis comes from a bounded sample and decides speed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import discard, join_hot, small_batches, written

#: Rounding in projections and distances.
SLACK = 1e-6
LEAF = 128
#: Blocks of a group, and the most bytes of a block.
GROUP = 16
BLOCK_BYTES = 2 << 20


def principal_axes(sample: np.ndarray, dims: int) -> np.ndarray:
    """(width, dims) orthonormal leading axes of the sample's second moments."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1][:, :dims]


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype("f8")
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(embedding: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key) of all vectors, key null where nothing can link, and one row for each class of equal vectors."""
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string"), "embedding", ok.alias("ok"))
    key = F.when(F.col("ok"), F.struct(F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2")))
    keyed = keyed.select("id", key.alias("key"), "label", "embedding")
    grouped = keyed.where(F.col("key").isNotNull()).groupBy("key")
    classes = grouped.agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    return keyed.select("id", "key"), classes.withColumn("cid", F.monotonically_increasing_id())


def _axes_by_width(classes: DataFrame, dims: int, sample_rows: int) -> dict[int, np.ndarray]:
    rows = classes.select("embedding", F.xxhash64("key").alias("o")).orderBy("o").limit(sample_rows).select("embedding").collect()
    by_width: dict[int, list] = {}
    for r in rows:
        by_width.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return {w: principal_axes(_unit(np.asarray(v)), dims) for w, v in by_width.items()}


def projected(unit: np.ndarray, axes: dict[int, np.ndarray], dims: int) -> np.ndarray:
    """(rows, dims + 1): places on the axes, zeros where there are fewer, and the length of what they leave out."""
    width = unit.shape[1]
    own = unit @ axes.get(width, np.eye(width)[:, :dims])
    out = np.zeros((len(unit), dims + 1))
    out[:, : own.shape[1]] = own
    out[:, dims] = np.sqrt(np.maximum(0, 1 - (own * own).sum(1)))
    return out


def _grid(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, dims: int) -> DataFrame:
    """label, width, cell, cid, copies, vector (bytes of doubles) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding").to_pylist()
            cells, raw = [], []
            for width in dict.fromkeys(map(len, lists)):
                at = [i for i, x in enumerate(lists) if len(x) == width]
                unit = _unit(np.asarray([lists[i] for i in at]))
                cell = np.floor(projected(unit, axes, dims) / eps).astype("i4")
                cells += zip(at, cell.tolist(), strict=True)
                raw += zip(at, [x.tobytes() for x in unit], strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("label"), pa.array([len(x) for x in lists], pa.int32()), pa.array([c for _, c in sorted(cells)], pa.list_(pa.int32())),
                    b.column("cid"), b.column("copies"), pa.array([x for _, x in sorted(raw, key=lambda r: r[0])], pa.binary()),
                ],
                ["label", "width", "cell", "cid", "copies", "vector"],
            )

    slim = classes.select("label", "embedding", "cid", "copies")
    return slim.mapInArrow(run, "label string, width int, cell array<int>, cid long, copies long, vector binary")


def _blocks(grid: DataFrame, axes: dict[int, np.ndarray], dims: int, block: int) -> DataFrame:
    """The sequence in grid order cut into blocks: range, grp, block, label, width, low, high, cids, copies, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        key = None

        def cut() -> pa.RecordBatch:
            unit = np.frombuffer(b"".join(h[2] for h in held), "<f8").reshape(len(held), key[1])
            place = projected(unit, axes, dims)
            return pa.RecordBatch.from_pydict(
                {
                    "range": [part], "grp": [part << 32 | seq // GROUP], "block": [part << 32 | seq], "label": [key[0]], "width": pa.array([key[1]], pa.int32()),
                    "low": [place.min(0).tolist()], "high": [place.max(0).tolist()], "cids": [[h[0] for h in held]], "copies": [[h[1] for h in held]], "vectors": [unit.tobytes()],
                }
            )

        for b in batches:
            for label, width, cid, copies, vector in zip(*(b.column(c).to_pylist() for c in ("label", "width", "cid", "copies", "vector")), strict=True):
                if held and (key != (label, width) or len(held) >= max(1, min(block, BLOCK_BYTES // (8 * width)))):
                    yield cut()
                    held, seq = [], seq + 1
                key = label, width
                held.append((cid, copies, vector))
        if held:
            yield cut()

    order = ["label", "width", "cell", "cid"]
    schema = "range long, grp long, block long, label string, width int, low array<double>, high array<double>, cids array<long>, copies array<long>, vectors binary"
    return grid.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _near(eps: float, dims: int) -> Column:
    """Whether the boxes (low, high) and (low2, high2) are within eps of each other."""
    gap = lambda k: F.greatest(F.lit(0.0), F.get("low", F.lit(k)) - F.get("high2", F.lit(k)), F.get("low2", F.lit(k)) - F.get("high", F.lit(k)))
    return sum((gap(k) * gap(k) for k in range(dims + 1)), F.lit(0.0)) <= eps * eps


def _other(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c + "2") for c in df.columns])


def _tiles(blocks: DataFrame, eps: float, dims: int) -> DataFrame:
    """label, width, grp, grp2: pairs of groups that may hold links, ranges against ranges first; boxes only."""
    ends = lambda f, c: F.array(*[f(F.get(c, F.lit(k))) for k in range(dims + 1)]).alias(c)
    boxes = blocks.groupBy("label", "width", "range", "grp").agg(ends(F.min, "low"), ends(F.max, "high"))
    outer = boxes.groupBy("label", "width", "range").agg(ends(F.min, "low"), ends(F.max, "high"))
    same = (F.col("label") == F.col("label2")) & (F.col("width") == F.col("width2"))
    ranges = outer.join(_other(outer), same & (F.col("range") <= F.col("range2")) & _near(eps, dims)).select("label", "width", "range", "range2")
    first = ranges.join(boxes, ["label", "width", "range"]).select("label", "width", "grp", "low", "high", F.col("range2").alias("r2"))
    found = first.join(_other(boxes), same & (F.col("r2") == F.col("range2")))
    return found.where((F.col("grp") <= F.col("grp2")) & _near(eps, dims)).select("label", "width", "grp", "grp2")


def join_block(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine >= threshold between unit rows of a and b; pa_, pb: their projections.

    Halves both sequences until a pair of intervals is provably distant or small.
    """
    out_i, out_j, todo = [], [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        x, y = pa_[i0:i1], pb[j0:j1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= threshold)
            out_i.append(i + i0)
            out_j.append(j + j0)
            continue
        rows = [(i0, i1)] if i1 - i0 <= LEAF else [(i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)]
        cols = [(j0, j1)] if j1 - j0 <= LEAF else [(j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)]
        todo += [(*r, *c) for r in rows for c in cols]
    none = np.empty(0, dtype="i8")
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _links(tiles: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], threshold: float, eps: float, dims: int) -> DataFrame:
    """cid, links (vectors linked, copies counted), root (a class it is connected with): at most a row for each class of a tile."""
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def joined(tile: tuple, held: list[dict]) -> pa.RecordBatch:
        width, g1, g2 = tile
        sizes = np.cumsum([0, *(len(r["cids"]) for r in held)])
        ids, copies = (np.concatenate([np.asarray(r[c], dtype="i8") for r in held]) for c in ("cids", "copies"))
        units = [np.frombuffer(r["vectors"], "<f8").reshape(-1, width) for r in held]
        places = [projected(u, axes, dims) for u in units]
        found_i, found_j = [np.empty(0, dtype="i8")], [np.empty(0, dtype="i8")]
        for x, r in enumerate(held):
            for y, q in enumerate(held):
                if r["grp"] != g1 or q["grp"] != g2 or r["block"] > q["block"]:
                    continue
                i, j = join_block(units[x], units[y], places[x], places[y], threshold, eps)
                if x == y:
                    i, j = i[i < j], j[i < j]
                found_i.append(i + sizes[x])
                found_j.append(j + sizes[y])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        links = np.zeros(len(ids), dtype="i8")
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = graph.forest(len(ids), i, j)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                key = r["label"], r["width"], r["g1"], r["g2"]
                if key != now and held:
                    yield joined(now[1:], held)
                    held = []
                now = key
                held.append(r)
        if held:
            yield joined(now[1:], held)

    of = tiles.select(F.col("label").alias("l"), F.col("width").alias("w"), F.col("grp").alias("g1"), F.col("grp2").alias("g2"), F.explode(F.array_distinct(F.array("grp", "grp2"))).alias("g"))
    rows = of.join(blocks, (F.col("l") == F.col("label")) & (F.col("w") == F.col("width")) & (F.col("g") == F.col("grp")))
    key = ["label", "width", "g1", "g2"]
    dealt = rows.select(*key, "grp", "block", "cids", "copies", "vectors").repartition(*key).sortWithinPartitions(*key, "block")
    return dealt.mapInArrow(run, "cid long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, dims: int = 8, block: int = 512, sample_rows: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors(vec_id, label, embedding): one row for each input row.

    Vectors with one label and one width link at cosine >= threshold; n_links counts other rows linked directly, equal
    vectors included; component_id is the smallest vec_id reachable by links, itself included, where rows that share a
    vec_id are one node; kept says that it is the row's own. Null, empty or zero vectors, ones with null or non-finite
    components, a null label or a null vec_id link with nothing (a null vec_id has a null component and isn't kept). An
    empty table gives no rows; other columns are left out.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    small_batches(vectors.sparkSession)
    rows, classes = _classes(vectors)
    rows, classes = written(rows, "vectors"), written(classes, "classes")
    member = F.col("key").isNotNull()
    axes = _axes_by_width(classes, dims, sample_rows)
    grid = written(_grid(classes, axes, eps, dims), "grid")
    blocks = written(_blocks(grid, axes, dims, block), "blocks")
    tiles = written(_tiles(blocks, eps, dims), "tiles")
    found = written(_links(tiles, blocks, axes, threshold, eps, dims), "found")
    discard(grid, blocks, tiles)
    edges = found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    same = graph.same_id_links(rows.where(member), classes)
    comps = written(graph.components(edges if same is None else edges.unionByName(same)), "components")
    sums = found.groupBy(F.col("cid").alias("s_cid")).agg(F.sum("links").alias("links"))
    known = classes.select("key", "cid", "copies", "first_id").join(sums, F.col("cid") == F.col("s_cid"), "left").join(graph.least_ids(comps, classes), F.col("cid") == F.col("node"), "left")
    known = known.select(F.col("key").alias("k"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "first_id").alias("c"))
    out = join_hot(rows.where(member), known, "key", "k", "copies", "known")
    discard(classes, found, comps)  # what is known of the classes is a table of its own
    out = out.select(F.col("id").alias("vec_id"), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where(~member).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
