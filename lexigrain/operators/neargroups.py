"""Near duplicates by groups: members of a tight group are known pairs, so n copies make rows in proportion to n.

Unit vectors lie on a sphere, where angles keep the triangle inequality. A group is a pivot and rows within half the link angle
of it, so any two members are near. Two groups whose pivots' angle and radii add up to less than the link angle are near in
all pairs; where the angle less the radii is beyond it, in none. Only what lies between is listed as pairs of rows.
Results are exact and don't depend on how the groups were chosen; null ids link with nothing, texts without words have no vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import dropped, written
from . import packed

#: Radians that two angles may differ by rounding, far above the error of an arc cosine of sums of doubles near 1.
SLACK = 1e-6


class NearGroups(NamedTuple):
    """nodes: doc, grp of each row that may have a link (rows apart from groups are their own). sure: g, h, both ways and g = h
    for a group of several, all of whose pairs are near. pairs: i < j, cosine, the other near pairs, a row each."""

    nodes: DataFrame
    sure: DataFrame
    pairs: DataFrame


def _angle(cosine):
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def _keys(v: packed.Packed, keys: int) -> DataFrame:
    """doc, k, h: the least hash of a row's terms, for each of several hashes."""
    schema = v.rows.select("doc", F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")).schema
    odd = np.random.default_rng(42).integers(1 << 62, 1 << 63, (keys, 2), dtype="u8") | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, heads = b.column("ids").flatten().to_numpy().astype("u8"), b.column("ids").offsets.to_numpy()
            heads = heads[:-1] - heads[0]
            for k, (p, q) in enumerate(odd):
                x = (ids + np.uint64(1)) * p
                x = (x ^ (x >> np.uint64(29))) * q >> np.uint64(1)
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.full(b.num_rows, k, "i4")), pa.array(np.minimum.reduceat(x, heads).astype("i8"))], ["doc", "k", "h"])

    return v.rows.where((F.size("ids") > 0) & F.col("doc").isNotNull()).select("doc", "ids").mapInArrow(run, schema)


def tight_groups(v: packed.Packed, sketch: packed.Sketches | None, above: float = 0.9, keys: int = 4, rounds: int = 2) -> DataFrame:
    """doc, grp, a: rows within half the link angle of a pivot (a = 0, its doc names the group); others have no row.

    A row tries the first rows that share one of its min-hash keys of terms, so there are at most `keys` tries for each row
    and round. The smallest pivot within reach takes it.
    """
    radius = math.acos(above) / 2 - SLACK
    open_ = written(_keys(v, keys), "keys")
    found = []
    for _ in range(rounds):
        leaders = open_.groupBy(F.col("k").alias("lk"), F.col("h").alias("lh")).agg(F.min("doc").alias("i"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        tries = open_.join(leaders, (F.col("k") == F.col("lk")) & (F.col("h") == F.col("lh"))).where("i < doc").select("i", F.col("doc").alias("j"))
        near = written(packed.cosines(packed.sketched(tries, sketch, math.cos(radius)), v).select("i", "j", _angle(F.col("cosine")).alias("a")).where(F.col("a") <= radius), "tight")
        taken = near.select(F.col("j").alias("_t")).distinct()
        mine = near.join(taken, F.col("i") == F.col("_t"), "left_anti").groupBy("j").agg(F.min(F.struct("i", "a")).alias("m")).select(F.col("j").alias("doc"), F.col("m.i").alias("grp"), F.col("m.a").alias("a"))
        mine = written(mine, "members")
        pivots = mine.select("grp").distinct().select(F.col("grp").alias("doc"), "grp", F.lit(0.0).alias("a"))
        found.append(mine.unionByName(pivots))
        open_ = open_.join(found[-1].select(F.col("doc").alias("_d")), F.col("doc") == F.col("_d"), "left_anti")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return written(out, "groups")


def near_groups(v: packed.Packed, above: float = 0.9) -> NearGroups:
    """The links of vectors with a cosine above the bound (0.5 to 1), as groups and pairs; see NearGroups."""
    theta, sketch = math.acos(above), packed.sketches(v)
    members = tight_groups(v, sketch, above)
    radii = written(members.groupBy(F.col("grp").alias("r_grp")).agg(F.max("a").alias("r")), "radii")
    placed = packed.prefixes(v, above).join(members.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d"), "left").drop("_d")
    placed = written(placed, "placed")
    listed = packed.cosines(packed.candidates(placed.where("grp IS NULL").select("term", "doc", "rest"), sketch, above), v, above)
    prefix = placed.select("doc", "term", F.coalesce("grp", "doc").alias("g"), F.coalesce("a", F.lit(0.0)).alias("a"), F.col("grp").isNotNull().alias("many"))
    groups = prefix.select("term", F.col("g").alias("doc"), "many").distinct()
    met = packed.candidates(groups, sketch and sketch.reaching(radii, "r_grp", "r"), above, groups=True)
    apart = met.join(packed.cosines(met, v).withColumnsRenamed({"i": "_i", "j": "_j"}), (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left")
    apart = apart.select("i", "j", _angle(F.coalesce("cosine", F.lit(0.0))).alias("apart"))
    for side in "ij":
        apart = apart.join(radii.select(F.col("r_grp").alias("_g"), F.col("r").alias(f"r{side}")), F.col(side) == F.col("_g"), "left").drop("_g")
    reach = F.coalesce("ri", F.lit(0.0)) + F.coalesce("rj", F.lit(0.0))
    apart = written(apart.select("i", "j", "apart", reach.alias("reach")).where(F.col("apart") - F.col("reach") <= theta + SLACK), "apart")
    all_near = F.col("apart") + F.col("reach") < theta - SLACK

    # between two groups that are near in part: rows that share a prefix term, bounded by their own angles
    part = apart.where(~all_near).select("i", "j", "apart")
    rows = prefix.select("doc", "term", "g", "a")
    left, right = (
        rows.withColumnsRenamed({"doc": f"d{s}", "a": f"a{s}"}).join(part.withColumnsRenamed({"i": "gi", "j": "gj"}), F.col("g") == F.col(f"g{s}")).drop("g", *(["apart"] if s == "j" else []))
        for s in "ij"
    )
    both = left.join(right, ["gi", "gj", "term"]).where(F.col("apart") - F.col("ai") - F.col("aj") <= theta + SLACK)
    some = packed.sketched(both.select(F.least("di", "dj").alias("i"), F.greatest("di", "dj").alias("j")), sketch, above)
    pairs = written(listed.unionByName(packed.cosines(some, v, above)), "pairs")
    dropped(placed, met)

    linked = apart.where(all_near).select(F.col("i").alias("g"), F.col("j").alias("h"))
    own = radii.select(F.col("r_grp").alias("g"), F.col("r_grp").alias("h"))
    sure = written(linked.unionByName(linked.select(F.col("h").alias("g"), F.col("g").alias("h"))).unionByName(own), "sure")
    alone = pairs.select(F.col("i").alias("doc")).union(pairs.select("j")).union(sure.select("h")).distinct().join(members.select(F.col("doc").alias("_d")), F.col("doc") == F.col("_d"), "left_anti")
    return NearGroups(written(members.select("doc", "grp").unionByName(alone.select("doc", F.col("doc").alias("grp"))), "nodes"), sure, pairs)


def link_counts(found: NearGroups) -> DataFrame:
    """doc, grp, n_near: each row with a near one, its group and the number of rows near it, without listing the pairs of groups."""
    sizes = found.nodes.groupBy(F.col("grp").alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    around = found.sure.join(sizes, F.col("h") == F.col("_g")).groupBy("g").agg(F.sum(F.col("n") - F.when(F.col("g") == F.col("h"), 1).otherwise(0)).alias("n_sure"))
    single = found.pairs.select(F.col("i").alias("d")).union(found.pairs.select("j")).groupBy("d").agg(F.count(F.lit(1)).alias("n_pairs"))
    joined = found.nodes.join(around, F.col("grp") == F.col("g"), "left").join(single, F.col("doc") == F.col("d"), "left")
    return joined.select("doc", "grp", (F.coalesce("n_sure", F.lit(0)) + F.coalesce("n_pairs", F.lit(0))).alias("n_near")).where("n_near > 0")


def greedy_removal(found: NearGroups, v: packed.Packed) -> DataFrame:
    """j, i, cosine: each row that goes and the first kept row that removes it, scanning rows in order.

    A row goes if a kept row before it is near; what has gone removes nothing. A round keeps the rows with no undecided near
    row before them: of groups only the first undecided row is looked at, and their rows go together. Rounds are tables in the
    shared folder, as many as the longest chain needs.
    """
    nodes, sure, edges = found.nodes, found.sure, found.pairs.select("i", "j")
    open_, kept = nodes, written(nodes.limit(0), "kept")
    while not open_.isEmpty():
        first = open_.groupBy("grp").agg(F.min("doc").alias("m"))
        before = sure.join(first, F.col("h") == F.col("grp")).groupBy("g").agg(F.min("m").alias("m"))
        free = open_.join(before, F.col("grp") == F.col("g"), "left").where(F.col("m").isNull() | (F.col("doc") <= F.col("m"))).select("doc", "grp")
        now = written(free.join(edges.select(F.col("j").alias("_j")).distinct(), F.col("doc") == F.col("_j"), "left_anti"), "now")
        groups = sure.join(now, F.col("g") == F.col("grp"), "left_semi").select("h").distinct()
        rows = edges.join(now, F.col("i") == F.col("doc"), "left_semi").select("j").distinct()
        left = open_.join(now.select(F.col("doc").alias("_n")), F.col("doc") == F.col("_n"), "left_anti")
        open_ = written(left.join(groups, F.col("grp") == F.col("h"), "left_anti").join(rows, F.col("doc") == F.col("j"), "left_anti"), "open")
        for side in "ij":
            edges = edges.join(open_.select(F.col("doc").alias("_o")), F.col(side) == F.col("_o"), "left_semi")
        edges, kept = written(edges, "edges"), written(kept.unionByName(now), "kept")
    gone = written(nodes.join(kept.select(F.col("doc").alias("_k")), F.col("doc") == F.col("_k"), "left_anti"), "gone")
    # two kept rows are never near, so of a group's kept neighbours the first is the one that matters
    by_group = sure.join(kept.select(F.col("doc").alias("i"), "grp"), F.col("h") == F.col("grp")).groupBy("g").agg(F.min("i").alias("i"))
    groups = gone.join(by_group, F.col("grp") == F.col("g")).where("i < doc").select(F.col("doc").alias("j"), "i")
    rows = found.pairs.join(kept, F.col("i") == F.col("doc"), "left_semi").join(gone, F.col("j") == F.col("doc"), "left_semi").select("j", "i")
    first = written(groups.unionByName(rows).groupBy("j").agg(F.min("i").alias("i")), "first")
    return packed.cosines(first, v).select("j", "i", F.round("cosine", 3).alias("cosine"))


def word_vectors(df: DataFrame, row: str = "row_id", key: str = "text_norm") -> packed.Packed:
    """TF-IDF vectors of the lower-case words of a text column; none for null and texts without words."""
    words = F.regexp_extract_all(F.coalesce(key, F.lit("")), F.lit(f"[{tx.WORD}]+"), F.lit(0))
    return packed.packed(df, row, F.transform(words, lambda t: F.lower(t)))


def dedup_near(df: DataFrame, row: str = "row_id", key: str = "text_norm", above: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """df without rows near an earlier kept one (TF-IDF cosine of words), and what was removed: j, i, cosine."""
    vectors = word_vectors(df, row, key)
    removed = written(greedy_removal(near_groups(vectors, above), vectors), "removed")
    return df.join(removed.select(F.col("j").alias("_gone")), F.col(row) == F.col("_gone"), "left_anti"), removed
