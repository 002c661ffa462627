"""Merkle manifest of a dataset: a hash tree for each group of rows, one over the groups, and proofs by coordinates.

A leaf is the hash of a row's fields. Leaves of a group ascend by key; `ARITY` consecutive nodes, or fewer at the end, become
their hash until one is left, the subroot; the subroots, by group, become the root in the same way. A tree is kept as a table
of runs: (level, run) holds the digests of its nodes. A node's siblings are the others of its run, so a leaf's proof is found by
its coordinates alone: index and group size give a run for each level. The leaves of a lowest run ask for the same runs above
it, so they ask once: its coordinates are exploded, joined with the table of runs, ordered, concatenated and folded. The top
levels, which many ask for, are broadcast if they have at most BROADCAST_ROWS runs; levels below them have no hot run.
Only DataFrame functions; H is sha256 in lower-case hex of what is concatenated, digests as hex text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, join_hot, written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value; numbers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def folded(steps: Column, start: Column) -> Column:
    """The root from a leaf and steps, an array of struct(before, after): the siblings on both sides, concatenated."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def around(nodes: Column, position: Column) -> Column:
    """struct(before, after): the digests of a run before and after a position."""
    return F.struct(
        F.array_join(F.slice(nodes, F.lit(1), position), "").alias("before"),
        F.array_join(F.slice(nodes, position + 2, F.lit(ARITY)), "").alias("after"),
    )


def indexed(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df, written, with `index` from 0 within each group in the given order (nulls first), and the group's `size`.

    Rows are sorted by ranges, so a group may span many tasks. A row's place is its place in its partition and the rows of the
    partitions before; that of a group's first row is taken off. Rows that tie in everything are alike.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered")  # written, since ranges drawn anew for a second use need not be the same
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_before")))  # a row for each partition
    groups = ranged.groupBy(F.col(group).alias("_g")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("size"))
    first = F.col("_before") + F.col("_first").bitwiseAND((1 << 33) - 1)
    groups = groups.join(starts, F.shiftright("_first", 33) == F.col("_p")).select("_g", first.alias("_start"), "size")
    placed = ranged.withColumn("_part", part).join(starts, F.col("_part") == F.col("_p")).withColumn("_rank", F.col("_before") + place)
    joined = join_hot(placed.select(*df.columns, "_rank"), groups, group, "_g", "size", "groups")
    return joined.select(*df.columns, (F.col("_rank") - F.col("_start")).alias("index"), "size")


@dataclass
class Tree:
    """leaves: the rows with index and size; runs: group, level, run, n (nodes of its level), nodes; roots: group, size, root."""

    leaves: DataFrame
    runs: DataFrame
    roots: DataFrame
    levels: int


def tree(rows: DataFrame, order: Sequence[str]) -> Tree:
    """The trees of rows(group, digest, ...), one for each group; every level is a table, an eighth of the one below."""
    leaves = written(indexed(rows, "group", order), "leaves")
    most = leaves.agg(F.max("size")).first()[0] or 0
    level = leaves.select("group", F.col("index").alias("i"), F.col("size").alias("n"), F.col("digest").alias("h"))
    runs, ends, k = level.limit(0).selectExpr("group", "0 AS level", "i AS run", "n", "array(h) AS nodes"), level.where("n = 1"), 0
    while most > 1:
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        run = level.where("n > 1").groupBy("group", "n", F.expr(f"i div {ARITY}").alias("run")).agg(nodes.alias("nodes"))
        run = written(run.select("group", F.lit(k).alias("level"), "run", "n", "nodes"), "runs")
        level = run.select("group", F.col("run").alias("i"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.sha2(F.array_join("nodes", ""), 256).alias("h"))
        runs, ends, most, k = runs.unionByName(run), ends.unionByName(level.where("n = 1")), -(-most // ARITY), k + 1
    sizes = leaves.where("index = 0").select(F.col("group").alias("_g"), "size")
    roots = ends.join(sizes, F.col("group").eqNullSafe(F.col("_g"))).select("group", "size", F.col("h").alias("root"))
    return Tree(leaves, runs, written(roots, "roots"), k)


def coordinates(runs: DataFrame, levels: int) -> DataFrame:
    """group, run, level, up, position: what each lowest run asks for, a row for each level above it.

    From its number and its group's size n: at level l run div ARITY^l, where its own node has the place
    (run div ARITY^(l - 1)) mod ARITY, as long as ARITY^l < n.
    """
    power = F.array(*[F.lit(ARITY**k).cast("long") for k in range(levels + 1)])
    above = F.filter(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.get(power, k) < F.col("n"))
    each = runs.where("level = 0").select("group", "run", F.explode(above).alias("level")).withColumn("_up", F.get(power, F.col("level"))).withColumn("_down", F.get(power, F.col("level") - 1))
    return each.selectExpr("group", "run", "level", "run div _up AS up", f"int(run div _down % {ARITY}) AS position")


def siblings(t: Tree) -> DataFrame:
    """The columns of t's leaves and steps, an array of struct(before, after): each leaf's siblings, lowest level first."""
    lowest = t.runs.where("level = 0").select(F.col("group").alias("_g"), F.col("run").alias("_r"), "nodes")
    upper = t.runs.where("level > 0").select(F.col("group").alias("_ug"), F.col("level").alias("_ul"), F.col("run").alias("_ur"), "nodes")
    counts = dict(t.runs.groupBy("level").agg(F.count(F.lit(1))).collect())  # a row for each level
    low, total = t.levels, 0  # levels from low on are few runs in all
    while low > 1 and total + counts[low - 1] <= BROADCAST_ROWS:
        low, total = low - 1, total + counts[low - 1]
    asked = coordinates(t.runs, t.levels)
    same = F.col("group").eqNullSafe(F.col("_ug")) & (F.col("level") == F.col("_ul")) & (F.col("up") == F.col("_ur"))
    found = asked.where(F.col("level") >= low).join(F.broadcast(upper.where(F.col("_ul") >= low)), same)
    if low > 1:
        found = found.unionByName(asked.where(F.col("level") < low).join(upper.where(F.col("_ul") < low), same))
    step = F.struct("level", around(F.col("nodes"), F.col("position")).alias("step"))
    above = found.groupBy("group", "run").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["step"]).alias("above"))
    runs = lowest.join(above, F.col("_g").eqNullSafe(F.col("group")) & (F.col("_r") == F.col("run")), "left").select("_g", "_r", "nodes", "above")
    mine = t.leaves.withColumn("_run", F.expr(f"index div {ARITY}")).join(runs, F.col("group").eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r")), "left")
    none = F.array().cast(STEPS)
    first = F.array(around(F.col("nodes"), (F.col("index") % ARITY).cast("int")))
    steps = F.when(F.col("nodes").isNull(), none).otherwise(F.concat(first, F.coalesce("above", none)))
    return mine.select(*t.leaves.columns, steps.alias("steps"))


STEPS = "array<struct<before:string,after:string>>"


@dataclass
class Manifest:
    """Tables of a dataset's trees: groups has one for each group, top one over their roots."""

    groups: Tree
    top: Tree

    def root(self) -> str | None:
        """The dataset's root; null for no rows."""
        found = self.top.roots.first()
        return found["root"] if found else None

    def proofs(self) -> DataFrame:
        """The columns given to build() with group, digest, subroot, root and steps (an array of struct(before, after))."""
        one = self.top.roots.select(F.col("root"))
        top = siblings(self.top).crossJoin(F.broadcast(one)).select(F.col("key").alias("_top"), F.col("digest").alias("subroot"), F.col("steps").alias("_up"), "root", F.col("n").alias("_n"))
        both = join_hot(siblings(self.groups), top, "group", "_top", "_n", "subroots")
        return both.select(*[c for c in self.groups.leaves.columns if c not in ("index", "size")], "subroot", "root", F.concat("steps", "_up").alias("steps"))


def build(rows: DataFrame, order: Sequence[str]) -> Manifest:
    """The manifest of rows(group, digest, ...): rows of a group in the given order, groups in theirs, null first."""
    groups = tree(rows, [*order, "digest"])
    tops = groups.roots.select(F.lit(0).alias("group"), F.col("group").alias("key"), F.col("size").alias("n"), F.col("root").alias("digest"))
    return Manifest(groups, tree(tops, ["key"]))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: a leaf for each row, from its fields; rows of a group ascend by key, then by leaf.

    Null fields are part of a leaf (-), a null group is one of its own and comes first, as null keys do in a group. Rows
    that share a key are leaves of their own; equal rows are equal leaves next to each other, with proofs of their own.
    Columns of docs that aren't fields are ignored, whatever their names; keep names further columns of proofs().
    An empty table has no root and no proofs.
    """
    slim = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(n) for n, c in (keep or {}).items()])
    return build(written(slim, "leaves"), ["key"])


def verified_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents, some of them tampered with.

    Where 3 divides the crc32 of the decimal doc_id, the leaf is recomputed from a text whose A-Z are lower-cased and
    folded with the siblings of the untouched tree; verified tells whether that gives the root. Rows without a doc_id
    are never tampered with. See manifest() for nulls, repeated rows, clashing columns and empty tables.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    other = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    found = manifest(docs, keep={"tampered": F.when(hit, leaf(*other))}).proofs()
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    again = folded(F.col("steps"), F.coalesce("tampered", "digest"))
    out = found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
