"""Filters, the cleaning funnel and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Letters that only the language has, common words typed without marks, phrases of the shop's staff.
VI_LETTERS = "[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]"
VI_PLAIN = (
    "san pham sp tot rat may xai sai dung duoc dc hai long mua nhan vien giao lap dat gia khong ko k chua cung on qua lam nen minh toi em anh chi noi tu quat "
    "nhe voi cam on hoi thay moi biet ban phuc vu ho tro tuyet voi chat luong"
).split()
STAFF = "(?iU)^\\s*(?:dạ\\s*,?\\s*)?(?:điện máy xanh|đmx|dmx)\\s+(?:xin|rất|chân thành|cảm ơn)|quản trị viên"


def is_vietnamese(text: Column) -> Column:
    """A letter of the language, or a common word of it typed without marks."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return text.rlike("(?iu)" + VI_LETTERS) | F.arrays_overlap(plain, F.array(*[F.lit(w) for w in sorted(set(VI_PLAIN))]))


def is_staff_reply(text: Column) -> Column:
    """A greeting in the shop's name at the start, or the administrator's title anywhere."""
    return text.rlike(STAFF)


def is_blocked_page(html: Column, status: Column | None = None) -> Column:
    """A page that asks for a captcha or denies access."""
    words = F.lower(F.coalesce(html, F.lit(""))).rlike("captcha|access denied|are you a robot")
    return words if status is None else words | status.isin(403, 429)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], counter: str = "step") -> DataFrame:
    """df with the name of the first step that a row fails (null: it passes all): one pass for all steps."""
    first = F.lit(None).cast("string")
    for name, fails in reversed(steps):
        first = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(first)
    return df.withColumn(counter, first)


def funnel_counts(marked: DataFrame, steps: Sequence[str], counter: str = "step") -> DataFrame:
    """step, ord, dropped, remaining: each step's count among the rows that were still there."""
    spark = marked.sparkSession
    names = spark.createDataFrame([(k, s) for k, s in enumerate(["raw", *steps])], "ord int, step string")
    counts = written(marked.groupBy(F.coalesce(counter, F.lit("passed")).alias("s")).agg(F.count(F.lit(1)).alias("n")), "steps")  # a row for each step; used twice
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    joined = names.join(counts, F.col("step") == F.col("s"), "left").crossJoin(F.broadcast(total))
    dropped = F.coalesce("n", F.lit(0))
    upto = F.sum(dropped).over(Window.orderBy("ord"))  # over the steps
    return joined.select("step", "ord", dropped.alias("dropped"), (F.col("total") - upto).alias("remaining"))


def dedup_exact(df: DataFrame, key: str = "text_norm", label: str = "label_star", row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """One row for each key, and the keys whose labels tie.

    A single row stays. Of several, the first with the most frequent label stays; if the two most frequent labels are as
    frequent, all go. Null labels aren't counted, and a group of only null labels keeps its first row. Counts are summed before
    the shuffle and the rows of a group never meet. df is written first, as it is read twice.
    """
    df = written(df, "keyed")
    counts = df.groupBy(F.col(key).alias("k"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    votes = F.when(F.col("l").isNotNull(), F.col("n")).otherwise(0)
    groups = counts.groupBy("k").agg(
        F.sum("n").alias("rows"), F.min("first").alias("any_row"), F.max(F.struct(votes.alias("n"), (-F.col("first")).alias("f"))).alias("best"),
        F.sort_array(F.collect_list(votes), asc=False).alias("votes"),
    )
    tie = (F.col("rows") > 1) & (F.get("votes", F.lit(0)) > 0) & F.coalesce(F.get("votes", F.lit(0)) == F.get("votes", F.lit(1)), F.lit(False))
    decided = groups.select("k", tie.alias("tie"), F.when((F.col("rows") == 1) | (F.col("best.n") == 0), F.col("any_row")).otherwise(-F.col("best.f")).alias("keep_row"))
    kept = df.join(decided.where(~F.col("tie")).select("keep_row"), F.col(row) == F.col("keep_row"), "left_semi")
    return kept, decided.where("tie").select(F.col("k").alias(key))


def tfidf_vectors(df: DataFrame, doc: str, tokens: Column, sublinear: bool = False) -> DataFrame:
    """doc, term, df, w, rest: unit vectors with idf ln((1 + N) / (1 + df)) + 1; N counts the rows of df.

    rest is the squared length of a vector from the term on, rare terms first. Texts are shuffled by doc and counted there, terms
    once by term, where their document frequency is counted, and once by doc.
    """
    terms = df.repartition(doc).select(F.col(doc).alias("doc"), F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = terms.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    tf = 1 + F.ln(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = known.repartition("doc").crossJoin(F.broadcast(n)).select("doc", "term", "df", (tf * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    vectors = raw.select("doc", "term", "df", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))).alias("w"))
    return vectors.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)))


#: Rows of a term up to which one task joins them.
PREFIX_ROWS = 2_000

#: Documents up to which a table of their ids is broadcast.
BROADCAST_DOCS = 20_000


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """i, j, cosine of pairs (i, j) of unit vectors (doc, term, w); pairs without a common term have no row.

    pairs are written first, so that only the vectors of their documents are shuffled.
    """
    pairs = written(pairs.select("i", "j"), "few")
    ids = written(pairs.select(F.col("i").alias("_id")).union(pairs.select("j")).distinct(), "ids")
    vectors = vectors.join(F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids, F.col("doc") == F.col("_id"), "left_semi")
    a = vectors.select(F.col("doc").alias("da"), F.col("term").alias("ta"), F.col("w").alias("wa"))
    b = vectors.select(F.col("doc").alias("db"), F.col("term").alias("tb"), F.col("w").alias("wb"))
    dots = pairs.join(a, F.col("i") == F.col("da")).join(b, (F.col("j") == F.col("db")) & (F.col("ta") == F.col("tb")))
    return dots.groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def greedy_removal(pairs: DataFrame) -> DataFrame:
    """j, i, cosine: each row that goes and the first kept row that removes it, scanning rows in order.

    A row goes if a kept row before it is near; what has gone removes nothing. Each round keeps the rows without an
    undecided neighbour before them and removes their neighbours; rounds are tables in the shared folder, as many as
    the longest chain needs.
    """
    edges = written(pairs.select("i", "j", "cosine"), "near")
    removed = written(edges.select(F.col("j").alias("gone")).limit(0), "gone")
    open_ = edges.select("i", "j")
    while not open_.isEmpty():
        first = open_.select(F.col("i").alias("n")).distinct().join(open_.select(F.col("j").alias("n")).distinct(), "n", "left_anti")
        now = written(open_.join(first, F.col("i") == F.col("n"), "left_semi").select(F.col("j").alias("gone")).distinct(), "gone")
        removed = written(removed.unionByName(now), "gone")
        left = open_.join(now, F.col("i") == F.col("gone"), "left_anti").join(now, F.col("j") == F.col("gone"), "left_anti")
        open_ = written(left.join(first, F.col("i") == F.col("n"), "left_anti"), "open")
    alive = edges.join(removed, F.col("i") == F.col("gone"), "left_anti").join(removed, F.col("j") == F.col("gone"), "left_semi")
    return alive.groupBy("j").agg(F.min(F.struct("i", "cosine")).alias("m")).select("j", "m.i", F.round("m.cosine", 3).alias("cosine"))


def first_by_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def leak_guard(df: DataFrame, test: DataFrame, text: str = "text_clean") -> DataFrame:
    """df with leaked: whether the text (null as '') is one of the test set's."""
    seen = test.select(F.coalesce(text, F.lit("")).alias("_seen")).distinct().withColumn("_hit", F.lit(True))
    return df.join(seen, F.coalesce(text, F.lit("")) == F.col("_seen"), "left").withColumn("leaked", F.coalesce("_hit", F.lit(False))).drop("_seen", "_hit")
