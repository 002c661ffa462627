"""Quality rules with host verdicts: per-document rules, failure rates by host shrunk with an empirical beta prior.

Only DataFrame functions. Text is read once; what the host verdicts need is a slim table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, join_hot, let, words, written

WINDOW = 5
RULES = ("too_short", "repetitive", "symbols", "dup_lines")


def repeated_words(word_list: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more in the list, the first one included.

    Windows are compared by a 64-bit hash. Most texts repeat none and end after one distinct(); the others sort their
    windows once, so a long text costs n log n.
    """

    def covered(grams: Column) -> Column:
        tagged = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            tagged,
            lambda s: F.transform(
                s,
                lambda e, k: F.when(
                    (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]
                ),
            ),
        )
        places = F.sort_array(F.filter(again, lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def of_hashes(h: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        )
        found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
        return F.when(F.size(h) <= width, F.lit(0).cast("long")).otherwise(found)

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), of_hashes)


def document_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a boolean fail_<rule> for each of RULES.

    Null text counts as no words. Other input columns are left out, so none can clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    full = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    lines = let(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    stats = docs.select(
        *keep,
        measured.alias("_m"),
        F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    c = F.col
    out = stats.select(*keep, "_m.n_words", "_m.word_chars", "n_symbols", c("_l.dup").alias("n_dup_lines"), "_m.n_repeat_words", c("_l.n").alias("_n"))
    return out.select(
        *[x for x in out.columns if x != "_n"],
        (c("n_words") < 10).alias("fail_too_short"),
        (100 * c("n_repeat_words") > 20 * c("n_words")).alias("fail_repetitive"),
        (10 * c("n_symbols") > c("word_chars")).alias("fail_symbols"),
        (100 * c("n_dup_lines") > 30 * c("_n")).alias("fail_dup_lines"),
    )


def host_verdicts(stats: DataFrame, host: str = "source", reject_above: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), rejected: one row for each host that is not null.

    A document fails if any rule fails. The beta prior has the mean and variance of the hosts' raw rates (moments);
    where the variance is 0 or too large for a beta, its strength is 2. Counts are summed before the shuffle, so a
    host with a third of the rows is no burden; the prior is one row.
    """
    failed = F.greatest(*[F.col(f"fail_{r}").cast("int") for r in RULES])
    by_host = (
        stats.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))
    )
    rates = by_host.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v"))
    strength = F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1
    prior = rates.select("m", F.when(strength > 0, F.least(strength, F.lit(1e6))).otherwise(F.lit(2.0)).alias("k"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return by_host.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > reject_above).alias("rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",), reject_above: float = 0.5) -> DataFrame:
    """keep, the statistics, base_failed and kept: one row for each input row, repeated rows included.

    base_failed: under 10 words, or more than a fifth of the words in repeated windows. kept: not base_failed and the
    host is not rejected. A null host has no verdict and rejects nothing. An empty table gives an empty result. keep may
    name the text: rows then carry it, and slim verdicts are joined to them.
    """
    cols = tuple(dict.fromkeys((*keep, host)))
    stats = written(document_stats(docs, text, cols), "quality")
    verdicts = host_verdicts(stats, host, reject_above).select(F.col("host").alias("_host"), "rejected", F.col("n_docs").alias("_n"))
    base = F.col("fail_too_short") | F.col("fail_repetitive")
    joined = join_hot(stats, verdicts, host, "_host", "_n", "hosts", "left")
    return joined.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )
