"""Registered queries over the driver's tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as sc
from .functions import text as tx
from .operators import aggregates, cleaning, features, joins, labels, metrics, neargroups, packed, ranking, sampling
from .operators.quantiles import exact_percentiles
from .plans import grids, models, svm
from .sources import html as web
from .sources.reviews import load_reviews, table
from .storage import dropped, shared_dir, written
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SPACE = r"[\s\p{Z}]+"
NORM = rf"trim(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '{SPACE}', ' ', 'g'), ' .,!?~-')"
TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+')"
STAR = "CASE WHEN {0} IN (1, 2) THEN 'Negative' WHEN {0} = 3 THEN 'Neutral' WHEN {0} IN (4, 5) THEN 'Positive' END"
BASE = f"""stars AS (
  SELECT d.doc_id AS row_id, substr(sha1(concat_ws('|', source, d.doc_id::VARCHAR, text)), 1, 16) AS review_id, source AS product_id, lang AS category,
         ((d.doc_id * 7 + 3) % 5 + 1)::INT AS star, text,
         CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' WHEN quality = 0 THEN 'Neutral' END AS label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
reviews AS (SELECT *, {STAR.format("star")} AS label_star, {STAR.format("((row_id * 3 + 1) % 5 + 1)")} AS label_other FROM stars)"""
LABELS3 = "(VALUES ('Negative'), ('Neutral'), ('Positive')) AS names(label)"


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {BASE}" + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)) if base else sql
        return f

    return add


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews with a second, unrelated prediction."""
    other = sc.star_label((F.col("row_id") * 3 + 1) % 5 + 1)
    return load_reviews(spark, sf_dir).withColumn("label_other", other)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).where(F.col("label").isNotNull())


STEPS = ("empty", "short", "repeated_mark")


@query(f"""
WITH m AS (SELECT CASE WHEN {NORM} = '' THEN 'empty' WHEN len({TOKENS}) < 3 THEN 'short' WHEN regexp_matches(text, '[!]{{2,}}') THEN 'repeated_mark' ELSE 'passed' END AS s FROM reviews),
steps AS (SELECT * FROM (VALUES (0, 'raw'), (1, 'empty'), (2, 'short'), (3, 'repeated_mark')) AS t(ord, step)),
c AS (SELECT s, count(*) AS n FROM m GROUP BY s),
j AS (SELECT step, ord, coalesce(n, 0) AS dropped FROM steps LEFT JOIN c ON step = s)
SELECT step, ord, dropped, ((SELECT count(*) FROM reviews) - sum(dropped) OVER (ORDER BY ord))::BIGINT AS remaining FROM j""")
def funnel_counts(spark, sf_dir):
    df = load_reviews(spark, sf_dir)
    steps = [("empty", tx.comparison_key(F.col("text")) == ""), ("short", tx.word_count(F.col("text")) < 3), ("repeated_mark", F.col("text").rlike("[!]{2,}"))]
    return cleaning.funnel_counts(cleaning.funnel(df, steps), STEPS)


@query("SELECT label, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM reviews WHERE label IS NOT NULL GROUP BY label")
def label_distribution(spark, sf_dir):
    return aggregates.value_counts(load_reviews(spark, sf_dir), "label")


@query("SELECT category, count(*) AS n FROM reviews WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 30")
def top_categories(spark, sf_dir):
    return aggregates.top_values(load_reviews(spark, sf_dir), "category")


@query("""
SELECT star, count(*) FILTER (label = 'Negative') AS "Negative", count(*) FILTER (label = 'Neutral') AS "Neutral", count(*) FILTER (label = 'Positive') AS "Positive",
       count(*) AS n, round(100 * avg((label <> label_star)::INT::DOUBLE), 1) AS pct_differs FROM reviews WHERE label IS NOT NULL GROUP BY star""")
def label_by_star(spark, sf_dir):
    return labels.noise_by_star(load_reviews(spark, sf_dir))


@query("""
WITH k AS (SELECT coalesce(label_star, 'Total') AS label_star, coalesce(label, 'Total') AS label, count(*) AS n FROM reviews WHERE label IS NOT NULL GROUP BY CUBE (label_star, label))
SELECT label_star, coalesce(sum(n) FILTER (label = 'Negative'), 0)::BIGINT AS "Negative", coalesce(sum(n) FILTER (label = 'Neutral'), 0)::BIGINT AS "Neutral",
       coalesce(sum(n) FILTER (label = 'Positive'), 0)::BIGINT AS "Positive", coalesce(sum(n) FILTER (label = 'Total'), 0)::BIGINT AS "Total" FROM k GROUP BY label_star""")
def label_transition_margins(spark, sf_dir):
    return labels.with_margins(load_reviews(spark, sf_dir), "label_star", "label")


@query(f"""
WITH w AS (SELECT label, len({TOKENS})::INT AS n_words FROM reviews WHERE label IS NOT NULL)
SELECT label, count(*) AS n, round(avg(n_words), 4) AS mean, round(stddev_samp(n_words), 4) AS std, min(n_words) AS min, quantile_cont(n_words::DOUBLE, 0.25) AS p25,
       quantile_cont(n_words::DOUBLE, 0.5) AS p50, quantile_cont(n_words::DOUBLE, 0.75) AS p75, max(n_words) AS max FROM w GROUP BY label""")
def length_describe(spark, sf_dir):
    return aggregates.describe(load_reviews(spark, sf_dir).withColumn("n_words", tx.word_count(F.col("text"))), "n_words", "label")


@query(f"""
WITH t AS (SELECT row_id, {NORM} AS k, label_star AS l FROM reviews),
c AS (SELECT k, l, count(*) AS n, min(row_id) AS first FROM t GROUP BY k, l),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, first) AS p, lead(n) OVER (PARTITION BY k ORDER BY n DESC, first) AS second FROM c)
SELECT first AS row_id, k AS text_norm, l AS label_star FROM r WHERE p = 1 AND n IS DISTINCT FROM second""")
def exact_dedup(spark, sf_dir):
    df = load_reviews(spark, sf_dir).select("row_id", "label_star", tx.comparison_key(F.col("text")).alias("text_norm"))
    return cleaning.dedup_exact(df)[0].select("row_id", "text_norm", "label_star")


def _unique_texts(spark, sf_dir):
    df = load_reviews(spark, sf_dir).select("row_id", tx.comparison_key(F.col("text")).alias("text_norm"))
    return written(df.groupBy("text_norm").agg(F.min("row_id").alias("row_id")), "unique")


VECTORS = rf"""
WITH u AS (SELECT min(row_id) AS row_id, k FROM (SELECT row_id, {NORM} AS k FROM reviews) GROUP BY k),
tf AS (SELECT row_id, t, count(*) AS f FROM (SELECT row_id, unnest(regexp_extract_all(k, '[\p{{L}}\p{{N}}_]+')) AS t FROM u) GROUP BY row_id, t),
idf AS (SELECT t, ln((1 + (SELECT count(*) FROM u)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY t),
raw AS (SELECT row_id, t, f * idf AS w FROM tf JOIN idf USING (t)),
v AS (SELECT row_id, t, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM raw),
p AS (SELECT a.row_id AS i, b.row_id AS j, sum(a.w * b.w) AS c FROM v a JOIN v b ON a.t = b.t AND a.row_id < b.row_id GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0.9)"""


@query(VECTORS + "\nSELECT i, j, round(c, 6) AS cosine FROM p")
def near_dup_pairs(spark, sf_dir):
    words = F.regexp_extract_all("text_norm", F.lit(f"[{tx.WORD}]+"), F.lit(0))
    return packed.near_pairs(packed.packed(_unique_texts(spark, sf_dir), "row_id", words)).select("i", "j", F.round("cosine", 6).alias("cosine"))


@query()
def near_dup_greedy(spark, sf_dir):
    return neargroups.dedup_near(_unique_texts(spark, sf_dir))[1]


@query(VECTORS + "\nSELECT row_id, count(*) AS n_near FROM (SELECT i AS row_id FROM p UNION ALL SELECT j FROM p) GROUP BY row_id")
def near_dup_links(spark, sf_dir):
    """How many other texts are near each text: groups of copies are counted, not listed as pairs."""
    found = neargroups.near_groups(neargroups.word_vectors(_unique_texts(spark, sf_dir)))
    return neargroups.link_counts(found).select(F.col("doc").alias("row_id"), "n_near")


@query(f"""
WITH t AS (SELECT row_id, {NORM} AS k, row_id % 10 = 0 AS test FROM reviews), s AS (SELECT DISTINCT k FROM t WHERE test)
SELECT row_id, s.k IS NOT NULL AS leaked FROM t LEFT JOIN s USING (k) WHERE NOT test""")
def leak_guard(spark, sf_dir):
    df = load_reviews(spark, sf_dir).select("row_id", tx.comparison_key(F.col("text")).alias("text_clean"))
    return cleaning.leak_guard(df.where("row_id % 10 <> 0"), df.where("row_id % 10 = 0")).select("row_id", "leaked")


def _gold(spark, sf_dir):
    return load_reviews(spark, sf_dir).select(F.col("row_id").alias("gold_id"), "label", "label_star", "star")


ADJUDICATED = """
WITH g AS (SELECT row_id AS gold_id, label_star AS label_llm, label AS truth, star FROM reviews ),
f AS (SELECT *, CASE WHEN star = 3 OR gold_id % 7 = 0 THEN 'low' ELSE 'high' END AS confidence FROM g),
h AS (SELECT gold_id AS id, truth AS label_human, gold_id % 2 = 0 AS person FROM f WHERE confidence = 'low' AND truth IS NOT NULL),
s AS (SELECT gold_id AS id, truth AS label_human_2 FROM f WHERE gold_id % 5 = 0 AND truth IS NOT NULL),
a AS (SELECT gold_id, label_llm, confidence, label_human, label_human_2, coalesce(label_human, label_llm) AS label,
             CASE WHEN h.id IS NULL THEN 'llm' WHEN person THEN 'human' ELSE 'llm_accepted' END AS label_source
      FROM f LEFT JOIN h ON h.id = gold_id LEFT JOIN s ON s.id = gold_id)"""


@query(ADJUDICATED + "\nSELECT * FROM a")
def label_adjudication(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    low = (F.col("star") == 3) | (F.col("gold_id") % 7 == 0)
    llm = gold.select(F.col("gold_id").alias("id"), F.col("label_star").alias("label_llm"), F.when(low, "low").otherwise("high").alias("confidence"), F.lit("").alias("reason"))
    person = F.when(F.col("gold_id") % 2 == 0, "nguoi").otherwise("llm_chap_nhan")
    short = F.concat(F.lit(" "), F.upper(F.substring("label", 1, 3)))
    reviewed = gold.where(low & F.col("label").isNotNull()).select(F.col("gold_id").alias("id"), short.alias("label_human"), person.alias("nguon_nhan"))
    second = gold.where((F.col("gold_id") % 5 == 0) & F.col("label").isNotNull()).select(F.col("gold_id").alias("id"), F.col("label").alias("label_human_2"))
    out = labels.adjudicate(gold.select("gold_id"), llm, reviewed, second)
    return out.select("gold_id", "label_llm", "confidence", "label_human", "label_human_2", "label", "label_source")


@query(ADJUDICATED + """
SELECT count(*) AS n, count(*) FILTER (label_source = 'human') AS n_human, count(*) FILTER (label_source = 'llm_accepted') AS n_llm_accepted, count(*) FILTER (label_source = 'llm') AS n_llm,
       count(label_human) AS n_reviewed, count(*) FILTER (label_human <> label_llm) AS n_changed, round(count(*) FILTER (label_human <> label_llm) / nullif(count(label_human), 0)::DOUBLE, 4) AS changed_rate FROM a""")
def agreement_summary(spark, sf_dir):
    return labels.agreement_summary(label_adjudication(spark, sf_dir))


@query("""
WITH e AS (SELECT row_id AS id, label, label_star FROM reviews WHERE row_id % 4 <> 1),
a AS (SELECT row_id AS id, CASE WHEN row_id % 11 = 0 THEN 'odd' ELSE label END AS label_llm, CASE WHEN row_id % 13 = 0 THEN 'medium' ELSE ' High' END AS confidence FROM reviews WHERE row_id % 4 <> 2
      UNION ALL SELECT row_id, label, 'low' FROM reviews WHERE row_id % 50 = 3)
SELECT 'bad_label' AS problem, count(*) AS n FROM a WHERE coalesce(lower(trim(label_llm)) NOT IN ('pos', 'positive', 'neu', 'neutral', 'neg', 'negative'), true)
UNION ALL SELECT 'bad_confidence', count(*) FROM a WHERE lower(trim(confidence)) NOT IN ('high', 'low')
UNION ALL SELECT 'missing_id', count(*) FROM e WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'extra_id', count(*) FROM a WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1)""")
def merge_dq(spark, sf_dir):
    df = load_reviews(spark, sf_dir).withColumnRenamed("row_id", "id")
    odd = F.when(F.col("id") % 11 == 0, "odd").otherwise(F.col("label"))
    answers = df.where("id % 4 <> 2").select("id", odd.alias("label_llm"), F.when(F.col("id") % 13 == 0, "medium").otherwise(" High").alias("confidence"))
    answers = answers.unionByName(df.where("id % 50 = 3").select("id", F.col("label").alias("label_llm"), F.lit("low").alias("confidence")))
    return labels.batch_problems(df.where("id % 4 <> 1"), answers)


@query("SELECT row_id FROM reviews WHERE label <> label_star OR star = 3")
def review_flags(spark, sf_dir):
    df = load_reviews(spark, sf_dir).withColumn("confidence", F.when(F.col("star") == 3, "low").otherwise("high"))
    return df.where(labels.review_flag("label")).select("row_id")


@query(f"""
WITH t AS (SELECT {TOKENS} AS t FROM reviews), w AS (SELECT unnest(t) AS w FROM t)
SELECT count(*) AS rows, sum(len(t))::BIGINT AS tokens, round(avg(len(t)), 4) AS mean_tokens, (SELECT count(DISTINCT w) FROM w) AS vocabulary,
       (SELECT round(100 * avg(contains(w, '_')::INT::DOUBLE), 4) FROM w) AS pct_compound FROM t""")
def token_stats(spark, sf_dir):
    return aggregates.token_stats(load_reviews(spark, sf_dir), "text")


CLEAN = r"""trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), '<phone>', ' '),
  '<[^>]+>', ' ', 'g'), 'https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+', ' ', 'g'), '[^\s\p{Z}]+@[^\s\p{Z}]+\.[^\s\p{Z}]+', ' ', 'g'),
  '[^\p{L}\p{N}_\s\p{Z}.,!?;:()\-/%''"]', ' ', 'g'), '_', ' '), '([.,!?;:])(\p{L})', '\1 \2', 'g'), '[\s\p{Z}]+', ' ', 'g'))"""


@query(f"SELECT row_id, {CLEAN} AS text_clean FROM reviews")
def text_clean(spark, sf_dir):
    return load_reviews(spark, sf_dir).select("row_id", tx.cleaned(F.col("text")).alias("text_clean"))


STOP = ("the", "and", "der", "les", "los")


@query(rf"""
WITH w AS (SELECT row_id, generate_subscripts(t, 1) AS i, trim(regexp_replace(unnest(t), '[^\p{{L}}\p{{N}}_]', '', 'g'), '_') AS w FROM (SELECT row_id, {TOKENS} AS t FROM reviews)),
k AS (SELECT * FROM w WHERE length(w) >= 2 AND regexp_matches(w, '\p{{L}}') AND w NOT IN ('the', 'and', 'der', 'les'))
SELECT r.row_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS text_words FROM reviews r LEFT JOIN k USING (row_id) GROUP BY r.row_id""")
def content_words(spark, sf_dir):
    return load_reviews(spark, sf_dir).select("row_id", tx.content_words(F.col("text"), STOP, keep=("los",)).alias("text_words"))


@query()
def text_normalized(spark, sf_dir):
    correct = tx.corrector({"ko": "không", "sp": "sản phẩm", "the": "le", "of the": "du"})
    join = tx.joined_compounds(["of the", "in the"])
    # each step is a column of its own: what both texts share is cleaned and normalised once
    df = load_reviews(spark, sf_dir).select("row_id", "text", tx.cleaned(tx.nfc(F.coalesce("text", F.lit("")))).alias("clean"))
    df = df.select("row_id", "text", tx.normalized(F.col("clean")).alias("plain"))
    plain = F.col("plain")
    return df.select("row_id", tx.normalized(F.col("text")).alias("text_norm"), tx.words_text(plain, correct, join, STOP).alias("text_model"), tx.running_text(plain, correct, join).alias("text_seq"))


@query(rf"""
SELECT row_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_.,])(\+?84|0|[xX]{{2,}})([0-9\s.\-xX]{{7,12}}[0-9])', '\1<phone>', 'g') AS text_masked FROM reviews""")
def phone_masking(spark, sf_dir):
    return load_reviews(spark, sf_dir).select("row_id", tx.mask_phones(F.col("text")).alias("text_masked"))


@query(r"SELECT sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')))::BIGINT AS matches, count(*) FILTER (regexp_matches(text, '[0-9]')) AS texts FROM reviews")
def match_counts(spark, sf_dir):
    return aggregates.match_counts(load_reviews(spark, sf_dir), "text", "[0-9]+")


@query(rf"""
WITH t AS (SELECT len({TOKENS}) AS a, len(list_filter({TOKENS}, lambda w: length(w) > 2)) AS b FROM reviews)
SELECT sum(a)::BIGINT AS tokens_before, sum(b)::BIGINT AS tokens_after, round(100 * (1 - sum(b)::DOUBLE / sum(a)), 2) AS pct_removed FROM t""")
def removed_tokens(spark, sf_dir):
    short = F.array_join(F.filter(tx.tokens(F.col("text")), lambda w: F.length(w) > 2), " ")
    return aggregates.removed_ratio(load_reviews(spark, sf_dir).withColumn("less", short), "text", "less")


@query(f"WITH t AS (SELECT len({TOKENS})::INT AS v FROM reviews) SELECT quantile_cont(v::DOUBLE, 0.5) AS median, quantile_cont(v::DOUBLE, 0.95) AS p95, round(100 * avg((v > 128)::INT::DOUBLE), 2) AS pct_longer FROM t")
def length_profile(spark, sf_dir):
    return aggregates.length_profile(load_reviews(spark, sf_dir), tx.word_count(F.col("text")))


GRAMS = rf"""
WITH t AS (SELECT row_id AS doc, {TOKENS} AS t FROM reviews WHERE label IS NOT NULL),
g AS (SELECT doc, unnest(t) AS term FROM t UNION ALL SELECT doc, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM t),
c AS (SELECT doc, term, count(*) AS tf FROM g GROUP BY doc, term),
o AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 5),
k AS (SELECT doc, term, tf, df FROM c JOIN o USING (term)),
r AS (SELECT doc, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM t)) / (1.0::DOUBLE + df)) + 1) AS w FROM k),
v AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM r),
y AS (SELECT row_id AS doc, label FROM reviews WHERE label IS NOT NULL)"""


def _counts(spark, sf_dir):
    return features.term_counts(labelled(spark, sf_dir), "row_id", "text", 1, 2, min_df=5)


def _weights(spark, sf_dir):
    """doc, labels, term, w, written: texts are split once, n-grams shuffled once by term and then, when that is deleted, once by document."""
    df = labelled(spark, sf_dir)
    counts = written(features.known_counts(df, "row_id", "text", 1, 2, min_df=5, gather="label"), "known")
    found = written(features.weighted(counts, df.agg(F.count(F.lit(1)).alias("n"))), "weights")
    dropped(counts)
    return found


@query(GRAMS + "\nSELECT doc, term, tf FROM k")
def bow_counts(spark, sf_dir):
    return written(_counts(spark, sf_dir), "counts")


@query(GRAMS + "\nSELECT doc, term, round(w, 6) AS w FROM v")
def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("doc", "term", F.round("w", 6).alias("w"))


@query(GRAMS + f""",
n AS (SELECT label, count(*) AS n FROM y GROUP BY label),
m AS (SELECT label, term, sum(w) / any_value(n) AS m FROM v JOIN y USING (doc) JOIN n USING (label) GROUP BY label, term),
f AS (SELECT term, names.label, coalesce(any_value(m) FILTER (m.label = names.label), 0) - greatest(0, coalesce(max(m) FILTER (m.label <> names.label), 0)) AS s FROM m, {LABELS3} GROUP BY term, names.label),
q AS (SELECT label, term, round(s, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, term) AS rank FROM f)
SELECT * FROM q WHERE rank <= 15""")
def top_terms_by_class(spark, sf_dir):
    return features.contrast_terms(_weights(spark, sf_dir), labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "label"))


@query(GRAMS + """,
n AS (SELECT label, count(*) AS n, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS prior FROM y GROUP BY label),
s AS (SELECT label, term, sum(w) AS s FROM v JOIN y USING (doc) GROUP BY label, term),
z AS (SELECT n.label, prior, coalesce(sum(s), 0) + 0.5 * (SELECT count(DISTINCT term) FROM v) AS bottom FROM n LEFT JOIN s USING (label) GROUP BY n.label, prior),
x AS (SELECT y.doc, z.label, any_value(prior) + coalesce(sum(w * (ln(coalesce(s.s, 0) + 0.5) - ln(bottom))), 0) AS score
      FROM y CROSS JOIN z LEFT JOIN v ON v.doc = y.doc LEFT JOIN s ON s.label = z.label AND s.term = v.term GROUP BY y.doc, z.label)
SELECT doc, arg_min(label, (-round(score, 9), label)) AS pred FROM x GROUP BY doc""")
def nb_multinomial_predict(spark, sf_dir):
    w, y = _weights(spark, sf_dir), labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "label")
    return models.predict_multinomial(models.fit_multinomial(w, y, alpha=0.5), w, y).select("doc", "pred")


DIMS = 64
EACH = "(SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""
WITH e AS {EACH}, s AS (SELECT k, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS d FROM e GROUP BY k)
SELECT vec_id, round(sum((x - m) / d * k), 4) AS z FROM e JOIN s USING (k) GROUP BY vec_id""", base=False)
def standard_scale(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    z = features.scaled(df, "embedding", features.scaler(df, "embedding", DIMS))
    return z.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("z"))


@query(f"""
WITH e AS {EACH}, t AS (SELECT vec_id, 'c' || label % 3 AS y, k, x FROM e), top AS (SELECT max(v) AS v FROM (SELECT var_pop(x) AS v FROM t GROUP BY k)),
s AS (SELECT y, k, avg(x) AS m, var_pop(x) + 1e-9 * (SELECT v FROM top) AS v FROM t GROUP BY y, k),
p AS (SELECT y, ln(count(DISTINCT vec_id)::DOUBLE / (SELECT count(*) FROM embeddings)) AS lp FROM t GROUP BY y),
x AS (SELECT t.vec_id, s.y, any_value(lp) - sum(ln(2 * pi() * v) + (x - m) * (x - m) / v) / 2 AS score FROM t JOIN s USING (k) JOIN p ON p.y = s.y GROUP BY t.vec_id, s.y)
SELECT vec_id AS doc, arg_min(y, (-round(score, 6), y)) AS pred FROM x GROUP BY vec_id""", base=False)
def nb_gaussian_predict(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("y", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    return models.predict_gaussian(models.fit_gaussian(df, "embedding", "y", DIMS), df, "vec_id", "embedding").select("doc", "pred")


@query(GRAMS + f""",
b AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT DISTINCT term FROM v)), vec AS (SELECT term, vec_id FROM b JOIN embeddings ON vec_id = i),
e AS {EACH},
s AS (SELECT v.doc, k, sum(v.w * x) / sum(v.w) AS x FROM v JOIN vec USING (term) JOIN e USING (vec_id) GROUP BY v.doc, k)
SELECT y.doc, coalesce(round(sum(x * k), 4), 0) AS checksum FROM y LEFT JOIN s USING (doc) GROUP BY y.doc""")
def weighted_mean_vector(spark, sf_dir):
    w = _weights(spark, sf_dir)
    terms = models.numbered_terms(w)
    vectors = terms.join(table(spark, sf_dir, "embeddings"), F.col("i") == F.col("vec_id")).select("term", F.col("embedding").cast("array<double>").alias("vector"))
    out = features.weighted_mean_vectors(w, vectors, labelled(spark, sf_dir).select(F.col("row_id").alias("doc")), DIMS)
    return out.select("doc", F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@query("SELECT label, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM reviews WHERE label IS NOT NULL GROUP BY label")
def class_weights(spark, sf_dir):
    return aggregates.class_weights(load_reviews(spark, sf_dir), "label")


@query("SELECT label, count(*) AS n FROM reviews WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 1")
def majority_baseline(spark, sf_dir):
    return models.majority_label(load_reviews(spark, sf_dir), "label")


def _candidates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    vote = F.when(F.col("p_size") % 7 != 0, F.round(3.9 + (F.col("p_partkey") % 11) / 10.0, 1))
    return part.select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("url"), vote.alias("vote"), (F.col("p_size") * 1.0).alias("sold"))


PICKED = """
WITH c AS (SELECT p_brand AS category, p_partkey AS url, CASE WHEN p_size % 7 <> 0 THEN round(3.9 + (p_partkey % 11) / 10.0::DOUBLE, 1) END AS vote, p_size::DOUBLE AS sold FROM part),
l AS (SELECT *, coalesce(vote < 4.5, false) AS low, sum(coalesce(vote < 4.5, false)::INT) OVER (PARTITION BY category) AS n_low FROM c),
f AS (SELECT *, NOT low AND vote IS NOT NULL AND row_number() OVER (PARTITION BY category, NOT low AND vote IS NOT NULL ORDER BY vote, sold DESC, url) <= 3 - n_low AS fill FROM l),
k AS (SELECT *, CASE WHEN low THEN 'low_vote' WHEN fill THEN 'low_rank' ELSE 'top_sold' END AS pick FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY category, pick = 'top_sold' ORDER BY (pick = 'low_rank')::INT, CASE WHEN pick = 'low_rank' THEN vote END, sold DESC, url) AS turn FROM k),
o AS (SELECT category, url, vote, sold, pick, row_number() OVER (PARTITION BY category ORDER BY turn, (pick = 'top_sold')::INT) AS place FROM t)"""


@query(PICKED + "\nSELECT * FROM o", base=False)
def candidate_order(spark, sf_dir):
    return ranking.candidate_order(_candidates(spark, sf_dir))


@query(PICKED + "\nSELECT category, url, row_number() OVER (ORDER BY place, category) AS turn FROM o", base=False)
def round_robin(spark, sf_dir):
    return ranking.round_robin(candidate_order(spark, sf_dir), "category", "category").select("category", "url", "turn")


@query("""
WITH r AS (SELECT l_suppkey AS product_id, (l_linenumber - 1) % 5 + 1 AS star, l_orderkey * 10 + l_linenumber AS item FROM lineitem),
p AS (SELECT *, (row_number() OVER (PARTITION BY product_id, star ORDER BY item) - 1) // 20 + 1 AS page FROM r),
b AS (SELECT *, count(*) OVER (PARTITION BY product_id, star ORDER BY page) - count(*) OVER (PARTITION BY product_id, star, page) AS before FROM p),
g AS (SELECT *, count(*) OVER (PARTITION BY product_id, star) AS crawled FROM b WHERE before < 30),
n AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY star DESC, page, item) AS n FROM g)
SELECT product_id, star, count(*) AS kept, max(crawled) AS crawled, max(item) AS last_item FROM n WHERE n <= 120 GROUP BY product_id, star""", base=False)
def capped_pages(spark, sf_dir):
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("product_id"), ((F.col("l_linenumber") - 1) % 5 + 1).alias("star"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    page = F.floor((F.row_number().over(Window.partitionBy("product_id", "star").orderBy("item")) - 1) / 20) + 1
    got = ranking.page_caps(rows.withColumn("page", page), 30, 120)
    return got.groupBy("product_id", "star").agg(F.count(F.lit(1)).alias("kept"), F.max("crawled").alias("crawled"), F.max("item").alias("last_item"))


@query("""
WITH z AS (SELECT label_star AS s, count(*) AS n FROM reviews GROUP BY s), t AS (SELECT ceil(0.15 * sum(n) - 1e-9) AS t, sum(n) AS n FROM z),
q AS (SELECT s, floor(z.n * t / t.n::DOUBLE) AS w, z.n * t / t.n::DOUBLE - floor(z.n * t / t.n::DOUBLE) AS r, t FROM z, t),
a AS (SELECT s, w + (row_number() OVER (ORDER BY r DESC, s) <= t - sum(w) OVER ())::INT AS quota FROM q),
h AS (SELECT row_id, label_star, row_number() OVER (PARTITION BY label_star ORDER BY sha1('42|' || row_id), row_id) AS p FROM reviews)
SELECT row_id, CASE WHEN p <= quota THEN 'val' ELSE 'train' END AS split FROM h JOIN a ON s = label_star""")
def strat_split(spark, sf_dir):
    return sampling.stratified_split(load_reviews(spark, sf_dir).select("row_id", "label_star"), "label_star", "row_id").select("row_id", "split")


@query("SELECT row_id FROM reviews ORDER BY sha1('42|' || row_id), row_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return sampling.sample_rows(load_reviews(spark, sf_dir).select("row_id"), 100, "row_id")


@query()
def gold_sample(spark, sf_dir):
    quota = {1: 20, 2: 14, 3: 30, 4: 16, 5: 20}
    return sampling.sample_gold(load_reviews(spark, sf_dir), quota).select("gold_id", "row_id", "star", "product_id")


@query("SELECT review_id, format('P{:04d}', row_number() OVER (ORDER BY review_id)) AS id, ((row_number() OVER (ORDER BY review_id) - 1) // 50 + 1)::INT AS batch FROM reviews")
def batch_assign(spark, sf_dir):
    return labels.batches(load_reviews(spark, sf_dir).select("review_id"), "review_id").select("review_id", "id", "batch")


LABELLED = """
WITH x AS (SELECT * FROM reviews WHERE label IS NOT NULL),
m AS (SELECT row_id, star, label AS t, model, p FROM (SELECT row_id, star, label, 'label_star' AS model, label_star AS p FROM x UNION ALL SELECT row_id, star, label, 'label_other', label_other FROM x))"""
REPORT = LABELLED + f""",
r AS (SELECT model, names.label, count(*) FILTER (t = names.label AND p = names.label) AS tp, count(*) FILTER (p = names.label) AS pp, count(*) FILTER (t = names.label) AS support, count(*) AS n
      FROM m, {LABELS3} GROUP BY model, names.label),
c AS (SELECT *, coalesce(tp::DOUBLE / nullif(pp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(pp + support, 0), 0) AS f1 FROM r)"""


def _predictions(spark, sf_dir):
    df = labelled(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("pred")) for c in ("label_star", "label_other")]))
    return df.select("row_id", "star", "label", pairs.alias("m")).select("row_id", "star", "label", "m.model", "m.pred")


@query(REPORT + "\nSELECT model, label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM c")
def classification_report(spark, sf_dir):
    return metrics.classification_report(_predictions(spark, sf_dir), "label", "pred", ("model",))


@query(REPORT + """
SELECT model, any_value(n) AS n, round(sum(tp)::DOUBLE / any_value(n), 4) AS accuracy, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1,
       model = 'label_other' AS is_reference FROM c GROUP BY model""")
def model_comparison(spark, sf_dir):
    return metrics.scores(_predictions(spark, sf_dir), "label", "pred", ("model",)).withColumn("is_reference", F.col("model") == "label_other")


@query(REPORT + "\nSELECT model, round(avg(f1), 4) AS macro_f1 FROM c GROUP BY model ORDER BY avg(f1) DESC, model LIMIT 1")
def best_model(spark, sf_dir):
    s = metrics.scores(_predictions(spark, sf_dir), "label", "pred", ("model",))
    return ranking.best_rows(s, [], "macro_f1", "model").select("model", "macro_f1")


@query(LABELLED + f""",
g AS (SELECT a.label AS t, b.label AS p FROM (SELECT * FROM {LABELS3}) a, (SELECT * FROM {LABELS3}) b),
k AS (SELECT g.t, g.p, count(x.row_id) AS n FROM g LEFT JOIN x ON x.label = g.t AND x.label_star = g.p GROUP BY g.t, g.p)
SELECT t, p, n, round(n / greatest(sum(n) OVER (PARTITION BY t), 1)::DOUBLE, 4) AS rate FROM k""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_rates(labelled(spark, sf_dir), "label", "label_star")


@query(LABELLED + """,
o AS (SELECT avg((label = label_star)::INT::DOUBLE) AS po, count(*) AS n FROM x),
e AS (SELECT sum(a.n * b.n)::DOUBLE AS ab FROM (SELECT label AS l, count(*) AS n FROM x GROUP BY l) a JOIN (SELECT label_star AS l, count(*) AS n FROM x GROUP BY l) b USING (l))
SELECT n, round(po, 4) AS raw, round((po - ab / (n * n)) / (1 - ab / (n * n)), 4) AS kappa FROM o, e""")
def cohen_kappa(spark, sf_dir):
    return labels.agreement(labelled(spark, sf_dir), "label", "label_star")


@query(LABELLED + f""",
i AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS r, label, label_star, label_other FROM x), n AS (SELECT count(*) AS n FROM i),
d AS (SELECT b, ('0x' || substr(md5('42|' || b || '|' || slot), 1, 8))::BIGINT % n AS r FROM n, range(2000) AS bb(b), range((SELECT n FROM n)) AS ss(slot)),
f AS (SELECT b, model, l.label, coalesce(2.0::DOUBLE * count(*) FILTER (t = l.label AND p = l.label) / nullif(count(*) FILTER (t = l.label) + count(*) FILTER (p = l.label), 0), 0) AS f1
      FROM (SELECT b, 'label_star' AS model, label AS t, label_star AS p FROM d JOIN i USING (r) UNION ALL SELECT b, 'label_other', label, label_other FROM d JOIN i USING (r)),
           (SELECT names.label FROM {LABELS3}) l GROUP BY b, model, l.label),
q AS (SELECT b, model, avg(f1) AS f1 FROM f GROUP BY b, model)
SELECT model, round(quantile_cont(f1, 0.025), 4) AS ci95_low, round(quantile_cont(f1, 0.975), 4) AS ci95_high FROM q GROUP BY model""")
def bootstrap_ci(spark, sf_dir):
    """2,000 resamples of all rows, each row of each resample drawn by its own hash."""
    df = ranking.numbered(labelled(spark, sf_dir).select("row_id", "label", "label_star", "label_other"), "r", "row_id")
    return metrics.bootstrap_rows(df.withColumn("r", F.col("r") - 1), "r", "label", ["label_star", "label_other"])


@query(REPORT + "\nSELECT model, round(avg(f1), 4) AS macro_f1, true AS inside, true AS narrow FROM c GROUP BY model")
def bootstrap_covers(spark, sf_dir):
    """Whether each model's score lies in its interval, and whether that is narrower than six deviations of a share."""
    df = labelled(spark, sf_dir)
    own = metrics.scores(_predictions(spark, sf_dir), "label", "pred", ("model",)).select("model", "n", "macro_f1")
    both = own.join(metrics.bootstrap_f1(df, "label", ["label_star", "label_other"]), "model")
    width = F.col("ci95_high") - F.col("ci95_low")
    return both.select("model", "macro_f1", F.col("macro_f1").between(F.col("ci95_low"), F.col("ci95_high")).alias("inside"), (width < 3 / F.sqrt("n")).alias("narrow"))


@query()
def robustness_table(spark, sf_dir):
    """Models with intervals, and beside a second rater, as one table."""
    df = labelled(spark, sf_dir)
    rater = df.select("row_id", F.when(F.col("row_id") % 3 > 0, F.col("label_other")).alias("rater"))
    return metrics.robustness(df, "label", ["label_star", "label_other"], "row_id", rater, "rater", "label_other")


@query(LABELLED + """,
a AS (SELECT 'label_star' AS model, row_id, label, label_star AS pred, label_other AS other_pred, label <> label_other AS both_wrong FROM x WHERE label <> label_star ORDER BY sha1('42|' || row_id), row_id LIMIT 15),
b AS (SELECT 'label_other' AS model, row_id, label, label_other AS pred, label_star AS other_pred, label <> label_star AS both_wrong FROM x WHERE label <> label_other AND row_id NOT IN (SELECT row_id FROM a) ORDER BY sha1('42|' || row_id), row_id LIMIT 15)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def errors_disjoint(spark, sf_dir):
    return metrics.error_samples(labelled(spark, sf_dir), "row_id", "label", "label_star", "label_other")


@query(LABELLED + "\nSELECT s.star::INT AS star, round(avg((label = label_star)::INT::DOUBLE), 4) AS accuracy FROM range(1, 6) AS s(star) LEFT JOIN x ON x.star = s.star GROUP BY s.star")
def accuracy_by_star(spark, sf_dir):
    return metrics.accuracy_by_star(labelled(spark, sf_dir), "label", "label_star")


@query(LABELLED + "\nSELECT row_id, label, label_star AS pred_first, label_other AS pred_second FROM x")
def wide_predictions(spark, sf_dir):
    return metrics.wide_predictions(_predictions(spark, sf_dir), "row_id", "label", "model", "pred", ["label_star", "label_other"], ["first", "second"])


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY o_orderpriority", base=False)
def seed_summary(spark, sf_dir):
    return metrics.seed_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("""
SELECT page_id, CASE WHEN len(s) = 2 THEN s[1] END AS category, CASE WHEN len(s) = 2 THEN s[2] END AS slug, len(s)::INT AS n_segments
FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)""", base=False)
def url_parts(spark, sf_dir):
    s = sc.url_segments(F.col("url"))
    two = F.size(s) == 2
    return table(spark, sf_dir, "pages").select("page_id", F.when(two, F.get(s, F.lit(0))).alias("category"), F.when(two, F.get(s, F.lit(1))).alias("slug"), F.size(s).alias("n_segments"))


@query("SELECT row_id, review_id, ('0x' || substr(md5(text), 1, 8))::BIGINT AS hash32 FROM reviews")
def content_hash_id(spark, sf_dir):
    return load_reviews(spark, sf_dir).select("row_id", "review_id", sc.stable_hash(F.col("text")).alias("hash32"))


@query(r"""
SELECT o_orderkey, format('G{:03d}', o_orderkey) AS gold_id, translate(format('{:,.2f}', round(o_totalprice::DECIMAL(30, 12), 2)::DECIMAL(30, 2)), ',.', '.,') AS price,
       trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM orders""", base=False)
def formatted_values(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", sc.numbered_id("G", 3, F.col("o_orderkey")).alias("gold_id"), sc.local_number(F.col("o_totalprice"), 2).alias("price"), sc.slug(F.col("o_orderpriority")).alias("slug"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g')) AS title,
       len(regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]*)"', 1)) AS n_links, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS n_paragraphs FROM pages""", base=False)
def html_title_links(spark, sf_dir):
    n = lambda pattern, group: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(group))).cast("long")
    df = table(spark, sf_dir, "pages")
    return web.page_stats(df).select("page_id", "title").join(df.select("page_id", n('(?i)<a\\b[^>]*href="([^"]*)"', 1).alias("n_links"), n("(?i)<p[\\s>]", 0).alias("n_paragraphs")), "page_id")


@query("SELECT page_id, regexp_matches(lower(html), 'captcha|access denied|are you a robot') AS blocked FROM pages", base=False)
def blocked_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.is_blocked_page(F.col("html")).alias("blocked"))


@query("""
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, role) AS n FROM conversations)
SELECT conv_id, turn, role, text FROM r WHERE n = 1""", base=False)
def first_turns(spark, sf_dir):
    return cleaning.first_by_key(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", "role")


@query("""
WITH p AS (SELECT product_id, count(*) AS n, count(*) FILTER (star = 1) AS s1, count(*) FILTER (star = 2) AS s2, count(*) FILTER (star = 3) AS s3, count(*) FILTER (star = 4) AS s4,
                  count(*) FILTER (star = 5) AS s5, count(*) FILTER (row_id % 2 = 0) AS v FROM reviews GROUP BY product_id)
SELECT sum(n)::BIGINT AS reviews, count(*) AS products, max(n) AS most, sum(s1)::BIGINT AS star_1, sum(s2)::BIGINT AS star_2, sum(s3)::BIGINT AS star_3, sum(s4)::BIGINT AS star_4, sum(s5)::BIGINT AS star_5,
       sum(v)::BIGINT AS verified, sum(n) >= 500 AND sum(s1) + sum(s2) >= 100 AND sum(s3) >= 60 AS met FROM p""")
def crawl_counts(spark, sf_dir):
    df = load_reviews(spark, sf_dir).withColumn("verified_purchase", F.col("row_id") % 2 == 0)
    return aggregates.targets_met(aggregates.crawl_counts(df), 500, 100, 60)


@query("""
WITH c AS (SELECT product_id, nullif(count(*) FILTER (star = 1), 9) AS s1, nullif(count(*) FILTER (star = 2), 9) AS s2, nullif(count(*) FILTER (star = 3), 9) AS s3, nullif(count(*) FILTER (star = 4), 10) AS s4,
                  CASE WHEN product_id LIKE '%1' THEN NULL ELSE count(*) FILTER (star = 5) END AS s5, count(*) AS n FROM reviews GROUP BY product_id),
m AS (SELECT *, (s1 IS NULL)::INT + (s2 IS NULL)::INT + (s3 IS NULL)::INT + (s4 IS NULL)::INT + (s5 IS NULL)::INT AS k FROM c)
SELECT product_id, CASE WHEN k = 1 THEN CASE WHEN s1 IS NULL THEN 1 WHEN s2 IS NULL THEN 2 WHEN s3 IS NULL THEN 3 WHEN s4 IS NULL THEN 4 ELSE 5 END END AS derived_star,
       CASE WHEN k = 1 THEN greatest(n - coalesce(s1, 0) - coalesce(s2, 0) - coalesce(s3, 0) - coalesce(s4, 0) - coalesce(s5, 0), 0) END AS derived_count FROM m""")
def derived_stars(spark, sf_dir):
    c = load_reviews(spark, sf_dir).groupBy("product_id").agg(*[F.count_if(F.col("star") == s).alias(f"s{s}") for s in range(1, 6)], F.count(F.lit(1)).alias("n"))
    known = [F.nullif(f"s{s}", F.lit(10 if s == 4 else 9)) for s in range(1, 5)] + [F.when(~F.col("product_id").like("%1"), F.col("s5"))]
    star, count = aggregates.derived_star_count(known, F.col("n"))
    return c.select("product_id", star.alias("derived_star"), count.alias("derived_count"))


@query("""
SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1995-01-01' GROUP BY n_name, o_orderpriority""", base=False)
def orders_by_nation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= DATE '1995-01-01'").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows at every size
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def svm_predict(spark, sf_dir):
    """Squared hinge machines of TF-IDF words in five texts or more, fitted on the train rows; predictions for all rows, with the split."""
    rows = written(sampling.stratified_split(labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "label", "text"), "label", "doc"), "split")
    tables = [grids.Sparse("TF-IDF", 1, 5, True)]
    v = grids.merged_vectors(grids.feature_tables(rows, tables), rows, 1)
    model = svm.fit_linear(v.rows.where("split = 'train' AND y >= 0"), "doc", v.sizes, grids.balanced(rows), (1.0,), sample=0)
    names = F.array(*[F.lit(x) for x in sc.LABELS])
    return svm.linear_predict(model, v.rows, ("doc", "label", "split"), 1.0).select("doc", "label", "split", F.get(names, F.col("pred")).alias("pred"))


@query()
def rff_svm_predict(spark, sf_dir):
    """Kernel machines of pairs of classes on standardised vectors, fitted on the train rows; predictions for all rows, with the split."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("label"), "embedding")
    split = written(sampling.stratified_split(df, "label", "vec_id"), "split")
    train = split.where("split = 'train'")
    names = ["c0", "c1", "c2"]
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("label")).cast("int") - 1
    z = written(features.scaled(split, "embedding", features.scaler(train, "embedding", DIMS)).withColumn("y", number), "scaled")
    model = svm.fit_kernel(z.where("split = 'train' AND y >= 0"), "embedding", "y", "vec_id", grids.balanced(split, names), (10.0,))
    return svm.kernel_predict(model, z, "embedding", ("vec_id", "label", "split")).select("vec_id", "label", "split", F.get(F.array(*[F.lit(x) for x in names]), F.col("pred")).alias("pred"))


@query()
def w2v_features(spark, sf_dir):
    df = labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "text")
    vectors = models.word_vectors(df, "text")
    w = features.tfidf_features(df, "doc", "text", 1, 1, sublinear=False)
    return features.weighted_mean_vectors(w, vectors, df, 200)


def _split_rows(spark, sf_dir):
    """doc, split, label, text: the labelled rows, split by label."""
    rows = sampling.stratified_split(labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "label", "text"), "label", "doc")
    return written(rows.select("doc", "split", "label", "text"), "split")


LABEL_SPLIT = f"""
WITH x AS (SELECT row_id AS doc, label, {TOKENS} AS t FROM reviews WHERE label IS NOT NULL),
z AS (SELECT label AS s, count(*) AS n FROM x GROUP BY s), t AS (SELECT ceil(0.15 * sum(n) - 1e-9) AS t, sum(n) AS n FROM z),
q AS (SELECT s, floor(z.n * t / t.n::DOUBLE) AS w, z.n * t / t.n::DOUBLE - floor(z.n * t / t.n::DOUBLE) AS r, t FROM z, t),
a AS (SELECT s, w + (row_number() OVER (ORDER BY r DESC, s) <= t - sum(w) OVER ())::INT AS quota FROM q),
h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42|' || doc), doc) AS p FROM x),
sp AS (SELECT doc, label, h.t, CASE WHEN p <= quota THEN 'val' ELSE 'train' END AS split FROM h JOIN a ON s = label)"""


@query(LABEL_SPLIT + f""",
g AS (SELECT doc, split, label, unnest(t) AS term FROM sp UNION ALL SELECT doc, split, label, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM sp),
c AS (SELECT doc, split, label, term, count(*) AS tf FROM g GROUP BY ALL),
o AS (SELECT term, count(*) AS df, contains(term, ' ')::INT + 1 AS size FROM c WHERE split = 'train' GROUP BY term),
ft(f, feature, ngram, min_df) AS (VALUES (0, 'BoW', 1, 1), (1, 'BoW', 1, 2), (2, 'BoW', 2, 1), (3, 'BoW', 2, 2), (4, 'TF-IDF', 2, 1), (5, 'TF-IDF', 2, 2), (6, 'TF-IDF', 2, 3), (7, 'TF-IDF', 2, 5)),
r AS (SELECT f, doc, split, label, term, f > 3 AS tfidf, CASE WHEN f > 3 THEN (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM sp WHERE split = 'train')) / (1.0::DOUBLE + df)) + 1) ELSE tf::DOUBLE END AS raw
      FROM c JOIN o USING (term) JOIN ft ON size <= ngram AND df >= min_df),
w AS (SELECT f, doc, split, label, term, CASE WHEN tfidf THEN raw / sqrt(sum(raw * raw) OVER (PARTITION BY f, doc)) ELSE raw END AS w FROM r),
s AS (SELECT f, label, term, sum(w) AS s FROM w WHERE split = 'train' GROUP BY f, label, term),
v AS (SELECT f, count(DISTINCT term) AS v FROM s GROUP BY f), y AS (SELECT f, label, sum(s) AS total FROM s GROUP BY f, label),
n AS (SELECT label, count(*) AS n FROM sp WHERE split = 'train' GROUP BY label),
k AS (SELECT f, label, ln(n::DOUBLE / sum(n) OVER (PARTITION BY f)) AS fitted, -ln(count(*) OVER (PARTITION BY f)::DOUBLE) AS uniform, coalesce(total, 0) AS total, coalesce(v, 0) AS v
      FROM n CROSS JOIN ft LEFT JOIN y USING (f, label) LEFT JOIN v USING (f)),
al(alpha) AS (VALUES (0.1::DOUBLE), (0.3), (0.5), (1.0)), pr(fit_prior) AS (VALUES (true), (false)),
mass AS (SELECT f, doc, sum(w) AS mass FROM w WHERE split = 'val' GROUP BY f, doc),
parts AS (SELECT w.f, w.doc, s.label, alpha, sum(w * ln((s + alpha) / alpha)) AS d FROM w JOIN s ON s.f = w.f AND s.term = w.term, al WHERE split = 'val' GROUP BY w.f, w.doc, s.label, alpha),
e AS (SELECT k.f, al.alpha, fit_prior, sp.doc, sp.label AS truth, k.label, CASE WHEN fit_prior THEN fitted ELSE uniform END + coalesce(mass * ln(al.alpha / (total + al.alpha * v)), 0) + coalesce(d, 0) AS score
      FROM sp CROSS JOIN k CROSS JOIN al CROSS JOIN pr LEFT JOIN mass ON mass.f = k.f AND mass.doc = sp.doc
      LEFT JOIN parts ON parts.f = k.f AND parts.doc = sp.doc AND parts.label = k.label AND parts.alpha = al.alpha WHERE split = 'val'),
b AS (SELECT f, e.alpha, fit_prior, doc, any_value(truth) AS t, arg_min(label, (-round(score, 9), label)) AS p FROM e GROUP BY f, e.alpha, fit_prior, doc),
m AS (SELECT f, alpha, fit_prior, names.label, count(*) FILTER (t = names.label AND p = names.label) AS tp, count(*) FILTER (p = names.label) AS pp, count(*) FILTER (t = names.label) AS sp, count(*) AS n FROM b, {LABELS3} GROUP BY f, alpha, fit_prior, names.label)
SELECT feature, ngram, min_df, alpha, fit_prior, round(sum(tp)::DOUBLE / any_value(n), 4) AS accuracy, round(avg(coalesce(2.0::DOUBLE * tp / nullif(pp + sp, 0), 0)), 4) AS macro_f1
FROM m JOIN ft USING (f) GROUP BY feature, ngram, min_df, alpha, fit_prior""")
def nb_grid(spark, sf_dir):
    """Multinomial naive Bayes: eight settings over eight feature tables, fitted on train rows, scored on validation rows."""
    rows = _split_rows(spark, sf_dir)
    return grids.nb_scores(grids.feature_tables(rows), rows)


@query()
def svm_grid(spark, sf_dir):
    """Linear machines of squared hinge loss: six values of C over eight feature tables."""
    rows = _split_rows(spark, sf_dir)
    return grids.svm_scores(grids.feature_tables(rows), rows)


def _word_vector_rows(spark, sf_dir, size=200):
    """doc, split, label, vector: means of word vectors by TF-IDF, both learned from the train rows."""
    rows = _split_rows(spark, sf_dir)
    train = rows.where("split = 'train'")
    vectors = written(models.word_vectors(train, "text", size), "words")
    counts = written(features.term_counts(rows, "doc", "text"), "counts")
    idf = features.idf_table(counts.join(train.select("doc"), "doc", "left_semi"), train.agg(F.count(F.lit(1)).alias("n")))
    means = features.weighted_mean_vectors(features.tfidf(counts, idf, sublinear=False), vectors, rows, size)
    return written(rows.drop("text").join(means, "doc"), "means")


@query()
def w2v_grid(spark, sf_dir):
    """Gaussian naive Bayes (six settings) and kernel machines (five values of C) over word vectors."""
    return grids.dense_scores(_word_vector_rows(spark, sf_dir), "vector", 200)


SQL["best_configurations"] = f"SELECT * FROM ({SQL['nb_grid']}) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY macro_f1 DESC, ngram, min_df, alpha, fit_prior DESC) = 1"


@query()
def best_configurations(spark, sf_dir):
    """The best naive Bayes setting of each feature; of equal ones the first in the grid's order."""
    rows = _split_rows(spark, sf_dir)
    weights = grids.feature_tables(rows)
    return grids.best_of(grids.nb_scores(weights, rows), ["feature"], "ngram", "min_df", "alpha", F.desc("fit_prior"))


@query("SELECT event_id, user_id, event_type FROM events", base=False)
def stream_ingest(spark, sf_dir):
    """The events as a stream of files, each event once, written exactly once and read again."""
    schema = table(spark, sf_dir, "events").schema
    out, state = f"{shared_dir(spark)}/lexigrain-stream/{spark.sparkContext.applicationId}", f"stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    query_ = ingest.append_to(ingest.once_each(stream, "event_id", "ts").select("event_id", "user_id", "event_type"), f"{out}/{state}/rows", f"{out}/{state}/state")
    query_.awaitTermination()
    return spark.read.parquet(f"{out}/{state}/rows")


@query("""
SELECT a.row_id, a.product_id, b.label_star FROM reviews a JOIN reviews b ON a.row_id = b.row_id""")
def validated_join(spark, sf_dir):
    df = load_reviews(spark, sf_dir)
    return joins.one_to_one(df.select("row_id", "product_id"), df.select("row_id", "label_star"), "row_id")


@query("""
WITH t AS (SELECT row_id, label_star, CASE WHEN row_id % 7 = 0 THEN 'gold' ELSE 'pool' END AS split FROM reviews)
SELECT split, label_star, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 1) AS pct FROM t GROUP BY split, label_star""")
def split_shares(spark, sf_dir):
    """Gold rows and the pool without them, and each split's labels."""
    from pyspark.sql import Window

    df = load_reviews(spark, sf_dir).select("row_id", "label_star")
    gold = df.where("row_id % 7 = 0")
    both = joins.tagged_union({"gold": gold, "pool": joins.without(df, gold, "row_id")})
    counts = both.groupBy("split", "label_star").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 1))


@query(f"""
WITH s AS ({SQL["strat_split"]}), a AS (SELECT DISTINCT product_id FROM reviews JOIN s USING (row_id) WHERE split = 'train'), b AS (SELECT DISTINCT product_id FROM reviews JOIN s USING (row_id) WHERE split = 'val')
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b""")
def key_overlap(spark, sf_dir):
    """Products of both sides of the split that strat_split makes, and of one alone."""
    df = sampling.stratified_split(load_reviews(spark, sf_dir).select("row_id", "label_star", "product_id"), "label_star", "row_id")
    return joins.overlap(df.where("split = 'train'"), df.where("split = 'val'"), "product_id")


@query("SELECT product_id, count(*) AS n, CASE WHEN count(*) >= 50 THEN 'ok' ELSE 'few:' || count(*) END AS status FROM reviews GROUP BY product_id")
def product_status(spark, sf_dir):
    counts = load_reviews(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("status", joins.product_status(F.col("n"), 50))


@query("""
WITH r AS (SELECT l_suppkey AS product_id, l_partkey AS rid, l_linenumber % 5 + 1 AS star, l_quantity::INT % 5 + 1 AS asked, CASE WHEN l_tax > 0.01 THEN l_shipmode END AS text, l_orderkey AS page, l_linenumber AS item
           FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)),
g AS (SELECT *, row_number() OVER (PARTITION BY product_id, rid ORDER BY page, item) AS n FROM r WHERE star = asked AND coalesce(text, '') <> '')
SELECT product_id, rid, page, item FROM g WHERE n = 1 AND (product_id, rid) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 10 = 0)""", base=False)
def unseen_reviews(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        F.col("l_suppkey").alias("product_id"), F.col("l_partkey").alias("rid"), (F.col("l_linenumber") % 5 + 1).alias("star"), (F.col("l_quantity").cast("int") % 5 + 1).alias("asked"),
        F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("text"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item"),
    )
    seen = line.where("l_orderkey % 10 = 0").select(F.col("l_suppkey").alias("product_id"), F.col("l_partkey").alias("rid"))
    return joins.unseen(rows, seen).select("product_id", "rid", "page", "item")


@query("""
WITH e AS (SELECT row_id, label_star AS model, CASE WHEN row_id % 3 = 0 THEN NULL ELSE 'g' || row_id % 3 END AS grp FROM reviews WHERE label <> label_star)
SELECT coalesce(grp, '') AS grp, count(*) FILTER (model = 'Negative') AS "Negative", count(*) FILTER (model = 'Neutral') AS "Neutral", count(*) FILTER (model = 'Positive') AS "Positive" FROM e GROUP BY 1""")
def error_groups(spark, sf_dir):
    df = labelled(spark, sf_dir).where("label <> label_star").select("row_id", F.col("label_star").alias("model"))
    groups = df.where("row_id % 3 <> 0").select("row_id", F.concat(F.lit("g"), (F.col("row_id") % 3).cast("string")).alias("grp"))
    return labels.confusion(df.join(groups, "row_id", "left").withColumn("grp", F.coalesce("grp", F.lit(""))), "grp", "model")


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(median(value), 4) AS median_value, max(value) AS most, count(*) FILTER (value > 50) AS above FROM events GROUP BY event_type""", base=False)
def event_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    sums = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), F.count_if(F.col("value") > 50).alias("above"))
    users = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c")).groupBy("event_type").agg(F.count("user_id").alias("users"))
    medians = exact_percentiles(events, "event_type", "value", (0.5,)).select("event_type", F.round(F.get("q", F.lit(0)), 4).alias("median_value"))
    keys = lambda d, n: d.withColumnRenamed("event_type", n)
    out = sums.join(keys(users, "_u"), F.col("event_type").eqNullSafe(F.col("_u"))).join(keys(medians, "_m"), F.col("event_type").eqNullSafe(F.col("_m")))
    return out.select("event_type", "n", "users", "median_value", "most", "above")


@query("""SELECT l_returnflag, '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}' AS params, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""", base=False)
def encoded_params(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("l_returnflag", F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))).alias("params"), "n")
