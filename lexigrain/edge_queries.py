"""Registered queries of the edges: files written and read again, pages, crawl rules, filters of the language, rater checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as sc
from .functions import text as tx
from .operators import aggregates, cleaning, features, joins, labels, metrics, ranking, sampling
from .plans import grids, models
from .queries import BASE, CLEAN, LABELLED, LABELS3, SQL, STOP, TOKENS, _predictions, _weights, labelled, query
from .sources import html as web
from .sources import tables
from .sources.reviews import load_reviews, table
from .storage import scratch, written

#: The greedy scan over near pairs in plain SQL: rows in order, each against those that are kept.
SQL["near_dup_greedy"] = SQL["near_dup_pairs"].split("\nSELECT i, j")[0].replace("WITH ", "WITH RECURSIVE ", 1) + """,
nodes AS (SELECT j AS node, list(i) AS near, row_number() OVER (ORDER BY j) AS k FROM p GROUP BY j),
scan AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL
  SELECT nodes.k, CASE WHEN len([x FOR x IN near IF NOT list_contains(gone, x)]) > 0 THEN list_append(gone, node) ELSE gone END FROM scan JOIN nodes ON nodes.k = scan.k + 1),
removed AS (SELECT unnest(gone) AS g FROM (SELECT gone FROM scan ORDER BY k DESC LIMIT 1))
SELECT j, min(i) AS i, round(arg_min(c, i), 3) AS cosine FROM p WHERE j IN (SELECT g FROM removed) AND i NOT IN (SELECT g FROM removed) GROUP BY j"""

#: The gold sample's scan in plain SQL: rows in hash order, each taken if its star's and its product's room allows.
SQL["gold_sample"] = f"""WITH RECURSIVE {BASE},
q AS (SELECT row_id, star, product_id, row_number() OVER (ORDER BY sha1('42|' || row_id), row_id) AS k FROM reviews),
scan AS (
  SELECT 0::BIGINT AS k, [20, 14, 30, 16, 20] AS room, []::VARCHAR[] AS used, NULL::BIGINT AS row_id, 0 AS star, NULL::VARCHAR AS product_id, false AS take
  UNION ALL
  SELECT k, CASE WHEN take THEN [CASE WHEN star = i THEN room[i] - 1 ELSE room[i] END FOR i IN range(1, 6)] ELSE room END, CASE WHEN take THEN list_append(used, product_id) ELSE used END, row_id, star, product_id, take
  FROM (SELECT q.k, room, used, q.row_id, q.star, q.product_id, room[q.star] > 0 AND len([x FOR x IN used IF x = q.product_id]) < 15 AS take FROM scan JOIN q ON q.k = scan.k + 1))
SELECT format('G{{:03d}}', row_number() OVER (ORDER BY sha1('43|' || row_id), row_id)) AS gold_id, row_id, star, product_id FROM scan WHERE take"""


@query("SELECT row_id, star, label, text FROM reviews")
def jsonl_append(spark, sf_dir):
    """All reviews as JSON lines, appended in two steps and read again."""
    df, path = load_reviews(spark, sf_dir).select("row_id", "star", "label", "text"), scratch(spark, "jsonl")
    tables.append_jsonl(df.where("star <= 2"), path)
    tables.append_jsonl(df.where("star > 2"), path)
    return tables.read_jsonl(spark, path, "row_id long, star int, label string, text string")


@query("SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations", base=False)
def csv_round_trip(spark, sf_dir):
    """All turns as CSV with a byte order mark, quotes and line ends in fields, read again with types."""
    path = scratch(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path, bom=True)
    return tables.read_csv(spark, path, ["conv_id", "turn", "role", "text"], {"conv_id": "long", "turn": "int"})


@query("SELECT review_id, star::VARCHAR AS star FROM reviews")
def csv_batches(spark, sf_dir):
    """Reviews in a folder of CSV for each star; a second run finds all batches done. Read again as one set of files."""
    df, path = load_reviews(spark, sf_dir).select("review_id", F.col("star").cast("string").alias("star"), F.col("star").alias("batch")), scratch(spark, "batches")
    tables.write_batches(df, path)
    tables.write_batches(df, path)
    return tables.read_csv_set(spark, f"{path}/*/*.csv", ["review_id", "star"]).select("review_id", "star")


WORDS = ("the", "and", "der", "les", "los", "une")


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM reviews) WHERE w IN {WORDS} GROUP BY w")
def word_list_counts(spark, sf_dir):
    """How often each word of a list file occurs."""
    path = scratch(spark, "words")
    spark.createDataFrame([("# function words\n" + "\n\n".join(WORDS) + "\n",)], "value string").coalesce(1).write.text(path)
    listed = tables.read_word_list(spark, path)
    each = load_reviews(spark, sf_dir).select(F.explode(tx.tokens(F.col("text"))).alias("word")).where(F.col("word").isin(listed))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/2 # some\nAllow: /en/25\nDisallow: /fr\nDisallow:\n"


@query(r"""
WITH u AS (SELECT DISTINCT url AS product_url FROM pages WHERE url IS NOT NULL),
s AS (SELECT product_url, list_filter(string_split(regexp_extract(product_url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s, regexp_extract(product_url, '^[a-z]+://[^/]+(/.*)?$', 1) AS p FROM u)
SELECT product_url, s[1] AS category, s[2] AS slug, starts_with(p, '/en/25') OR NOT (starts_with(p, '/en/2') OR starts_with(p, '/fr')) AS allowed, s[1] IN ('en', 'de') AS priority FROM s WHERE len(s) = 2""", base=False)
def sitemap_products(spark, sf_dir):
    """The pages' addresses by way of sitemaps, split, and checked against crawl rules."""
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    maps = pages.select(F.concat(F.lit("<urlset><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>")).alias("xml"))
    return web.products(maps, web.robots_rules(spark.createDataFrame([(ROBOTS,)], "text string")), priority=("en", "de"))


def _review_pages(spark, sf_dir):
    """A review page for each review, in the shop's markup: its classes and ids are fixed values."""
    c, lit = F.col, F.lit
    html = F.concat(
        lit("<html><head><title>"), (c("row_id") % 90 + 1).cast("string"), lit(" đánh giá</title></head><body><div class=\"point-average-score\">"), c("star").cast("string"), lit(","),
        (c("row_id") % 10).cast("string"), lit("</div><ul class=\"rate-list\"><li>5 <b>"), (c("row_id") % 100).cast("string"), lit(",5%</b></li></ul><ul id=\"l\"><li id=\"r-"), c("row_id").cast("string"),
        lit("\" class=\"par\"><p class=\"cmt-top-name\">Lan</p>"), F.expr("repeat('<i class=\"iconcmt-starbuy\"></i>', star)"), F.when(c("row_id") % 2 == 0, "<span class=\"confirm-buy\">ok</span>").otherwise(""),
        lit("<p class=\"cmt-txt\">Máy  "), F.coalesce("category", lit("")), lit(" &amp; <b>tốt</b></p></li></ul><div class=\"pagcomment\"><a>1</a><span>"), (c("row_id") % 30 + 1).cast("string"), lit("</span></div></body></html>"),
    )
    return load_reviews(spark, sf_dir).select("row_id", html.alias("html"))


@query(r"""
SELECT row_id, 'r-' || row_id AS rid, star, trim(regexp_replace('Máy ' || coalesce(category, '') || ' & tốt', ' +', ' ', 'g')) AS text, row_id % 2 = 0 AS verified_purchase, false AS named FROM reviews""")
def review_page_rows(spark, sf_dir):
    """Reviews from pages whose personal nodes are taken out first."""
    pages = _review_pages(spark, sf_dir).withColumn("html", web.without_blocks(F.col("html"), "p", "cmt-top-name"))
    rows = web.review_rows(pages.withColumn("named", F.col("html").contains("cmt-top-name")))
    return rows.select("row_id", "rid", "star", "text", "verified_purchase", "named")


@query("""
SELECT row_id, (row_id % 90 + 1)::INT AS title_total, round(star + row_id % 10 / 10.0, 1)::DOUBLE AS page_avg, (row_id % 30 + 1)::INT AS last_page, (row_id % 100 + 0.5)::DOUBLE AS five,
       (row_id % 30 * 20 + star)::BIGINT AS about FROM reviews""")
def review_page_stats(spark, sf_dir):
    """Totals, averages, bars and last pages of review pages, and the count that a last page with `star` rows tells."""
    s = web.page_stats(_review_pages(spark, sf_dir)).join(load_reviews(spark, sf_dir).select(F.col("row_id").alias("r"), "star"), F.col("row_id") == F.col("r"))
    about = aggregates.extrapolated_count(F.col("last_page"), F.col("star")).cast("long")
    return s.select("row_id", "title_total", "page_avg", "last_page", F.element_at("bar_pct", F.lit(5)).alias("five"), about.alias("about"))


@query("""
SELECT p_partkey, '/p' || p_size % 5 || '/' || p_partkey AS href, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 2 = 0 THEN (p_size + 0.5) * 1000 ELSE p_size END::DOUBLE AS sold,
       CASE WHEN p_size % 4 > 0 THEN 4 + p_size % 10 / 10.0 END::DOUBLE AS vote FROM part""", base=False)
def listing_page_rows(spark, sf_dir):
    """Products from the items of category pages: address, sold count, vote."""
    size, text = F.col("p_size"), F.col("p_size").cast("string")
    sold = F.when(size % 3 == 0, "Mới").otherwise(F.concat(F.lit("Đã bán "), text, F.when(size % 2 == 0, ",5k").otherwise("")))
    vote = F.when(size % 4 > 0, F.concat(F.lit("<p class=\"vote-txt\">Sao <b>4,"), (size % 10).cast("string"), F.lit("</b></p>"))).otherwise("")
    html = F.concat(
        F.lit("<ul><li class=\"item x\"><a href=\"/p"), (size % 5).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("?src=list\">x</a><div class=\"rating_Compare\">"), sold, F.lit("</div>"), vote, F.lit("</li></ul>"),
    )
    return web.listing_rows(table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))).select("p_partkey", "href", "sold", "vote")


PLANTED = "CASE WHEN row_id % 7 = 0 THEN 'Dạ, Điện Máy Xanh xin chào ' || coalesce(text, '') WHEN row_id % 11 = 0 THEN 'san pham 12' WHEN row_id % 13 = 0 THEN 'QUẢN TRỊ VIÊN' ELSE text END"


@query(rf"""
WITH t AS (SELECT row_id, coalesce({PLANTED}, '') AS t FROM reviews)
SELECT row_id, regexp_matches(t, '(?i){cleaning.VI_LETTERS}') OR list_has_any(regexp_extract_all(lower(t), '[a-z]+'), {sorted(set(cleaning.VI_PLAIN))}) AS vietnamese,
       regexp_matches(t, '(?i)^[\s\p{{Z}}]*(?:dạ[\s\p{{Z}}]*,?[\s\p{{Z}}]*)?(?:điện máy xanh|đmx|dmx)[\s\p{{Z}}]+(?:xin|rất|chân thành|cảm ơn)|quản trị viên') AS staff FROM t""")
def language_filters(spark, sf_dir):
    """The language's own letters or plain words, and replies of the shop's staff, in reviews some of which are planted."""
    t = load_reviews(spark, sf_dir).select("row_id", F.coalesce(F.expr(PLANTED), F.lit("")).alias("t"))
    return t.select("row_id", cleaning.is_vietnamese(F.col("t")).alias("vietnamese"), cleaning.is_staff_reply(F.col("t")).alias("staff"))


@query("SELECT row_id AS id, star, label_star AS label_llm, CASE WHEN star = 3 THEN 'low' ELSE 'high' END AS confidence FROM reviews")
def merged_answers(spark, sf_dir):
    """All reviews with their batch answers, which are checked and parsed."""
    df = load_reviews(spark, sf_dir).withColumnRenamed("row_id", "id")
    said = F.concat(F.lit(" "), F.upper(F.substring("label_star", 1, 3)))
    answers = df.select("id", said.alias("label_llm"), F.when(F.col("star") == 3, "low").otherwise(" High").alias("confidence"), F.lit("r").alias("reason"))
    return labels.merge_answers(df.select("id", "star"), answers).select("id", "star", "label_llm", "confidence")


@query("SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey", base=False)
def customer_lookup(spark, sf_dir):
    """Every order's customer; an order without one would be an error."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.complete_lookup(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("o_orderkey", "c_custkey", "c_nationkey")


@query("""
WITH n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, greatest(count(*) OVER () // 8, 1) AS k FROM reviews)
SELECT row_id FROM n WHERE i % k = 0 AND i // k < 8""")
def strided_rows(spark, sf_dir):
    return ranking.strided(load_reviews(spark, sf_dir).select("row_id"), "row_id").select("row_id")


@query("SELECT row_id, CASE label_star WHEN 'Negative' THEN 'Tiêu cực' WHEN 'Positive' THEN 'Tích cực' ELSE label_star END AS name FROM reviews")
def display_names(spark, sf_dir):
    return load_reviews(spark, sf_dir).select("row_id", sc.translated(F.col("label_star"), {"Negative": "Tiêu cực", "Positive": "Tích cực"}).alias("name"))


@query("SELECT row_id FROM reviews WHERE label IS NULL OR star = 3")
def unfilled_labels(spark, sf_dir):
    """Rows whose label is missing or blank."""
    df = load_reviews(spark, sf_dir).withColumn("label_human", F.when(F.col("star") == 3, "  ").otherwise(F.col("label")))
    return labels.unfilled(df, "label_human").select("row_id")


@query(rf"SELECT row_id, regexp_replace(nfc_normalize(coalesce(text, '')), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS raw, replace(coalesce(text, ''), '_', ' ') AS parted FROM reviews")
def raw_texts(spark, sf_dir):
    t = F.col("text")
    return load_reviews(spark, sf_dir).select("row_id", tx.raw_text(t).alias("raw"), tx.unsegmented(F.coalesce(t, F.lit(""))).alias("parted"))


@query(f"""
WITH t AS (SELECT row_id, len({TOKENS}) AS n, text, {CLEAN} AS clean FROM reviews),
k AS (SELECT row_id, regexp_matches(clean, '[0-9]') AS changed FROM t WHERE n BETWEEN 6 AND 35),
r AS (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY sha1('42|' || row_id), row_id) AS p FROM k)
SELECT row_id, changed FROM r WHERE p <= CASE WHEN changed THEN 6 ELSE 4 END""")
def example_rows(spark, sf_dir):
    """Six rows that a rule changes and four others, of 6 to 35 words."""
    df = load_reviews(spark, sf_dir)
    return sampling.example_rows(df, "row_id", F.col("text"), tx.cleaned(F.col("text")).rlike("[0-9]")).select("row_id", "changed")


@query(LABELLED + f""",
h AS (SELECT row_id, CASE WHEN row_id % 3 > 0 THEN label_other END AS rater FROM x),
a AS (SELECT model, rater AS t, p FROM m JOIN h USING (row_id) WHERE rater IS NOT NULL UNION ALL SELECT 'gold', rater, label FROM x JOIN h USING (row_id) WHERE rater IS NOT NULL),
r AS (SELECT model, names.label, count(*) FILTER (t = names.label AND p = names.label) AS tp, count(*) FILTER (p = names.label) AS pp, count(*) FILTER (t = names.label) AS sp, count(*) AS n FROM a, {LABELS3} GROUP BY model, names.label)
SELECT model, any_value(n) AS n, round(sum(tp)::DOUBLE / any_value(n), 4) AS accuracy, round(avg(coalesce(2.0::DOUBLE * tp / nullif(pp + sp, 0), 0)), 4) AS macro_f1 FROM r GROUP BY model""")
def second_rater_scores(spark, sf_dir):
    """Each model, and the gold labels, against a second rater's labels."""
    rater = labelled(spark, sf_dir).select("row_id", F.when(F.col("row_id") % 3 > 0, F.col("label_other")).alias("rater"))
    return metrics.second_rater_scores(_predictions(spark, sf_dir), rater, "row_id", "label", "model", "pred", "rater")


@query(LABELLED + f""",
s AS ({SQL["strat_split"]}),
r AS (SELECT split, model, names.label, count(*) FILTER (t = names.label AND p = names.label) AS tp, count(*) FILTER (p = names.label) AS pp, count(*) FILTER (t = names.label) AS sp, count(*) AS n
      FROM m JOIN s USING (row_id), {LABELS3} GROUP BY split, model, names.label),
f AS (SELECT split, model, round(avg(coalesce(2.0::DOUBLE * tp / nullif(pp + sp, 0), 0)), 4) AS f1, round(sum(tp)::DOUBLE / any_value(n), 4) AS acc FROM r GROUP BY split, model)
SELECT model, max(f1) FILTER (split = 'val') AS val_macro_f1, max(f1) FILTER (split = 'train') AS test_macro_f1, max(acc) FILTER (split = 'train') AS test_accuracy FROM f GROUP BY model""")
def validation_beside_test(spark, sf_dir):
    """Models compared on two sets of rows, side by side."""
    split = sampling.stratified_split(load_reviews(spark, sf_dir).select("row_id", "label_star"), "label_star", "row_id").select("row_id", "split")
    p = _predictions(spark, sf_dir).join(split, "row_id")
    return metrics.beside(p.where("split = 'val'"), p.where("split = 'train'"), "label", "pred", "model")


SQL["saved_model_predict"] = SQL["nb_multinomial_predict"]


@query()
def saved_model_predict(spark, sf_dir):
    """Naive Bayes saved, found again, loaded and used."""
    w, y, folder = _weights(spark, sf_dir), labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "label"), scratch(spark, "models")
    models.save_naive_bayes(models.fit_multinomial(w, y, alpha=0.5), f"{folder}/words")
    (name,) = models.saved_models(spark, folder)
    return models.predict_multinomial(models.load_naive_bayes(spark, f"{folder}/{name}"), w, y).select("doc", "pred")


@query()
def stopword_ablation(spark, sf_dir):
    """The best feature with stop words, tuned again without them, on the same validation rows; for the report only."""
    df = labelled(spark, sf_dir).select(F.col("row_id").alias("doc"), "label", "text")
    df = written(sampling.stratified_split(df, "label", "doc"), "ablation")
    found = []
    for name, stop in (("kept", ()), ("removed", STOP)):
        rows = written(df.withColumn("text", tx.content_words(F.col("text"), stop)), "words")
        found.append(written(grids.nb_scores(grids.feature_tables(rows), rows).withColumn("stop_words", F.lit(name)), "scores"))
    order = ["feature", "ngram", "min_df", "alpha", F.desc("fit_prior")]
    first = F.broadcast(grids.best_of(found[0], ["stop_words"], *order).select(F.col("feature").alias("_f")))  # one row
    both = found[0].unionByName(found[1]).join(first, F.col("feature") == F.col("_f"), "left_semi")
    return grids.best_of(both, ["stop_words"], *order).select("stop_words", "feature", "ngram", "min_df", "alpha", "fit_prior", "accuracy", "macro_f1")


@query("SELECT row_id, category, star FROM reviews WHERE category = 'fr' AND star = 2")
def parameter_lookup(spark, sf_dir):
    return joins.looked_up(load_reviews(spark, sf_dir), category="fr", star=2).select("row_id", "category", "star")


@query("SELECT row_id FROM reviews WHERE label IS NOT NULL ORDER BY row_id LIMIT 100")
def double_label_rows(spark, sf_dir):
    return ranking.first_rows(labelled(spark, sf_dir).select("row_id"), "row_id")


@query("SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages GROUP BY url HAVING max(length(html)) > 4000)", base=False)
def listed_pages(spark, sf_dir):
    """Pages whose address is among those that some long page has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return joins.members(pages.select("page_id", "url"), pages.where(F.length("html") > 4000), "url")


@query("SELECT row_id, label_star AS model, '' AS grp FROM reviews WHERE label <> label_star")
def errors_without_groups(spark, sf_dir):
    """Errors joined with an optional file of groups that isn't there."""
    groups = tables.read_csv_if_there(spark, scratch(spark, "groups") + ".csv", ["gid", "grp"])
    wrong = labelled(spark, sf_dir).where("label <> label_star").select("row_id", F.col("label_star").alias("model"))
    return wrong.join(groups, F.col("row_id") == F.col("gid").try_cast("long"), "left").select("row_id", "model", F.coalesce("grp", F.lit("")).alias("grp"))


@query("SELECT star, count(*) AS n, 1::BIGINT AS times FROM reviews GROUP BY star")
def ingest_times(spark, sf_dir):
    """Rows by star with the time of ingestion: one time for all rows of a run."""
    stamped = tables.ingested(load_reviews(spark, sf_dir).select("star"))
    return stamped.groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ingested_at").alias("times"))
