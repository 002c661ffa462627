"""Rows from crawled pages by built-in expressions: no parser objects, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import comma_number, sold_count, url_segments
from ..functions.text import one_spaced


def unescaped(text: Column) -> Column:
    """The five named entities and the hard space as characters; the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def inner_text(html: Column) -> Column:
    """Text without tags, scripts and styles, single spaces."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return one_spaced(unescaped(F.regexp_replace(bare, "<[^>]*>", " ")))


def sitemap_urls(xml: Column) -> Column:
    """Array of the locations of a sitemap."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit("(?s)<loc>\\s*(.*?)\\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def products(sitemaps: DataFrame, rules: DataFrame, xml: str = "xml", priority: tuple[str, ...] = ()) -> DataFrame:
    """product_url, category, slug, allowed, priority: URLs of two path segments, each once."""
    urls = sitemaps.select(F.explode(sitemap_urls(F.col(xml))).alias("product_url")).distinct()
    parts = urls.withColumn("_s", url_segments(F.col("product_url"))).where(F.size("_s") == 2)
    out = parts.select("product_url", F.get("_s", F.lit(0)).alias("category"), F.get("_s", F.lit(1)).alias("slug"))
    return robots_allowed(out, rules, "product_url").withColumn("priority", F.col("category").isin(list(priority)) if priority else F.lit(False))


def robots_rules(robots: DataFrame, text: str = "text", agent: str = "*") -> DataFrame:
    """allow, prefix: the rules of robots.txt for an agent (its own group's, by the agent's name or *)."""
    lines = robots.select(F.posexplode(F.split(F.coalesce(text, F.lit("")), "\\r?\\n")).alias("n", "line"))
    kv = lines.select("n", F.lower(F.trim(F.regexp_extract("line", "^\\s*([A-Za-z-]+)\\s*:", 1))).alias("k"), F.trim(F.regexp_extract("line", ":\\s*([^#]*)", 1)).alias("v"))
    array = kv.agg(F.sort_array(F.collect_list(F.struct("n", "k", "v"))).alias("a"))  # one file
    step = F.aggregate(
        "a", F.struct(F.lit("").alias("agent"), F.array().cast("array<struct<agent:string,allow:boolean,prefix:string>>").alias("out")),
        lambda acc, x: F.struct(
            F.when(x["k"] == "user-agent", x["v"]).otherwise(acc["agent"]).alias("agent"),
            F.when(x["k"].isin("allow", "disallow") & (x["v"] != ""), F.concat(acc["out"], F.array(F.struct(acc["agent"].alias("agent"), (x["k"] == "allow").alias("allow"), x["v"].alias("prefix"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return array.select(F.explode(step["out"]).alias("r")).where(F.lower(F.col("r.agent")) == agent.lower()).select("r.allow", "r.prefix")


def robots_allowed(df: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """df with allowed: the longest rule that the path begins with decides, allow before disallow; none allows."""
    path = F.regexp_extract(F.col(url), "^[a-z]+://[^/]+(/.*)?$", 1)
    listed = rules.agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("_rules"))  # a file's rules
    joined = df.crossJoin(F.broadcast(listed)).withColumn("_p", F.when(path == "", "/").otherwise(path))
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("_p"), r["prefix"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_rules", "_p")


def blocks(html: Column, tag: str, attribute: str = "") -> Column:
    """Array of the whole elements of a tag that hold none of their own kind."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?is)<{tag}\\b[^>]*{attribute}[^>]*>(?:(?!<{tag}\\b).)*?</{tag}>"), F.lit(0))


def without_blocks(html: Column, tag: str, css_class: str) -> Column:
    """html without the elements of a class: personal nodes are taken out before a page is kept."""
    return F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*class=\"[^\"]*\\b{css_class}\\b[^\"]*\"[^>]*>(?:(?!<{tag}\\b).)*?</{tag}>", "")


def review_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns and rid, star, text, verified_purchase, used_for of each review item.

    Fixed values: the classes of the review list's markup.
    """
    item = F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<li\\b[^>]*class=\"[^\"]*\\bpar\\b[^\"]*\"[^>]*>.*?(?=<li\\b[^>]*class=\"[^\"]*\\bpar\\b|</ul>|$)"), F.lit(0)))
    one = pages.withColumn("_li", item)
    part = lambda cls: F.regexp_extract("_li", f"(?is)class=\"[^\"]*\\b{cls}\\b[^\"]*\"[^>]*>(.*?)</", 1)
    return one.select(
        *[c for c in pages.columns if c != html], F.regexp_extract("_li", "(?is)^<li\\b[^>]*\\bid=\"([^\"]*)\"", 1).alias("rid"),
        F.size(F.regexp_extract_all("_li", F.lit("iconcmt-starbuy"), F.lit(0))).alias("star"), inner_text(part("cmt-txt")).alias("text"),
        F.col("_li").contains("confirm-buy").alias("verified_purchase"), F.nullif(inner_text(part("cmtd")), F.lit("")).alias("used_for"),
    )


def listing_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns and href, sold, vote of each item of a category page."""
    item = F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<li\\b[^>]*class=\"[^\"]*\\bitem\\b[^\"]*\"[^>]*>.*?</li>"), F.lit(0)))
    one = pages.withColumn("_li", item)
    href = F.regexp_extract("_li", "(?is)<a\\b[^>]*href=\"([^\"?#]+)", 1)
    meta = inner_text(F.regexp_extract("_li", "(?is)class=\"[^\"]*rating_Compare[^\"]*\"[^>]*>(.*?)</(?:div|p)>", 1))
    vote = inner_text(F.regexp_extract("_li", "(?is)class=\"[^\"]*vote-txt[^\"]*\"[^>]*>.*?<b>(.*?)</b>", 1))
    out = one.select(*[c for c in pages.columns if c != html], href.alias("href"), sold_count(meta).alias("sold"), comma_number(F.nullif(vote, F.lit(""))).alias("vote"))
    return out.where(F.col("href") != "")


def page_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns and title, title_total, page_avg, last_page of a review page, bar_pct as a map of star to percent."""
    h = F.coalesce(html, F.lit(""))
    title = inner_text(F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1))
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    pager = F.regexp_extract(h, "(?is)class=\"[^\"]*pagcomment[^\"]*\"[^>]*>(.*?)</div>", 1)
    last = F.array_max(F.transform(F.regexp_extract_all(inner_text(pager), F.lit("\\d+"), F.lit(0)), lambda x: x.cast("int")))
    bars = F.regexp_extract_all(inner_text(F.regexp_extract(h, "(?is)class=\"[^\"]*rate-list[^\"]*\"[^>]*>(.*?)</ul>", 1)), F.lit("[1-5]\\D+[\\d.,]+\\s*%"), F.lit(0))
    entry = F.transform(bars, lambda b: F.struct(F.substring(b, 1, 1).cast("int").alias("k"), comma_number(F.regexp_extract(b, "\\D+([\\d.,]+)", 1)).alias("v")))
    return pages.select(
        *[c for c in pages.columns if c != html], title.alias("title"), number(title, "^\\s*(\\d+)").cast("int").alias("title_total"),
        comma_number(number(inner_text(F.regexp_extract(h, "(?is)class=\"[^\"]*point-average-score[^\"]*\"[^>]*>(.*?)</", 1)), "([\\d.,]+)")).alias("page_avg"),
        F.coalesce(last, F.lit(1)).alias("last_page"), F.map_from_entries(F.array_distinct(entry)).alias("bar_pct"),
    )
