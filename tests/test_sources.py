"""Edge formats, pages and streams."""

import json

from pyspark.sql import functions as F

from lexigrain.sources import html as web
from lexigrain.sources import tables
from lexigrain.streaming import ingest


def test_csv_with_mark_and_surplus_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text,n\nG1,"x, ""y""",4,\nG2,,nope,\n', encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text", "n"], {"n": "int"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("G1", 'x, "y"', 4), ("G2", None, None)]


def test_csv_round_trip_and_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", None, 1), ("c", "z", 2)], "id string, t string, batch int")
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"), bom=True)
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), ["id", "t", "batch"]).collect())) == [("a", "x", "1"), ("b", None, "1"), ("c", "z", "2")]
    tables.write_batches(df.where("batch = 1"), str(tmp_path / "b"))
    tables.write_batches(df, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).count() == 3
    assert tables.path_exists(spark, str(tmp_path / "b")) and not tables.path_exists(spark, str(tmp_path / "no"))
    assert {r["file"].split("-")[0] for r in tables.read_csv_set(spark, str(tmp_path / "b/*/*.csv"), ["id", "t"]).collect()} == {"part"}


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("m", "f1", 0.5), ("m", "p", float("nan"))], "model string, metric string, value double")
    assert json.loads(tables.nested_json(df, ["model", "metric"], "value")) == {"m": {"f1": 0.5, "p": None}}
    tables.append_jsonl(df.limit(1), str(tmp_path / "j"))
    tables.append_jsonl(df.limit(1), str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "model string").count() == 2
    (tmp_path / "d.json").write_text('{\n "a": 1\n}')
    assert tables.read_json_document(spark, str(tmp_path / "d.json"), "a int").first()["a"] == 1


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\nko\tkhông\n\nsp\tsản phẩm\n", encoding="utf-8")
    assert tables.read_word_map(spark, str(tmp_path / "w.txt")) == {"ko": "không", "sp": "sản phẩm"}


def test_sitemap_and_robots(spark):
    xml = "<urlset><url><loc>https://s.vn/a/b?x=1&amp;y=2</loc></url><url><loc> https://s.vn/a/c </loc></url><loc>https://s.vn/only</loc><loc>https://s.vn/a/c</loc></urlset>"
    robots = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /a/b # no\nAllow: /a/bc\nDisallow:\n"
    rules = web.robots_rules(spark.createDataFrame([(robots,)], "text string"))
    assert sorted(map(tuple, rules.collect())) == [(False, "/a/b"), (True, "/a/bc")]
    got = {r["product_url"]: r for r in web.products(spark.createDataFrame([(xml,)], "xml string"), rules, priority=("a",)).collect()}
    assert set(got) == {"https://s.vn/a/b?x=1&y=2", "https://s.vn/a/c"} and not got["https://s.vn/a/b?x=1&y=2"]["allowed"] and got["https://s.vn/a/c"]["allowed"]
    one = web.robots_allowed(spark.createDataFrame([("https://s.vn/a/bcd",), ("https://s.vn",)], "u string"), rules, "u")
    assert [r["allowed"] for r in one.collect()] == [True, True]


PAGE = """<html><head><title>12 đánh giá &amp; nhận xét</title></head><body><div class="point-average-score">4,9</div>
<ul class="rate-list"><li>5 <b>99.7%</b></li><li>1 0,3 %</li></ul>
<ul id="scrollList"><li id="r-1" class="par"><p class="cmt-top-name">Lan</p><i class="iconcmt-starbuy"></i><i class="iconcmt-starbuy"></i><span class="confirm-buy">ok</span>
<div class="cmt-content"><p class="cmt-txt">Máy  tốt<br>lắm</p></div><span class="cmtd">Đã dùng 3 tháng</span></li><li class="par x" id="r-2"><p class="cmt-txt">Tệ</p></li></ul>
<div class="pagcomment"><a>1</a><a>2</a><span>17</span></div></body></html>"""


def test_review_page(spark):
    df = spark.createDataFrame([("p1", PAGE), ("p2", None)], "page string, html string")
    got = {r["rid"]: r for r in web.review_rows(df).collect()}
    assert tuple(got["r-1"]) == ("p1", "r-1", 2, "Máy tốt lắm", True, "Đã dùng 3 tháng") and got["r-2"]["star"] == 0 and got["r-2"]["used_for"] is None
    stats = {r["page"]: r for r in web.page_stats(df).collect()}
    assert stats["p1"]["title"] == "12 đánh giá & nhận xét" and stats["p1"]["title_total"] == 12 and stats["p1"]["page_avg"] == 4.9 and stats["p1"]["last_page"] == 17
    assert stats["p1"]["bar_pct"] == {5: 99.7, 1: 0.3} and stats["p2"]["last_page"] == 1
    assert "Lan" not in df.select(web.without_blocks(F.col("html"), "p", "cmt-top-name")).first()[0]


def test_listing(spark):
    item = '<ul class="listproduct"><li class="item a"><a class="main-contain" href="/tv/x?s=1">X</a><div class="rating_Compare">★ 4.9 • Đã bán 41,8k</div><div class="vote-txt"><b>4.9</b></div></li><li class="item"><a>no link</a></li></ul>'
    assert [tuple(r) for r in web.listing_rows(spark.createDataFrame([("c", item)], "cat string, html string")).collect()] == [("c", "/tv/x", 41800.0, 4.9)]


def test_stream_takes_each_review_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    row = lambda k, t: json.dumps({"review_id": k, "text": t, "crawled_at": f"2026-01-0{t[-1]}T00:00:00Z"})
    schema = "review_id string, text string, crawled_at timestamp"

    def run():
        stream = ingest.prepared(ingest.once_each(ingest.read_stream(spark, str(source), schema)))
        ingest.append_to(stream, str(out), str(tmp_path / "state")).awaitTermination()
        return sorted(r["review_id"] for r in spark.read.schema(schema).parquet(str(out)).collect())

    (source / "a.json").write_text("\n".join([row("a", "gọi 0912345678 t1"), row("b", "t1"), row("a", "t2")]))
    assert run() == ["a", "b"]
    (source / "b.json").write_text("\n".join([row("b", "t2"), row("c", "t3")]))
    assert run() == ["a", "b", "c"]
    assert "<phone>" in spark.read.schema(schema).parquet(str(out)).where("review_id = 'a'").first()["text"]


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps({"t": f"2026-01-01T0{h}:10:00Z", "k": "x"}) for h in (0, 0, 1, 9)))
    stream = spark.readStream.schema("t timestamp, k string").json(str(tmp_path))
    q = ingest.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("w").orderBy("window_start").collect()][:2] == [2, 1]
