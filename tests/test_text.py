"""Text and scalar functions on hand-written cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrain.functions import scalars as sc
from lexigrain.functions import text as tx


def each(spark, column, values, kind="string"):
    rows = [(k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"k int, x {kind}")
    return [r["y"] for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_comparison_key(spark):
    assert each(spark, tx.comparison_key, ["..Tốt!! ", "Tốt", "a  b\tc ", None, "- ~ -", "Ü"]) == ["tốt", "tốt", "a b c", "", "", "ü"]


def test_word_count(spark):
    assert each(spark, tx.word_count, ["  a b ", "a b", "", None, "\n", "x"]) == [2, 2, 0, 0, 0, 1]


def test_cleaned(spark):
    texts = ["tốt.máy", "xem https://a.b/c?d nhé", "mail a@b.co x", "<b>đậm</b>", "gọi <phone> nhé", "hay 😀 quá", "snake_case", "a  b", None, "1.000 đ", "www.x.y ok"]
    want = ["tốt. máy", "xem nhé", "mail x", "đậm", "gọi nhé", "hay quá", "snake case", "a b", "", "1.000 đ", "ok"]
    assert each(spark, tx.cleaned, texts) == want


def test_normalized(spark):
    texts = ["hoà", "HOÀ", "thuỷ", "quý", "tốtttt", "!!!", "aa bbb", "hoàn", "khoẻ.", "?!?!"]
    assert each(spark, tx.normalized, texts) == ["hòa", "HOÀ", "thủy", "quý", "tốt", "!", "aa b", "hoàn", "khỏe.", "?!?!"]


def test_corrector(spark):
    fix = tx.corrector({"ko": "không", "k": "ko", "nv": "nhân viên", "nv gh": "người giao"})
    assert each(spark, fix, ["Ko tốt", "ko_x", "k", "nv gh", "nv", "ako", None, ""]) == ["không tốt", "ko_x", "ko", "người giao", "nhân viên", "ako", None, ""]
    assert each(spark, tx.corrector({}), ["x", None]) == ["x", None]


def test_content_words(spark):
    words = lambda c: tx.content_words(c, stop=("the", "not"), keep=("not",))
    assert each(spark, words, ["the not máy_giặt a 12 _x_ ab!", "", None, "x1"]) == ["not máy_giặt ab", "", "", "x1"]


def test_segments(spark):
    join = tx.joined_compounds(["máy giặt", "máy giặt lớn"])
    assert each(spark, join, ["Máy giặt lớn tốt", "giặt máy", ""]) == ["Máy_giặt_lớn tốt", "giặt máy", ""]
    assert each(spark, tx.unsegmented, ["a_b c"]) == ["a b c"]


def test_phones(spark):
    texts = ["gọi 0912345678", "+84 912 345 678", "xxxx231245", "giá 10.000.000", "id a0912345678", None]
    assert each(spark, tx.mask_phones, texts) == ["gọi <phone>", "<phone>", "<phone>", "giá 10.000.000", "id a0912345678", None]


def test_pipelines(spark):
    got = each(spark, lambda c: tx.model_text(c, tx.corrector({"ko": "không"}), None, ("là",)), ["Máy Ko là TỐT!!! :)", None])
    assert got == ["máy không tốt", ""]
    assert each(spark, lambda c: tx.sequence_text(c), ["Máy  TỐT!!!"]) == ["Máy TỐT!"]


def test_labels(spark):
    assert each(spark, sc.parsed_label, ["Pos", " NEG ", "", None, "neutral"]) == ["Positive", "Negative", None, None, "Neutral"]
    with pytest.raises(PySparkException):
        each(spark, sc.parsed_label, ["foo"])
    assert each(spark, sc.star_label, [1, 2, 3, 4, 5, 6, None], "int") == ["Negative", "Negative", "Neutral", "Positive", "Positive", None, None]
    assert each(spark, sc.label_origin, ["nguoi", "llm_chap_nhan", None, "?"]) == ["human", "llm_accepted", "llm", "llm"]


def test_numbers(spark):
    assert each(spark, sc.comma_number, ["4,9", "abc", None, "3"]) == [4.9, None, None, 3.0]
    assert each(spark, sc.sold_count, ["★ 4.9 • Đã bán 41,8k", "Đã bán 950", "none", None]) == [41800.0, 950.0, 0.0, 0.0]
    assert each(spark, lambda c: sc.local_number(c, 3), [0.7905, 1234.5, 0.0005], "double") == ["0,791", "1.234,500", "0,001"]
    assert each(spark, lambda c: sc.local_number(c), [1234567.0], "double") == ["1.234.567"]


def test_names(spark):
    assert each(spark, sc.slug, ["TF-IDF + SVM", "Điện máy", " é "]) == ["tf_idf_svm", "dien_may", "e"]
    assert each(spark, lambda c: sc.numbered_id("P", 4, c), [7, 12345], "int") == ["P0007", "P12345"]
    assert each(spark, sc.url_segments, ["https://a.b/x/y?z", "https://a.b/", None]) == [["x", "y"], [], []]
    assert each(spark, lambda c: sc.translated(c, {"a": "b"}), ["a", "c"]) == ["b", "c"]
    assert each(spark, lambda c: sc.content_id(c, F.lit(1)), ["p"]) == [__import__("hashlib").sha1(b"p|1").hexdigest()[:16]]
