"""Column functions on hand-made texts; expected values follow from the rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_nfc_repairs_decomposed_text_and_keeps_nulls(spark):
    rows = [("Điều luật",), (unicodedata.normalize("NFD", "Điều luật"),), (None,), ("plain",)]
    got = [r["v"] for r in spark.createDataFrame(rows, "t string").select(X.nfc("t").alias("v")).collect()]
    assert got == ["Điều luật", "Điều luật", None, "plain"]


def test_tokens_drop_stopwords_and_single_characters(spark):
    assert sorted(value(spark, "Người bị hại và a 12 tuổi", lambda c: X.tokens(X.normalize(c)))) == ["12", "hại", "tuổi"]
    assert value(spark, None, lambda c: X.tokens(X.normalize(c))) == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a\r\nb\rc", "a\nb\nc"), ("x \t\n\n\n\ny\x00z", "x\n\nyz"), ("  a b ", "a b"), (None, ""), ("a" + chr(0xA0) + "b" + chr(0x200B), "a b")],
)
def test_clean_text(spark, raw, want):
    assert value(spark, raw, X.clean_text) == want


def test_score_text_counts_words_and_marked_words(spark):
    assert value(spark, "Tòa án nhân dân", X.score_text) == 2 * 4 + 5 * 4
    assert value(spark, "123 !", X.score_text) == -1
    assert value(spark, None, X.score_text) == -1


def test_text_stats(spark):
    s = value(spark, "Tòa án (cid:12) [không đọc được]", X.text_stats)
    assert s["unreadable_marks"] == 1
    assert s["chars"] == len("Tòaán(cid:12)[khôngđọcđược]")
    assert s["bad_ratio"] == pytest.approx(6 / s["chars"])
    assert value(spark, "", X.text_stats).asDict() == {"chars": 0, "words": 0, "viet_ratio": 0.0, "bad_ratio": 0.0, "unreadable_marks": 0}


def test_legacy_code_page_is_translated(spark):
    old = "ViÖt Nam quyÕt ®Þnh " * 8
    got = value(spark, old, X.fix_legacy)
    assert got["encoding"] == "TCVN3"
    assert got["text"].startswith("Việt Nam quyết định")
    assert value(spark, "Việt Nam", X.fix_legacy)["encoding"] is None
    assert value(spark, "vieät baûn " * 20, X.fix_legacy)["encoding"] == "VNI"


@pytest.mark.parametrize(
    ("line", "level"),
    [("Chương II", "chuong"), ("PHẦN THỨ NHẤT", "phan"), ("Tiểu mục 1", "tieu_muc"), ("Mục 3. ABC", "muc"), ("Điều 1. X", None)],
)
def test_structure_level(spark, line, level):
    assert value(spark, line, X.structure_level) == level


def test_article_number_and_title(spark):
    assert value(spark, "Điều 217a.  Tội vi phạm", X.article_number) == "217a"
    assert value(spark, "Điều 217a.  Tội vi phạm", X.article_title) == "Tội vi phạm"
    assert value(spark, "Điều 5: x", X.article_number) == ""


def test_case_type_needs_four_marks_and_three_times_the_others(spark):
    civil = "nguyên đơn, BỊ ĐƠN, người khởi kiện, án phí dân sự"
    assert value(spark, civil, X.case_type) == "DAN_SU_HANH_CHINH"
    assert value(spark, civil + " bị can truy tố", X.case_type) is None
    assert value(spark, "bị can " * 4, X.case_type) == "HINH_SU"
    assert value(spark, "bị can " * 3, X.case_type) is None


def test_is_filled(spark):
    for text, want in (("x", True), ("  ", False), ("[thiếu dữ liệu: năm]", False), (None, False)):
        assert value(spark, text, X.is_filled) is want


def test_cut_json(spark):
    assert value(spark, 'x ```json {"a": {"b": 1}} ``` y', X.cut_json) == '{"a": {"b": 1}}'
    assert value(spark, "no braces", X.cut_json) == "no braces"
    assert value(spark, "} {", X.cut_json) == "} {"


def test_title_lines_and_number_keys(spark):
    assert value(spark, "NHỮNG QUY ĐỊNH CHUNG", X.is_title_line) is True
    assert value(spark, "Những", X.is_title_line) is False
    assert value(spark, "12", X.is_title_line) is False
    rows = spark.createDataFrame([("217a",), ("217",), ("218",), ("30",)], "n string").orderBy(X.number_key("n"))
    assert [r["n"] for r in rows.collect()] == ["30", "217", "217a", "218"]


def test_fold(spark):
    assert value(spark, " Thủy  Đặng ", X.fold) == "thuy dang"
