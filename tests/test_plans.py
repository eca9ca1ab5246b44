"""Whole cases with a stub, decided pages, results as DOCX, and the catalogue against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.test_operators import ARTICLES, REPORT

from quillon.functions import constants as K
from quillon.operators import pages
from quillon.plans import cases, catalogue
from quillon.sources import docx_out
from quillon.sources.docx import docx_bytes, docx_text


def stub(system, user):
    if "Classify" in system:
        return "HÌNH SỰ"
    if "Extract" in system:
        return '```json\n{"toi_danh_nghi_van": "cố ý gây thương tích", "dieu_luat_blhs_duoc_nhac_toi": ["134"], "dien_bien_vu_an_nguyen_van": "A đánh B."}\n```'
    return f"TIÊU ĐỀ\nCăn cứ luật\n{K.NARRATIVE_SLOT}\n- Nhân thân: [THIẾU DỮ LIỆU]\n{'134' if 'Điều 134' in user else 'none'}"


def test_run_cases(spark, tmp_path):
    rows = [("r", REPORT), ("c", "bị can truy tố cáo trạng bị can " * 3), ("o", "một văn bản không rõ loại nhưng đủ dài để được xử lý tiếp"), ("s", "ngắn")]
    rows[0] = ("r", REPORT + "\nnguyên đơn bị đơn người khởi kiện án phí dân sự")
    lib = spark.createDataFrame(ARTICLES, "article_id long, load_seq long, code string, number string, title string, body string")
    lib = lib.withColumn("law", F.lit("Luật")).withColumn("chuong", F.lit(""))
    out, known = cases.run_cases(spark.createDataFrame(rows, "case_id string, text string"), lib, stub, str(tmp_path))
    got = {r["case_id"]: r for r in out.collect()}
    assert set(got) == {"r", "c", "o"}
    assert got["r"]["direct"] and got["r"]["final"].startswith("Căn cứ Điều 27")
    assert got["c"]["case_type"] == got["o"]["case_type"] == K.CRIMINAL
    assert got["c"]["final"] == "Căn cứ luật\nA đánh B.\n- Nhân thân: Không\n134"
    assert got["c"]["laws"].split("\n\n---\n\n")[1].startswith("[Luật] Điều 134")
    assert K.CHECK_BEGIN in got["c"]["appendix"]
    assert known.count() == 4  # one to classify, two to extract, one draft: both have the same facts and laws


def test_decided_pages(spark):
    viet = "Tòa án nhân dân tỉnh đã thụ lý vụ án này theo quy định của pháp luật. "
    layers = [("f", 1, 0, "a", viet), ("f", 2, 0, "a", ""), ("f", 3, 0, "a", ""), ("f", 4, 0, "a", "(cid:1)" * 30 + viet), ("f", 5, 0, "a", ""), ("f", 6, 0, "a", "")]
    images = [("f", i, 0.0 if i in (1, 4) else 0.9, i == 2) for i in range(1, 7)]
    readings = [("f", 3, "Tesseract", viet, 0.5, None), ("f", 4, "x", "ít", 0.99, None), ("f", 5, "x", None, None, "boom")]
    out = pages.decide_pages(
        spark.createDataFrame(layers, "file string, page int, ord int, engine string, text string"),
        spark.createDataFrame(images, "file string, page int, coverage double, blank boolean"),
        spark.createDataFrame(readings, "file string, page int, engine string, text string, confidence double, error string"),
        most=3,
    )
    got = {r["page"]: (r["method"], set(r["issues"])) for r in out.collect()}
    assert got[1] == ("text", set()) and got[2] == ("blank", set())
    assert got[3] == ("ocr", {"low_confidence"})
    assert got[4] == ("text", {"garbage_layer", "reading_not_better"})
    assert got[5] == ("failed", {"reading_failed"}) and got[6] == ("skipped", {"over_the_limit"})
    f = pages.read_files(out).first()
    assert f["ocr_pages"] == [3] and f["problem_pages"] == [3, 4, 5, 6] and f["needs_review"] and f["text"].startswith("Tòa án")


def test_results_as_docx(spark):
    template = docx_bytes(["Kính gửi {{BODY}}", "Cuối", "{{APPENDIX}}"])
    rows = spark.createDataFrame([("1", "một\nhai", "phụ lục")], "case_id string, final string, appendix string")
    filled, composed = docx_out.write_results(rows, template).first(), docx_out.write_results(rows).first()
    assert docx_text(bytes(filled["content"]))[0] == "Kính gửi một\nhai\nCuối\nphụ lục"
    assert docx_text(bytes(composed["content"]))[0] == "một\nhai\nphụ lục"
    assert "BODY" in docx_out.write_results(rows, docx_bytes(["none"])).first()["error"]


@pytest.fixture(scope="module")
def sql(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(tables):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, sql, tables, name):
    got = catalogue.QUERIES[name](spark, tables)
    names = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect())))
    if name not in catalogue.SQL:
        assert rows and "False" not in "".join(rows)
        return
    want = sql.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    assert rows == sorted(map(repr, (tuple(dict(zip(columns, r, strict=True))[c] for c in names) for r in want.fetchall())))


def test_nothing_outside_llm_imports_it():
    root = os.path.dirname(os.path.dirname(__file__))
    for folder, _, files in os.walk(os.path.join(root, "quillon")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                assert "quillon.llm" not in open(os.path.join(folder, f), encoding="utf8").read()
