"""Operators on fixtures: retrieval, sequences, pages, facts, assembly, audit, memo."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.operators import assemble, audit, facts, memo, pages, retrieval, sequence


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


ARTICLES = [
    # id, load_seq, code, number, title, body
    (1, 1, "blhs", "51", "Các tình tiết giảm nhẹ", "Các tình tiết giảm nhẹ trách nhiệm"),
    (2, 2, "blhs", "134", "Tội cố ý gây thương tích", "Tội cố ý gây thương tích hoặc gây tổn hại"),
    (3, 3, "blds", "134", "Thời hiệu", "Thời hiệu khởi kiện"),
    (4, 4, "blhs", "52", "Tình tiết tăng nặng", "Tình tiết tăng nặng hình sự"),
    (5, 5, "blhs", "52", "Bản sau", "bản sau của điều này"),
    (6, 6, "blds", "9", "trùng điểm", "abc xyz"),
    (7, 7, "blds", "10", "trùng điểm", "abc xyz"),
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "article_id long, load_seq long, code string, number string, title string, body string")


def naive(query):
    import re

    norm = lambda t: t.lower()
    toks = lambda t: {w for w in re.findall(K.TOKEN, norm(t)) if w not in K.STOPWORDS and len(w) > 1}
    out = {}
    q, numbers = toks(query), set(re.findall(K.CITED, norm(query)))
    for i, _, code, number, title, body in ARTICLES:
        hay = title + " " + body
        s = len(q & toks(hay)) + 3 * len(q & toks(title)) + sum(4 for p in K.PHRASES if p in norm(query) and p in norm(hay))
        s += sum(n for c, a, n, ts in K.BOOSTS if c == code and a in (None, number) and any(t in norm(query) for t in ts))
        s += 10 * (number in numbers)
        if s > 0 and q:
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["cố ý gây thương tích điều 51", "tình tiết giảm nhẹ dưới 18 tuổi", "abc xyz", "và của", "", "134"])
def test_scores_equal_the_rule_stated_for_every_pair(spark, articles, query):
    queries = spark.createDataFrame([(1, query)], "query_id long, text string")
    got = {r["article_id"]: r["score"] for r in retrieval.score_articles(queries, articles).collect()}
    assert got == naive(query)


def test_ties_keep_load_order_and_pins_come_first(spark, articles):
    queries = spark.createDataFrame([(1, "abc xyz trùng điểm")], "query_id long, text string")
    scores = retrieval.score_articles(queries, articles)
    asked = spark.createDataFrame([(1, 0, "52"), (1, 1, "51"), (1, 2, "52"), (1, 3, "999")], "query_id long, ord int, number string")
    pins = retrieval.articles_by_number(asked, articles)
    out = [(r["article_id"], r["pinned"]) for r in retrieval.pinned_top_k(scores, pins, 2).orderBy("rank").collect()]
    assert out == [(5, True), (1, True), (6, False), (7, False)]  # the last article of a number wins; pins go beyond k


def test_citations_from_lists_and_text(spark):
    rows = [(1, '{"dieu_luat_blhs_duoc_nhac_toi": ["Điều 134 khoản 1", "217a"]}'), (2, '{"dieu_luat_blhs_duoc_nhac_toi": "Điều 9, 10"}'), (3, "not json")]
    got = retrieval.citations(spark.createDataFrame(rows, "query_id long, facts string")).orderBy("query_id", "ord").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["number"])
    assert by == {1: ["134", "217a", "51", "52"], 2: ["9", "10", "51", "52"], 3: ["51", "52"]}


def test_format_articles(spark, articles):
    ranked = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "query_id long, rank int, article_id long")
    lib = articles.withColumn("law", F.lit("Luật")).withColumn("chuong", F.when(F.col("article_id") == 1, "Chương I"))
    out = retrieval.format_articles(ranked, lib, spark.createDataFrame([(1,), (2,)], "query_id long")).orderBy("query_id").collect()
    parts = out[0]["context"].split("\n\n---\n\n")
    assert parts[1] == "[Luật] Điều 134\nThời hiệu khởi kiện"
    assert parts[2].startswith("[Luật] Điều 51 (Chương I)\n")
    assert out[1]["context"].startswith("[KHÔNG TÌM THẤY")


@pytest.mark.parametrize("seed", range(3))
def test_islands_and_gaps_expand_to_the_input(spark, seed):
    rng = random.Random(seed)
    numbers = sorted(rng.sample(range(200), 90))
    df = spark.createDataFrame([("a", n) for n in numbers] + [("b", 5)], "g string, n long")
    found = sequence.islands(df, "g", "n", bucket=16)
    runs = sorted((r["lo"], r["hi"]) for r in found.where("g = 'a'").collect())
    assert [n for lo, hi in runs for n in range(lo, hi + 1)] == numbers
    assert all(b[0] - a[1] > 1 for a, b in zip(runs, runs[1:], strict=False))
    missing = sorted(r["number"] for r in sequence.missing_numbers(sequence.gaps(found, "g"), "g").collect())
    assert missing == sorted(set(range(numbers[0], numbers[-1] + 1)) - set(numbers))


def test_page_list(spark):
    found = sequence.islands(spark.createDataFrame([("f", n) for n in (1, 2, 3, 5, 7, 8)], "g string, n long"), "g", "n", bucket=4)
    assert pages.page_list(found, "g").first()["pages"] == "1–3, 5, 7–8"


LAW = """lời nói đầu
PHẦN THỨ NHẤT
NHỮNG QUY ĐỊNH CHUNG
Chương I
ĐIỀU KHOẢN
CƠ BẢN
Điều 1. Phạm vi
1. Khoản một
Mục 1
dòng thường sau tiêu đề
Điều 2. Đối tượng
Chương II:
TÊN CHƯƠNG
Điều 3a. Chèn
KHÔNG PHẢI TÊN
Điều 6. Sau
nội dung đã bãi bỏ một phần
Điều 8. Cuối
Điều 8. Lặp lại với nội dung đủ dài
Điều 9: sai dấu
XÁC THỰC VĂN BẢN HỢP NHẤT
Điều 99. Ngoài"""


def test_parse_articles_carries_headings(spark):
    rows = [(1, i, t) for i, t in enumerate(LAW.split("\n"))]
    paragraphs = spark.createDataFrame(rows, "source_id long, pos long, text string")
    got = {r["article"]: r for r in sequence.parse_articles(paragraphs).collect()}
    assert [got[i]["dieu_so"] for i in sorted(got)] == ["1", "2", "3a", "6", "8", "8"]
    assert got[1]["phan"] == "PHẦN THỨ NHẤT – NHỮNG QUY ĐỊNH CHUNG"
    assert got[1]["chuong"] == "Chương I – ĐIỀU KHOẢN CƠ BẢN"
    assert got[1]["noi_dung"] == "Phạm vi\n1. Khoản một\ndòng thường sau tiêu đề"  # a heading does not close the article
    assert got[2]["muc"] == "Mục 1"
    assert got[3]["chuong"] == "Chương II: TÊN CHƯƠNG"
    assert got[3]["muc"] == ""  # a chapter ends the section
    assert got[3]["noi_dung"] == "Chèn\nKHÔNG PHẢI TÊN"
    findings = {(r["finding"], r["item"]) for r in sequence.audit(sequence.parse_articles(paragraphs), paragraphs).collect()}
    assert {("lettered", "3a"), ("duplicate", "8"), ("repealed", "7"), ("unparsed", "Điều 9: sai dấu"), ("short", "2")} <= findings
    assert {i for f, i in findings if f == "missing"} == {"3", "4", "5"}
    assert not any(f == "out_of_order" for f, _ in findings)


def test_rejoin_lines(spark):
    rows = [
        ("Điều 1. Tiêu đề dài", 10.0, 200.0, True),
        ("nội dung chạy tới lề phải và", 10.0, 200.0, False),
        ("tiếp tục ở đây.", 10.0, 90.0, False),
        ("2. Khoản mới dừng giữa", 10.0, 120.0, False),
        ("chừng câu;", 10.0, 60.0, False),
    ]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "source_id long, ord long, text string, x0 double, x1 double, bold boolean")
    got = [r["text"] for r in sequence.rejoin_lines(df).orderBy("pos").collect()]
    assert got == ["Điều 1. Tiêu đề dài", "nội dung chạy tới lề phải và tiếp tục ở đây.", "2. Khoản mới dừng giữa chừng câu;"]


def test_judge_and_best_layer(spark):
    viet = "Tòa án nhân dân tỉnh đã thụ lý vụ án này theo quy định của pháp luật. " * 4
    latin = "this text has no marks at all and goes on for a while " * 6
    rows = [(viet, 0.0, "good"), ("ngắn", 0.0, "empty"), (latin, 0.0, "suspect"), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", 0.9, "garbage"), (viet + "(cid:1)" * 20, 0.0, "garbage")]
    df = spark.createDataFrame([(t, c) for t, c, _ in rows], "t string, c double").select(pages.judge("t", F.col("c")).alias("v"))
    assert [r["v"] for r in df.collect()] == [w for *_, w in rows]
    layers = [(1, 0, "a", "hai từ"), (1, 1, "b", "hai  từ"), (2, 0, "a", ""), (2, 1, "b", "~~~~"), (3, 0, "a", "x y"), (3, 1, "b", "x y")]
    best = {r["page"]: r["engine"] for r in pages.best_layer(spark.createDataFrame(layers, "page int, ord int, engine string, text string"), ["page"]).collect()}
    assert best == {1: "b", 2: "b", 3: "a"}  # longer wins a tie, then the earlier engine


def test_cap_and_summary(spark):
    df = spark.createDataFrame([("f", i, i % 2 == 0) for i in range(1, 9)], "f string, number int, n boolean")
    got = {r["number"]: r["method"] for r in pages.cap_pages(df, "f", "number", F.col("n"), 2).collect()}
    assert got == {1: "text", 2: "ocr", 3: "text", 4: "ocr", 5: "text", 6: "skipped", 7: "text", 8: "skipped"}
    info = spark.createDataFrame([("f", 1, "ocr", []), ("f", 2, "text", ["x"]), ("g", 1, "text", [])], "f string, number int, method string, issues array<string>")
    out = {r["f"]: r for r in pages.file_summary(info, "f").collect()}
    assert out["f"]["ocr_pages"] == [1] and out["f"]["problem_pages"] == [2] and out["f"]["needs_review"] and not out["g"]["needs_review"]


def test_cluster_boxes_folds_lines(spark):
    rows = [(1, 0.0, 10.0, 50.0, "b"), (1, 1.0, 11.0, 5.0, "a"), (1, 20.0, 30.0, 0.0, "c")]
    got = pages.cluster_boxes(spark.createDataFrame(rows, "page int, top double, bottom double, left double, text string")).first()["text"]
    assert got == "a b\nc"


def test_apply_defaults(spark):
    f = {"bi_can": [{"ho_ten": "A", "tien_an": "", "tien_su": "[THIẾU DỮ LIỆU]", "nhan_than": "x"}], "ho_so": {"so_tap": "2"}, "hanh_vi_pham_toi_tom_tat": "tóm tắt", "hanh_vi_tung_bi_can": [{"bi_can": "A", "hanh_vi_cu_the": "đánh"}]}
    got = one(spark, facts.apply_defaults("f", "t"), f=json.dumps(f, ensure_ascii=False), t="")
    assert got["suspects"][0] == {"ho_ten": "A", "nhan_than": "x", "tien_an": "Không", "tien_su": "Không", "bien_phap_ngan_chan": "Không"}
    assert (got["so_tap"], got["so_to"], got["narrative"]) == ("2", "…", "tóm tắt\nA: đánh")
    story = "Nội dung vụ án:\n" + "diễn biến " * 30 + "\nVật chứng: dao"
    assert one(spark, facts.apply_defaults("f", "t"), f=json.dumps(f), t=story)["narrative"] == ("diễn biến " * 30).strip()
    assert one(spark, facts.narrative("t"), t="Tình huống:\n" + "x" * 199) == ""
    assert one(spark, facts.narrative("t"), t="Tình huống:\n" + "x" * 200) == "x" * 200
    assert one(spark, facts.apply_defaults("f", "t"), f="[1]", t="") is None


def test_headers(spark):
    v = {"vks_truy_to": {"ten_day_du": "Viện kiểm sát nhân dân khu vực 3, tỉnh Nghệ An"}}
    got = one(spark, facts.criminal_header("f"), f=json.dumps(v, ensure_ascii=False))
    assert got["unit_name"] == "VIỆN KIỂM SÁT NHÂN DÂN KHU VỰC 3 - NGHỆ AN" and got["so_ky_hieu"] == "Số: …/CT-VKSKV3-…"
    assert one(spark, facts.criminal_header("f"), f="{}") is None
    assert one(spark, facts.criminal_header("f"), f="nonsense") is None
    c = {"loai_vu_viec": "Tranh chấp lao động", "toa_an_thu_ly": "Tòa án nhân dân tỉnh Huế", "vks_phat_bieu": {"tinh_thanh": "Huế"}}
    got = one(spark, facts.civil_header("f"), f=json.dumps(c, ensure_ascii=False))
    assert (got["ma_loai"], got["toa_an_tail"], got["vks_tail"], got["unit_name"]) == ("LĐ", "tỉnh Huế", "tỉnh Huế", "VIỆN KSND TỈNH HUẾ")
    assert one(spark, facts.is_administrative("f"), f='{"loai_vu_viec": "Hành chính"}') is True
    assert one(spark, facts.is_administrative("f"), f="oops") is False


def test_audit(spark):
    draft = "a [THIẾU DỮ LIỆU: năm] b [THIẾU DỮ LIỆU: năm] [CẦN KIỂM TRA LẠI ĐIỀU LUẬT] {{TEN}} [Gợi ý của AI, KSV cần xác nhận lại: xem lại]"
    m = one(spark, audit.marker_audit("d"), d=draft)
    assert (m["missing"], m["missing_marks"], m["law_marks"], m["conflicts"], m["suggestions"], m["open_slots"]) == (2, "[THIẾU DỮ LIỆU: năm]", 1, 0, 1, "{{TEN}}")
    body = f"thân\n{K.CHECK_BEGIN}\nx\n{K.CHECK_END}\nđuôi"
    got = one(spark, audit.split_check("d"), d=body)
    assert got["document"] == "thân\n\nđuôi" and got["appendix"] == f"{K.CHECK_BEGIN}\nx\n{K.CHECK_END}"
    got = one(spark, audit.split_check("d"), d=f"thân\n{K.CHECK_BEGIN}\nx")
    assert got["document"] == "thân" and got["appendix"] == f"{K.CHECK_BEGIN}\nx"
    assert one(spark, audit.split_check("d"), d="thân")["appendix"] is None
    kept = one(spark, audit.keep_suggestions("d", "e"), d="mở đầu\nQUYẾT ĐỊNH\nhết", e=draft)
    assert kept == "mở đầu\n\n[GỢI Ý CỦA AI, KSV CẦN XÁC NHẬN LẠI: xem lại]\n\nQUYẾT ĐỊNH\nhết"
    assert one(spark, audit.keep_suggestions("d", "e"), d=kept, e=draft) == kept
    assert one(spark, audit.legal_terms("d"), d="gửi Phòng thi hành án dân sự khu vực 3; hết") == f"gửi {K.ENFORCEMENT_NAME}; hết"
    assert "2 chỗ đánh dấu" in one(spark, audit.code_check("d"), d=draft)


def test_assembly(spark):
    assert one(spark, assemble.insert_narrative("d", "s"), d=f"a {K.NARRATIVE_SLOT} b", s="x $1\n\n y") == "a x $1\ny b"
    assert one(spark, assemble.insert_narrative("d", "s"), d="đầu\nTrên cơ sở kết quả điều tra đã xác định:\ncuối", s="s") == "đầu\nTrên cơ sở kết quả điều tra đã xác định:\ns\ncuối"
    assert one(spark, assemble.default_wording("d"), d="- Nhân thân: [THIẾU DỮ LIỆU]\nTiền án: [THIẾU DỮ LIỆU x], y") == "- Nhân thân: Không\nTiền án: Không, y"
    assert one(spark, assemble.strip_markdown("d"), d="# T\n---\n**b** *i* a*b*c\n* x\n\n\n\ny") == "T\nb i a*b*c\n- x\n\ny"
    assert one(spark, assemble.trim_statement("d"), d="QUỐC HIỆU\nCăn cứ A\nthân\nNơi nhận: x") == "Căn cứ A\nthân"
    long = "TIÊU ĐỀ\nCăn cứ A\nDanh sách những người Viện kiểm sát đề nghị Tòa án triệu tập: 1\ngiữa\nDanh sách những người Viện kiểm sát đề nghị Tòa án triệu tập: 2\nNơi nhận"
    assert one(spark, assemble.trim_indictment("d"), d=long).endswith("triệu tập: 2")


REPORT = """VIỆN KSND TỐI CAO
VIỆN KSND TỈNH NGHỆ AN
Số: 12/BC-VKS-DS
Nghệ An, ngày 3 tháng 4 năm 2026
BÁO CÁO ĐỀ XUẤT
giải quyết vụ án “Tranh chấp đất” do Tòa án nhân dân tỉnh Nghệ An thụ lý
Chúng tôi gồm: - Nguyễn Văn A - KSV
Nguyên đơn: ông B, sinh năm
Bị đơn: bà C
Sau khi nghiên cứu hồ sơ
III. QUAN ĐIỂM CỦA CÔNG CHỨC
1. Về việc tuân theo pháp luật tố tụng
Tòa án đúng.
Như vậy quá trình thụ lý là đúng
2. Đề xuất quan điểm
2.1. Chấp nhận
Trên đây là báo cáo"""


def test_reports_become_statements_that_split_again(spark):
    rows = [(1, REPORT), (2, REPORT.replace("Sau khi nghiên cứu", "Sau đó")), (3, REPORT.replace("bà C", "bà C, vụ án hành chính")), (4, None)]
    parsed = assemble.parse_reports(spark.createDataFrame(rows, "case_id long, text string"))
    out = {r["case_id"]: r for r in assemble.build_statements(parsed).collect()}
    r = out[1]["report"]
    assert (r["kind"], r["year"], r["dia_danh"], r["ten_vu_an"], r["toa_an"], r["ksv"]) == ("DAN_SU", 2026, "Nghệ An", "Tranh chấp đất", "Tòa án nhân dân tỉnh Nghệ An", "Nguyễn Văn A")
    assert out[2]["report"] is None and out[4]["report"] is None and out[3]["report"]["kind"] == "HANH_CHINH" and out[3]["statement"] is None
    text = out[1]["statement"]
    assert "Nguyên đơn: ông B, sinh năm\nBị đơn: bà C." in text  # an open year stays as it is
    assert "đại diện Viện kiểm sát nhân dân tỉnh Nghệ An phát biểu" in text and "\n1. Chấp nhận\n" in text and "Như vậy" not in text
    assert out[1]["header"]["vks_tail"] == "tỉnh Nghệ An" and out[1]["header"]["nam"] == "2026"
    parts = one(spark, assemble.split_statement("t"), t=text)
    assert parts["parties"] == ["Nguyên đơn: ông B, sinh năm", "Bị đơn: bà C."] and parts["sec1"] == ["Tòa án đúng."] and parts["kien_nghi"] == []
    assert one(spark, assemble.split_statement("t"), t="Hôm nay") is None


def test_statement_rules_apply_in_order(spark):
    header = F.struct(F.lit("tỉnh A$").alias("toa_an_tail"), *(F.lit("").alias(k) for k in "vks_tail loai ten_vu_an ma_loai unit_parent unit_name dia_danh nam".split()))
    text = "Tòa án nhân dân…(4)… x; PB-VKS-…(3)…; năm 20…"
    assert one(spark, assemble.rewrite("t", assemble.statement_rules(header)), t=text) == "Tòa án nhân dân tỉnh A$ x; PB-VKS-DS; năm 20…"


def test_memo_sends_each_prompt_once_and_stores_answers_only(spark):
    schema = "key string, system string, user string"
    asked = spark.createDataFrame([("a", "s", "u1"), ("b", "s", "u2"), ("b", "s", "u2"), ("c", "s", "bad"), ("d", "s", "")], schema)
    known = spark.createDataFrame([("a", "old")], "key string, response string")

    def call(system, user):
        if user == "bad":
            raise ValueError("no")
        return user

    out, new = memo.answer(asked, known, call, tasks=2)
    assert sorted((r["key"], r["response"]) for r in out.collect()) == [("a", "old"), ("b", "u2"), ("b", "u2"), ("c", None), ("d", None)]
    assert [r["key"] for r in new.collect()] == ["b"]


@pytest.mark.parametrize("most", [4096, 1])
def test_best_articles_equal_the_full_join(spark, tables, monkeypatch, most):
    """In one pass, and past its bound, the same rows as ranking every pair; ties in load order."""
    from quillon.plans import catalogue as c

    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    queries, articles = c._library(spark, tables)
    how = {"phrases": c.DEMO_PHRASES, "boosts": c.DEMO_BOOSTS, "cited": r"(\d+)"}
    got = retrieval.best_articles(queries, articles, 7, **how)
    want = retrieval.top_k(retrieval.score_articles(queries, articles, **how), "query_id", "load_seq", 7)
    columns = ["query_id", "rank", "article_id", "load_seq", "code", "number", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert retrieval.best_articles(queries.where("false"), articles, 7, **how).count() == 0
    assert retrieval.best_articles(queries, articles.where("false"), 7, **how).count() == 0


def test_gaps_of_any_length(spark):
    """A gap of a thousand million numbers is one row until its numbers are asked for; marks in far buckets are found."""
    far = 1_000_000_000
    n = spark.createDataFrame([("a", 1), ("a", 2), ("a", far), ("a", far + 3), ("b", 5), ("b", 9)], "g string, n long")
    between = sequence.gaps(sequence.islands(n, "g", "n"), "g")
    assert sorted(map(tuple, between.collect())) == [("a", 3, far - 1), ("a", far + 1, far + 2), ("b", 6, 8)]
    marks = spark.createDataFrame([("a", 400), ("b", 4)], "g string, n long")
    told = lambda own: sorted(map(tuple, sequence.classify_gaps(between, marks, "g", "n", F.lit(True), own=own).collect()))
    assert told(True) == [("a", 3, far - 1, True), ("a", far + 1, far + 2, False), ("b", 6, 8, False)]
    late = spark.createDataFrame([("b", far + 1)], "g string, n long")
    other = sequence.classify_gaps(between, late, "g", "n", F.lit(True), own=False)
    assert sorted((r["g"], r["lo"]) for r in other.where("repealed").collect()) == [("a", far + 1)]
    some = sequence.missing_numbers(between.where("lo > 3"), "g", 2)
    assert sorted(map(tuple, some.collect())) == [("a", far + 1), ("a", far + 2), ("b", 6), ("b", 7), ("b", 8)]


def test_gaps_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(400)) for g in "xyz" for _ in range(60)]
    marks = [(g, rng.randrange(400)) for g in "xyz" for _ in range(9)]
    n = spark.createDataFrame(rows, "g string, n long")
    between = sequence.gaps(sequence.islands(n, "g", "n", 16), "g", 16)
    want = {}
    for g in "xyz":
        own = sorted({b for a, b in rows if a == g})
        for a, b in zip(own, own[1:], strict=False):
            if b > a + 1:
                want[g, a + 1, b - 1] = any(h == g and a <= m < b for h, m in marks)
    got = sequence.classify_gaps(between, spark.createDataFrame(marks, "g string, n long"), "g", "n", F.lit(True), bucket=16)
    assert {tuple(r)[:3]: r["repealed"] for r in got.collect()} == want
