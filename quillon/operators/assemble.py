"""Texts put together from facts: narratives, default wording, trimming, ordered rewrites, statements from reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X
from quillon.operators.audit import split_check
from quillon.operators.facts import tail



def _rest(text: Column, start: Column) -> Column:
    return F.substring(text, start, F.lit(1 << 30))


def _head(text: Column, length: Column) -> Column:
    return F.substring(text, F.lit(1), length)


def insert_narrative(document: Column | str, story: Column | str) -> Column:
    """The story in its slot; without one, after the line that leads to it; without that, nowhere."""
    slot, right, left = F.lit(K.NARRATIVE_SLOT), X.U + r"\s+$", X.U + r"^\s+"
    told = F.array_join(F.filter(F.transform(F.split(X.strip(X.empty(story)), "\n"), X.strip), lambda x: x != ""), "\n")

    def led(doc: Column, told: Column, lead: Column) -> Column:
        end = F.instr(doc, lead) + F.length(lead)
        after = F.concat(F.regexp_replace(_head(doc, end - 1), right, ""), F.lit("\n"), told, F.lit("\n"), F.regexp_replace(_rest(doc, end), left, ""))
        return F.when(lead != "", after).otherwise(doc)

    def put(doc: Column, told: Column) -> Column:
        lead = F.regexp_extract(doc, r"(?Ud)(?im)^(.*Trên cơ sở kết quả điều tra[^\n]*\n?)", 1)
        return (
            F.when(told == "", X.strip(F.replace(doc, slot, F.lit(""))))
            .when(F.contains(doc, slot), F.replace(doc, slot, told))
            .otherwise(X.let(lead, lambda x: led(doc, told, x)))
        )

    return X.let(X.empty(document), lambda doc: X.let(told, lambda t: put(doc, t)))


def default_wording(document: Column | str) -> Column:
    no = "$1Không"
    out = F.regexp_replace(X.empty(document), r"(?Ud)(?im)^(\s*-?\s*(?:Nhân thân|Tiền án, tiền sự|Biện pháp ngăn chặn[^:\n]*)\s*:\s*)" + K.MISSING_MARK + r"\s*$", no)
    for name in ("Tiền án", "Tiền sự"):
        out = F.regexp_replace(out, rf"(?Ud)(?i)({name}\s*:\s*)" + K.MISSING_MARK, no)
    return F.regexp_replace(out, r"(?Ud)(?im)^\s*-?\s*Hồ sơ vụ án gồm[^\n]*$", K.FILE_LINE)


def _with_appendix(document: Column, appendix: Column) -> Column:
    return F.when(appendix.isNull() | (appendix == ""), document).otherwise(X.strip(F.concat(document, F.lit("\n\n"), appendix)))


def _from(doc: Column, pattern: str) -> Column:
    """From the first match on; the whole text without one."""
    return X.let(F.regexp_instr(doc, F.lit("(?Ud)(?m)" + pattern)), lambda at: F.when(at > 0, _rest(doc, at)).otherwise(doc))


def trim_indictment(c: Column | str) -> Column:
    """From the first legal basis to the end of the last line that names whom to summon; the appendix stays."""
    upto = "(?Ud)(?im)(?s:(\\A.*" + K.BODY_END.replace("^", "(?m:^)", 1) + "))"

    def ended(doc: Column) -> Column:
        return X.let(F.regexp_extract(doc, upto, 1), lambda x: F.when(x != "", x).otherwise(doc))

    return X.let(split_check(c), lambda p: _with_appendix(X.strip(X.let(_from(p["document"], r"^\s*Căn cứ"), ended)), p["appendix"]))


def trim_statement(c: Column | str) -> Column:
    """From the first legal basis to the list of recipients; the appendix stays."""

    def ended(doc: Column) -> Column:
        at = F.regexp_instr(doc, F.lit(r"(?Ud)(?m)^\W*(?:\*\*)?Nơi nhận"))
        return X.let(at, lambda x: F.when(x > 0, _head(doc, x - 1)).otherwise(doc))

    return X.let(split_check(c), lambda p: _with_appendix(X.strip(X.let(_from(p["document"], r"^\W*Căn cứ"), ended)), p["appendix"]))


def strip_markdown(c: Column | str) -> Column:
    """Without rules, headings, bold and italics; bullets become dashes."""

    def plain(line: Column) -> Column:
        x = F.regexp_replace(X.strip(line), r"^#{1,6}\s*", "")
        x = F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1")
        x = F.regexp_replace(x, r"(?Ud)(?<!\w)\*(?!\s)(.+?)(?<!\s)\*(?!\w)", "$1")
        return F.regexp_replace(x, r"(?Ud)^[*•]\s+", "- ")

    kept = F.filter(F.split(X.empty(c), "\\r\\n|\\n|\\r"), lambda x: ~X.strip(x).rlike(r"^[-*_=]{3,}$"))
    return X.strip(F.regexp_replace(F.array_join(F.transform(kept, plain), "\n"), "\\n{3,}", "\n\n"))


def rewrite(c: Column | str, rules: list[tuple[str, Column | str]]) -> Column:
    """Replacements in order; each sees what the ones before it left. A replacement may be a column."""
    out = X.empty(c)
    for pattern, new in rules:
        out = F.regexp_replace(out, F.lit("(?Ud)" + pattern), new if isinstance(new, Column) else F.lit(new))
    return out


def quoted(c: Column) -> Column:
    """Text that a replacement takes as it is."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def statement_rules(header: Column) -> list[tuple[str, Column | str]]:
    """What the slots of the official form are, in the order in which they are filled."""
    h = lambda k, other: quoted(F.when(X.empty(header[k]) != "", header[k]).otherwise(other))
    year = F.when(header["nam"].rlike(r"^\d+$"), header["nam"]).otherwise("20…")
    case, kind = h("ten_vu_an", "…"), h("loai", "dân sự")
    return [
        (r"58,\s*…\(5\)…\s*", "58, 262 "),
        (r"43,\s*…\(3\)…\s*", "43, 190 "),
        (r"Tòa án nhân dân…\(\d+\)…\s*", F.concat(F.lit("Tòa án nhân dân "), h("toa_an_tail", "…"), F.lit(" "))),
        (r"Viện kiểm sát nhân dân…\(2\)…\.*\s*", F.concat(F.lit("Viện kiểm sát nhân dân "), h("vks_tail", "…"), F.lit(" "))),
        (r"\s*\(phiên họp\)(\s*sơ thẩm)…\(4\)…", "$1"),
        (r"(phiên tòa)\s*\(phiên họp\)", "$1"),
        (r"\(việc\)…\(7\)…", F.concat(kind, F.lit(" "))),
        (r"\(VIỆC\)…\(7\)…", F.upper(kind)),
        (r"\(việc\)\.\.\.\(7\)\.\.\.\s*", F.concat(case, F.lit(" "))),
        (r"về…\([58]\)…", F.concat(F.lit("về “"), case, F.lit("”"))),
        (r"Số:\s*…\.+", "Số:      "),
        (r"PB-VKS-…\(3\)…", F.concat(F.lit("PB-VKS-"), h("ma_loai", "DS"))),
        (r"VIỆN KIỂM SÁT NHÂN DÂN\(1\)\.+", h("unit_parent", "VIỆN KIỂM SÁT NHÂN DÂN TỐI CAO")),
        (r"VIỆN KIỂM SÁT NHÂN DÂN\(2\)\.+", h("unit_name", "VIỆN KIỂM SÁT NHÂN DÂN …")),
        (r"…+,\s*ngày", F.concat(h("dia_danh", "…"), F.lit(", ngày"))),
        (r"năm 20…", F.concat(F.lit("năm "), year)),
    ]


def find_line(lines: Column, pattern: str, start: Column | None = None) -> Column:
    """0-based place of the first line from ``start`` on that matches; null if none does."""
    start = F.coalesce(start, F.lit(0)) if start is not None else F.lit(0)
    places = F.transform(lines, lambda x, i: F.when((i >= start) & x.rlike("(?Ud)(?i)" + pattern), i))
    return F.array_min(places)


def cut(lines: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.slice(lines, F.coalesce(start, F.lit(0)) + 1, F.greatest(F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0)), F.lit(0))))


def is_report(c: Column | str) -> Column:
    return X.empty(c).rlike(r"(?Ud)(?i)BÁO\s+CÁO\s+ĐỀ\s+XUẤT") & X.empty(c).rlike(r"(?Ud)(?i)QUAN\s+ĐIỂM\s+CỦA\s+CÔNG\s+CHỨC")


def parse_reports(cases: DataFrame) -> DataFrame:
    """Cases (case_id, text) with ``report``: the parsed proposal report, null where a mark is missing or out of order."""
    df = cases.withColumn("l", X.lines("text"))
    L = F.col("l")
    df = df.withColumn("number", find_line(L, r"^Số\s*:")).withColumn("flat", F.array_join("l", " "))
    df = df.withColumn("p0", find_line(L, r"^(Nguyên đơn|Người khởi kiện)\b")).withColumn("p1", find_line(L, "^Sau khi nghiên cứu", F.col("p0")))
    df = df.withColumn("iii", find_line(L, r"^III\.\s*QUAN\s+ĐIỂM"))
    for name, pattern in (("s1", r"^1\.\s*Về việc tuân theo pháp luật tố tụng"), ("s2", r"^2\.\s*Đề xuất quan điểm"), ("end", "^Trên đây là báo cáo")):
        df = df.withColumn(name, find_line(L, pattern, F.col("iii")))
    at = lambda i: F.get(L, i)
    date = r"(?Ud)(?:^|\|)\s*([^,|]+?)\s*,\s*ngày\s+\d+\s+tháng\s+\d+\s+năm\s+(\d{4})"
    near = F.filter(F.slice(L, F.coalesce(F.col("number"), F.lit(0)) + 1, 6), lambda x: x.rlike(date))
    dated = F.get(near, F.lit(0))
    first = lambda p: F.regexp_extract("flat", "(?Ud)" + p, 1)
    suffix = F.regexp_extract(at(F.col("number")), r"(?Ud)Số\s*:\s*\d*\s*/\s*([A-ZĐ]+)\s*-\s*(\S+)", 2)
    case = first(r"giải quyết vụ án\s*[“\"](.+?)[”\"]")
    prosecutor = first(r"Chúng tôi gồm:\s*-?\s*(.+?)\s*-\s*KSV")
    whole = is_report("text") & (F.col("number") >= 1) & (case != "") & (prosecutor != "")
    whole = whole & F.col("p0").isNotNull() & F.col("p1").isNotNull() & F.col("iii").isNotNull() & (F.col("s1") < F.col("s2")) & (F.col("s2") < F.col("end"))
    report = F.struct(
        F.when(F.col("flat").rlike("(?Ud)(?i)vụ án hành chính"), "HANH_CHINH").otherwise("DAN_SU").alias("kind"),
        F.coalesce(F.regexp_extract(dated, date, 2).try_cast("int"), F.lit(0)).alias("year"),
        F.when(F.col("number") >= 2, at(F.col("number") - 2)).otherwise("").alias("parent_line"),
        at(F.col("number") - 1).alias("unit_line"),
        F.when(suffix != "", suffix).otherwise("VKS").alias("so_suffix"),
        X.strip(X.empty(F.regexp_extract(dated, date, 1))).alias("dia_danh"),
        X.strip(case).alias("ten_vu_an"),
        X.strip(first(r"do\s+(Tòa án nhân dân[^,“”\"]*?)\s+(?:thụ lý|giải quyết)")).alias("toa_an"),
        F.btrim(prosecutor, F.lit(" -")).alias("ksv"),
        cut(L, F.col("p0"), F.col("p1")).alias("parties"),
        cut(L, F.col("s1"), F.col("s2")).alias("section1"),
        cut(L, F.col("s2") + 1, F.col("end")).alias("section2"),
    )
    return df.select(*cases.columns, F.when(whole, report).alias("report"))


def end_mark(line: Column, last: Column) -> Column:
    open_year = line.rlike(r"(?Ud)(?i)sinh\s+năm\s*$")
    ended = F.when(F.endswith(line, F.lit(".")), line).otherwise(F.concat(F.rtrim(line, F.lit(";,")), F.lit(".")))
    listed = F.when(line.rlike("[;:]$"), line).otherwise(F.concat(F.rtrim(line, F.lit(".,")), F.lit(";")))
    return F.when(open_year, line).when(last, ended).otherwise(listed)


def place_name(c: Column) -> Column:
    """A unit in capitals, as it is written inside a sentence."""
    lower = ("VIỆN", "TỈNH", "KHU", "VỰC", "THÀNH", "PHỐ")

    def word(w: Column) -> Column:
        u = F.upper(w)
        return (
            F.when(u == "KSND", "kiểm sát nhân dân")
            .when(u.isin(*lower), F.lower(w))
            .when(w.rlike(r"^(\d+|-)$"), w)
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
        )

    text = F.array_join(F.transform(F.filter(F.split(c, X.U + r"\s+"), lambda w: w != ""), word), " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


#: The legal basis of a statement in a civil case, and its set sentences.
LEGAL_BASIS = (
    "Căn cứ Điều 27 Luật Tổ chức Viện kiểm sát nhân dân năm 2014 đã được sửa đổi, bổ sung bởi Luật số 82/2025/QH15;",
    "Căn cứ các điều 21, 58, 262 Bộ luật Tố tụng dân sự số 92/2015/QH13 đã được sửa đổi, bổ sung bởi Bộ luật số 45/2019/QH14, Luật số 59/2020/QH14, Luật số 13/2022/QH15, Luật số 19/2023/QH15, Luật số 34/2024/QH15, Luật số 46/2024/QH15 và Luật số 85/2025/QH15;",
    "Căn cứ Điều 29 Thông tư liên tịch số 07/2026/TTLT-VKSNDTC-TANDTC ngày 10/3/2026 của Viện trưởng Viện kiểm sát nhân dân tối cao - Chánh án Tòa án nhân dân tối cao quy định việc phối hợp giữa Viện kiểm sát nhân dân và Tòa án nhân dân trong việc thi hành một số quy định của Bộ luật Tố tụng dân sự.",
)
PANEL = (
    "2. Việc tuân theo pháp luật tố tụng của Hội đồng xét xử (Hội đồng giải quyết việc dân sự; Hội đồng xét đơn yêu cầu), Thư ký phiên tòa (phiên họp)",
    "Hội đồng xét xử, Thư ký phiên tòa đã thực hiện đúng, đầy đủ quy định của Bộ luật Tố tụng dân sự và các văn bản quy phạm pháp luật có liên quan về việc xét xử vụ án.",
    "3. Việc chấp hành pháp luật của người tham gia tố tụng",
    "Người tham gia tố tụng đã thực hiện đúng, đầy đủ quyền và nghĩa vụ tố tụng theo quy định của pháp luật",
    "II. VỀ VIỆC GIẢI QUYẾT VỤ ÁN DÂN SỰ",
)


def build_statements(parsed: DataFrame) -> DataFrame:
    """Parsed cases with ``statement`` and ``header``: the statement of a civil report, word for word from it; else null."""
    r = F.col("report")
    court = F.when(X.empty(r["toa_an"]) != "", r["toa_an"]).otherwise("Tòa án nhân dân")
    unit = place_name(r["unit_line"])
    fixed = lambda *x: F.array(*map(F.lit, x))
    parties = F.transform(r["parties"], lambda x, i: end_mark(x, i == F.size(r["parties"]) - 1))
    body = F.concat(
        fixed(*LEGAL_BASIS),
        F.array(F.concat(F.lit("Hôm nay, "), court, F.lit(" mở phiên tòa sơ thẩm giải quyết vụ án dân sự về “"), r["ten_vu_an"], F.lit("” giữa các đương sự:"))),
        parties,
        F.array(
            F.concat(
                F.lit("Qua nghiên cứu hồ sơ vụ án dân sự, kết quả kiểm sát việc tuân theo pháp luật của "), court,
                F.lit(" và tham gia phiên tòa sơ thẩm hôm nay, đại diện "), unit, F.lit(" phát biểu ý kiến như sau:"),
            )
        ),
        fixed("I. VỀ VIỆC TUÂN THEO PHÁP LUẬT TỐ TỤNG"),
        F.filter(r["section1"], lambda x: ~F.startswith(x, F.lit("Như vậy quá trình thụ lý"))),
        fixed(*PANEL),
        F.transform(r["section2"], lambda x: F.regexp_replace(x, r"^2\.(\d+)\.\s*", "$1. ")),
        F.array(
            F.concat(
                F.lit("Trên đây là ý kiến của đại diện "), unit, F.lit(" về việc tuân theo pháp luật tố tụng và giải quyết vụ án "),
                r["ten_vu_an"], F.lit(" nêu trên. Đề nghị HĐXX xem xét, quyết định."),
            )
        ),
    )
    header = F.struct(
        F.lit("PHAT_BIEU").alias("kind"),
        F.when(r["parent_line"] != "", r["parent_line"]).otherwise("VIỆN KSND TỐI CAO").alias("unit_parent"),
        r["unit_line"].alias("unit_name"),
        F.concat(F.lit("Số:      /PB-"), r["so_suffix"]).alias("so_ky_hieu"),
        r["dia_danh"].alias("dia_danh"),
        F.when(r["year"] > 0, r["year"].cast("string")).otherwise("20…").alias("nam"),
        r["ten_vu_an"].alias("ten_vu_an"),
        r["ksv"].alias("ksv"),
        F.lit(False).alias("hanh_chinh"),
        F.lit("dân sự").alias("loai"),
        F.lit("DS").alias("ma_loai"),
        tail(court, "Tòa án nhân dân").alias("toa_an_tail"),
        tail(unit, "Viện kiểm sát nhân dân").alias("vks_tail"),
    )
    civil = r["kind"] == "DAN_SU"
    return parsed.withColumns({"statement": F.when(civil, F.array_join(body, "\n")), "header": F.when(civil, header)})


#: Marks of a flat statement in order; each is looked for from another one on.
STATEMENT_MARKS = (
    ("hom", "^Hôm nay", None),
    ("qua", "^Qua nghiên cứu", "hom"),
    ("one", r"^I\.\s", "qua"),
    ("s1", r"^1\.\s*(Việc|Về việc) tuân theo", "one"),
    ("s2", r"^2\.\s*Việc tuân theo pháp luật tố tụng của Hội đồng", "s1"),
    ("s3", r"^3\.\s*Việc chấp hành", "s2"),
    ("two", r"^II\.\s", "s3"),
    ("three", r"^III\.\s", "two"),
    ("end", "^Trên đây là ý kiến", "two"),
)


def with_marks(lines: Column, marks, body, found: dict | None = None) -> Column:
    """``body`` of the places of all marks; each place is looked up once."""
    found = found or {}
    if not marks:
        return body(found)
    name, pattern, after = marks[0]
    place = find_line(lines, pattern, found.get(after))
    return X.let(place, lambda at: with_marks(lines, marks[1:], body, found | {name: at}))


def split_statement(c: Column | str) -> Column:
    """Parts of a flat statement; null where a required mark is missing."""

    def parts(L: Column):
        def body(m: dict) -> Column:
            whole = m["hom"].isNotNull()
            for name in ("qua", "one", "s1", "s2", "s3", "two", "end"):
                whole = whole & m[name].isNotNull()
            out = F.struct(
                cut(L, m["hom"] + 1, m["qua"]).alias("parties"),
                cut(L, m["s1"] + 1, m["s2"]).alias("sec1"),
                cut(L, m["s2"] + 1, m["s3"]).alias("sec2"),
                cut(L, m["s3"] + 1, m["two"]).alias("sec3"),
                cut(L, m["two"] + 1, F.coalesce(m["three"], m["end"])).alias("giai_quyet"),
                F.coalesce(cut(L, m["three"] + 1, m["end"]), F.array().cast("array<string>")).alias("kien_nghi"),
            )
            return F.when(whole, out)

        return body

    return X.let(X.lines(c), lambda L: with_marks(L, STATEMENT_MARKS, parts(L)))
