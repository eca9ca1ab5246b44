"""Markers in drafts: counting, the appendix of an internal check, suggestions that must not get lost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X


def occurrences(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def marker_audit(c: Column | str, missing: str = K.MISSING_MARK, law: str = K.LAW_MARK, conflict: str = K.CONFLICT_MARK, suggestion: str = K.SUGGESTION, slot: str = K.LEFT_SLOT) -> Column:
    """Counts of every marker, the first six distinct missing marks (60 characters each), and slots left open."""
    text = X.empty(c)
    found = F.regexp_extract_all(text, F.lit("(?Ud)" + missing), F.lit(0))
    shown = F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda m: F.substring(m, 1, 60)))), F.lit(1), F.lit(6))
    slots = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?Ud)" + slot), F.lit(0))))
    return F.struct(
        F.size(found).alias("missing"),
        F.array_join(shown, "; ").alias("missing_marks"),
        occurrences(text, law).alias("law_marks"),
        occurrences(text, conflict).alias("conflicts"),
        F.regexp_count(text, F.lit("(?Ud)(?i)" + suggestion)).alias("suggestions"),
        F.array_join(slots, ", ").alias("open_slots"),
    )


def code_check(c: Column | str) -> Column:
    """The appendix of an internal check, from the counts alone."""
    m = marker_audit(c)
    shown = F.when(m["missing"] > 0, F.concat(F.lit(" ("), m["missing_marks"], F.lit(")"))).otherwise("")
    slots = F.when(m["open_slots"] != "", F.concat(F.lit("còn ô mẫu chưa điền: "), m["open_slots"])).otherwise("không còn ô mẫu chưa điền.")
    n = lambda k: m[k].cast("string")
    return F.concat_ws(
        "\n",
        F.lit(K.CHECK_BEGIN),
        F.concat(
            F.lit("1. KIỂM TRA DỮ KIỆN: "), n("missing"), F.lit(" chỗ đánh dấu [THIẾU DỮ LIỆU]"), shown, F.lit("; "), n("conflicts"),
            F.lit(" chỗ [TÌNH TIẾT MÂU THUẪN]. Các số hiệu, ngày tháng, họ tên được lấy từ dữ kiện hồ sơ; Kiểm sát viên đối chiếu lại với bản gốc."),
        ),
        F.concat(F.lit("2. KIỂM TRA CẤU TRÚC: "), slots),
        F.concat(
            F.lit("3. KIỂM TRA ĐIỀU LUẬT: "), n("law_marks"), F.lit(" chỗ [CẦN KIỂM TRA LẠI ĐIỀU LUẬT]; "), n("suggestions"),
            F.lit(" gợi ý của AI cần Kiểm sát viên xác nhận. (Kiểm tra bằng code, không dùng AI.)"),
        ),
        F.lit(K.CHECK_END),
    )


def split_check(c: Column | str, begin: str = K.CHECK_BEGIN, end: str = K.CHECK_END) -> Column:
    """Struct (document, appendix): the appendix from its first mark to its end mark, or to the end of the text."""

    def split(text: Column, at: Column) -> Column:
        before, inside = F.substring(text, F.lit(1), at - 1), F.substring(text, F.greatest(at, F.lit(1)), F.lit(1 << 30))

        def ended(stop: Column) -> Column:
            length = stop - 1 + len(end)
            document = (
                F.when(at == 0, text)
                .when(stop == 0, F.regexp_replace(before, X.U + r"\s+$", ""))
                .otherwise(X.strip(F.concat(before, F.substring(text, at + length, F.lit(1 << 30)))))
            )
            appendix = F.when(at == 0, F.lit(None)).when(stop == 0, X.strip(inside)).otherwise(X.strip(F.substring(text, at, length)))
            return F.struct(document.alias("document"), appendix.alias("appendix"))

        return X.let(F.instr(inside, end), ended)

    return X.let(X.empty(c), lambda text: X.let(F.instr(text, begin), lambda at: split(text, at)))


def legal_terms(c: Column | str) -> Column:
    out = X.empty(c)
    for pattern in K.ENFORCEMENT:
        out = F.regexp_replace(out, "(?Ud)(?i)" + pattern, K.ENFORCEMENT_NAME)
    return out


def keep_suggestions(document: Column | str, draft: Column | str) -> Column:
    """Suggestions of the draft that the document lost, put back before the line of the decision, else at the end."""
    found = F.regexp_extract_all(X.empty(draft), F.lit("(?Ud)(?i)" + K.SUGGESTION), F.lit(1))
    marks = F.transform(found, lambda s: F.concat(F.lit("[GỢI Ý CỦA AI, KSV CẦN XÁC NHẬN LẠI: "), X.strip(s), F.lit("]")))
    right = lambda x: F.regexp_replace(x, X.U + r"\s+$", "")

    def placed(doc: Column, block: Column, at: Column) -> Column:
        inside = F.concat(right(F.substring(doc, F.lit(1), at - 1)), F.lit("\n\n"), block, F.lit("\n\n"), F.substring(doc, at, F.lit(1 << 30)))
        return F.when(block == "", doc).when(at > 0, X.strip(inside)).otherwise(X.strip(F.concat(right(doc), F.lit("\n\n"), block)))

    def put(doc: Column) -> Column:
        lost = F.array_join(F.filter(marks, lambda m: ~F.contains(doc, m)), "\n")
        return X.let(lost, lambda block: X.let(F.regexp_instr(doc, F.lit(r"(?Ud)(?m)^\s*QUYẾT ĐỊNH\s*$")), lambda at: placed(doc, block, at)))

    return X.let(X.empty(document), put)
