"""Fixed values of the domain: word lists, markers, patterns and tables that results depend on."""

#: Stop words of the lexical search.
STOPWORDS = (
    "và hoặc của cho là các một những người khi để theo về trong có không bị đã này đó với từ được thì nào"
).split()

#: Characters of a search token.
TOKEN = "[a-zà-ỹ0-9]+"

#: Phrases worth 4 points each when query and article both have them.
PHRASES = ("người chưa thành niên", "người dưới 18 tuổi", "tình tiết giảm nhẹ", "tình tiết tăng nặng")
PHRASE_POINTS, TITLE_POINTS, NUMBER_POINTS = 4, 3, 10

#: Fixed values: (code, article number or None, points, phrases of which the query has one).
BOOSTS = (
    ("luat_tu_phap_nguoi_chua_thanh_nien", None, 8, ("chưa thành niên", "dưới 18 tuổi", "xử lý chuyển hướng")),
    ("nq04_2025_tinh_tiet_giam_nhe", None, 8, ("tình tiết giảm nhẹ", "điều 51", "điều 52", "tăng nặng")),
    (
        "blhs",
        "134",
        30,
        ("cố ý gây thương tích", "gây thương tích", "hung khí nguy hiểm", "tổn hại sức khỏe", "thương tích"),
    ),
)
ALWAYS_PINNED = ("51", "52")
CITED = r"\b(?:điều\s*)?(\d+[a-zđ]?)\b"

#: Fact fields whose text is the query.
CRIMINAL_FIELDS = (
    "toi_danh_nghi_van hanh_vi_pham_toi_tom_tat tuoi_tai_thoi_diem_pham_toi la_nguoi_duoi_18_tuoi "
    "tinh_tiet_tang_nang tinh_tiet_giam_nhe"
).split()
CIVIL_FIELDS = ("quan_he_phap_luat_tranh_chap", "yeu_cau_khoi_kien", "loai_vu_viec")

#: Letters that mark a Vietnamese word, what a word is, what is removed from texts.
VIETNAMESE = (
    "[ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]"
)
WORD = "[A-Za-zÀ-ỹ]{2,}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F﻿​]"
UNREADABLE = "[không đọc được]"

#: Words that speak for a criminal case, and for a civil or administrative one.
CRIMINAL_MARKERS = (
    "bị can|Bộ luật Hình sự|kết luận điều tra|khởi tố bị can|khởi tố vụ án hình sự|cáo trạng|"
    "Cơ quan (?:Cảnh sát )?điều tra|truy tố"
)
CIVIL_MARKERS = (
    "nguyên đơn|bị đơn|người khởi kiện|người bị kiện|quyền lợi,? nghĩa vụ liên quan|"
    "Bộ luật Tố tụng dân sự|BLTTDS|Luật Tố tụng hành chính|vụ án dân sự|vụ án hành chính|"
    "báo cáo đề xuất|phiên tòa sơ thẩm|án phí dân sự"
)
CRIMINAL, CIVIL = "HINH_SU", "DAN_SU_HANH_CHINH"

#: The old single-byte code page TCVN3, what shows it and what shows Unicode text; marks of VNI text.
TCVN3_FROM = "µ¶·¸¹¨»¼½¾Æ©ÇÈÉÊË®ÌÎÏÐÑªÒÓÔÕÖ×ØÜÝÞßáâãä«åæçèé¬êëìíîïñòóô­õö÷øùúûüýþ¡¢£¤¥¦§"
TCVN3_TO = "àảãáạăằẳẵắặâầẩẫấậđèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵĂÂÊÔƠƯĐ"
TCVN3_SIGNS = "[µ¶·¸¹¨»¼½¾Æ©ÇÈÉÊË®ÌÎÏÐÑªÒÓÔÕÖ×ØÜÝÞß«¬­¡¢£¤¥¦§÷øþ]"
UNICODE_SIGNS = "[ĂăĐđĨĩŨũƠơƯưẠ-ỹ]"
VNI_SIGNS = "[aeiouyAEIOUYöô][øùûõïâáàåãäêéèúüë]"

#: Statute structure.
ARTICLE = r"^Điều\s+(\d+[a-zđ]?)\.\s*(.*)$"
LOOSE_ARTICLE = r"^Điều\s*\d+[a-zđ]?\s*[:\-–.]"
LEVELS = (
    ("phan", r"^Phần\s+(thứ\s+\w+|[IVXLC]+)\b"),
    ("chuong", r"^Chương\s+[IVXLC\d]+\b"),
    ("tieu_muc", r"^Tiểu\s+mục\s+[IVXLC\d]+\b"),
    ("muc", r"^Mục\s+[IVXLC\d]+\b"),
)
#: Levels from the highest to the lowest: a heading ends all below it.
RANKS = ("phan", "chuong", "muc", "tieu_muc")
END_OF_LAW = "XÁC THỰC VĂN BẢN HỢP NHẤT"
REPEALED = ("bãi bỏ", "hết hiệu lực")
CLAUSE = r"^(\d{1,3}\.|[a-zđ]\)|[a-zđ]\.\d+\))\s"

#: Markers in drafts.
MISSING = "THIẾU DỮ LIỆU"
MISSING_MARK = r"\[THIẾU DỮ LIỆU[^\]]*\]"
LAW_MARK, CONFLICT_MARK = "[CẦN KIỂM TRA LẠI ĐIỀU LUẬT", "[TÌNH TIẾT MÂU THUẪN"
SUGGESTION = r"\[(?:GỢI Ý PHÁP LÝ\s*-\s*KSV XÁC NHẬN|GỢI Ý CỦA AI,?\s*KSV CẦN XÁC NHẬN LẠI):\s*([^\]]+)\]"
LEFT_SLOT = r"…\(\d+\)…|\{\{[A-Z_]+\}\}"
CHECK_BEGIN, CHECK_END = "--- PHỤ LỤC KIỂM TRA NỘI BỘ ---", "--- HẾT PHỤ LỤC KIỂM TRA NỘI BỘ ---"
ENFORCEMENT = (
    r"phòng\s+thi\s+hành\s+án(?:\s+dân\s+sự)?(?:\s+khu\s+vực\s*\d+)?(?:\s*[–-]\s*[^,;.\n]+)?",
    r"thi\s+hành\s+án\s+khu\s+vực\s*\d+(?:\s*[–-]\s*[^,;.\n]+)?",
)
ENFORCEMENT_NAME = "Cơ quan Thi hành án dân sự có thẩm quyền"
NARRATIVE_SLOT = "[[DIEN_BIEN_VU_AN]]"
FILE_LINE = "- Hồ sơ vụ án gồm: … tập, bằng … tờ; đánh số thứ tự từ 01 đến hết."
NARRATIVE_START = (
    r"^\W*(?:\d+\.\s*)?(?:Diễn\s*biến(?:\s*(?:của\s*)?(?:vụ\s*án|hành\s*vi[^\n:]*))?|Nội\s*dung\s*vụ\s*án|Tình\s*huống)\s*:?[^\n]*\n"
)
NARRATIVE_END = (
    r"^\W*(?:\d+\.\s*)?(?:Tình\s*tiết\s*(?:tăng|giảm)|Phân\s*tích|Vật\s*chứng|Việc\s*thu\s*giữ|"
    r"Phần\s*dân\s*sự|Trách\s*nhiệm\s*dân\s*sự|Kết\s*luận(?!\s*giám)|Lý\s*lịch|Nhân\s*thân|"
    r"Bị\s*can\s*:|Họ\s*tên\s*:|Căn\s*cứ\s*(?:vào|các))"
)
#: Parts of an error that make a call worth repeating.
RETRYABLE = ("503", "429", "404", "500", "unavailable", "overload", "resource_exhausted", "quota", "not found", "deadline", "timeout")
BODY_END = r"^\W*Danh sách những người Viện kiểm sát đề nghị Tòa án triệu tập[^\n]*\n?"
