"""Facts as JSON text: cleaning, defaults, narratives and headers. Bad input falls back as each function says; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as X

#: Fields of a suspect that default to "Không", and of the file that default to an ellipsis.
SUSPECT_FIELDS, FILE_FIELDS = ("nhan_than", "tien_an", "tien_su", "bien_phap_ngan_chan"), ("so_tap", "so_to")


def field(facts: Column | str, path: str) -> Column:
    """Text of a field, "" where it is missing or the facts don't parse."""
    return X.empty(F.get_json_object(X.col(facts), path))


def filled(facts: Column | str, path: str, default: Column | str) -> Column:
    value = field(facts, path)
    return F.when(X.is_filled(value), value).otherwise(F.lit(default) if isinstance(default, str) else default)


def is_object(facts: Column | str) -> Column:
    c = X.col(facts)
    return F.coalesce(F.try_parse_json(c).isNotNull() & c.rlike(r"(?s)^\s*\{"), F.lit(False))


def clean_json(c: Column | str) -> Column:
    """The object inside a reply, rewritten if it parses; else the piece between the braces, or the whole text."""
    cut = X.cut_json(c)
    return F.coalesce(F.to_json(F.try_parse_json(cut)), cut)


def is_administrative(facts: Column | str) -> Column:
    kind = F.lower(X.strip(field(facts, "$.loai_vu_viec")))
    return is_object(facts) & (F.contains(kind, F.lit("hành chính")) | F.contains(kind, F.lit("hanh chinh")))


def narrative(text: Column | str) -> Column:
    """The account of events: after its heading, up to the next known heading; "" unless it has 200 characters."""
    body = F.regexp_extract(X.empty(text), "(?Ud)(?im)" + K.NARRATIVE_START + "(?s:(.*))", 1)
    cut = F.regexp_replace(body, "(?Ud)(?im)" + K.NARRATIVE_END + "(?s:.*)", "")
    cut = X.strip(cut)
    return F.when(F.length(cut) >= 200, cut).otherwise("")


def apply_defaults(facts: Column | str, text: Column | str) -> Column:
    """Facts with defaults: struct (suspects, so_tap, so_to, narrative). A list of suspects that doesn't parse is null.

    The narrative comes from the case text, else from the facts, else from the acts of each suspect.
    """
    people = F.from_json(F.get_json_object(X.col(facts), "$.bi_can"), "array<map<string,string>>")
    default = lambda m, k: F.when(X.is_filled(F.try_element_at(m, F.lit(k))), F.try_element_at(m, F.lit(k))).otherwise(F.lit("Không"))
    suspects = F.transform(
        people,
        lambda m: F.map_concat(
            F.map_filter(m, lambda k, _: ~k.isin(*SUSPECT_FIELDS)),
            F.create_map(*(x for k in SUSPECT_FIELDS for x in (F.lit(k), default(m, k)))),
        ),
    )
    acts = F.from_json(F.get_json_object(X.col(facts), "$.hanh_vi_tung_bi_can"), "array<struct<bi_can:string,hanh_vi_cu_the:string>>")
    told = F.transform(F.coalesce(acts, F.array().cast("array<struct<bi_can:string,hanh_vi_cu_the:string>>")), lambda a: F.concat(X.empty(a["bi_can"]), F.lit(": "), X.empty(a["hanh_vi_cu_the"])))
    parts = F.filter(F.concat(F.array(field(facts, "$.hanh_vi_pham_toi_tom_tat")), told), X.is_filled)
    own, given = narrative(text), X.strip(field(facts, "$.dien_bien_vu_an_nguyen_van"))
    story = F.when(own != "", own).when(X.is_filled(given), given).otherwise(F.array_join(parts, "\n"))
    out = F.struct(
        suspects.alias("suspects"),
        filled(facts, "$.ho_so.so_tap", "…").alias("so_tap"),
        filled(facts, "$.ho_so.so_to", "…").alias("so_to"),
        story.alias("narrative"),
    )
    return F.when(is_object(facts), out)


def tail(name: Column, prefix: str) -> Column:
    text = X.strip(X.empty(name))
    return F.when(F.startswith(F.lower(text), F.lit(prefix.lower())), X.strip(F.substring(text, len(prefix) + 1, 1 << 20))).otherwise(text)


def criminal_header(facts: Column | str) -> Column:
    """Issuing unit of an indictment; null unless the province is known."""
    v = lambda k: field(facts, f"$.vks_truy_to.{k}")
    full, level = v("ten_day_du"), F.lower(v("cap"))
    area = X.strip(v("so_khu_vuc"))
    area = F.when(area != "", area).otherwise(F.regexp_extract(full, r"(?Ud)(?i)khu\s*vực\s*(\d+)", 1))
    given = X.strip(v("tinh_thanh"))
    place = F.when(X.is_filled(given), given).otherwise(X.strip(F.regexp_extract(full, r"(?Ud)(?i)(?:tỉnh|thành phố)\s+(.+)$", 1)))
    known = F.contains(level, F.lit("khu vực")) | F.contains(level, F.lit("tỉnh"))
    regional = F.when(known, F.contains(level, F.lit("khu vực"))).otherwise((area != "") | F.contains(F.lower(full), F.lit("khu vực")))
    upper = F.upper(place)
    unit = F.when(
        regional, F.replace(F.concat(F.lit("VIỆN KIỂM SÁT NHÂN DÂN KHU VỰC "), area, F.lit(" - "), upper), F.lit("  "), F.lit(" "))
    ).otherwise(F.concat(F.lit("VIỆN KIỂM SÁT NHÂN DÂN TỈNH "), upper))
    parent = F.when(regional, F.concat(F.lit("VIỆN KIỂM SÁT NHÂN DÂN TỈNH "), upper)).otherwise("VIỆN KIỂM SÁT NHÂN DÂN TỐI CAO")
    number = F.when(regional & (area != ""), F.concat(F.lit("Số: …/CT-VKSKV"), area, F.lit("-…"))).otherwise("Số: …/CT-VKS…-…")
    out = F.struct(
        unit.alias("unit_name"),
        parent.alias("unit_parent"),
        number.alias("so_ky_hieu"),
        place.alias("dia_danh"),
        F.concat(F.lit("VIỆN TRƯỞNG "), unit).alias("vien_truong"),
    )
    return F.when((X.is_filled(full) | X.is_filled(given)) & (place != ""), out)


def civil_header(facts: Column | str) -> Column:
    """Header of a statement in a civil or administrative case; null if the facts aren't an object."""
    place = X.strip(field(facts, "$.vks_phat_bieu.tinh_thanh"))
    kind = field(facts, "$.loai_vu_viec")
    kind = F.lower(X.strip(F.when(kind == "", "dân sự").otherwise(kind)))
    admin = is_administrative(facts)
    has = lambda x: F.contains(kind, F.lit(x))
    code = F.when(admin, "HC").when(has("hôn nhân"), "HNGĐ").when(has("kinh doanh"), "KDTM").when(has("lao động"), "LĐ").otherwise("DS")
    court, name = field(facts, "$.toa_an_thu_ly"), field(facts, "$.vks_phat_bieu.ten_day_du")
    out = F.struct(
        F.lit("PHAT_BIEU").alias("kind"),
        admin.alias("hanh_chinh"),
        F.when(admin, "hành chính").when(code == "DS", "dân sự").otherwise(kind).alias("loai"),
        code.alias("ma_loai"),
        F.when(X.is_filled(court), tail(court, "Tòa án nhân dân")).otherwise("").alias("toa_an_tail"),
        F.when(X.is_filled(name), tail(name, "Viện kiểm sát nhân dân")).when(place != "", F.concat(F.lit("tỉnh "), place)).otherwise("").alias("vks_tail"),
        F.lit("VIỆN KSND TỐI CAO").alias("unit_parent"),
        F.when(X.is_filled(place), F.concat(F.lit("VIỆN KSND TỈNH "), F.upper(place))).otherwise("VIỆN KSND …").alias("unit_name"),
        F.concat(F.lit("Số:      /PB-VKS-"), code).alias("so_ky_hieu"),
        F.when(X.is_filled(place), place).otherwise("").alias("dia_danh"),
        F.lit("20…").alias("nam"),
        filled(facts, "$.ten_vu_an", "").alias("ten_vu_an"),
        filled(facts, "$.kiem_sat_vien", "").alias("ksv"),
    )
    return F.when(is_object(facts), out)
