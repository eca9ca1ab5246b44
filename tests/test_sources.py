"""Decoders on bytes made here."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import files
from quillon.sources.doc import doc_text, without_fields
from quillon.sources.docx import W, docx_text, ordinal
from quillon.sources.rtf import rtf_bytes, rtf_text


def test_rtf():
    data = rb"""{\rtf1\ansi\ansicpg1258{\fonttbl{\f0 Arial;}}\uc1 Vi\u7879?t{\*\unknown skipped}{\listtext 1.\tab}A\'e9\par
x\cell y\cell\row{\footnote  note }end\~z}"""
    text = rtf_text(data)
    assert text.startswith("Việt1.\tAé\nx | y\n")
    assert "[Chú thích: note]" in text and text.endswith("end z") and "Arial" not in text and "skipped" not in text


def test_rtf_skips_as_many_fallback_characters_as_told():
    assert rtf_text(rb"{\rtf1\uc2 \u226 ??b\uc0\u226 c}") == "âbâc"
    assert rtf_text(rb"{\rtf1 \u-10179?\u-8704?}") == chr(0x1F600)


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (rb"{\rtf1{\field{\*\fldinst HYPERLINK x}{\fldrslt shown}}}", "shown"),
        (rb"{\rtf1 a{\pict\bin4 }{{x}b}", "ab"),  # four bytes follow as they are
        (rb"{\rtf1\ansicpg874\'a1\'a2}", chr(0xE01) + chr(0xE02)),
        (rb"{\rtf1\uc3\u226 \'61b\b x}", "âx"),  # a byte, a letter and a control word are one unit each
        (rb"{\rtf1{\uc0\u226 }\u226 ?x}", "ââx"),  # a group keeps its own count
        (rb"{\rtf1{\*\shpinst{\sp{\sn a}{\sv b}}{\shptxt box}}{\header top}}", "box"),
        (rb"{\rtf1 a\cell\cell c\cell\row b}}}", "a |  | c\nb"),
        (rb"{\rtf1 x{\footnote {\b one}\par two}y", "x [Chú thích: one\ntwo]y"),
    ],
)
def test_rtf_by_the_specification(data, want):
    assert rtf_text(data) == want


def test_deep_groups_are_read():
    assert rtf_text(b"{\\rtf1 " + b"{" * 50_000 + b"x" + b"}" * 50_000 + b"}") == "x"


@pytest.mark.parametrize("text", ["", "a{b}\\c\nđường", "😀 x\ty"])
def test_rtf_roundtrip(text):
    assert rtf_text(rtf_bytes(text)) == text


def package(body, **parts):
    ns = f'xmlns:w="{W[1:-1]}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml.replace("<w:root", f"<w:root {ns}", 1))
    return out.getvalue()


def p(text, extra=""):
    return f"<w:p>{extra}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_walk():
    num = lambda n, lvl=0: f'<w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{n}"/></w:numPr></w:pPr>'
    inner = f"<w:tbl><w:tr><w:tc>{p('n1')}</w:tc><w:tc>{p('n2')}</w:tc></w:tr></w:tbl>"
    body = (
        p("một", num(1)) + p("con", num(1, 1)) + p("hai", num(1)) + p("khác", num(2)) + p("lại", num(3))
        + f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{inner}</w:tc></w:tr></w:tbl>"
        + '<w:p><w:r><w:t>x</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t> new</w:t></w:r></w:ins></w:p>'
        + "<w:p><mc:AlternateContent><mc:Choice><w:txbxContent>" + p("box") + "</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>" + p("box") + "</w:txbxContent></mc:Fallback></mc:AlternateContent></w:p>"
    )
    lvl = lambda i, f, t: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>'
    numbering = (
        f'<w:root><w:abstractNum w:abstractNumId="9">{lvl(0, "decimal", "%1.")}{lvl(1, "lowerLetter", "%1.%2)")}</w:abstractNum>'
        '<w:num w:numId="1"><w:abstractNumId w:val="9"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num>'
        '<w:num w:numId="3"><w:abstractNumId w:val="9"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="1"/></w:lvlOverride></w:num></w:root>'
    )
    notes = f'<w:root><w:footnote w:id="0" w:type="separator">{p("no")}</w:footnote><w:footnote w:id="2">{p("ghi chú")}</w:footnote></w:root>'
    header = f"<w:root>{p('Đầu')}{p('12 / 3')}{p('Đầu')}</w:root>"
    text, warnings = docx_text(package(body, numbering=numbering, footnotes=notes, header1=header))
    assert text.split("\n") == ["[Đầu trang] Đầu", "1. một", "1.a) con", "2. hai", "3. khác", "1. lại", "a / b | n1 | n2", "x [Chú thích: ghi chú] new", "[Khung văn bản] box"]
    assert len(warnings) == 1


def test_ordinals():
    assert [ordinal(n, "lowerLetter") for n in (1, 26, 27, 52, 53)] == ["a", "z", "aa", "az", "ba"]
    assert [ordinal(n, "upperRoman") for n in (4, 9, 14, 1990)] == ["IV", "IX", "XIV", "MCMXC"]
    assert ordinal(7, "decimalZero") == "07"


def compound(streams):
    """A compound file with 512-byte sectors; streams are padded past the size of small ones."""
    end, blocks, fat, entries = 0xFFFFFFFE, [], [], []

    def add(data):
        data += b"\0" * (-len(data) % 512)
        first = len(blocks)
        n = len(data) // 512
        for i in range(n):
            blocks.append(data[512 * i : 512 * i + 512])
            fat.append(first + i + 1 if i + 1 < n else end)
        return first

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append(entry(name, 2, add(data), len(data)))
    directory = add(entry("Root Entry", 5, end, 0) + b"".join(entries))
    fat_at = len(blocks)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIIII", 0, 1, directory, 0, 4096, end, 0, end, 0, fat_at)
    return head.ljust(512, b"\xff") + b"".join(blocks) + table


def word_file(text, flags=0x0200):
    document = bytearray(4096)
    struct.pack_into("<HH", document, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", document, 0x0A, flags)
    struct.pack_into("<I", document, 0x4C, len(text))
    raw = text.encode("utf-16-le")
    plan = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 4096, 0)
    clx = b"\x02" + struct.pack("<I", len(plan)) + plan
    struct.pack_into("<II", document, 0x01A2, 0, len(clx))
    return compound({"WordDocument": bytes(document) + raw, "1Table": clx})


def test_doc():
    text, warnings = doc_text(word_file("Tòa án\rHYPER \x13 LINK x \x14shown\x15 end\x07cell\x07\x07"))
    assert text == "Tòa án\nHYPER shown end | cell |\n" and warnings == []
    assert without_fields("a\x13code\x13in\x14x\x15\x14b\x15c") == "abc"
    with pytest.raises(ValueError, match="mật khẩu"):
        doc_text(word_file("x", flags=0x0300))


def test_sniff_and_extract(spark):
    made = [
        ("a.txt", b"\x00" * 100 + b"%PDF-1.7"), ("b.docx", b" \n{\\rtf1 xin ch\\u224?o}"), ("c", package(p("nội dung"))), ("d.docx", b"broken"),
        ("e.xyz", b"???"), ("f.rtf", b""), ("g.doc", word_file("Viện kiểm sát")), ("h.docx", b"PK\x03\x04junk"),
    ]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in made], "path string, content binary")
    kinds = {r["path"]: r["k"] for r in df.select("path", files.sniff("content").alias("k")).collect()}
    assert kinds == {"a.txt": "pdf", "b.docx": "rtf", "c": "docx", "d.docx": None, "e.xyz": None, "f.rtf": None, "g.doc": "doc", "h.docx": "docx"}
    out = {r["path"]: r for r in files.extract(df).collect()}
    assert len(out) == len(made)
    assert (out["b.docx"]["file_type"], out["b.docx"]["text"], out["b.docx"]["error"]) == ("rtf", "xin chào", None)
    assert out["c"]["text"] == "nội dung" and out["g.doc"]["text"] == "Viện kiểm sát"
    assert all(out[x]["error"] for x in ("a.txt", "d.docx", "e.xyz", "f.rtf", "h.docx"))


def test_laws_keep_their_order(spark, tmp_path):
    import json

    from quillon.sources import laws

    for name, numbers in (("b", "12"), ("a", "345")):
        rows = [{"dieu_so": n, "tieu_de": "t", "noi_dung": "t", "phan": "", "chuong": "", "muc": "", "tieu_muc": "", "luat": name, "ma_luat": name} for n in numbers]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=2))
    got = laws.read_laws(spark, str(tmp_path)).orderBy("load_seq").collect()
    assert [(r["load_seq"], r["ma_luat"], r["dieu_so"]) for r in got] == [(0, "a", "3"), (1, "a", "4"), (2, "a", "5"), (3, "b", "1"), (4, "b", "2")]
    laws.write_laws(laws.read_laws(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("ma_luat") == "b").count() == 2


def test_stream_reads_each_file_once(spark, tmp_path):
    from quillon.streaming.cases import stream_cases

    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for round_ in range(2):
        (source / f"{round_}.rtf").write_bytes(rtf_bytes("bị can " * 5))
        stream_cases(spark, str(source), str(target), str(tmp_path / "state")).awaitTermination(60)
    rows = spark.read.parquet(str(target)).collect()
    assert sorted(r["path"][-5:] for r in rows) == ["0.rtf", "1.rtf"] and {r["route"] for r in rows} == {"HINH_SU"}
