"""Binary Word files: the compound file, the piece table, and the stories it is made of."""

from __future__ import annotations

import re
import struct

from quillon.sources.docx import PAGE_NUMBER, Unreadable

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
#: Places in the file information block.
FLAGS, TEXT_START, TEXT_END, STORIES, CLX, CLX_SIZE = 0x0A, 0x18, 0x1C, 0x4C, 0x01A2, 0x01A6
ENCRYPTED, SECOND_TABLE = 0x0100, 0x0200


def u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else 0


def u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name."""
    sector, small = 1 << u16(data, 30), 1 << u16(data, 32)
    block = lambda i: data[(i + 1) * sector : (i + 2) * sector]

    def chain(i: int, table: list[int]):
        seen = 0
        while i < END and i < len(table) and seen <= len(table):
            yield i
            i, seen = table[i], seen + 1

    tables = [u32(data, 76 + 4 * i) for i in range(109)]
    following, left = u32(data, 68), u32(data, 72)
    while left and following < END:
        more = struct.unpack(f"<{sector // 4}I", block(following))
        tables += more[:-1]
        following, left = more[-1], left - 1
    fat = [x for t in tables if t < END and len(block(t)) == sector for x in struct.unpack(f"<{sector // 4}I", block(t))]
    whole = lambda i: b"".join(map(block, chain(i, fat)))
    directory, minor = whole(u32(data, 48)), whole(u32(data, 60))
    mini = list(struct.unpack(f"<{len(minor) // 4}I", minor[: len(minor) // 4 * 4]))
    root = whole(u32(directory, 116))
    out = {}
    for at in range(0, len(directory) - 127, 128):
        size, start = u32(directory, at + 120), u32(directory, at + 116)
        name = directory[at : at + max(0, u16(directory, at + 64) - 2)].decode("utf-16-le", "replace")
        if directory[at + 66] == 2:
            tiny = size < u32(data, 56)
            content = b"".join(root[i * small : (i + 1) * small] for i in chain(start, mini)) if tiny else whole(start)
            out[name] = content[:size]
    return out


def pieces(document: bytes, table: bytes) -> str:
    """All text in the order of the piece table; "" if there is none that makes sense."""
    clx = table[u32(document, CLX) : u32(document, CLX) + u32(document, CLX_SIZE)]
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + u16(clx, at + 1)
    if at >= len(clx) or clx[at] != 2:
        return ""
    plan = clx[at + 5 : at + 5 + u32(clx, at + 1)]
    n = (len(plan) - 4) // 12
    out = []
    for i in range(max(0, n)):
        size, place = u32(plan, 4 * i + 4) - u32(plan, 4 * i), u32(plan, 4 * (n + 1) + 8 * i + 2)
        if size > 0 and place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(document[start : start + size].decode("cp1252", "replace"))
        elif size > 0:
            out.append(document[place & 0x3FFFFFFF :][: 2 * size].decode("utf-16-le", "replace"))
    return "".join(out)


def without_fields(text: str) -> str:
    """Field codes go, what they show stays."""
    before = None
    while before != text:
        before = text
        text = re.sub("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15", lambda m: m[1] or "", text)
    return re.sub("\x13[^\x14]*\x14?|[\x14\x15]", "", text)


#: Characters with a meaning of their own in a document's text: paragraph, line, page and cell ends, hyphens that don't break, hard
#: spaces. Every other control character says nothing.
CONTROLS = dict.fromkeys((*range(0x09), *range(0x0E, 0x20))) | {0x07: " | ", 0x0B: "\n", 0x0C: "\n", 0x0D: "\n", 0x1E: "-", 0xA0: " "}
ROW_END = re.compile("\x07\x07")  # an empty cell end closes a row


def plain(text: str) -> str:
    """A story as lines; rows of tables are lines too."""
    rows = ROW_END.sub(" |\n", without_fields(text)).translate(CONTROLS)
    return rows.removeprefix(" |\n")


def notes_of(story: str) -> list[str]:
    """Notes of a story, without their marks and their blank ones; each note follows a mark."""
    said = (" ".join(plain(part).split()) for part in story.split("\x02"))
    return list(filter(None, said))


def readable_runs(data: bytes) -> str:
    """Last resort: runs of readable characters under two decodings; the one with more words wins."""
    best = ("", -1)
    for codec in ("utf-16-le", "cp1252"):
        runs = re.findall(r"[\t\n\r -ɏḀ-℀]{4,}", data.decode(codec, "replace"))
        text = "\n".join(r.strip() for r in runs if len(re.findall("[A-Za-zÀ-ỹ]", r)) >= 3)
        best = max(best, (text, len(re.findall("[A-Za-zÀ-ỹ]{2,}", text))), key=lambda x: x[1])
    return best[0].replace("\r", "\n")


def doc_text(data: bytes) -> tuple[str, list[str]]:
    """(text, warnings)."""
    found = streams(data)
    if "EncryptedPackage" in found:
        raise Unreadable("File đang được đặt mật khẩu mở. Hãy bỏ mật khẩu rồi lưu lại.")
    document = found.get("WordDocument", b"")
    if len(document) < 0x60:
        raise Unreadable("File .doc này không chứa văn bản Word (thiếu luồng WordDocument).")
    flags = u16(document, FLAGS)
    if flags & ENCRYPTED:
        raise Unreadable("File .doc đang được đặt mật khẩu. Hãy bỏ mật khẩu rồi lưu lại.")
    text = pieces(document, found.get("1Table" if flags & SECOND_TABLE else "0Table", b""))
    if not text:
        if 0 < u16(document, 2) < 0xC1:
            return plain(document[u32(document, TEXT_START) : u32(document, TEXT_END)].decode("cp1252", "replace")), []
        return readable_runs(document), ["structure unreadable: characters may be missing or wrong"]
    sizes = [u32(document, STORIES + 4 * i) for i in range(8)]
    if not sizes[0] or sum(sizes) > len(text) + 8:
        sizes = [len(text)] + [0] * 7
    ends = [sum(sizes[: i + 1]) for i in range(8)]
    main, foot, head, _, _, endnotes, boxes, _ = (text[e - s : e] for s, e in zip(sizes, ends, strict=True))
    notes = notes_of(foot) + notes_of(endnotes)
    if notes and main.count("\x02") == len(notes):
        said = iter(notes)
        main, notes = re.sub("\x02", lambda _: f" [Chú thích: {next(said)}]", main), []
    parts = [plain(main)] + (["[Chú thích]\n" + "\n".join(notes)] if notes else [])
    if box := plain(boxes).strip():
        parts.append("[Khung văn bản]\n" + box)
    margin = list(dict.fromkeys(x for x in map(str.strip, plain(head).split("\n")) if x and not PAGE_NUMBER.fullmatch(x)))
    return "\n".join(parts + (["[Đầu trang / chân trang] " + " / ".join(margin)] if margin else [])), []
