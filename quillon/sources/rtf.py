r"""RTF bytes to text, after the published RTF specification (1.9.1).

Three steps, each on its own: ``lex`` cuts the bytes into tokens, ``groups`` nests them by braces, and ``Story`` tells a
group's text. A group is one of three: data (a destination that carries no text of the document, or an unknown one marked
``\*``), a note (told by a story of its own and set in brackets where it stands), or plain text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Destinations without text of the document, by the chapter of the specification that defines them.
DATA = {
    "tables of fonts, colours, styles, lists, files, revisions": "fonttbl colortbl stylesheet listtable listoverridetable filetbl revtbl rsidtbl",
    "document information and protection": "info generator userprops xmlnstbl themedata colorschememapping latentstyles datastore passwordhash",
    "pictures, objects and drawing properties": "pict nonshppict shppict objdata sp background",
    "running heads": "header headerl headerr headerf footer footerl footerr footerf",
    "note separators": "ftnsep ftnsepc ftncn aftnsep aftnsepc aftncn",
    "field instructions and bookmarks": "fldinst bkmkstart bkmkend",
    "comments": "annotation atnid atnauthor atrfstart atrfend",
    "mathematical properties": "mmathPr",
}
SILENT = frozenset(name for names in DATA.values() for name in names.split())
#: Marked as ignorable, yet they hold text that a reader of the page sees: list labels, and text inside shapes.
SHOWN = frozenset(("listtext", "pntext", "shpinst", "shptxt"))
#: Control words that are one character (chapter "Special Characters").
CHARACTERS = {
    "tab": "\t",
    "emspace": " ",
    "enspace": " ",
    "qmspace": " ",
    "emdash": "—",
    "endash": "–",
    "bullet": "•",
    "lquote": "‘",
    "rquote": "’",
    "ldblquote": "“",
    "rdblquote": "”",
}
#: Control words that end a line, and those that end a table cell.
LINE_ENDS = frozenset(("par", "line", "sect", "page", "row", "nestrow"))
CELL_ENDS = frozenset(("cell", "nestcell"))
#: Control symbols; a backslash before a line end is a paragraph mark.
SYMBOLS = {b"~": " ", b"_": "-", b"\\": "\\", b"{": "{", b"}": "}", b"\n": "\n", b"\r": "\n"}
#: Character sets that a header may name without a number.
CODE_PAGES = {"ansi": "cp1252", "pc": "cp437", "pca": "cp850", "mac": "mac_roman"}
LAST_BAR = re.compile(r"[ \t]*\|[ \t]*$")  # the last cell's end is the row's
CELL = "\x00"  # stands for a cell's end until its line is whole


class Token(NamedTuple):
    kind: str  # open, close, word, symbol, byte, text
    value: object
    number: int | None = None


WORD = re.compile(rb"([A-Za-z]+)(-?\d+)? ?")
PLAIN = re.compile(rb"[^\\{}\r\n]+")


def lex(data: bytes):
    at, end = 0, len(data)
    while at < end:
        c = data[at : at + 1]
        at += 1
        if c == b"{":
            yield Token("open", None)
        elif c == b"}":
            yield Token("close", None)
        elif c == b"\\":
            if word := WORD.match(data, at):
                at = word.end()
                number = None if word[2] is None else int(word[2])
                if word[1] == b"bin":  # that many bytes follow as they are
                    at += max(number or 0, 0)
                else:
                    yield Token("word", word[1].decode(), number)
            elif data[at : at + 1] == b"'":
                digits = data[at + 1 : at + 3]
                if re.fullmatch(rb"[0-9A-Fa-f]{2}", digits):
                    yield Token("byte", bytes.fromhex(digits.decode()))
                    at += 3
                else:
                    at += 1
            else:
                yield Token("symbol", data[at : at + 1])
                at += 1
        elif c not in b"\r\n":
            run = PLAIN.match(data, at - 1)
            yield Token("text", run[0])
            at = run.end()


def groups(tokens) -> list:
    """Nested lists of tokens; braces that don't match are forgiven."""
    path: list[list] = [[]]
    for t in tokens:
        if t.kind == "open":
            path[-1].append([])
            path.append(path[-1][-1])
        elif t.kind == "close":
            if len(path) > 1:
                path.pop()
        else:
            path[-1].append(t)
    return path[0]


def destination(group: list) -> tuple[str, bool]:
    """A group's first control word, and whether it may be ignored by who does not know it."""
    head = [x for x in group[:2] if isinstance(x, Token)]
    ignorable = bool(head) and head[0] == Token("symbol", b"*")
    word = head[ignorable] if len(head) > ignorable else None
    return (word.value if word and word.kind == "word" else ""), ignorable


class Story:
    """The text of one run of groups: that of the document, or of one note."""

    def __init__(self, code_page: str = "cp1252"):
        self.code_page, self.parts, self.pending = code_page, [], b""

    def say(self, text: str) -> None:
        if self.pending:  # bytes are decoded together, since a character may take several
            try:
                self.parts.append(self.pending.decode(self.code_page, "replace"))
            except LookupError:
                self.parts.append(self.pending.decode("cp1252", "replace"))
            self.pending = b""
        self.parts.append(text)

    def tell(self, group: list, fallback: int = 1) -> Story:
        """``fallback``: how many units stand after a Unicode character for readers that don't know it."""
        todo = [(iter(group), fallback)]
        skipped = 0
        while todo:
            items, fallback = todo.pop()
            for x in items:
                if isinstance(x, list):
                    skipped, (name, ignorable) = 0, destination(x)
                    if name == "footnote":
                        said = Story(self.code_page).tell(x, fallback).text().strip()
                        self.say(f" [Chú thích: {said}]")
                    elif name not in SILENT and (not ignorable or name in SHOWN):
                        todo += [(items, fallback), (iter(x), fallback)]
                        break
                elif skipped:
                    if x.kind == "text" and len(x.value) > skipped:
                        self.pending += x.value[skipped:]
                    skipped -= min(skipped, len(x.value) if x.kind == "text" else 1)
                elif x.kind in ("text", "byte"):
                    self.pending += x.value
                elif x.kind == "symbol":
                    self.say(SYMBOLS.get(x.value, ""))
                elif x.value == "u" and x.number is not None:
                    self.say(chr(x.number & 0xFFFF))
                    skipped = fallback
                elif x.value == "uc" and x.number is not None:
                    fallback = max(x.number, 0)
                elif x.value == "ansicpg" and x.number:
                    self.code_page = f"cp{x.number}"
                elif x.value in CODE_PAGES:
                    self.code_page = CODE_PAGES[x.value]
                elif x.value in CHARACTERS:
                    self.say(CHARACTERS[x.value])
                elif x.value in LINE_ENDS or x.value in CELL_ENDS:
                    self.say("\n" if x.value in LINE_ENDS else CELL)
            else:
                skipped = 0
        return self

    def text(self) -> str:
        self.say("")
        joined = "".join(self.parts).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        *ended, last = joined.replace(CELL, " | ").split("\n")
        return "\n".join(line.strip() for line in [*(LAST_BAR.sub("", line) for line in ended), last])


def rtf_text(data: bytes) -> str:
    return Story().tell(groups(lex(data))).text()


def rtf_bytes(text: str) -> bytes:
    """A plain RTF file of a text: the inverse of ``rtf_text`` up to white space."""
    out = []
    for c in text:
        if c == "\n":
            out.append("\\par\n")
        elif c in "{}\\":
            out.append("\\" + c)
        elif c == "\t":
            out.append("\\tab ")
        elif ord(c) < 128:
            out.append(c)
        else:
            code = c.encode("utf-16-le")
            out += [f"\\u{int.from_bytes(code[i : i + 2], 'little', signed=True)}?" for i in range(0, len(code), 2)]
    return ("{\\rtf1\\ansi\\ansicpg1252\\uc1 " + "".join(out) + "}").encode("ascii")
