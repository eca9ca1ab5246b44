"""Token ids of whole texts with a public tokenizer file, through a bounded cache of chunks between white space."""

from __future__ import annotations

import re
from functools import cache
from struct import Struct, pack

SMALL_SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")
#: White space that ``str.split`` knows besides the six ASCII characters.
OTHER_SPACES = re.compile("[%s]" % "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))
#: Chunks whose lower case, normal form and letter classes are plain: ASCII and Latin letters without dotted capital I.
PLAIN = re.compile("[!-~%c-%c%c-%c]+" % (0xA1, 0x12F, 0x131, 0x24F)).fullmatch
PACK = [Struct(f"<{n}I").pack for n in range(64)]
#: Entries of one generation of the cache; two are kept.
CACHED = 450_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """``encode(text)``: the library's ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins what it separates, so chunks are encoded once and looked up.
    A plain chunk is cut by the tokenizer's own pattern and its pieces go to the library's model; any other chunk goes
    through the library whole.
    """

    def __init__(self, path: str, cached: int = CACHED):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.old = Tokenizer.from_file(path), cached, {}
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = norm == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        if not known:
            raise ValueError("this tokenizer isn't one that drops white space and lower-cases")
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.model, self.special = self.tokenizer.model, [t["content"] for t in spec["added_tokens"]]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})

    def _model(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else pack(f"<{len(ids)}I", *ids)

    def _word(self, lower: str) -> bytes:
        """Ids of letters alone, which are one piece."""
        found = self.get(lower) or self.old.get(lower)
        if found is None:
            found = self[lower] = self._model(lower)
        return found

    def _chunk(self, chunk: str) -> bytes:
        plain = (chunk.isascii() and chunk.isprintable()) or PLAIN(chunk)
        if plain and chunk.isalpha():
            return self._word(chunk.lower())
        if plain and chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # letters and a mark are two pieces
            return self._word(chunk[:-1].lower()) + self[chunk[-1]]
        if plain and not any(s in chunk for s in self.special):
            pieces = self.pieces(chunk.lower())
            return self._model(chunk) if pieces == [chunk] else b"".join(map(self.__getitem__, pieces))
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self._chunk(chunk)
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = text.split()
        if OTHER_SPACES.search(text):
            chunks = [c for c in SMALL_SPACES.split(text) if c]
        return b"".join(map(self.__getitem__, chunks))


def slices(batches, rows: int = 256):
    """Small slices of Arrow batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@cache
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)
