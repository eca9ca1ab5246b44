"""Column functions over text. Patterns carry ``(?Ud)``: Unicode classes, and only a line feed ends a line."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K

U = "(?Ud)"
#: Texts of these characters alone are in normal form C already: Latin up to U+02FF, Vietnamese letters, common punctuation.
INERT = "^[\\u0000-\\u02FF\\u1EA0-\\u1EF9\\u2010-\\u2027\\u2030-\\u205E\\u20AB\\u20AC]*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once a row and written once in the plan, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfc(c: Column | str) -> Column:
    """Normal form C. Spark has no such function, so texts that may not be in it yet go through Arrow; the others stay."""


    @F.pandas_udf("string")
    def compose(texts):  # noqa: ANN001
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    c = col(c)
    return F.coalesce(compose(F.when(~c.rlike(INERT), c)), c)


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.regexp_replace(c, U + r"^\s+", ""), U + r"\s+$", "")


def normalize(c: Column | str) -> Column:
    return F.lower(nfc(empty(c)))


def tokens(normal: Column, stopwords: list[str] | tuple = tuple(K.STOPWORDS)) -> Column:
    """Distinct search tokens of a normalised text."""
    found = F.array_distinct(F.regexp_extract_all(normal, F.lit(K.TOKEN), F.lit(0)))
    kept = F.filter(found, lambda w: F.length(w) > 1)
    return F.array_except(kept, F.array(*map(F.lit, stopwords))) if stopwords else kept


def clean_text(c: Column | str) -> Column:
    out = F.replace(F.replace(nfc(empty(c)), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.replace(out, F.lit(chr(0xA0)), F.lit(" ")), K.CONTROL, "")
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n")
    return strip(out)


def text_words(c: Column | str) -> Column:
    return F.regexp_extract_all(empty(c), F.lit(K.WORD), F.lit(0))


def marked_words(words: Column, letters: str = K.VIETNAMESE) -> Column:
    return F.size(F.filter(words, lambda w: F.lower(w).rlike(letters)))


def score_text(c: Column | str, letters: str = K.VIETNAMESE) -> Column:
    """2 points a word and 5 more for one with Vietnamese letters; -1 without words."""
    w = text_words(c)
    return F.when(F.size(w) == 0, F.lit(-1)).otherwise(F.size(w) * 2 + marked_words(w, letters) * 5)


def text_stats(c: Column | str, letters: str = K.VIETNAMESE) -> Column:
    text = empty(c)
    w = text_words(text)
    chars = F.length(F.regexp_replace(text, U + r"\s", ""))
    strange = F.regexp_count(text, F.lit(U + r"[\x{FFFD}\x{E000}-\x{F8FF}[\x00-\x1F&&[^\s\x1C-\x1F]]]"))
    bad = strange + F.regexp_count(text, F.lit(U + r"\(cid:\d+\)")) * 6
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return F.struct(
        chars.alias("chars"),
        F.size(w).alias("words"),
        ratio(marked_words(w, letters), F.size(w)).alias("viet_ratio"),
        ratio(bad, chars).alias("bad_ratio"),
        ((F.length(text) - F.length(F.replace(F.lower(text), F.lit(K.UNREADABLE), F.lit("")))) / len(K.UNREADABLE))
        .cast("int")
        .alias("unreadable_marks"),
    )


def letters(c: Column | str) -> Column:
    return F.regexp_count(empty(c), F.lit(r"\p{L}"))


def legacy_encoding(c: Column | str) -> Column:
    """"TCVN3", "VNI" or null."""
    text = empty(c)
    viet = F.regexp_count(text, F.lit(K.UNICODE_SIGNS))
    old, vni = F.regexp_count(text, F.lit(K.TCVN3_SIGNS)), F.regexp_count(text, F.lit(K.VNI_SIGNS))
    return F.when((old >= 15) & (old > 5 * viet), "TCVN3").when(
        (vni >= 15) & (vni > 5 * viet) & (vni > letters(text) * 0.04), "VNI"
    )


def fix_legacy(c: Column | str) -> Column:
    """Struct of the repaired text and the encoding found; VNI text is only reported."""
    text = empty(c)
    found = legacy_encoding(text)
    fixed = F.when(found == "TCVN3", nfc(F.translate(text, K.TCVN3_FROM, K.TCVN3_TO))).otherwise(text)
    return F.struct(fixed.alias("text"), found.alias("encoding"))


def corpus_line(c: Column | str) -> Column:
    """A line of a statute: composed, with the right capital D, single spaces, no space at its ends."""
    out = F.translate(nfc(empty(c)), chr(0xD0), chr(0x110))
    return strip(F.regexp_replace(out, "[ \\t\\u00A0\\u2000-\\u200B\\u202F\\u3000]+", " "))


def structure_level(c: Column | str) -> Column:
    out = None
    for level, pattern in K.LEVELS:
        hit = col(c).rlike(f"(?Ud)(?i){pattern}")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def is_title_line(c: Column | str) -> Column:
    return (F.upper(col(c)) == col(c)) & col(c).rlike(r"\p{L}")


def article_number(c: Column | str) -> Column:
    return F.regexp_extract(col(c), U + K.ARTICLE, 1)


def article_title(c: Column | str) -> Column:
    return F.regexp_extract(col(c), U + K.ARTICLE, 2)


def number_key(c: Column | str) -> Column:
    """Sorts "217a" after "217" and before "218"."""
    return F.struct(
        F.regexp_extract(col(c), r"^(\d+)", 1).try_cast("int").alias("n"), F.regexp_replace(col(c), r"^\d+", "").alias("suffix")
    )


def case_type(c: Column | str, criminal: str = K.CRIMINAL_MARKERS, civil: str = K.CIVIL_MARKERS) -> Column:
    """Route by rule: four marks at least and three times as many as of the other kind; else null. Civil comes first."""
    hs = F.regexp_count(empty(c), F.lit(f"(?Ud)(?i){criminal}"))
    ds = F.regexp_count(empty(c), F.lit(f"(?Ud)(?i){civil}"))
    one = F.lit(1)
    return F.when((ds >= 4) & (ds >= 3 * F.greatest(hs, one)), K.CIVIL).when((hs >= 4) & (hs >= 3 * F.greatest(ds, one)), K.CRIMINAL)


def is_filled(c: Column | str) -> Column:
    """Not blank, and not marked as missing."""
    text = strip(empty(c))
    return (text != "") & ~F.upper(text).contains(K.MISSING)


def cut_json(c: Column | str) -> Column:
    """From the first brace to the last; the whole text where there is no such piece."""
    text = strip(empty(c))
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    good = (start > 0) & (F.instr(text, "}") > 0) & (end > start)
    return F.when(good, F.substring(text, start, end - start + 1)).otherwise(text)


def lines(c: Column | str) -> Column:
    """Lines with single spaces; blank ones are dropped."""
    parts = F.split(empty(c), "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]")
    return F.filter(F.transform(parts, lambda x: strip(F.regexp_replace(x, "[ \\t\\u00A0]+", " "))), lambda x: x != "")


def is_retryable(c: Column | str) -> Column:
    low = F.lower(empty(c))
    out = F.lit(False)
    for mark in K.RETRYABLE:
        out = out | low.contains(mark)
    return out


def fold(c: Column | str) -> Column:
    """Without diacritics, lower case, single spaces."""

    @F.pandas_udf("string")
    def plain(texts):  # noqa: ANN001
        return texts.map(lambda t: t if t is None else "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn"))

    out = F.translate(plain(empty(c)), chr(0x111) + chr(0x110), "dD")
    return F.lower(strip(F.regexp_replace(out, U + r"\s+", " ")))
