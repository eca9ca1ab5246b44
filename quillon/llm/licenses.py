"""Licence scans by sentence rules: normalised sentences become identifiers, identifier sequences become licences.

1. A text is laid out anew: comment marks at line starts go, blank lines, list items, colons at a line's end and a few set openings start a new sentence, other line
   breaks become spaces, and what is left is cut after ``. ! ?`` before a capital. So wrapping, capitals and comments don't matter.
2. A sentence with a trigger word is normalised (lower case, runs of other characters than letters and digits become one space) and mapped to the
   first known sentence that it holds, word for word but for the slots of the known one; else to ``UNKNOWN``.
3. Ordered rules consume the identifier sequence: a rule takes every place where its identifiers follow one another, at most ``SKIP`` unknown
   sentences between two of them, and what it takes is gone for later rules. Each identifier of a rule must be there unless marked.

Defined cases: a null or empty text, or one without trigger, has no identifiers and no licences. One row for each row of
the table, null and repeated ids included; rows that agree get the same result. Long texts are one row's expressions, linear in their length. Empty tables
give no rows. A table's own columns stay as they are: a result whose name is taken gets the prefix ``out_``. The work is DataFrame functions on each
row alone: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import P, add_columns

#: Unknown sentences that may stand between two identifiers of a rule.
SKIP = 3

#: Words without which a sentence is never a licence sentence.
TRIGGER = "licen[cs]e|copyright|all rights reserved|warrant|permission|redistribut|spdx|public domain|liab|endorse|advertising|not evil"

#: Names of the SPDX list that are read after ``SPDX-License-Identifier:``; longer ones before their beginnings.
SPDX = "MIT-0 MIT Apache-2.0 BSD-2-Clause BSD-3-Clause-Clear BSD-3-Clause BSD-4-Clause 0BSD ISC GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC-BY-4.0 Unlicense BSL-1.0 Zlib"

#: Known sentences, in normal form, as their licences publish them. ``~`` is a slot for any words, ``^`` and ``$`` the ends of the sentence.
TEXTS = [
    ("MIT0_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~ to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so$"),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~ to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files$"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice ~ shall be included in all copies or substantial portions of the software"),
    ("MIT_ASIS", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MIT_ASIS", "the software is provided as is without warranty of any kind express$"),
    ("MIT_LIABILITY", "in no event shall ~ be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("X11_NAMES", "except as contained in this notice the name ~ shall not be used in advertising or otherwise to promote the sale use or other dealings in"),
    ("JSON_GOOD", "the software shall be used for good not evil"),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC_GRANT", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC_ASIS", "the software is provided as is and ~ all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ISC_LIABILITY", "in no event shall ~ be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("BSD_GRANT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD_CLEAR_GRANT", "redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer below provided that the following conditions are met"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD_ADVERT", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD_ENDORSE", "neither the name of ~ may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_ENDORSE", "the name of ~ may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_NO_PATENTS", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("BSD_ASIS", "this software is provided ~ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BSD_LIABILITY", "in no event shall ~ be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("APACHE2_GRANT", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("APACHE2_GRANT", "licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("APACHE2_COPY", "you may obtain a copy of the license at"),
    ("APACHE2_ASIS", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("APACHE2_SEE", "see the license for the specific language governing permissions and limitations under the license"),
    ("APACHE2_TITLE", "apache license version 2 0 january 2004"),
    ("AGPL3_FREE", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license ~ version 3"),
    ("LGPL21_FREE", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license ~ version 2 1"),
    ("LGPL2_FREE", "free software you can redistribute it and or modify it under the terms of the gnu library general public license ~ version 2"),
    ("LGPL3_FREE", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license ~ version 3"),
    ("GPL3_FREE", "free software you can redistribute it and or modify it under the terms of the gnu general public license ~ version 3"),
    ("GPL2_FREE", "free software you can redistribute it and or modify it under the terms of the gnu general public license ~ version 2"),
    ("GNU_WARRANTY", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GNU_SEE", "see the gnu ~ general public license for more details"),
    ("GNU_COPY", "you should have received a copy of the gnu ~ along with this"),
    ("GPL2_TITLE", "gnu general public license version 2 june 1991"),
    ("GPL3_TITLE", "gnu general public license version 3 29 june 2007"),
    ("LGPL21_TITLE", "gnu lesser general public license version 2 1 february 1999"),
    ("LGPL3_TITLE", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL3_TITLE", "gnu affero general public license version 3 19 november 2007"),
    ("MPL2_FORM", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL2_TITLE", "^mozilla public license version 2 0$"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("BSL1_GRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ZLIB_GRANT", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]

#: Names that a sentence may give after "licensed under" and the like; patterns over normal form.
NAMES = [
    ("APACHE2", "apache (software )?licen[cs]e (version |v ?)?2( 0)?"),
    ("MIT", "(mit|expat|mit expat) licen[cs]e"),
    ("AGPL3", "(gnu )?affero general public licen[cs]e (agpl )?(version |v ?)?3( 0)?"),
    ("LGPL21", "(gnu )?(lesser|library) general public licen[cs]e (lgpl )?(version |v ?)?2 1"),
    ("LGPL3", "(gnu )?lesser general public licen[cs]e (lgpl )?(version |v ?)?3( 0)?"),
    ("LGPL", "(gnu )?(lesser|library) general public licen[cs]e"),
    ("GPL3", "((gnu )?general public licen[cs]e|gnu gpl|gpl) ?(gpl )?(version |v ?)?3( 0)?"),
    ("GPL2", "((gnu )?general public licen[cs]e|gnu gpl|gpl) ?(gpl )?(version |v ?)?2( 0)?"),
    ("BSD3", "((3|three) clause bsd|(new|modified|revised) bsd|bsd (3|three) clause)( licen[cs]e)?"),
    ("BSD2", "((2|two) clause bsd|simplified bsd|bsd (2|two) clause)( licen[cs]e)?"),
    ("BSD", "bsd( style)? licen[cs]e"),
    ("ISC", "isc licen[cs]e"),
    ("MPL2", "mozilla public licen[cs]e (mpl )?(version |v ?)?2( 0)?"),
    ("CC_BY_NC4", "(cc by nc|creative commons attribution non ?commercial)( licen[cs]e)? 4 0"),
    ("CC_BY_SA4", "(cc by sa|creative commons attribution share ?alike)( licen[cs]e)? 4 0"),
    ("CC_BY4", "(cc by|creative commons attribution)( licen[cs]e)? 4 0"),
    ("CC0", "(cc0|creative commons zero)"),
]
UNDER = "(licen[cs]ed|released|distributed|available|published|provided|redistributed|covered) (under|by|with) (the |a |an )?(terms (and conditions )?of )?(the |a |an )?"
DENIED = "(not|never|neither|nor|no longer|isn t|aren t) (yet |currently |necessarily )?"

#: Ordered rules; each is a sequence of identifiers (``?`` marks one that may be missing) and its licence.
RULES = [
    ("MIT_GRANT MIT_NOTICE JSON_GOOD MIT_ASIS MIT_LIABILITY?", "JSON"),
    ("MIT_GRANT MIT_NOTICE MIT_ASIS MIT_LIABILITY? X11_NAMES", "X11"),
    ("MIT_GRANT MIT_NOTICE MIT_ASIS MIT_LIABILITY?", "MIT"),
    ("MIT0_GRANT MIT_ASIS MIT_LIABILITY?", "MIT-0"),
    ("ISC_GRANT ISC_ASIS ISC_LIABILITY?", "ISC"),
    ("0BSD_GRANT ISC_ASIS ISC_LIABILITY?", "0BSD"),
    ("BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ADVERT BSD_ENDORSE BSD_ASIS BSD_LIABILITY?", "BSD-4-Clause"),
    ("BSD_CLEAR_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE BSD_NO_PATENTS? BSD_ASIS BSD_LIABILITY?", "BSD-3-Clause-Clear"),
    ("BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE BSD_ASIS BSD_LIABILITY?", "BSD-3-Clause"),
    ("BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ASIS BSD_LIABILITY?", "BSD-2-Clause"),
    ("APACHE2_TITLE", "Apache-2.0"),
    ("APACHE2_GRANT APACHE2_COPY? APACHE2_ASIS? APACHE2_SEE?", "Apache-2.0"),
    ("AGPL3_FREE GNU_WARRANTY? GNU_SEE? GNU_COPY?", "AGPL-3.0"),
    ("LGPL21_FREE GNU_WARRANTY? GNU_SEE? GNU_COPY?", "LGPL-2.1"),
    ("LGPL2_FREE GNU_WARRANTY? GNU_SEE? GNU_COPY?", "LGPL-2.0"),
    ("LGPL3_FREE GNU_WARRANTY? GNU_SEE? GNU_COPY?", "LGPL-3.0"),
    ("GPL3_FREE GNU_WARRANTY? GNU_SEE? GNU_COPY?", "GPL-3.0"),
    ("GPL2_FREE GNU_WARRANTY? GNU_SEE? GNU_COPY?", "GPL-2.0"),
    ("GPL2_TITLE", "GPL-2.0"),
    ("GPL3_TITLE", "GPL-3.0"),
    ("LGPL21_TITLE", "LGPL-2.1"),
    ("LGPL3_TITLE", "LGPL-3.0"),
    ("AGPL3_TITLE", "AGPL-3.0"),
    ("MPL2_FORM", "MPL-2.0"),
    ("MPL2_TITLE", "MPL-2.0"),
    ("UNLICENSE", "Unlicense"),
    ("BSL1_GRANT", "BSL-1.0"),
    ("ZLIB_GRANT", "Zlib"),
    ("APACHE2_REF", "Apache-2.0"),
    ("MIT_REF", "MIT"),
    ("AGPL3_REF", "AGPL-3.0"),
    ("LGPL21_REF", "LGPL-2.1"),
    ("LGPL3_REF", "LGPL-3.0"),
    ("LGPL_REF", "LGPL"),
    ("GPL3_REF", "GPL-3.0"),
    ("GPL2_REF", "GPL-2.0"),
    ("BSD3_REF", "BSD-3-Clause"),
    ("BSD2_REF", "BSD-2-Clause"),
    ("BSD_REF", "BSD"),
    ("ISC_REF", "ISC"),
    ("MPL2_REF", "MPL-2.0"),
    ("CC_BY_NC4_REF", "CC-BY-NC-4.0"),
    ("CC_BY_SA4_REF", "CC-BY-SA-4.0"),
    ("CC_BY4_REF", "CC-BY-4.0"),
    ("CC0_REF", "CC0-1.0"),
    ("COPYRIGHT? ALL_RIGHTS", "All-Rights-Reserved"),
]
#: What may stand before the first sentence of a notice and belongs to it.
BEFORE, NOTICES = "COPYRIGHT? ALL_RIGHTS? ", ("MIT_", "MIT0_", "ISC_", "0BSD_", "BSD_", "APACHE2_GRANT")

GAP = r"[ \t\n]*"
#: Steps of the layout: (pattern, replacement); U+0001 stands between sentences. Both regex dialects read them alike.
LAYOUT = [
    ("[\r\x01]+", ""),
    (r"\n[ \t]*(/\*+!?|\*+/|\*|//+!?|#+|;+|--+|%+|<!--|-->|dnl )[ \t]*", "\n"),
    (rf":?[ \t]*\n[ \t]*\n{GAP}|:[ \t]*\n", "\x01\n"),
    (r"\n[ \t]*(\(?[0-9]{1,2}[.)]|\(?[a-z]\)|[-•])[ \t]+", "\x01"),
    (r"(?i)\n[ \t]*(spdx-license|copyright[ \t]+(\(c\)|©|[0-9]{4})|all rights reserved|licensed under|released under|permission is hereby|redistribution and use|redistributions (of|in) )", "\x01{1}"),
    (r"\n[ \t]*", " "),
    (r"([.!?][\"')\]]*)[ \t]+([\"'(\[]*[A-Z])", "{1}\x01{2}"),
]
OTHER = "[^a-z0-9]+"


def known_pattern(text: str) -> str:
    """A pattern over normal form for one known sentence."""
    start, text = ("^", text[1:]) if text[0] == "^" else ("(^| )", text)
    end, text = ("$", text[:-1]) if text[-1] == "$" else ("( |$)", text)
    return start + text.replace(" ~ ", " (.* )?") + end


TAG = "spdx license identifier"


def spdx_names() -> dict[str, str]:
    """Identifier of each SPDX name, after the tag in normal form."""
    return {"SPDX_" + re.sub(OTHER, "_", x.lower()): x for x in SPDX.split()}


def spdx_pattern() -> str:
    return f"(^| ){TAG} ({'|'.join(x[5:].replace('_', ' ') for x in spdx_names())})( |$)"


def known_sentences() -> list[tuple[str, str]]:
    """(identifier, pattern) in the order of trial, after the SPDX names: other SPDX tags, whole sentences, references by name, and what is left of notices."""
    named = "|".join(f"({p})" for _, p in NAMES)
    return [
        ("SPDX_OTHER", f"(^| ){TAG} "),
        *((i, known_pattern(t)) for i, t in TEXTS),
        ("DENIED", f"(^| ){DENIED}{UNDER}({named})( |$)"),
        *((f"{i}_REF", f"(^| ){UNDER}({p})( |$)") for i, p in NAMES),
        ("COPYRIGHT", "(^| )copyright (c )?([0-9]{4} )+"),
        ("ALL_RIGHTS", "(^| )all rights reserved( |$)"),
    ]


def licence_rules() -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Rules over sequences, in order; and licences that one identifier tells, which no sequence holds."""
    rules = [(BEFORE + s if s.startswith(NOTICES) else s, name) for s, name in RULES]
    held = {x.rstrip("?") for s, _ in rules if " " in s for x in s.split()}
    alone = {s: name for s, name in rules if " " not in s and s not in held}
    return [(s, name) for s, name in rules if s not in alone], alone | spdx_names()


def rule_pattern(sequence: str) -> str:
    """A pattern over identifiers, each with a comma after it."""
    skip, out, begun = f"(UNKNOWN,){{0,{SKIP}}}", "", False
    for x in sequence.split():
        one = x.rstrip("?") + ","
        one = skip + one if begun else one + skip if x.endswith("?") else one
        out += f"({one})?" if x.endswith("?") else one
        begun |= not x.endswith("?")
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_license_sentences``, ``sentence_ids``, ``licenses`` (sorted, distinct) and ``n_unknown``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = F.concat(F.lit("\n"), text)
    for pattern, by in LAYOUT:
        flat = F.regexp_replace(flat, F.lit(pattern), F.lit(re.sub(r"\{(\d)\}", r"$\1", by)))
    normal = F.transform(F.split(flat, "\x01"), lambda s: F.btrim(F.regexp_replace(F.lower(s), OTHER, " ")))
    sentences, tag = known_sentences(), spdx_pattern()

    def known(s: Column) -> Column:
        name = F.regexp_extract(s, tag, 2)
        spdx = F.when(name != "", F.concat(F.lit("SPDX_"), F.replace(name, F.lit(" "), F.lit("_"))))
        return F.coalesce(spdx, *(F.when(s.rlike(p), F.lit(i)) for i, p in sentences), F.lit("UNKNOWN"))

    ids = F.transform(F.filter(normal, lambda s: s.rlike(TRIGGER)), known)
    none = F.array().cast("array<string>")
    out = docs.withColumn(P + "ids", F.when(text.rlike(f"(?i){TRIGGER}"), ids).otherwise(none))
    left = F.concat(F.array_join(P + "ids", ","), F.lit(","))
    found, (rules, alone) = [], licence_rules()
    for i, (sequence, name) in enumerate(rules):
        p = "(^|,)" + rule_pattern(sequence)
        out = out.withColumn(f"{P}s{i}", left)
        found.append(F.when(F.col(f"{P}s{i}").rlike(p), F.lit(name)))
        left = F.regexp_replace(f"{P}s{i}", p, "$1")
    single = F.create_map(*(F.lit(x) for pair in alone.items() for x in pair))
    names = F.concat(F.array(*found), F.transform(P + "ids", lambda x: F.element_at(single, x)))
    results = {
        "n_license_sentences": F.size(P + "ids").cast("long"),
        "n_unknown": F.size(F.filter(P + "ids", lambda x: x == "UNKNOWN")).cast("long"),
        "sentence_ids": F.array_join(P + "ids", ","),
        "licenses": F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ","),
    }
    return add_columns(out, results, docs.columns)


def oracle() -> str:
    """The same rules as SQL, over documents."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    flat = "chr(10) || coalesce(text, '')"
    for pattern, by in LAYOUT:
        flat = f"regexp_replace({flat}, {lit(pattern)}, {lit(re.sub(r'{(.)}', r'\\\1', by))}, 'g')"
    name = f"regexp_extract(s, {lit(spdx_pattern())}, 2)"
    tests = [f"WHEN {name} <> '' THEN 'SPDX_' || replace({name}, ' ', '_')"] + [f"WHEN regexp_matches(s, {lit(p)}) THEN {lit(i)}" for i, p in known_sentences()]
    known = f"CASE {' '.join(tests)} ELSE 'UNKNOWN' END"
    steps, found = ["r0 AS (SELECT *, array_to_string(ids, ',') || ',' AS s0 FROM b)"], []
    rules, alone = licence_rules()
    single = f"MAP {{{', '.join(f'{lit(k)}: {lit(v)}' for k, v in alone.items())}}}"
    for i, (sequence, name) in enumerate(rules):
        p = lit("(^|,)" + rule_pattern(sequence))
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE s{i}, regexp_replace(s{i}, {p}, '\\1', 'g') AS s{i + 1}, CASE WHEN regexp_matches(s{i}, {p}) THEN {lit(name)} END AS f{i} FROM r{i})")
        found.append(f"f{i}")
    return f"""WITH a AS (
  SELECT doc_id, list_filter(list_transform(string_split({flat}, chr(1)),
    lambda s: trim(regexp_replace(lower(s), {lit(OTHER)}, ' ', 'g'))), lambda s: regexp_matches(s, {lit(TRIGGER)})) AS c FROM documents),
b AS (SELECT doc_id, list_transform(c, lambda s: {known}) AS ids FROM a),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_license_sentences,
  CAST(len(list_filter(ids, lambda x: x = 'UNKNOWN')) AS BIGINT) AS n_unknown,
  array_to_string(ids, ',') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat([{", ".join(found)}], list_transform(ids, lambda x: {single}[x])), lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM r{len(rules)}"""
