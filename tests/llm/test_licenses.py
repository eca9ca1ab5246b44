"""Licence scans on notices as they are published, wrapped and commented in several ways, and on near misses."""

import re
import textwrap

import pytest

from quillon.llm import licenses

COPYRIGHT = "Copyright (c) 2019, The Example Authors"
MIT = [
    "MIT License",
    COPYRIGHT,
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
BSD_HEAD = [COPYRIGHT + "\nAll rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"]
BSD_ITEMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
BSD_TAIL = [
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
]
ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
numbered = lambda items: [f"{i}. {x}" for i, x in enumerate(items, 1)]
starred = lambda items: [f"* {x}" for x in items]
ISC = [
    COPYRIGHT,
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
]
APACHE = [
    "Copyright 2020 Example",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]


def gnu(what, name, version, place="along with this program.  If not, see <https://www.gnu.org/licenses/>."):
    return [
        COPYRIGHT,
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the {name} for more details.",
        f"You should have received a copy of the {name} {place}",
    ]


GPL2 = gnu("program", "GNU General Public License", "2", "along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
GPL3 = gnu("program", "GNU General Public License", "3")
LGPL21 = gnu("library", "GNU Lesser General Public License", "2.1", "along with this library; if not, write to the Free Software Foundation.")
MPL2 = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]

PUBLISHED = {
    "MIT": MIT,
    "BSD-2-Clause": BSD_HEAD + numbered(BSD_ITEMS[:2]) + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + numbered(BSD_ITEMS) + BSD_TAIL,
    "ISC": ISC,
    "Apache-2.0": APACHE,
    "GPL-2.0": GPL2,
    "GPL-3.0": GPL3,
    "LGPL-2.1": LGPL21,
    "MPL-2.0": MPL2,
    "BSD-4-Clause": BSD_HEAD + numbered([*BSD_ITEMS[:2], ADVERT, BSD_ITEMS[2]]) + BSD_TAIL,
}


def laid_out(paragraphs, width, mark):
    lines = []
    for p in paragraphs:
        for line in p.split("\n"):
            lines += textwrap.wrap(line.strip(), width - len(mark), subsequent_indent="   " if re.match(r"\d\.|\*", line) else "") or [""]
        lines.append("")
    if mark == " * ":
        return "/*\n" + "\n".join((mark + x).rstrip() for x in lines) + "\n */\nint main;\n"
    return "\n".join((mark + x).rstrip() for x in lines)


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_published_notices_are_found(spark):
    cases = [(name, laid_out(t, width, mark)) for name, t in PUBLISHED.items() for width in (50, 72, 80, 10_000) for mark in ("", "# ", "// ", " * ")]
    cases += [("BSD-3-Clause", laid_out(BSD_HEAD + starred(BSD_ITEMS) + BSD_TAIL, 72, "")), ("MIT", "\n\n".join(MIT).replace("\n", "\r\n")), ("MIT", "\n\n".join(MIT).lower().capitalize().replace("in no event", "In no event"))]
    got = scan(spark, [t for _, t in cases])
    assert [(n, g) for (n, _), g in zip(cases, got, strict=True) if g != n] == []


TITLES = [
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n 51 Franklin Street\n Everyone is permitted to copy and distribute verbatim copies\n"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n"),
]
SHORT = [
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\npackage main"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
    ("BSD-3-Clause", "Distributed under the 3-clause BSD licence"),
    ("MIT,MPL-2.0", "Released under the MIT License.\nParts are available under the terms of the Mozilla Public License 2.0."),
    ("Apache-2.0", "Available under the Apache License v2.0, as everybody knows"),
    ("JSON", "\n\n".join([*MIT[1:4], "The Software shall be used for Good, not Evil.", MIT[4]])),
    ("MIT-0", "\n\n".join([MIT[2].replace(", subject to the following conditions:", "."), MIT[4]])),
    ("X11", "\n\n".join([*MIT[1:], "Except as contained in this notice, the name of the Example Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization."])),
]
NEAR_MISSES = [
    "\n\n".join([MIT[2], MIT[4]]).replace("IN NO EVENT", "It is so. in no event"),  # no notice sentence, no liability sentence
    "\n\n".join(MIT).replace("to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies", "to use and copy, but never to sell copies"),
    "\n\n".join(BSD_HEAD[1:] + BSD_ITEMS[:1] + BSD_TAIL),  # no binary clause
    "\n\n".join(BSD_HEAD[1:] + BSD_ITEMS).replace("are permitted provided", "are forbidden unless"),
    "\n\n".join(ISC[1:]).replace("with or without fee is hereby granted", "against a fee is hereby granted"),
    "Licensed under the Apache License, Version 1.1.",
    "This file is not licensed under the MIT License.",
    "The GNU General Public License and the MIT License differ in many ways, says this text on licences.",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "Mozilla Public License, version 1.1, covers nothing here.",
    "His works are now in the public domain in some countries.",
    "You should have received a copy of the GNU General Public License along with this program.",
    "The licence of the pub was revoked; permission to sell beer is hereby granted to nobody.",
]


@pytest.mark.parametrize("cases", [TITLES, SHORT, [("", t) for t in NEAR_MISSES]], ids=["titles", "short", "near misses"])
def test_titles_references_and_near_misses(spark, cases):
    got = scan(spark, [t for _, t in cases])
    assert [(want, g, t[:70]) for (want, t), g in zip(cases, got, strict=True) if g != want] == []


def test_a_rule_skips_a_few_unknown_sentences_but_no_more(spark):
    some = lambda n: [f"This is a {x} warranty remark." for x in ["odd", "rare", "new", "old"][:n]]
    notice = lambda n: "\n\n".join([MIT[2], *some(n), *MIT[3:]])
    assert scan(spark, [notice(3), notice(4)]) == ["MIT", ""]


def test_empty_table_and_names_that_clash(spark):
    df = spark.createDataFrame([(None, None, 1, "x", "y")], "doc_id long, text string, n_unknown int, Licenses string, sentence_ids string")
    out = licenses.scan_licenses(df)
    assert out.columns == [*df.columns, "n_license_sentences", "out_n_unknown", "out_sentence_ids", "out_licenses"]
    assert tuple(out.first()) == (None, None, 1, "x", "y", 0, 0, "", "")
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_sql_gives_the_same(spark):
    import duckdb

    texts = [laid_out(t, w, m) for t in PUBLISHED.values() for w, m in ((72, "# "), (80, " * "))] + NEAR_MISSES + [t for _, t in TITLES + SHORT]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    pandas = df.toPandas()
    con.register("documents", pandas)
    want = sorted(con.execute(licenses.oracle()).fetchall())
    cols = ("doc_id", "n_license_sentences", "n_unknown", "sentence_ids", "licenses")
    assert sorted(tuple(r[c] for c in cols) for r in licenses.scan_licenses(df).collect()) == want
