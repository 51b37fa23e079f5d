import re
import textwrap

from pyspark.sql import functions as F

from quire.llm.licences import RULES, SENTENCES, scan

STOPS = ".!?:"


def sentences(text):
    """Sentences as lists of their lines, character by character."""
    lines = []
    for line in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "").replace("\r", "")).split("\n"):
        line = re.sub(r"^[ \t]*((//+|#+|/?\*+/?|;+|--+|%+|<!--)[ \t]*)?(\(?(\d{1,3}|[a-z]|[ivx]{2,4})[.)][ \t]+)?", "", line, flags=re.ASCII)
        lines.append(line)
    lines = named("\n".join(lines)).split("\n")
    out, now = [], [""]

    def end():
        nonlocal now
        if any(re.search("[a-z0-9]", x) for x in now):
            out.append([x for x in (" ".join(re.findall("[a-z0-9]+", y)) for y in now) if x])
        now = [""]

    for n, line in enumerate(lines):
        for i, c in enumerate(line):
            now[-1] += c
            if c in STOPS and (line[i + 1 : i + 2] in (" ", "\t") or i + 1 == len(line) and n + 1 < len(lines)):
                end()
        if n + 1 < len(lines):
            if not line.strip(" \t") or re.match("copyright[ \t]", line):
                end()
            now.append("")
    end()
    return out


def between(text, first, last, new):
    """Puts new in place of the words first, at most 300 characters, and the words last, word by word."""
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n]+", text)]
    words = [text[a:b] for a, b in tokens]
    i = 0
    while i < len(words):
        n = next((len(f) for f in first if words[i : i + len(f)] == f), 0)
        if n:
            for j in range(i + n, len(words)):
                gap = tokens[j][0] - tokens[i + n][0]
                if gap > 301:
                    break
                m = next((len(x) for x in last if words[j : j + len(x) - 1] == x[:-1] and len(words) > j + len(x) - 1 and words[j + len(x) - 1].startswith(x[-1])), 0)
                if m and j > i + n:
                    end = tokens[j + m - 1][0] + max(len(x[-1]) for x in last if len(x) == m and words[j + m - 1].startswith(x[-1]))
                    return text[: tokens[i][0]] + new + between(text[end:], first, last, new)
        i += 1
    return text


def named(text):
    own = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    promote = [f"be used to endorse or promote products derived from this {x}".split() for x in ("software", "material", "program")]
    text = between(text, [["neither", "the", x, "of"] for x in ("name", "names", "trademark", "trademarks")] + [["neither", "the", x] for x in ("name", "names")], [["may", *p] for p in promote], own)
    text = between(text, [["the", "name", "of"], ["the", "names", "of"]], [["may", "not", *p] for p in promote], own)
    text = between(text, [["in", "no", "event", "shall"]], ["be liable for any claim, damages or other liability".split()], "in no event shall the authors or copyright holders be liable for any claim, damages or other liability")
    text = between(text, [["this", "software", "is", "provided", "by"]], [["and", "any", "express"]], 'this software is provided by the copyright holders and contributors "as is" and any express')
    return between(text, [["to", "the", "extent", "possible", "under", "law,"]], [["has", "waived", "all", "copyright"]], "to the extent possible under law, the author has waived all copyright")


NAMES, RUNS = {}, {}
for number, known in SENTENCES.items():
    RUNS[number] = [NAMES.setdefault(" ".join(x), len(NAMES) + 1) for x in sentences(known)]


def brute(text):
    ids = []
    found = sentences(text)
    for lines in found:
        whole = NAMES.get(" ".join(lines))
        for n in [whole] if whole else [NAMES.get(x, 0) for x in lines]:
            if n or not ids or ids[-1]:
                ids.append(n)
    left, hits, shown = list(ids), set(), " ".join(map(str, ids))
    for rule in sorted(RULES, key=lambda r: -sum(len(RUNS[s]) for s in r.sentences)):
        want, i = [n for s in rule.sentences for n in RUNS[s]], 0
        while i + len(want) <= len(left):
            if left[i : i + len(want)] == want:
                hits.add(rule)
                left[i : i + len(want)] = [0]
            i += 1
    kinds = {r.kind for r in hits}
    return len(found), shown, ",".join(sorted({r.licence for r in hits})), next((k for k in ("restricted", "copyleft", "permissive") if k in kinds), "none")


def check(df):
    rows = df.collect()
    got = sorted(((r.doc_id, r.n_sentences, r.sentence_ids, r.licences, r.licence_kind) for r in scan(df).collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in rows), key=repr)
    return {r[0]: r[3:] for r in got}


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_documents(docs, odd, none):
    got = check(docs)
    assert {"MIT", "Apache-2.0", "GPL-3.0-only", "CC-BY-NC-4.0", "proprietary"} >= {r[0] for r in got.values()} - {""} and any(r[0] for r in got.values())
    check(odd.withColumns({"id": F.lit("x"), "left": F.lit(1), "found": F.lit(None).cast("int")}))
    assert scan(none).count() == 0


def test_rules(spark):
    s = SENTENCES
    got = check(texts(spark, [
        f"MIT License\n\nCopyright (c) 2020 X\n\n{s[3]}:\n\n{s[4]}.\n\n{s[5]}.", f"{s[31]}:\n1. {s[32]}.\n", f"{s[31]}:\n{s[32]}.\n{s[33]}.\n{s[34]}.", f"{s[31]}:\n{s[32]}.\n{s[33]}.",
        "text  Released under\tthe MIT  License.", "released UNDER the mit licence.", "RELEASED under the MIT License!  All rights reserved.",
        "Words before. Licensed under the Apache License, Version 2.0. Words after.", f"{s[3]}:\nNot so.\n{s[4]}.", "A line of prose without a stop\nReleased under the MIT License\nand more prose.",
    ]))
    assert [got[i] for i in range(10)] == [
        ("MIT", "permissive"), ("", "none"), ("BSD-3-Clause", "permissive"), ("BSD-2-Clause", "permissive"), ("", "none"), ("", "none"), ("MIT,proprietary", "restricted"), ("Apache-2.0", "permissive"), ("", "none"), ("MIT", "permissive"),
    ]


def test_parts_alone_mean_nothing(spark):
    got = check(texts(spark, ["Version: 2.0", "MIT", "The licence is called:\nMIT\n", "ISC\n\n2.0", "SPDX-License-Identifier: unknown", "Mozilla Public License, v. 3.0"]))
    assert set(got.values()) == {("", "none")}
    got = check(texts(spark, ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: GPL-2.0-or-later", "see SPDX-License-Identifier: MIT"]))
    assert [got[i][0] for i in range(3)] == ["MIT", "GPL-2.0-or-later", ""]


def wrapped(*parts, width=72, lead=""):
    return "\n".join(lead + line for part in parts for line in [*textwrap.wrap(part, width), ""])


def test_wrapped_and_numbered(spark):
    s = SENTENCES
    mit = ("MIT License", "Copyright (c) 2020 A B", f"{s[3]}:", f"{s[4]}.", f"{s[5]}. {s[7]}.")
    bsd = (f"Copyright (c) 2020, A B. {s[71]}.", f"{s[31]}:", f"1. {s[32]}.", f"2. {s[33]}.", f"3. {s[34]}.", f"{s[39]}.")
    apache = ("Copyright 2020 A", f"{s[12]}. {s[13]}", s[14], "Unless required by applicable law or agreed to in writing, software is distributed on an \"AS IS\" BASIS.")
    gpl = (f"{s[22]}.", f"{s[23]}.  {s[24]}.")
    rows = [wrapped(*mit), wrapped(*mit, width=50, lead="// "), wrapped(*bsd), wrapped(*bsd, lead=" * "), wrapped(*apache, lead="# "), wrapped(*gpl, lead="   "), wrapped(*gpl, lead="# ").replace("\n", "\r\n"),
            wrapped(f"{s[61]}. {s[65]}."), f"                    {s[86][:26]}\n                       Version 2, June 1991\n\n Copyright (C) 1989\n", wrapped(f"{s[111]}.", f"{s[23]}. {s[112]}.", lead="-- "),
            wrapped(f"{s[91]}.", f"{s[92]}. {s[93]}."), wrapped(f"{s[41]}.", "THE SOFTWARE IS PROVIDED \"AS IS\""), wrapped(f"{s[131]}.", f"{s[132]}."), f"Copyright (c) 2021 Z\n{textwrap.fill(s[3], 60)}:\n{textwrap.fill(s[4], 60)}.",
            wrapped(f"{s[8]}.", f"{s[5]}."), f"(a) {s[18]}:"]
    got = check(texts(spark, rows))
    assert [got[i][0] for i in range(len(rows))] == [
        "MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-or-later", "MPL-2.0", "GPL-2.0", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "ISC", "Unlicense", "MIT", "MIT-0", "Apache-2.0",
    ]


def test_every_rule_is_found(spark):
    rows = [" . ".join(SENTENCES[n] for n in rule.sentences) for rule in RULES]
    got = check(texts(spark, rows))
    assert [rule.licence for i, rule in enumerate(RULES) if rule.licence not in got[i][0].split(",")] == []


BSD = """Copyright (c) 2019, %s
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY %s "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NEITHER = """
3. Neither the name of %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
X11 = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE FOO
CONSORTIUM, Inc. BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_texts_with_names(spark):
    """Texts as they are found, with holders' names in them; none is built from the tables."""
    third = [NEITHER % name for name in ("the copyright holder", "Foo Inc.", "the University", "the University of Somewhere, Inc. (\"Some. U.\")", "A. B. Builder\n   & Sons Ltd.")]
    third += ["\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n", "\n* The names of its contributors may not be used to endorse or promote products\n  derived from this software without specific prior written permission.\n"]
    third.append("\n3. Neither the names of Foo GmbH, nor any of\n   their employees may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n")
    four = "\n3. All advertising materials mentioning features or use of this software must\n   display the following acknowledgement:\n   This product includes software developed by Foo Inc.\n" + NEITHER.replace("3.", "4.") % "Foo Inc."
    by = ["THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "Foo Inc. AND CONTRIBUTORS", "THE REGENTS", "A. B., C. D. ''AND OTHERS''", "X", "Y", "Z", "W"]
    rows = [BSD % ("Foo Inc.", x, y) for x, y in zip(third, by, strict=True)] + [BSD % ("Foo Inc.", "", "Foo Inc."), BSD % ("Foo", four, "Foo Inc."), X11, X11.replace("\n", "\n// ")]
    rows += ["# The ASF licenses this file to You under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file except in compliance with\n# the License.  You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"]
    rows += ["To the extent possible under law, Foo B. Baz has waived all copyright and related or neighboring rights to this work.", "Neither the name of the rose " + "x" * 400 + " may be used to endorse or promote products derived from this software without specific prior written permission."]
    got = check(texts(spark, rows))
    names = [",".join(n for n in got[i][0].split(",") if n != "proprietary") for i in range(len(rows))]
    assert names == ["BSD-3-Clause"] * 8 + ["BSD-2-Clause", "BSD-4-Clause", "MIT", "MIT", "Apache-2.0", "CC0-1.0", ""]


def test_the_sql_says_the_same(spark):
    import duckdb

    from quire.llm.licences import scan_sql

    rows = [BSD % ("Foo", NEITHER % "Foo Inc.", "Foo Inc."), X11, X11.replace("\n", "\r\n"), "MIT", "", None, BSD % ("A", "", "A")]
    docs = texts(spark, rows)
    with duckdb.connect() as db:
        documents = docs.toArrow()
        db.register("documents", documents)
        want = {tuple(r) for r in db.sql(scan_sql()).fetchall()}
    assert {tuple(r) for r in scan(docs).collect()} == want
