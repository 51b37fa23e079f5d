r"""Licence recognition by sentence rules.

A text's lines lose comment signs and list numbers at their beginnings. It is then cut into sentences after . ! ? or :
before white space, at empty lines and after a copyright line; a line end within a sentence is a space. A sentence is
normalised: ASCII letters lower-cased, all but letters and digits made one space. The table of known sentences maps it to
an identifier; a sentence that it lacks is tried line by line, so that a licence line needs no stop, and what is unknown is 0.
A known text that itself falls into several sentences gives each of them an identifier. The text's identifiers, in order,
are matched against ordered rules, each a run of neighbouring identifiers and the licence that it means: the longer
rules come first, and what one rule has matched is no longer there for the next, so a licence that contains
another's sentences isn't reported as both.

Some sentences have places for names, of holders or of who disclaims. Before a text is cut, each such place, of at most GAP characters, gets the
words that the table has there, so that neither a name nor a stop in it (`Inc.`) matters: a licence with a clause about someone's name isn't taken for the one without.

The tables are fixed and small; they are literals of the plan. Nothing is shuffled.

Edge cases: a null or empty text has no sentences and no licence. A text of one very long sentence is one unknown
sentence. Null and repeated identifiers pass as they are; an empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of their notices, by identifier.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    6: "SPDX-License-Identifier: MIT",
    7: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    8: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    9: "This project is licensed under the MIT License",
    10: "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    11: "Licensed under the Apache License, Version 2.0",
    12: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    13: "You may obtain a copy of the License at",
    14: "http://www.apache.org/licenses/LICENSE-2.0",
    15: "SPDX-License-Identifier: Apache-2.0",
    16: "Apache License Version 2.0, January 2004",
    17: "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    18: "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions",
    19: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    20: "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    21: "This work is licensed under the GNU General Public License, version 3",
    22: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    23: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    24: "See the GNU General Public License for more details",
    25: "SPDX-License-Identifier: GPL-3.0-only",
    26: "SPDX-License-Identifier: GPL-3.0-or-later",
    27: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    28: "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    29: "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program",
    31: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    32: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    33: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    34: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    35: "SPDX-License-Identifier: BSD-2-Clause",
    36: "SPDX-License-Identifier: BSD-3-Clause",
    37: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    39: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    41: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    42: "SPDX-License-Identifier: ISC",
    43: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    44: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    45: "SPDX-License-Identifier: 0BSD",
    51: "Licensed under CC BY-NC 4.0",
    52: "Licensed under CC BY 4.0",
    53: "Licensed under CC BY-SA 4.0",
    54: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    55: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    56: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    57: "SPDX-License-Identifier: CC-BY-4.0",
    58: "SPDX-License-Identifier: CC-BY-SA-4.0",
    59: "SPDX-License-Identifier: CC-BY-NC-4.0",
    61: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    62: "If a copy of the MPL was not distributed with this file, You can obtain one at",
    63: "SPDX-License-Identifier: MPL-2.0",
    64: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    65: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    66: "Mozilla Public License Version 2.0",
    67: "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license",
    71: "All rights reserved",
    81: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    82: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    83: "This work is licensed under the GNU General Public License, version 2",
    84: "SPDX-License-Identifier: GPL-2.0-only",
    85: "SPDX-License-Identifier: GPL-2.0-or-later",
    86: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    87: "The licenses for most software are designed to take away your freedom to share and change it",
    88: "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the Program a copy of this License along with the Program",
    91: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    92: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    93: "See the GNU Lesser General Public License for more details",
    94: "SPDX-License-Identifier: LGPL-2.1-only",
    95: "SPDX-License-Identifier: LGPL-2.1-or-later",
    96: "SPDX-License-Identifier: LGPL-3.0-only",
    97: "SPDX-License-Identifier: LGPL-3.0-or-later",
    98: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    99: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    100: "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    101: "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    111: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    112: "See the GNU Affero General Public License for more details",
    113: "SPDX-License-Identifier: AGPL-3.0-only",
    114: "SPDX-License-Identifier: AGPL-3.0-or-later",
    115: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    116: "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    121: "CC0 1.0 Universal",
    122: "SPDX-License-Identifier: CC0-1.0",
    123: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    124: "To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action",
    131: "This is free and unencumbered software released into the public domain",
    132: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    133: "SPDX-License-Identifier: Unlicense",
    141: "Boost Software License - Version 1.0 - August 17th, 2003",
    142: "Distributed under the Boost Software License, Version 1.0",
    143: "SPDX-License-Identifier: BSL-1.0",
}


class Rule(NamedTuple):
    licence: str
    kind: str
    sentences: tuple[int, ...]


def rules_of(kind: str, **licences: list) -> list[Rule]:
    return [Rule(name.replace("__", ".").replace("_", "-"), kind, run if isinstance(run, tuple) else (run,)) for name, runs in licences.items() for run in runs]


#: The rules, in the order in which they are tried among rules of equally many sentences. A name's _ is -, its __ is a point.
RULES = [
    *rules_of("permissive", MIT=[(3, 4, 5, 7), (3, 4, 5), (3, 4), 1, 2, 6, 9], MIT_0=[(8, 5, 7), (8, 5)], Apache_2__0=[(12, 13, 14), (12, 19), (12, 20), (10, 13, 14), 12, 10, 11, 15, 16, 17, 18]),
    *rules_of("permissive", BSD_4_Clause=[(71, 31, 32, 33, 37), (31, 32, 33, 37)], BSD_3_Clause=[(71, 31, 32, 33, 34), (31, 32, 33, 34), 36], BSD_2_Clause=[(71, 31, 32, 33), (31, 32, 33), 35], ISC=[(41, 5), 41, 43, 42], **{"0BSD": [(44, 5), 44, 45]}),
    *rules_of("permissive", CC_BY_4__0=[52, 54, 57], CC0_1__0=[121, 122, 123, 124], Unlicense=[(131, 132), 131, 133], BSL_1__0=[141, 142, 143]),
    *rules_of("copyleft", GPL_3__0_or_later=[(22, 23, 24), 22, 26], GPL_3__0_only=[21, 25], GPL_3__0=[(27, 28), 27, 28, 29], GPL_2__0_or_later=[(81, 23, 24), 81, 85], GPL_2__0_only=[82, 83, 84], GPL_2__0=[86, 88]),
    *rules_of("copyleft", LGPL_2__1_or_later=[(91, 92, 93), 91, 95], LGPL_2__1_only=[94], LGPL_2__1=[98], LGPL_3__0_or_later=[(101, 92, 93), 101, 97], LGPL_3__0_only=[96], LGPL_3__0=[99, 100]),
    *rules_of("copyleft", AGPL_3__0_or_later=[(111, 23, 112), 111, 114], AGPL_3__0_only=[113], AGPL_3__0=[115, 116], CC_BY_SA_4__0=[53, 56, 58], MPL_2__0=[(61, 62), (61, 64), (61, 65), 61, 63, 66]),
    *rules_of("restricted", CC_BY_NC_4__0=[51, 55, 59], proprietary=[71]),
]

#: Characters of a name.
GAP = 300
#: Sentences with a place for a name: what stands before it and after it, and the words that the table has in between. A blank is any white space.
SLOTS = [
    ("neither the (?:names?|trademarks?) (?:of )?", "may be used to endorse or promote products derived from this (?:software|material|program)", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("the names? of ", "may not be used to endorse or promote products derived from this (?:software|material|program)", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("in no event shall ", "be liable for any claim, damages or other liability", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("this software is provided by ", "and any express", 'this software is provided by the copyright holders and contributors "as is" and any express'),
    ("to the extent possible under law, ", "has waived all copyright", "to the extent possible under law, the author has waived all copyright"),
]

#: What a line loses at its beginning: a comment sign and a list number. Lines end at \n; the flags of Java's patterns say so.
LEADERS = r"(?md)^[ \t]*(?:(?://+|#+|/?\*+/?|;+|--+|%+|<!--)[ \t]*)?(?:\(?(?:[0-9]{1,3}|[a-z]|[ivx]{2,4})[.)][ \t]+)?"
COPYRIGHT = r"(?md)^(copyright[ \t][^\n]*)\n"
#: Ends of sentences.
ENDS = r"[.!?:][ \t]*\n|[.!?:][ \t]+|\n[ \t]*\n"
KINDS = ("restricted", "copyleft", "permissive")


def slot_pattern(before: str, after: str) -> str:
    return f"{before}.{{1,{GAP}}}?{after}".replace(" ", r"[ \t\n]+")


def sentences_of(text: str) -> list[str]:
    """The normalised sentences of a table's text: the same cuts as a document's, with Python's patterns."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = re.split(ENDS, re.sub(LEADERS.replace("(?md)", "(?m)"), "", lowered))
    return [p for p in (re.sub(r"[^a-z0-9]+", " ", x).strip(" ") for x in parts) if p]


def known(sentences: Mapping[int, str]) -> tuple[dict[str, int], dict[int, list[int]]]:
    """(identifier of each distinct known sentence, in the order of the table; those that each of the table's texts consists of)"""
    found: dict[str, int] = {}
    runs = {n: [found.setdefault(p, len(found) + 1) for p in sentences_of(text)] for n, text in sentences.items()}
    return found, runs


def patterns(sentences: Mapping[int, str], rules: Sequence[Rule]) -> list[tuple[Rule, str]]:
    """The rules and their runs of identifiers, written as in `sequence`; the longest first."""
    runs = known(sentences)[1]
    whole = [(rule, [n for s in rule.sentences for n in runs[s]]) for rule in rules]
    return [(rule, "".join(f",{n};" for n in run)) for rule, run in sorted(whole, key=lambda x: -len(x[1]))]


def sequence(text: Column, sentences: Mapping[int, str]) -> tuple[Column, Column]:
    """(number of sentences, their identifiers as ,1;,0;... with one 0 for unknown ones beside one another)."""
    names = known(sentences)[0]
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.regexp_replace(lowered, LEADERS, ""), COPYRIGHT, "$1\n\n")
    for before, after, words in SLOTS:  # a chain: a condition on the text so far would have it made again at each step
        plain = F.regexp_replace(plain, "(?s)" + slot_pattern(before, after), words)
    clean = lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " "))
    table = F.create_map(*[F.lit(x) for name, n in names.items() for x in (name, f",{n};")])
    of = lambda p: F.try_element_at(table, clean(p))
    parts = F.filter(F.split(plain, ENDS), lambda p: F.regexp_like(p, F.lit("[a-z0-9]")))
    by_line = lambda p: F.array_join(F.transform(F.filter(F.split(p, "\n"), lambda x: F.regexp_like(x, F.lit("[a-z0-9]"))), lambda x: F.coalesce(of(x), F.lit(",0;"))), "")
    ids = F.array_join(F.transform(parts, lambda p: F.coalesce(of(p), F.when(F.contains(p, F.lit("\n")), by_line(p)), F.lit(",0;"))), "")
    return F.size(parts).cast("long"), F.regexp_replace(ids, "(,0;)+", ",0;")


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", sentences: Mapping[int, str] = SENTENCES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row: (id, n_sentences, sentence_ids, licences, licence_kind).

    sentence_ids: identifiers of `known` in order, 0 for a run of unknown sentences. licences: names in order of the alphabet, comma-joined;
    empty for none. licence_kind: the strictest kind among them, or none.
    """
    count, ids = sequence(F.col(text), sentences)
    step = docs.select(F.col(id).alias("id"), count.alias("n_sentences"), ids.alias("ids"))
    tried = F.array(*[F.struct(F.lit(p).alias("run"), F.lit(r.licence).alias("licence"), F.lit(r.kind).alias("kind")) for r, p in patterns(sentences, rules)])
    nothing = F.array().cast("array<struct<run: string, licence: string, kind: string>>")
    start = F.struct(F.col("ids").alias("left"), nothing.alias("found"))
    matched = F.aggregate(tried, start, lambda acc, rule: F.when(F.contains(acc["left"], rule["run"]), F.struct(
        F.replace(acc["left"], rule["run"], F.lit(",0;")).alias("left"), F.concat(acc["found"], F.array(rule)).alias("found"))).otherwise(acc), lambda acc: acc["found"])
    step = step.withColumn("found", F.when(F.replace("ids", F.lit(",0;"), F.lit("")) == "", nothing).otherwise(matched))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda r: r["licence"]))), ",")
    kinds = F.transform("found", lambda r: r["kind"])
    kind = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in KINDS], F.lit("none"))
    shown = F.regexp_replace(F.regexp_replace(F.col("ids"), "^,|;$", ""), ";,", " ")
    return step.select(F.col("id").alias(id), "n_sentences", shown.alias("sentence_ids"), names.alias("licences"), kind.alias("licence_kind"))


def scan_sql(sentences: Mapping[int, str] = SENTENCES, rules: Sequence[Rule] = RULES) -> str:
    """The same as DuckDB SQL over documents, from the two tables alone: the SQL cuts and numbers the known sentences itself."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({n}, {quoted(t)})" for n, t in sentences.items())
    w = "[ \\t\\n]+"
    listed = ", ".join(f"({i}, {quoted(r.licence)}, {quoted(r.kind)}, {list(r.sentences)})" for i, r in enumerate(rules))
    return f"""
WITH RECURSIVE table_texts(number, body) AS (VALUES {texts}), table_rules(place, licence, kind, numbers) AS (VALUES {listed}),
bodies AS (
  SELECT 1 AS is_table, number::BIGINT AS id, 0::BIGINT AS nth, body FROM table_texts
  UNION ALL SELECT 0, doc_id, row_number() OVER (), coalesce(text, '') FROM documents
), bare AS (
  SELECT is_table, id, nth, regexp_replace(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz'),
    '(?m)^[ \\t]*(?:(?://+|#+|/?\\*+/?|;+|--+|%+|<!--)[ \\t]*)?(?:\\(?(?:[0-9]{{1,3}}|[a-z]|[ivx]{{2,4}})[.)][ \\t]+)?', '', 'g'), '(?m)^(copyright[ \\t][^\\n]*)\\n', E'\\\\1\\n\\n', 'g') AS body FROM bodies
), endorsed AS (
  SELECT is_table, id, nth, regexp_replace(body, '(?s)(neither{w}the{w}(name|trademark)s?{w}(of{w})?.{{1,{GAP}}}?may|the{w}names?{w}of{w}.{{1,{GAP}}}?may{w}not){w}be{w}used{w}to{w}endorse{w}or{w}promote{w}products{w}derived{w}from{w}this{w}(software|material|program)',
    'neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software', 'g') AS body FROM bare
), disclaimed AS (
  SELECT is_table, id, nth, regexp_replace(regexp_replace(regexp_replace(body, '(?s)in{w}no{w}event{w}shall{w}.{{1,{GAP}}}?be{w}liable{w}for{w}any{w}claim,{w}damages{w}or{w}other{w}liability', 'in no event shall the authors or copyright holders be liable for any claim damages or other liability', 'g'),
    '(?s)this{w}software{w}is{w}provided{w}by{w}.{{1,{GAP}}}?and{w}any{w}express', 'this software is provided by the copyright holders and contributors as is and any express', 'g'),
    '(?s)to{w}the{w}extent{w}possible{w}under{w}law,{w}.{{1,{GAP}}}?has{w}waived{w}all{w}copyright', 'to the extent possible under law the author has waived all copyright', 'g') AS body FROM endorsed
), pieces AS (
  SELECT is_table, id, nth, list_filter(regexp_split_to_array(body, '[.!?:][ \\t]*\\n|[.!?:][ \\t]+|\\n[ \\t]*\\n'), lambda p: regexp_matches(p, '[a-z0-9]')) AS pieces FROM disclaimed
), placed AS (
  SELECT is_table, id, nth, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS spot FROM pieces
), cleaned AS (
  SELECT *, trim(regexp_replace(piece, '[^a-z0-9]+', ' ', 'g')) AS clean FROM placed
), names AS (
  SELECT clean AS name, row_number() OVER (ORDER BY min(id * 1000 + spot)) AS number FROM cleaned WHERE is_table = 1 GROUP BY clean
), runs AS (
  SELECT c.id AS text_number, string_agg(',' || n.number || ';', '' ORDER BY spot) AS run, count(*) AS length FROM cleaned c JOIN names n ON c.clean = n.name WHERE is_table = 1 GROUP BY c.id
), rules AS (
  SELECT place, licence, kind, string_agg(run, '' ORDER BY i) AS run, row_number() OVER (ORDER BY sum(length) DESC, place) AS step
  FROM (SELECT *, unnest(numbers) AS text_number, unnest(range(len(numbers))) AS i FROM table_rules) JOIN runs USING (text_number) GROUP BY place, licence, kind
), lines AS (
  SELECT nth, spot, i, trim(regexp_replace(line, '[^a-z0-9]+', ' ', 'g')) AS clean
  FROM (SELECT nth, spot, unnest(string_split(piece, chr(10))) AS line, unnest(range(len(string_split(piece, chr(10))))) AS i FROM cleaned WHERE is_table = 0 AND contains(piece, chr(10)))
  WHERE regexp_matches(line, '[a-z0-9]')
), by_line AS (
  SELECT nth, spot, string_agg(',' || coalesce(number, 0) || ';', '' ORDER BY i) AS ids FROM lines LEFT JOIN names ON clean = name GROUP BY nth, spot
), told AS (
  SELECT c.nth, count(*) AS n_sentences, regexp_replace(string_agg(coalesce(',' || number || ';', l.ids, ',0;'), '' ORDER BY c.spot), '(,0;)+', ',0;', 'g') AS ids
  FROM cleaned c LEFT JOIN names ON c.clean = name LEFT JOIN by_line l ON c.nth = l.nth AND c.spot = l.spot WHERE is_table = 0 GROUP BY c.nth
), tried AS (
  SELECT nth, ids AS rest, 0::BIGINT AS step, ''::VARCHAR AS hit, ''::VARCHAR AS kind FROM told WHERE replace(ids, ',0;', '') <> ''
  UNION ALL SELECT nth, replace(rest, run, ',0;'), r.step, CASE WHEN contains(rest, run) THEN r.licence ELSE '' END, CASE WHEN contains(rest, run) THEN r.kind ELSE '' END
  FROM tried t JOIN rules r ON r.step = t.step + 1
), hits AS (
  SELECT nth, string_agg(DISTINCT hit, ',' ORDER BY hit) AS licences, min(CASE kind WHEN 'restricted' THEN 1 WHEN 'copyleft' THEN 2 ELSE 3 END) AS strict FROM tried WHERE hit <> '' GROUP BY nth
)
SELECT id AS doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(regexp_replace(regexp_replace(ids, '^,|;$', '', 'g'), ';,', ' ', 'g'), '') AS sentence_ids,
  coalesce(licences, '') AS licences, coalesce(['restricted', 'copyleft', 'permissive'][strict], 'none') AS licence_kind
FROM bodies LEFT JOIN told USING (nth) LEFT JOIN hits USING (nth) WHERE is_table = 0
"""
