"""Licence notices in texts, by the Dice coefficient of word bigrams with notice templates.

The units compared are the lines of a text, its blocks between blank lines, and the whole text. Letters are put in
lower case and everything but ASCII letters, digits and line ends becomes a space. Two bounds, both exact, leave few
comparisons: a coefficient of ``LEAST`` bounds how far the numbers of bigrams can differ, and it means that
so many of a template's bigrams are shared that at least one of a short template's key bigrams, or of a long one's key words,
is. Only built-in SQL functions are used.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.geometry import let
from linkspark.llm.license_texts import WHOLE

#: Least Dice coefficient of a match.
LEAST = 0.8

# Notices as licences word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "Copyright. All rights reserved."),
]
#: Headers of GNU licences: licence, its long name, the work, the version.
GNU = [
    ("GPL-3.0", "General Public License", "program", "3"),
    ("GPL-2.0", "General Public License", "program", "2"),
    ("AGPL-3.0", "Affero General Public License", "program", "3"),
    ("LGPL-3.0", "Lesser General Public License", "library", "3"),
    ("LGPL-2.1", "Lesser General Public License", "library", "2.1"),
]
HEADER = (
    "This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {long} as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
NO_WARRANTY = (
    " This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {long} for more details. You should have received a copy of "
    "the GNU {long} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
)
TEMPLATES += [(name, t.format(work=w, long=g, version=v)) for name, g, w, v in GNU for t in (HEADER, HEADER + NO_WARRANTY)]
APACHE_TERMS = (
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
    'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
    "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
TEMPLATES += [("Apache-2.0", TEMPLATES[1][1] + APACHE_TERMS)]
#: Identifiers of the SPDX list besides those above; a GNU version has three.
SPDX = (
    "0BSD AFL-3.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 "
    "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 ISC MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL "
    "Python-2.0 Unlicense WTFPL Zlib"
).split()
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
TEMPLATES += [
    (name, f"SPDX-License-Identifier: {name}{end}")
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
    for end in ("", "-only", "-or-later")
    if (name, end) != ("GPL-3.0", "-or-later")
]
TEMPLATES += WHOLE
#: Bigrams from which a template is long: its key words are looked for in long units only.
LONG = 90
#: Words too common in prose to be a key word while a template has others.
COMMON = set("a all and any are as be by can for found has in is it may not of or that the this to use with you if on an no but so other your under from such which have its at who what when we s will make these each those either must used any than there do does only".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def key_words(bigrams: set[str]) -> list[str]:
    """Fewest words so that every text that reaches ``LEAST`` has one of them.

    With a template bigrams and b text bigrams, ``2c >= LEAST (a + b)`` and ``c <= b`` give
    ``c >= a LEAST / (2 - LEAST)``; so the text has one of any bigrams that are more than the rest of the template's.
    """
    spare = len(bigrams) * (1 - LEAST / (2 - LEAST))
    left, out = set(bigrams), []
    while len(bigrams) - len(left) <= spare + 1e-9:
        count = Counter(w for b in left for w in set(b.split()))
        out.append(max(count, key=lambda w: (w not in COMMON, count[w], w)))
        left = {b for b in left if out[-1] not in b.split()}
    return out


def key_pairs(bigrams: set[str]) -> list[str]:
    """The same with whole bigrams: any that are more than a text may lack, those of the least common looking words."""
    spare = len(bigrams) * (1 - LEAST / (2 - LEAST))
    plainness = lambda b: (sum(w in COMMON or len(w) < 3 for w in b.split()), -len(b), b)
    return sorted(bigrams, key=plainness)[: int(spare + 1e-9) + 1]


def any_of(keys: set[str]) -> str:
    """Pattern of the keys as whole words, branching letter by letter: a regular expression tries its alternatives in turn."""

    def branch(some: list[str]) -> str:
        by_letter: dict[str, list[str]] = {}
        for k in some:
            by_letter.setdefault(k[:1], []).append(k[1:])
        ends = by_letter.pop("", None) is not None
        parts = [letter + branch(rest) for letter, rest in sorted(by_letter.items())]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + "?" if ends else body

    return rf"\b{branch(sorted(keys))}\b"


def bounds(n: int) -> tuple[int, int]:
    """Least and most bigrams of a text that can match a template of ``n``."""
    low = next(k for k in range(1, n + 1) if 2 * min(k, n) >= LEAST * (k + n) - 1e-9)
    high = next(k for k in range(4 * n, 0, -1) if 2 * min(k, n) >= LEAST * (k + n) - 1e-9)
    return low, high


def matches(text: Column, templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    """Array of ``(score, license)``, the best template of every unit that matches one; a null text has none."""
    sets = [(name, sorted(bigrams_of(words_of(t)))) for name, t in templates]
    key_of = lambda some, keys: any_of({w for b in some for w in keys(set(b))})
    long = [b for _, b in sets if len(b) >= LONG]
    # a unit with so many bigrams has more words than that, each of a character and a space at least
    room = 2 * min((bounds(len(b))[0] for b in long), default=0)
    has_key = lambda u: u.rlike(key_of([b for _, b in sets if len(b) < LONG], key_pairs))
    has_long = lambda u: (F.length(u) > room) & u.rlike(key_of(long, key_words)) if long else F.lit(False)
    longest = max(bounds(len(b))[1] for _, b in sets)
    shortest = min(bounds(len(b))[0] for _, b in sets)
    # only ASCII is left when letters are put in lower case, so no other letter becomes one of them
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9\n]+", " "))
    joined = lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))
    # a lambda evaluates its argument once; written out three times, the text would be changed for each
    units = let(plain, lambda p: F.concat(F.split(p, "\n"), F.split(p, r"\n *\n"), F.array(p)))
    units = F.array_distinct(F.transform(units, joined))
    # what a unit can match by its key words: bigrams of a short template, of a long one, or none
    most = max((bounds(len(b))[1] for _, b in sets if len(b) < LONG), default=0)
    limit = lambda u: F.when(has_long(u), longest).when(has_key(u), most).otherwise(0)
    units = F.filter(F.transform(units, lambda u: F.struct(F.split(u, " +").alias("words"), limit(u).alias("most"))), lambda u: u["most"] > 0)
    # a word may repeat, so the number of words bounds the number of bigrams from above only, that of different words from below
    units = F.filter(units, lambda u: (F.size(u["words"]) > shortest) & (F.size(F.array_distinct(u["words"])) <= u["most"] + 1))
    word_lists = F.transform(units, lambda u: u["words"])
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    bigrams = F.filter(F.transform(word_lists, pairs), lambda b: F.size(b).between(shortest, longest))
    known = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.split(F.lit("\n".join(b)), "\n").alias("bigrams"),
            F.lit(bounds(len(b))[0]).alias("low"), F.lit(bounds(len(b))[1]).alias("high"),
        )
        for name, b in sets
    ])

    def best(b):
        fitting = F.filter(known, lambda t: F.size(b).between(t["low"], t["high"]))
        scored = F.transform(
            fitting,
            lambda t: F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + F.size(t["bigrams"]))).alias("score"),
                t["license"].alias("license"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["score"] >= LEAST))

    return F.filter(F.transform(bigrams, best), lambda s: s.isNotNull())


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the number of different units that match, all licences, the best one and its score.

    Null and empty texts match nothing: 0, an empty text, null and null. Of equal scores the last name wins.
    Repeated rows give repeated rows.
    """
    found = docs.select(*keep, matches(F.col(text)).alias("_found"))
    top = F.array_max("_found")
    return found.select(
        *keep,
        F.size("_found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("_found.license"))), ",").alias("licenses"),
        top["license"].alias("license"),
        top["score"].alias("score"),
    )


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL, without the bounds."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in sorted(bigrams_of(words_of(t))))) for n, t in TEMPLATES)
    return f"""
    WITH template(license, bigrams) AS (VALUES {rows}),
    plain AS (
      SELECT doc_id, row_number() OVER () AS r,
             regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS n
      FROM {table}),
    unit AS (
      SELECT DISTINCT r, trim(replace(u, chr(10), ' ')) AS u
      FROM (SELECT r, unnest(list_concat(string_split(n, chr(10)), string_split_regex(n, '\\n *\\n'), [n])) AS u FROM plain)),
    listed AS (SELECT r, u, string_split_regex(u, ' +') AS w FROM unit),
    paired AS (
      SELECT DISTINCT r, u, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM listed WHERE len(w) > 1),
    scored AS (
      SELECT r, u, license, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS score
      FROM paired, template WHERE len(list_intersect(b, bigrams)) > 0),
    best AS (
      SELECT r, u, score, license FROM scored WHERE score >= {LEAST}
      QUALIFY row_number() OVER (PARTITION BY r, u ORDER BY score DESC, license DESC) = 1),
    top AS (
      SELECT r, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
             first(license ORDER BY score DESC, license DESC) AS license, max(score) AS score
      FROM best GROUP BY r)
    SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, license, score
    FROM plain LEFT JOIN top USING (r)"""
