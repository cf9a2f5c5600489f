"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is read as a whole, by paragraphs, by lines, and by sentences of lines. Each such unit is normalised (lower case, runs of other
characters than a-z and 0-9 as one space), and its set of word bigrams is compared with each template's. With a
coefficient of at least ``least``, t, a unit's set of a bigrams and a template's of b obey
t / (2 - t) * b <= a <= (2 - t) / t * b; other pairs aren't compared. By the same bound a unit lacks at most
b - t / (2 - t) * b of the template's bigrams, so that words which more of them hold must occur in it: units
without any of these anchors are passed over, which loses none.

Edge cases: null or empty texts match nothing; of templates that match equally the first in the list is named;
rows that repeat are scanned each; a null doc_id is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and text of statements and notices, as projects use them.
TEMPLATES = [
    ("mit-statement", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("apache-2.0-statement", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-statement", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0-statement", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-statement", "This library is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0-statement", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-statement", "Distributed under the terms of the BSD 3-Clause License."),
    ("bsd-2-statement", "Distributed under the terms of the BSD 2-Clause License."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0-statement", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-statement", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-statement", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("apache-2.0-notice", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("cc-by-4.0-short", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-short", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0-short", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-4.0-short", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4.0-short", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-4.0-statement", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0-statement", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0-statement", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4.0-statement", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("epl-2.0-statement", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("epl-2.0-licensed", "Licensed under the Eclipse Public License, version 2.0."),
    ("artistic-2.0-statement", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("bsl-1.0-statement", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-permission", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("mit-permission-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-2.0-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_shared(size: int, least: float) -> int:
    """The fewest bigrams of a template of this size in a unit that matches it."""
    return math.ceil(round(least * size / (2 - least), 9))


#: Words of the templates that other texts have often too; they are anchors only where others don't do.
ORDINARY = """a all and any are as author by code copy extent file for form from http in is may mit not of on or public source subject terms that the this to
under use version with without work you""".split()


def anchors(sets: list[list[str]], least: float) -> list[str]:
    """Words of which any unit that matches a template has one: of each template the longest words, ordinary ones
    last, until fewer bigrams are without one than a match must share."""
    found: set[str] = set()
    for own in sets:
        words = sorted({w for b in own for w in b.split()}, key=lambda w: (w in ORDINARY or w.isdigit() or len(w) < 2, -len(w), w))
        for w in words:
            if sum(not found & {*b.split()} for b in own) < least_shared(len(own), least):
                break
            found.add(w)
    return sorted(found)


def license_matches(docs: DataFrame, least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license (best template or null), dice (rounded to 6 places, 0 without), n_units (that match)."""
    sets = [bigrams(normal_words(t)) for _, t in templates]
    words = anchors(sets, least)
    # what holds a longer anchor holds a shorter one within it
    words = [w for w in words if not any(o != w and o in w for o in words)]
    table = F.array(*(F.struct(F.lit(-k).alias("k"), F.lit(name).alias("name"), F.array(*map(F.lit, s)).alias("own")) for k, ((name, _), s) in enumerate(zip(templates, sets, strict=True))))
    shortest, longest = min(map(len, sets)), max(map(len, sets))
    low, high = least / (2 - least), (2 - least) / least

    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    units = F.concat(F.array("t"), F.split("t", "\n[ \\t\\r]*\n"), F.split("t", "\n"), F.split(F.regexp_replace("t", "([.!?])[ \\t]+", "$1\n"), "\n"))

    def anchored(c: Column) -> Column:
        found = c.contains(words[0])
        for w in words[1:]:
            found = found | c.contains(w)
        return found

    near = F.filter(F.array_distinct(units), anchored)
    # a unit has at least as many bigrams as it has words, each counted once, but for one
    normal = F.transform(near, lambda u: F.split(F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")), " "))
    split = F.filter(normal, lambda w: (F.size(w) - 1 >= low * shortest) & (F.size(F.array_distinct(w)) - 1 <= high * longest))
    pairs = F.transform(split, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))))
    fit = F.filter(pairs, lambda p: (F.size(p) >= low * shortest) & (F.size(p) <= high * longest))

    def best(p: Column) -> Column:
        some = F.filter(table, lambda t: (F.size(p) >= low * F.size(t["own"]) - 1e-9) & (F.size(p) <= high * F.size(t["own"]) + 1e-9))
        return F.array_max(F.transform(some, lambda t: F.struct(F.round(2 * F.size(F.array_intersect(p, t["own"])) / (F.size(p) + F.size(t["own"])), 6).alias("dice"), t["k"].alias("k"), t["name"].alias("name"))))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.when(anchored(F.col("t")), F.filter(F.transform(fit, best), lambda b: b["dice"] >= least)).alias("found"))
    top = F.array_max("found")
    return scored.select("doc_id", top["name"].alias("license"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), F.coalesce(F.when(F.col("found").isNotNull(), F.size("found")), F.lit(0)).cast("long").alias("n_units"))


def oracle(least: float = 0.8) -> str:
    """The same in SQL, without anchors or bounds."""
    values = ", ".join(f"({k}, '{name}', '{' '.join(normal_words(t))}')" for k, (name, t) in enumerate(TEMPLATES))  # normalised words hold no quotes
    return f"""
        WITH t AS (SELECT k, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own
                   FROM (SELECT k, name, string_split(body, ' ') AS w FROM (VALUES {values}) v(k, name, body))),
        d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
        u AS (SELECT DISTINCT doc_id, unnest(list_concat([t], string_split_regex(t, '\\n[ \\t\\r]*\\n'), string_split(t, '\\n'), string_split(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || '\\n', 'g'), '\\n'))) AS unit FROM d),
        w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(unit, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
        b AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
        s AS (SELECT doc_id, unit, k, name, round(2.0 * len(list_intersect(b.own, t.own)) / (len(b.own) + len(t.own)), 6) AS dice
              FROM b JOIN t ON len(b.own) <= 1.6 * len(t.own)),
        best AS (SELECT doc_id, unit, arg_max(name, dice * 1000 - k) AS name, max(dice) AS dice, min(k) AS k FROM
                 (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, k) AS r FROM s WHERE dice >= {least}) WHERE r = 1 GROUP BY doc_id, unit),
        f AS (SELECT doc_id, count(*) AS n_units, max(dice) AS dice FROM best GROUP BY doc_id),
        n AS (SELECT best.doc_id, arg_min(name, k) AS license FROM best JOIN f ON best.doc_id = f.doc_id AND best.dice = f.dice GROUP BY best.doc_id)
        SELECT documents.doc_id, n.license, coalesce(f.dice, 0.0) AS dice, CAST(coalesce(f.n_units, 0) AS BIGINT) AS n_units
        FROM documents LEFT JOIN f ON documents.doc_id = f.doc_id LEFT JOIN n ON documents.doc_id = n.doc_id
    """.replace("'\\n'", "chr(10)")
