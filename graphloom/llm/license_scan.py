"""Licence scan by digests of canonical texts.

A text's canonical form has A-Z in lower case, lines with a copyright notice taken out, each run of punctuation and
white space as one blank, and equivalent spellings made one.  Canonical texts are hashed, and digests meet those of
known licence texts in an equi-join; the known table is a constant of this module, so its broadcast has a fixed size.

What is looked up is an entire text: the document, each of its paragraphs (between empty lines) and each of its lines.
So a notice on its own line is found as well as a licence that fills a file.  A unit longer than the longest known text, or
one that begins with a word that no known text begins with (words are of letters and digits, as in the canonical form),
cannot match and is not hashed; both are exact tests.

Null or empty text has an empty canonical form and no licence.  Rows that repeat an id, and rows with a null id, are
scanned each for itself; an empty table gives no rows.  Other columns are ignored and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, text_or_empty

#: Spellings that licence texts use for one another.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "merchantibility": "merchantability", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

#: Full texts of short public licences, without their copyright lines, and of the notices that the
#: Apache, GPL and MPL licences ask files to carry (those licences themselves are not here).
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: Names by which one-line notices call a licence, and the ways such a notice begins.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License", "ISC"], "0BSD": ["Zero-Clause BSD License", "0BSD"], "Zlib": ["zlib License", "Zlib"], "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"], "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    **{f"{short}-{v}.0": [f"GNU {long} Public License, version {v}", f"GNU {long} Public License v{v}", f"GNU {long} Public License v{v}.0", f"{short}-{v}.0", f"{short}v{v}"] for short, long, vs in (("GPL", "General", (2, 3)), ("LGPL", "Lesser General", (2, 3)), ("AGPL", "Affero General", (3,))) for v in vs},
    **{f"CC-{kind.replace(' ', '-') if kind != '0' else '0'}-{v}": [f"CC {kind} {v}", f"CC-{kind}-{v}"] for kind, v in [("0", "1.0"), *((k, v) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0"))]},
}
BEGINNINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This file is licensed under", "This document is licensed under"]

#: Patterns that Java and RE2 read alike.
COPYRIGHT = "(?m)^[^A-Za-z0-9\n]*(copyright|\\(c\\)|©)[^\n]*$"
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F\\x{A0}\\x{A9}\\x{AB}\\x{BB}\\x{2010}-\\x{2015}\\x{2018}-\\x{201F}\\x{2022}\\x{2026}]+"
VARIANTS = "\\b(" + "|".join(SPELLINGS) + ")\\b"


def spelled(plain: Column) -> Column:
    """Texts with a variant spelling have all of them replaced; other texts pass."""
    out = plain
    for k, v in SPELLINGS.items():
        out = F.regexp_replace(out, f"\\b{k}\\b", v)
    return F.when(plain.rlike(VARIANTS), out).otherwise(plain)


def without_notices(text: Column) -> Column:
    lower = ascii_lower(text)
    return F.when(lower.contains("copyright") | lower.contains("(c)") | lower.contains("©"), F.regexp_replace(lower, COPYRIGHT, "")).otherwise(lower)


def words_only(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, PUNCTUATION, " "))


def canonical(text: Column) -> Column:
    return spelled(words_only(without_notices(text_or_empty(text))))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of everything that is looked up, built from the fixed values above."""
    notices = [(i, f"{b} {the}{name}") for i, names in NAMES.items() for name in names for b in BEGINNINGS for the in ("", "the ")]
    tags = [(i, f"SPDX-License-Identifier: {x}") for i in NAMES for x in ([i, f"{i}-only"] if "GPL" in i else [i])]
    titled = [(i, f"{names[0]}\n\n{TEXTS[i]}") for i, names in NAMES.items() if i in TEXTS]
    return [*TEXTS.items(), *titled, *notices, *tags]


def known(spark: SparkSession) -> DataFrame:
    """(digest, license, words, first): one row for each canonical text; of licences that share one, the lowest name."""
    rows = spark.createDataFrame(known_texts(), "license string, text string").select("license", canonical(F.col("text")).alias("text"))
    return rows.groupBy("text").agg(F.min("license").alias("license")).select(F.sha2("text", 256).alias("digest"), "license", F.char_length("text").alias("size"), F.substring_index("text", " ", 1).alias("first"))


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n[\\x20\\x09\\x0D]*\n\\s*")


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, found): the digest of each whole text, and the known licences among its paragraphs and lines."""
    spark = docs.sparkSession
    table = known(spark).collect()  # a constant of this module: about 700 rows
    longest, firsts = max(r["size"] for r in table), sorted({r["first"] for r in table})
    firsts += sorted(k for k, v in SPELLINGS.items() if v in firsts)
    slack = 4 * longest  # punctuation and blanks of a unit that is longer than its canonical form
    lookup = F.broadcast(spark.createDataFrame([(r["digest"], r["license"]) for r in table], "digest string, license string"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text")).select("id", F.xxhash64("text").alias("hash"), without_notices(F.col("text")).alias("plain"))
    units = F.array_distinct(F.concat(F.split("plain", "\n"), F.filter(paragraphs(F.col("plain")), lambda p: p.contains("\n"))))
    parts = texts.select("id", "hash", F.filter(units, lambda u: u.rlike("^[^a-z0-9]*(" + "|".join(firsts) + ")(?![a-z0-9])")).alias("units")).where(F.size("units") > 0)
    hits = (
        parts.select("id", "hash", F.explode("units").alias("unit"))
        .select("id", "hash", words_only(F.col("unit")).alias("unit")).where(F.char_length("unit") <= slack)
        .select("id", "hash", F.sha2(spelled(F.col("unit")), 256).alias("digest")).join(lookup, "digest")
        .groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.countDistinct("digest").alias("n_matches"))
    )
    whole = texts.select("id", "hash", F.sha2(spelled(words_only(F.col("plain"))), 256).alias("canonical_sha256")).join(lookup.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    return whole.join(hits, whole["id"].eqNullSafe(F.col("__id")) & (whole["hash"] == F.col("__hash")), "left")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, canonical_sha256, license (of the entire text, or empty), licenses (found in it, joined by commas), n_matches."""
    out = scanned(docs, id_col, text_col)
    return out.select(
        F.col("id").alias(id_col), "canonical_sha256", F.coalesce("license", F.lit("")).alias("license"),
        F.coalesce("licenses", "license", F.lit("")).alias("licenses"), F.coalesce(F.col("n_matches"), F.col("license").isNotNull().cast("long")).alias("n_matches"),
    )


def oracle() -> str:
    """The same in DuckDB, with no test that skips units."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known_texts())

    def form(text: str) -> str:
        out = f"trim(regexp_replace(regexp_replace({lower(text)}, {quote(COPYRIGHT)}, '', 'g'), {quote(PUNCTUATION)}, ' ', 'g'))"
        for k, v in SPELLINGS.items():
            out = f"regexp_replace({out}, '\\b{k}\\b', '{v}', 'g')"
        return out

    def lower(text: str) -> str:
        return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    return f"""
WITH k AS (SELECT sha256({form("t")}) AS digest, min(i) AS license FROM (VALUES {values}) v(i, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, regexp_replace({lower("text")}, {quote(COPYRIGHT)}, '', 'g') AS text FROM d),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM p
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\\n[\\x20\\x09\\x0D]*\\n\\s*')) FROM p),
h AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT digest) AS n_matches
  FROM (SELECT doc_id, sha256({form("unit")}) AS digest FROM u) x JOIN k USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, sha256({form("text")}) AS canonical_sha256 FROM d)
SELECT w.doc_id, w.canonical_sha256, coalesce(k.license, '') AS license, coalesce(h.licenses, k.license, '') AS licenses,
  coalesce(h.n_matches, CASE WHEN k.license IS NULL THEN 0 ELSE 1 END) AS n_matches
FROM w LEFT JOIN k ON w.canonical_sha256 = k.digest LEFT JOIN h ON w.doc_id = h.doc_id
"""
