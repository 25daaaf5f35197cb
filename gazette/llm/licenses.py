"""Operator 3: whole texts that are a known licence, found by a hash join of canonical digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

# The words of public licences, without their copyright lines.
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""

#: SPDX id -> texts under which the licence is known, with and without its title; one-line notices too.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _GRANT_MIT),
    ("MIT", "MIT License\n\n" + _GRANT_MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _GRANT_MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_NO_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_NO_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_NO_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _ISC_NO_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
]

#: Spellings that count as one.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("organisation", "organization"), ("recognise", "recognize"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"), ("web site", "website"), ("https", "http"),
]

#: A line that only says whose copyright it is, or that all rights are reserved.
COPYRIGHT = r"(^|\n)[^\pL\pN\n(©]*((?i:copyright)[ \t]*(©|\([cC]\)|[0-9<\[{:])|\([cC]\)[ \t]*[0-9<\[{]|©|(?i:all rights reserved)[.]?[ \t\r]*(\n|$))[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, equal spellings; words stand between double spaces."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), COPYRIGHT, "\n")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(t), r"[^\pL\pN]+", "  ")), F.lit(" "))
    for other, usual in SPELLINGS:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return t


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """license_id, digest of the given licences; a digest of two licences counts for the first by name."""
    rows = spark.createDataFrame(texts, "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Licences as whole text files, named by their ids, such as a folder of a distribution's common licences."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    return sorted((r["name"], r["value"]) for r in rows.collect())


#: Characters of the longest line that is held against one-line notices.
LINE = 300


def notices(text: Column, by_digest: dict[str, str]) -> Column:
    """The ids of the known texts that are a line of a text by their canonical form, sorted and joined by commas; '' if none is."""
    lines = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: (F.char_length(x) <= LINE) & (x != ""))
    found = F.array_intersect(F.transform(lines, lambda x: F.sha2(canonical(x), 256)), F.array(*map(F.lit, sorted(by_digest))))
    names = F.create_map(*(F.lit(x) for kv in sorted(by_digest.items()) for x in kv))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: names[d]))), ",")


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license_id (null: no licence), digest, notices for every row of docs: the licence that the whole text is, and those
    of which a line is a one-line notice.

    Null counts as empty; a text that is empty once normalised is no licence. Rows that repeat stay. The known licences
    are a list in code or of the caller's, so broadcasting them is bounded by it; an empty table gives no rows; columns besides
    doc_id and text are ignored, whatever their names. Texts of any length are digested whole; lines of over LINE characters
    are no notices, and neither are notices of several lines."""
    spark = docs.sparkSession
    texts = KNOWN if texts is None else texts
    short = known(spark, [(k, t) for k, t in texts if "\n" not in t.strip() and len(t) <= LINE]).collect()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"), (notices(F.col("text"), {r["digest"]: r["license_id"] for r in short}) if short else F.lit("")).alias("notices"))
    return own.join(F.broadcast(known(spark, texts)), "digest", "left").select("doc_id", "license_id", "digest", "notices")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    t = f"regexp_replace(coalesce({text}, ''), {_sql_text(COPYRIGHT)}, chr(10), 'g')"
    t = f"' ' || trim(regexp_replace(translate({t}, '{UPPER}', '{LOWER}'), '[^\\pL\\pN]+', '  ', 'g')) || ' '"
    for other, usual in SPELLINGS:
        t = f"replace({t}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return t


SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in KNOWN)}) AS v(license_id, text) GROUP BY 1),
short AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in KNOWN if "\n" not in t)}) AS v(license_id, text) GROUP BY 1),
own AS (SELECT row_number() OVER () AS n, doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents),
line AS (SELECT n, sha256({_sql_canonical("line")}) AS digest FROM (SELECT n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM own) WHERE length(line) BETWEEN 1 AND {LINE}),
found AS (SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM line JOIN short USING (digest) GROUP BY n)
SELECT doc_id, license_id, digest, coalesce(notices, '') AS notices FROM own LEFT JOIN known USING (digest) LEFT JOIN found USING (n)
"""
