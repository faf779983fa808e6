"""Licence scans by canonical digest (operator 6).

A text is normalised (case, equivalent spellings, copyright lines, punctuation, white space) and hashed whole; the
digest is joined to the digests of known licence texts and notices, normalised the same way.  Lines are texts too: a
line that is one of the known notices is found by the same join.  Texts that normalise to nothing match nothing.

Texts are not shuffled: a line leaves its task only as a licence found, a text only as its digest.  The known table has
one row per licence text; beyond ``BROADCAST_ROWS`` rows Spark joins it by shuffling.

Defined results: a null text is empty, has the digest of the empty text and no licence; repeated rows come back as often;
notices of rows that share a doc_id are listed together; a null doc_id has no notices; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000

# Spellings taken for equal, the first written as the second.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("recognise", "recognize"), ("non-commercial", "noncommercial"), ("per cent", "percent"),
    ("whilst", "while"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfil ", "fulfill "), ("copyright owner", "copyright holder"),
    ("https://", "http://"), ("&", " and "),
]
# Lines that name an owner or a year, and the reservation that goes with them.
COPYRIGHT_LINE = (
    r"(^|\n)[^\p{L}\p{N}\n]*((copyright[ \t]*)+(\(c\)|©|[0-9]{4}|\[|<)|©|\(c\)[ \t]*[0-9]|all rights reserved)[^\n]*")
NOT_WORD = r"[^\p{L}\p{N}]+"

# Fixed texts of licences and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
# (licence, text): whole licences, and notices of one line.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


def canonical(text: Column) -> Column:
    """The normalised text, as a Spark expression."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def canonical_sql(text: str) -> str:
    """The same for DuckDB."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'))"


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id: one row per distinct normalised text; of several names the first."""
    rows = spark.createDataFrame(texts or KNOWN, "license_id string, text string")
    own = rows.select("license_id", canonical(F.col("text")).alias("canonical")).filter("canonical <> ''")
    return own.groupBy(F.sha2(F.col("canonical").cast("binary"), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text), notices (licences of lines, sorted, comma-joined, or empty)."""
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    table = F.broadcast(known) if few else known
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select("doc_id", F.sha2(canonical(text).cast("binary"), 256).alias("text_digest"))
    named = whole.join(table.select(F.col("digest").alias("text_digest"), "license_id"), "text_digest", "left")
    lines = docs.select("doc_id", F.explode(F.split(text, "\n")).alias("line")).filter("doc_id IS NOT NULL AND line <> ''")
    found = lines.select("doc_id", F.sha2(canonical(F.col("line")).cast("binary"), 256).alias("digest")).join(table, "digest")
    # Distinct before they are gathered: a document has at most as many notices as there are licences.
    notices = found.select("doc_id", "license_id").distinct().groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("license_id")), ",").alias("notices"))
    return named.join(notices, "doc_id", "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def plain(text: str) -> str:
    """The normalised text in Python, for tests."""
    import regex

    out = regex.sub(COPYRIGHT_LINE, "\n", text.lower())
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return regex.sub(NOT_WORD, " ", out).strip(" ")


def oracle() -> str:
    """DuckDB SQL for ``scan`` over the table ``documents`` with the built-in licences."""
    values = ", ".join(f"('{name}', '{hashlib.sha256(plain(text).encode()).hexdigest()}')" for name, text in KNOWN)
    line = canonical_sql("line")
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (VALUES {values}) v(license_id, digest) GROUP BY digest),
whole AS (SELECT doc_id, sha256({canonical_sql("text")}) AS text_digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
notices AS (
  SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT DISTINCT doc_id, license_id FROM (SELECT doc_id, sha256({line}) AS digest FROM lines WHERE line <> '') JOIN known USING (digest))
  GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN notices n ON n.doc_id = w.doc_id"""
