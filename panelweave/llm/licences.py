"""License scans by canonical digest lookup.

Texts are brought to one form: small letters, copyright lines dropped, punctuation and white
space as single spaces, equivalent spellings as one. The digest of the whole form is joined to
the digests of known licences; so are the digests of single lines that speak of a licence, since
many documents end in a one-line notice. Everything is column expressions and one equi-join with
the catalogue, a list of fixed length.

Defined cases: NULL and empty texts match nothing; repeated rows are reported each; a text that
has a catalogue text as a part of a line, or wrapped over lines inside a longer text, is no match
(digests are of entire texts and entire lines); an empty table gives no rows; columns other than
id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import query, table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

# Public licence texts and one-line notices, by SPDX identifier. (Fixed values.)
CATALOGUE = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3 + _BSD_TAIL),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Spellings that count as one: (as written, as kept). (Fixed values.)
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("per cent", "percent"),
    ("https", "http"),
]

# A line with the year and owner of a copyright, and the line that often follows it.
COPYRIGHT_LINE = r"^[ \t*#/;-]*(?:(?:portions )?copyright[ \t]*(?:\(c\)|©)?[ \t]*[\[<{(]?(?:[0-9]{4}|year|yyyy)|(?:\(c\)|©)[ \t]*[0-9]{4}|all rights reserved\.?[ \t\r]*$)[^\n]*$"
SPEAKS_OF_LICENCE = r"(?i)licen[cs]e"


def normalised(text: Column) -> Column:
    """The canonical form; empty where nothing is left."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for written, kept in SPELLINGS:
        t = F.replace(t, F.lit(f" {written} "), F.lit(f" {kept} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def catalogue(spark: SparkSession, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """Distinct (license_id, digest) of the known texts."""
    known = spark.createDataFrame(entries or CATALOGUE, "license_id string, text string")
    return known.select("license_id", digest(F.col("text")).alias("digest")).distinct()


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, line, digest, license_id): line 0 is the whole text, others count from 1."""
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    whole = t.select("doc_id", F.lit(0).alias("line"), digest(F.col("text")).alias("digest"))
    lines = t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(SPEAKS_OF_LICENCE))
    single = lines.select("doc_id", (F.col("line") + 1).alias("line"), digest(F.col("text")).alias("digest"))
    return whole.unionByName(single).join(known, "digest").select("doc_id", "line", "digest", "license_id")


def _sql(text: str) -> str:
    t = f"regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', '', 'g')"
    t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for written, kept in SPELLINGS:
        t = f"replace({t}, ' {written} ', ' {kept} ')"
    return f"sha256(trim(regexp_replace({t}, ' +', ' ', 'g')))"


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in CATALOGUE)

OP1_SQL = f"""
WITH known AS (SELECT DISTINCT license_id, {_sql('text')} AS digest FROM (VALUES {_VALUES}) v(license_id, text)),
lines AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS l
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
found AS (SELECT doc_id, 0 AS line, {_sql('text')} AS digest FROM documents
  UNION ALL SELECT doc_id, line, {_sql('l')} FROM lines WHERE regexp_matches(l, '{SPEAKS_OF_LICENCE}'))
SELECT doc_id, CAST(line AS INTEGER) AS line, digest, license_id FROM found JOIN known USING (digest)
"""


@query("op1_license_scan", OP1_SQL)
def op1_license_scan(spark, d):
    return scan_licences(table(spark, d, "documents"), catalogue(spark))
