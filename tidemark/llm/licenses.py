"""License scans: canonical digest lookup [native].

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings), and the digest of the whole form is hash-joined with
the digests of known licence texts. The same is done with every run of lines
that begins with the first line of a known text and is as long as it, so that a
one-line notice and an entire licence inside a longer document are found too.
Texts are canonicalised once; what is kept of them are digests.

``KNOWN`` are the entire texts below ``license_texts`` (the file's name is the
licence) and the notices in this module: Apache-2.0, MIT, ISC, BSD-2-Clause,
BSD-3-Clause, 0BSD, Zlib, Unlicense, CC0-1.0, MPL-2.0, GPL-2.0, GPL-3.0,
LGPL-2.1, LGPL-3.0, Artistic-1.0-Perl, and for CC-BY-NC-4.0 its notices. Another
list may be given, of at most ``MOST_KNOWN`` texts, as its digests are a table
on the driver. A licence whose lines are broken elsewhere is known by its whole
text (a document of its own), not inside another one.

Edge cases: a null or blank text has the digest of the empty form and no
licence; repeated rows get the same answer each; equal notices in one document
are listed once; an empty table gives an empty result, an empty list of licences
finds none; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, text_of

MOST_KNOWN = 10_000
#: Equivalent spellings of the licence matching guidelines, variant to common form.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "licence": "license",
    "licenced": "licensed",
    "organisation": "organization",
    "noncommercial": "non  commercial",
    "sublicence": "sublicense",
    "whilst": "while",
}
#: The terms of each licence: permissive, copyleft or restricted.
TERMS = {
    "0BSD": "permissive",
    "Apache-2.0": "permissive",
    "Artistic-1.0-Perl": "copyleft",
    "BSD-2-Clause": "permissive",
    "BSD-3-Clause": "permissive",
    "CC-BY-NC-4.0": "restricted",
    "CC0-1.0": "permissive",
    "GPL-2.0": "copyleft",
    "GPL-3.0": "copyleft",
    "ISC": "permissive",
    "LGPL-2.1": "copyleft",
    "LGPL-3.0": "copyleft",
    "MIT": "permissive",
    "MPL-2.0": "copyleft",
    "Unlicense": "permissive",
    "Zlib": "permissive",
}
#: Notices by which a file or document names its licence.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
]
WHOLE = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
#: The known texts as (licence, terms, text).
KNOWN: list[tuple[str, str, str]] = [(i, TERMS[i], t) for i, t in [*NOTICES, *WHOLE]]
#: A line that starts like this is a copyright line.
COPYRIGHT = r"(^|\n)[\x20\x09]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: White space and punctuation, all but the line feed.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’–—…«»]+"


def canonical_lines(text: Column) -> Column:
    """The lines of a text that are left in canonical form, words two spaces apart."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    out = F.regexp_replace(out, MARKS, "  ")
    out = F.concat(F.lit("  "), F.replace(out, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for variant, common in EQUIVALENT.items():
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {common} "))
    return F.filter(F.transform(F.split(out, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def known(spark: SparkSession, licenses: list[tuple[str, str, str]] = KNOWN) -> DataFrame:
    """digest, license, terms, hash of the first line and number of lines of the known texts, by the rule of the documents; one row a digest."""
    if len(licenses) > MOST_KNOWN:
        raise ValueError(f"{len(licenses)} known texts, at most {MOST_KNOWN}")
    texts = spark.createDataFrame(licenses, "license string, terms string, text string")
    lines = texts.select("license", "terms", canonical_lines(F.col("text")).alias("lines")).where("size(lines) > 0")
    digest = F.sha2(F.array_join("lines", "  "), 256)
    first, n = F.xxhash64(F.get("lines", F.lit(0))), F.size("lines")
    return lines.groupBy(digest.alias("digest")).agg(F.min("license").alias("license"), F.min("terms").alias("terms"), F.min(first).alias("first"), F.min(n).alias("n"))


def digests(docs: DataFrame, starts: dict[int, list[int]]) -> DataFrame:
    """rid, doc_id, digest of the whole text and those of its runs of lines that begin and last like a known text (``starts``: first line to lengths); saved."""
    lines = docs.select("doc_id", canonical_lines(text_of()).alias("lines"))
    none = F.array().cast("array<string>")
    if starts:
        lengths = F.create_map(*[x for h, ns in starts.items() for x in (F.lit(h), F.array(*[F.lit(n) for n in ns]))])
        places = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), F.xxhash64(x).alias("first"))), lambda x: x["first"].isin(list(starts)))
        run = lambda at: lambda n: F.sha2(F.array_join(F.slice("lines", at, n), "  "), 256)
        runs = F.flatten(F.transform(places, lambda x: F.transform(F.element_at(lengths, x["first"]), run(x["at"]))))
    whole = F.sha2(F.array_join("lines", "  "), 256)
    out = lines.select("doc_id", whole.alias("digest"), (F.array_distinct(runs) if starts else none).alias("runs"))
    return saved(out.withColumn("rid", F.monotonically_increasing_id()))


def scan(docs: DataFrame, licenses: list[tuple[str, str, str]] = KNOWN) -> DataFrame:
    """One row for each document: digest and licence of the whole text, and its licence notices."""
    table_ = saved(known(docs.sparkSession, licenses))
    starts: dict[int, list[int]] = {}
    for r in table_.select("first", "n").distinct().orderBy("n").collect():
        starts.setdefault(r["first"], []).append(r["n"])
    found = digests(docs, starts)
    grade = F.when(F.col("terms") == "restricted", 2).when(F.col("terms") == "copyleft", 1).when(F.col("terms") == "permissive", 0)
    terms = table_.select("digest", "license", grade.alias("grade"))
    whole = found.select("rid", "doc_id", "digest").join(terms.withColumnRenamed("license", "whole_license"), "digest", "left")
    hits = found.where("size(runs) > 0").select("rid", F.explode("runs").alias("digest")).join(terms, "digest")
    per = hits.groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.max("grade").alias("most"))
    both = whole.join(per, "rid", "left")
    worst = F.greatest("grade", "most")
    return both.select(
        "doc_id",
        F.col("digest").alias("canonical_sha256"),
        F.coalesce("whole_license", F.lit("")).alias("whole_license"),
        F.coalesce("notices", F.lit("")).alias("notices"),
        F.when(worst == 2, "restricted").when(worst == 1, "copyleft").when(worst == 0, "permissive").otherwise("none").alias("terms"),
    )


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def license_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with an entire licence in place of every tenth text, in capitals and under a copyright line, and inside every tenth."""
    licence = F.element_at(F.array(*[F.lit(t) for _, t in WHOLE]), (F.floor(F.col("doc_id") / 10) % len(WHOLE) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Copyright (c) 2020 Somebody\n"), F.upper(licence))).when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("\n"), licence, F.lit("\nend"))).otherwise(F.col("text"))
    return scan(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).drop("canonical_sha256")


def _sql_lines(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', '\\1', 'g')"
    out = f"'  ' || replace(regexp_replace({out}, '{MARKS}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for variant, common in EQUIVALENT.items():
        out = f"replace({out}, ' {variant} ', ' {common} ')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _sql_text(text: str) -> str:
    return "array_to_string([" + ", ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + "], chr(10))"


def _sql_scan(documents: str) -> str:
    return f"""raw AS (
  SELECT * FROM (VALUES {", ".join(f"('{i}', '{t}', {_sql_text(x)})" for i, t, x in KNOWN)}) AS v(license, terms, text)
), forms AS (
  SELECT license, terms, {_sql_lines("text")} AS lines FROM raw
), known AS (
  SELECT sha256(array_to_string(lines, '  ')) AS digest, min(license) AS license, min(lines[1]) AS first, min(len(lines)) AS n,
         min(CASE terms WHEN 'restricted' THEN 2 WHEN 'copyleft' THEN 1 ELSE 0 END) AS grade FROM forms GROUP BY 1
), d AS (
  SELECT row_number() OVER () AS k, doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM {documents}
), p AS (
  SELECT k, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), n AS (
  SELECT p.k, license, grade FROM p JOIN known ON line = first JOIN d ON d.k = p.k WHERE sha256(array_to_string(lines[i:i + n - 1], '  ')) = digest
), per AS (
  SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, max(grade) AS most FROM n GROUP BY k
), w AS (
  SELECT k, doc_id, sha256(array_to_string(lines, '  ')) AS digest FROM d
), j AS (
  SELECT doc_id, w.digest, license, notices, greatest(grade, most) AS grade FROM w LEFT JOIN known ON w.digest = known.digest LEFT JOIN per USING (k)
)
SELECT doc_id, digest AS canonical_sha256, coalesce(license, '') AS whole_license, coalesce(notices, '') AS notices,
       CASE grade WHEN 2 THEN 'restricted' WHEN 1 THEN 'copyleft' WHEN 0 THEN 'permissive' ELSE 'none' END AS terms
FROM j"""


QUERIES = {"op2_license_digests": op2_license_digests, "license_whole_texts": license_whole_texts}
ORACLES = {
    "op2_license_digests": f"WITH {_sql_scan('documents')}",
    "license_whole_texts": f"""
WITH whole AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, {_sql_text(t)})" for i, (_, t) in enumerate(WHOLE))}) AS v(i, licence)
), planted AS (
  SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'Copyright (c) 2020 Somebody' || chr(10) || upper(licence) WHEN 1 THEN text || chr(10) || licence || chr(10) || 'end' ELSE text END AS text
  FROM documents JOIN whole ON i = (doc_id // 10) % {len(WHOLE)}
), {_sql_scan('planted').replace("SELECT doc_id, digest AS canonical_sha256,", "SELECT doc_id,")}""",
}
