"""License scan: canonical digests of entire texts, joined with those of known licences.

The canonical form is lower case, without copyright lines, with one spelling for equivalent
ones, and with every run of other characters than a-z and 0-9 as one blank.  A copyright line is one that
starts with the word or the sign and goes on with a year, a sign or a place for the year, so a line of the licence's
own that happens to start with the word stays, wherever lines are broken.  A notice may be broken, too: a second form of a
text also leaves out what follows such a line up to the next empty one, and either form may match.  Units are the
whole text of a document and each of its lines (a notice of use stands on a line of its own); a
unit matches only if the whole of it has the digest of a known text, with or without its title.  Units without any word
that all known texts need are passed over before they are put in canonical form.

``KNOWN`` has whole texts of seven licences and the notices of others; longer licences (Apache, GPL, MPL) come
from a folder of texts (``known_texts``), one file a licence, as systems keep in their folder of common licences.

Defined results: null and empty texts match nothing; null ids are returned with what their
text matches; repeated rows are returned each; known texts that are null or empty in canonical form match nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: public licence texts and the short notices that name a licence
KNOWN = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """BSD 3-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Zlib": """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": """The Unlicense

This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
}
# fixed values: spellings that mean the same, each with the one that is kept
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("https:", "http:"),
    ("non-commercial", "noncommercial"),
    ("&", "and"),
)
_OTHER = r"[^\p{L}\p{N}\n]*"
_YEAR = r"(?:[0-9]{4}|[<\[{](?:year|yyyy))"
# what a copyright line starts with, in lower case
NOTICE = rf"{_OTHER}(?:copyright{_OTHER}(?:\(c\)|©|{_YEAR})|\(c\){_OTHER}{_YEAR}|©|all rights reserved)"
COPYRIGHT_LINE = rf"(?m)^{NOTICE}[^\n]*$"
COPYRIGHT_PARAGRAPH = rf"(?m)^{NOTICE}[^\n]*(?:\n[^\n]*[^\s][^\n]*)*"
NEEDS = ("licen", "permi")  # every known text has one of these; checked in known_licenses


def canonical(text: Column, notices: str = COPYRIGHT_LINE) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(text), notices, ""), r"\s+", " ")
    for other, kept in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(kept))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def with_untitled(known: dict[str, str]) -> list[tuple[str, str]]:
    """(id, text) of known texts, and of those with a title line of their own also without it."""
    rows = list(known.items())
    for name, text in known.items():
        title, _, rest = (text or "").partition("\n")
        if rest.strip() and len(title.split()) <= 6:
            rows.append((name, rest))
    return rows


def known_texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """The texts of the licence files in a folder (a bounded set, a few dozen), by file name without an ending such as .txt."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1).alias("name"), "value")
    return {r.name: r.value for r in rows.collect()}


def known_licenses(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of both forms; for equal digests the first id by name."""
    rows = with_untitled(KNOWN if known is None else known)
    df = spark.createDataFrame(rows, "license_id string, text string").where("text is not null")
    forms = F.array(canonical(F.col("text")), canonical(F.col("text"), COPYRIGHT_PARAGRAPH))
    named = df.select("license_id", F.explode(forms).alias("c")).where("c <> ''")
    return named.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def _worth(text: Column, known: dict[str, str]) -> Column:
    if all(t and any(w in t.lower() for w in NEEDS) for _, t in with_untitled(known)):
        low = F.lower(text)
        return low.contains(NEEDS[0]) | low.contains(NEEDS[1])
    return F.lit(True)


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, whole_license, notices, n_notices): the licence that the whole text is, ids of the lines' licences (sorted, joined by commas), number of such lines."""
    spark = docs.sparkSession
    known = KNOWN if known is None else known
    digests = F.broadcast(known_licenses(spark, known))  # as many rows as known texts
    # rows are told apart by their place, as ids may be null or repeated
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    worth = docs.where(F.col("text").isNotNull() & _worth(F.col("text"), known)).select("doc_id", "text", F.xxhash64("text").alias("t"))
    forms = F.array_distinct(F.array(canonical(F.col("text")), canonical(F.col("text"), COPYRIGHT_PARAGRAPH)))
    whole = worth.select("doc_id", "t", F.explode(forms).alias("c")).select("doc_id", "t", F.sha2("c", 256).alias("digest"), F.lit(True).alias("whole"))
    lines = worth.select("doc_id", "t", F.explode(F.split("text", "\n")).alias("line")).where(_worth(F.col("line"), known))
    lines = lines.select("doc_id", "t", F.sha2(canonical(F.col("line")), 256).alias("digest"), F.lit(False).alias("whole"))
    hits = whole.unionByName(lines).join(digests, "digest")
    per = hits.groupBy("doc_id", "t", "whole").agg(F.min("license_id").alias("first"), F.array_sort(F.collect_set("license_id")).alias("ids"), F.count("*").alias("n"))
    per = per.groupBy("doc_id", "t").agg(
        F.max(F.when(F.col("whole"), F.col("first"))).alias("whole_license"),
        F.max(F.when(~F.col("whole"), F.array_join("ids", ","))).alias("notices"),
        F.max(F.when(~F.col("whole"), F.col("n"))).alias("n"),
    )
    copies = docs.groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.count("*").alias("copies"))
    # repeated rows counted their lines together
    per = per.join(copies, per.doc_id.eqNullSafe(copies.doc_id) & (per.t == copies.t)).select(per.doc_id, per.t, "whole_license", "notices", (F.col("n") / F.col("copies")).cast("long").alias("n"))
    left = docs.select("doc_id", F.xxhash64("text").alias("t"))
    out = left.join(per, left.doc_id.eqNullSafe(per.doc_id) & (left.t == per.t), "left")
    return out.select(left.doc_id, "whole_license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The definition line by line: which lines are notices, which of them a paragraph loses, what is left as words."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def words(x: str) -> str:
        x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
        for other, kept in SPELLINGS:
            x = f"replace({x}, {quote(other)}, {quote(kept)})"
        return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in with_untitled(KNOWN))
    start = "^[^\\p{L}\\p{N}]*"
    year = "([0-9]{4}|[<\\[{](year|yyyy))"
    notice = " OR ".join(f"regexp_matches(line, '{start}{x}')" for x in (f"copyright[^\\p{{L}}\\p{{N}}]*(\\(c\\)|©|{year})", f"\\(c\\)[^\\p{{L}}\\p{{N}}]*{year}", "©", "all rights reserved"))
    return f"""
WITH known_text AS (SELECT -row_number() OVER () AS id, k, t FROM (VALUES {rows}) v(k, t)),
texts AS (SELECT row_number() OVER () AS id, doc_id, NULL AS k, text FROM documents UNION ALL SELECT id, NULL, k, t FROM known_text),
lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS line FROM (SELECT id, string_split(lower(text), chr(10)) AS l FROM texts)),
seen AS (SELECT *, {notice} AS hit, count(*) FILTER (trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '') OVER (PARTITION BY id ORDER BY no) AS para FROM lines),
marked AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY id, para ORDER BY no), false) AS after FROM seen),
one AS (SELECT id, {words("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT hit), '')")} AS c FROM marked GROUP BY id),
two AS (SELECT id, {words("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT after), '')")} AS c FROM marked GROUP BY id),
forms AS (SELECT * FROM one UNION SELECT * FROM two),
known AS (SELECT c, min(k) AS license_id FROM forms JOIN known_text USING (id) WHERE c <> '' GROUP BY c),
whole AS (SELECT id, min(license_id) AS whole_license FROM forms JOIN known USING (c) WHERE id > 0 GROUP BY id),
notes AS (SELECT id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n
  FROM (SELECT id, CASE WHEN hit THEN '' ELSE {words("line")} END AS c FROM seen WHERE id > 0) JOIN known USING (c) GROUP BY id)
SELECT doc_id, whole_license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM texts LEFT JOIN whole USING (id) LEFT JOIN notes USING (id) WHERE id > 0
"""


QUERIES = {"op2_licenses": op2_licenses}
ORACLES = {"op2_licenses": _sql()}
