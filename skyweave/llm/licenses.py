"""License scans by canonical digest lookup.

Texts are brought to a canonical form: copyright lines go, case and
punctuation fold, equivalent spellings become one. The digest of the whole
text is joined to the digests of known license texts; the digests of single
lines that mention a license are joined to those of known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, text_of

# Lines that name a copyright holder. A clause that happens to begin a line with the word is none: such lines
# have a year, a sign or a blank for the year.
_YEAR = r"\b(?:19|20)\d\d\b"
COPYRIGHT = (
    r"(?im)^[^\p{L}\p{N}\n]*(?:copyright\b[^\n]*(?:" + _YEAR + r"|\(c\)|©|[<\[{]\s*(?:year|yyyy))|(?:\(c\)|©)[^\n]*" + _YEAR + r")[^\n]*$|\ball rights reserved\b\.?"
)
# Spellings taken as one, whole words, in this order.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "analogue": "analog",
    "artefact": "artifact",
    "artefacts": "artifacts",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "http": "https",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "merchantibility": "merchantability",
    "modelled": "modeled",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "optimisation": "optimization",
    "organisation": "organization",
    "organisations": "organizations",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Notices, one line each.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
}

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Titles that a text may have, or lack.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "Free Public License 1.0.0", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

# Whole license texts, without title.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AUTHOR}",
    "0BSD": f"{_GRANT}.\n\n{_AUTHOR}",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}{_BSD_3}\n{_BSD_END}",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}

# Digests of the canonical form of longer texts, whole and as far as the end of their terms.
DIGESTS = {
    "Apache-2.0": [
        "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5",
        "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93",
        "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809",
    ],
    "CC0-1.0": [
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ],
    "GPL-2.0": [
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
    ],
    "GPL-3.0": [
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
    ],
    "LGPL-2.1": [
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    ],
    "MPL-2.0": [
        "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13",
    ],
}


def canonical(text: Column) -> Column:
    """The canonical form of a text: words with single spaces between them.
    Line breaks do not matter but where a line names a copyright holder."""
    # Two spaces, so that each word has its own on both sides.
    plain = F.concat(F.lit("  "), F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, " ")), r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    one = plain
    for a, b in SPELLINGS.items():
        one = F.replace(one, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    heads = "|".join(sorted({a.split()[0] for a in SPELLINGS}))
    return F.trim(F.regexp_replace(F.when(F.regexp_like(plain, F.lit(f" (?:{heads}) ")), one).otherwise(plain), " +", " "))


def _listed() -> list[tuple[str, str, bool]]:
    """``(id, text, whole)`` of all texts, with and without titles, and notices."""
    whole = [(i, f"{title}\n\n{t}", True) for i, t in TEXTS.items() for title in ["", *TITLES[i]]]
    return whole + [(i, t, False) for i, x in NOTICES.items() for t in x]


def known(spark: SparkSession) -> DataFrame:
    """``(digest, license_id, whole)`` of the texts and notices above; a
    digest that two share goes to the first id. A table of one's own may take
    its place, of any size."""
    made = spark.createDataFrame(_listed(), "license_id string, text string, whole boolean").withColumn("digest", F.sha2(canonical(F.col("text")), 256))
    more = spark.createDataFrame([(i, d, True) for i, ds in DIGESTS.items() for d in ds], "license_id string, digest string, whole boolean")
    return made.drop("text").unionByName(more).groupBy("digest", "whole").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, digest, license_id,
    n_notices, notices``.

    ``digest`` is the SHA-256 of the whole canonical text, ``license_id`` the
    known license that it is (null: none). ``notices`` names, sorted and joined
    by commas, the licenses that single lines announce, ``n_notices`` counts
    those lines; the whole text is looked at, line by line. Without a table of
    one's own, lines without licens or licenc need no look. A null text is empty; empty texts are no license; rows equal in id and text
    get equal results; other columns do not matter."""
    speak = (lambda x: x.rlike("(?i)licen[sc]")) if table is None else (lambda x: F.length(x) > 0)
    table = known(docs.sparkSession) if table is None else table
    whole = table.where("whole").select(F.col("digest").alias("_whole"), "license_id")
    lines = table.where("not whole").select(F.col("digest").alias("_line"), F.col("license_id").alias("notice"))
    rows = keyed(docs)
    slim = rows.select("doc_id", "th", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    line = F.filter(F.split("text", "\n"), speak)
    said = (
        rows.where(speak(F.col("text")))
        .distinct()
        .select("doc_id", "th", F.explode(line).alias("line"))
        .select("doc_id", "th", F.sha2(canonical(F.col("line")), 256).alias("_line"))
        .join(lines, "_line")
        .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        .agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    )
    out = slim.join(whole, F.col("digest") == F.col("_whole"), "left").join(said, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def sql(table: str) -> str:
    """:func:`scan` as SQL over ``table``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        plain = f"array_to_string(regexp_extract_all(lower(regexp_replace({text}, {quote(COPYRIGHT)}, ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), ' ')"
        for a, b in SPELLINGS.items():
            plain = f"regexp_replace({plain}, '\\b{a}\\b', '{b}', 'g')"
        return f"sha256({plain})"

    values = ", ".join(f"({quote(i)}, {quote(t)}, {str(w).lower()})" for i, t, w in _listed())
    more = ", ".join(f"({quote(d)}, true, {quote(i)})" for i, ds in DIGESTS.items() for d in ds)
    return f"""
WITH known AS (
  SELECT digest, whole, min(license_id) AS license_id
  FROM (SELECT {form("text")} AS digest, whole, license_id FROM (VALUES {values}) AS v(license_id, text, whole) UNION ALL VALUES {more}) GROUP BY 1, 2),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}),
said AS (
  SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS notices
  FROM (SELECT r, {form("line")} AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '(?i)licen[sc]'))
  JOIN (SELECT * FROM known WHERE NOT whole) USING (digest) GROUP BY r)
SELECT doc_id, d.digest, k.license_id, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, {form("text")} AS digest FROM docs) d
LEFT JOIN said USING (r) LEFT JOIN (SELECT * FROM known WHERE whole) k ON k.digest = d.digest
"""
