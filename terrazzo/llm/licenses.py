"""License scans by sparse TF-IDF cosine to templates, with inheritance along paths (DataFrame operations only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpoint, hinted, join_groups, join_known, table

#: Wordings of short notices by which licenses are recognised.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
)
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_GNU = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
#: Whole texts of licences, and whole headers of those whose text is a book of its own.
FULL = (
    ("MIT", """MIT License

Copyright (c)

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c)\n\n{_BSD}\n{_AS_IS}"),
    ("BSD-3-Clause", f"""BSD 3-Clause License\n\nCopyright (c)\n\n{_BSD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.\n\n{_AS_IS}"""),
    ("ISC", """ISC License

Copyright (c)

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Copyright

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""),
    ("GPL-3.0", f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program {_GNU}"""),
    ("GPL-2.0", f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program {_GNU}"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
)
#: A line, paragraph or file that holds none of these is neither header nor licence; every template holds one.
CUE = r"(?i)licen[sc]e|spdx|permission is hereby|permission to use|redistribut|public domain|copyright"
#: Paragraphs end at a line without letters and digits, such as an empty one or one of a comment's marks.
PARAGRAPH = "\n[^\\p{L}\\p{N}\n]*\n"


def _templates() -> tuple[tuple[str, str], ...]:
    """Notices, whole texts, and each paragraph of those that holds a cue, but for the bare line of a copyright holder."""
    parts = [(name, part) for name, text in FULL for part in text.split("\n\n") if re.search(CUE, part) and len(part.split()) > 3]
    return tuple(dict.fromkeys((*NOTICES, *FULL, *parts)))


TEMPLATES = _templates()
TERM = "[a-z]+(?:-[a-z]+)*|[0-9]+(?:\\.[0-9]+)*"
COSINE = 0.75
#: A document of which notices make up this share of all words is a licence file, and speaks for its directory.
FILE_SHARE = 0.5


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def units_of(docs: DataFrame) -> DataFrame:
    """(row, kind, terms, n_words): each line, each paragraph and the whole of each text with a cue, if it holds one itself.

    A header that is wrapped over lines is one paragraph, and a licence file one text, so that all their words are compared.
    Texts without a cue are never split.
    """
    cued = docs.where(F.col("text").rlike(CUE))
    parts = F.concat(
        F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit("line").alias("kind"), t.alias("t"))),
        F.transform(F.split("text", PARAGRAPH), lambda t: F.struct(F.lit("paragraph").alias("kind"), t.alias("t"))),
        F.array(F.struct(F.lit("whole").alias("kind"), F.col("text").alias("t"))),
    )
    each = cued.select("row", F.explode(parts).alias("u")).where(F.col("u.t").rlike(CUE))
    return each.select("row", "u.kind", terms_of(F.col("u.t")).alias("terms"), F.regexp_count("u.t", F.lit(WORD)).cast("long").alias("n_words"))


def match_units(units: DataFrame) -> DataFrame:
    """(row, kind, license, cosine, n_words) of the best template of each unit, if it is near enough.

    Units of one text are many, but distinct term lists are few and compared once, as sparse vectors joined on terms with
    the templates' few hundred, and the result is joined back. Inverse document frequencies are those of the terms among all
    units of the corpus, plus the templates; only terms of templates can add to a product, and all terms count in a unit's
    length. Terms and units that are very frequent are broadcast to their rows.
    """
    spark = units.sparkSession
    units = checkpoint(units.withColumn("unit", F.xxhash64("terms")))
    counted = checkpoint(units.groupBy("unit").agg(F.first("terms").alias("terms"), F.count("*").alias("n")))
    given = spark.createDataFrame([(k, *x) for k, x in enumerate(TEMPLATES)], "template int, license string, text string")
    given = given.select("template", "license", F.explode(terms_of(F.col("text"))).alias("term"))
    given = given.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    tf = checkpoint(counted.select("unit", "n", F.explode("terms").alias("term")).groupBy("unit", "n", "term").agg(F.count("*").alias("tf")))
    total = (counted.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES)
    df = tf.select("term", F.col("n").alias("df"), F.lit(1).alias("one")).union(given.select("term", F.lit(1).cast("long"), F.lit(0)))
    df = df.groupBy("term").agg(F.sum("df").alias("df"), F.sum("one").alias("__n"))
    idf = checkpoint(df.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"), "__n"))
    weight = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    # Templates are a fixed list of a few thousand terms.
    given_w = checkpoint(idf.join(F.broadcast(given), "term").select("template", "license", "term", weight))
    given_norm = given_w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("given_norm"))
    given_w = F.broadcast(given_w.join(given_norm, "template").select("template", "license", "term", (F.col("w") / F.col("given_norm")).alias("v")))
    units_w = checkpoint(join_groups(tf, idf, "term", tf.count()).select("unit", "term", weight))
    norm = units_w.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = units_w.join(given_w, "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = (
        dots.join(norm, "unit").select("unit", "license", "template", cosine.alias("cosine")).where(F.col("cosine") >= COSINE)
        .groupBy("unit").agg(F.max(F.struct("cosine", -F.col("template"), "license")).alias("b"))
        .select("unit", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), (-F.col("b.col2")).alias("template"))
    )
    best = checkpoint(best.join(counted.select("unit", F.col("n").alias("__n")), "unit"))
    return join_known(units, best, "unit", total, 128).select("row", "kind", "license", "cosine", "template", "n_words")


def parents(path: str = "directory") -> Column:
    """All directories above and at a directory, the root's empty name included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def license_scan(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, license, origin, cosine, directory.

    A document's own licence is that of its best unit: a line, a paragraph or the whole text, of the greatest cosine to a
    template of short notices, headers and licence texts (ties to the first template). origin is ``header`` then, or ``file``
    if the whole text is near a template, if notices make up half of its words, or if its name is that of a licence file; such a
    document speaks for its directory (of several, the greatest cosine, then the first name). A document without a
    licence of its own inherits from the nearest directory upwards that has one (``inherited``), or has none (``none``,
    null). Whole texts are searched.

    path is /source/lang/doc_id by default. Null parts of it count as empty, null texts as empty. Repeated rows are
    all returned; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    name = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(name if path is None else path, F.lit("")).alias("path"))
    cued = named.select("doc_id", "path", F.when(F.col("text").rlike(CUE), F.col("text")).alias("text"))
    # Only texts with a cue are kept for the second look.
    rows = checkpoint(cued.withColumn("row", F.monotonically_increasing_id()))
    own = match_units(units_of(rows))
    noticed = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_words"))), F.lit(0))
    best = own.groupBy("row").agg(
        F.max(F.struct("cosine", -F.col("template"), "license")).alias("b"), F.bool_or(F.col("kind") == "whole").alias("whole"),
        F.greatest(noticed("line"), noticed("paragraph")).alias("noticed"),
    )
    known = rows.join(hinted(checkpoint(best), 160), "row").select(
        "row", "path", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"),
        (F.col("whole") | (F.col("noticed") >= FILE_SHARE * F.regexp_count("text", F.lit(WORD)))).alias("mostly"),
    )
    is_file = F.col("mostly") | F.regexp_extract("path", "([^/]*)$", 1).rlike(r"(?i)^(licen[sc]e|copying|unlicense)(\.\w+)?$")
    known = checkpoint(known.select("row", "license", "cosine", is_file.alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("at"), "path"))
    speaking = known.where("file").groupBy("at").agg(F.min(F.struct(-F.col("cosine"), F.col("path"), F.col("license"))).alias("s"))
    speaking = checkpoint(speaking.select("at", F.col("s.license").alias("from_dir")))
    # Directories are joined with their ancestors once each, not once for each document.
    placed = checkpoint(rows.select("row", "doc_id", F.regexp_replace("path", "/[^/]*$", "").alias("directory")))
    dirs = checkpoint(placed.groupBy("directory").agg(F.count("*").alias("__n")))
    above = checkpoint(dirs.select("directory", F.explode(parents()).alias("at")))
    counts = above.groupBy("at").agg(F.count("*").alias("__n"))
    above = join_known(above, speaking.join(counts, "at"), "at", above.count(), 512)
    near = above.groupBy("directory").agg(F.max(F.struct(F.length("at"), "from_dir")).alias("n")).select("directory", F.col("n.from_dir").alias("near"))
    near = checkpoint(dirs.join(near, "directory", "left"))
    found = join_known(placed, near, "directory", placed.count(), 512).join(hinted(known.drop("at", "path"), 128), "row", "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("file"), "file").otherwise("header"))
    return found.select(
        "doc_id", F.coalesce("license", "near").alias("license"),
        F.coalesce(origin, F.when(F.col("near").isNotNull(), "inherited"), F.lit("none")).alias("origin"),
        "cosine", "directory",
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    given = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(TEMPLATES))
    terms = lambda c: f"regexp_extract_all(lower({c}), '{TERM}')"
    words = lambda c: f"len(regexp_extract_all({c}, '{WORD}'))"
    weighed = lambda t: f"SELECT {t}.*, (1 + ln(tf)) * idf AS w FROM {t} JOIN idf USING (term)"
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, '/' || coalesce(source, '') || '/' || coalesce(lang, '') AS directory,
         coalesce(doc_id::VARCHAR, '') AS name FROM documents
), parts AS (
  SELECT row, 'line' AS kind, unnest(string_split(text, chr(10))) AS t FROM rows WHERE regexp_matches(text, '{CUE}')
  UNION ALL SELECT row, 'paragraph', unnest(string_split_regex(text, '{PARAGRAPH}')) FROM rows WHERE regexp_matches(text, '{CUE}')
  UNION ALL SELECT row, 'whole', text FROM rows
), units AS (SELECT row, kind, {terms("t")} AS terms, {words("t")} AS n_words FROM parts WHERE regexp_matches(t, '{CUE}')),
counted AS (SELECT terms, count(*) AS n, row_number() OVER () AS unit FROM units GROUP BY terms),
templates(template, license, text) AS (VALUES {given}),
given AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms("text")}) AS term FROM templates) GROUP BY ALL),
tf AS (SELECT unit, n, term, count(*) AS tf FROM (SELECT unit, n, unnest(terms) AS term FROM counted) GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) + {len(TEMPLATES)} AS total FROM counted),
idf AS (
  SELECT term, ln((1.0::DOUBLE + total) / (1 + sum(df))) + 1 AS idf
  FROM (SELECT term, n AS df FROM tf UNION ALL SELECT term, 1 FROM given), total GROUP BY term, total
), units_w AS ({weighed("tf")}), given_w AS ({weighed("given")}),
norm AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM units_w GROUP BY unit),
given_norm AS (SELECT template, sqrt(sum(w * w)) AS norm FROM given_w GROUP BY template),
cosines AS (
  SELECT l.unit, g.template, g.license, round(sum(l.w * g.w / gn.norm) / any_value(norm.norm), 6) AS cosine
  FROM units_w l JOIN given_w g USING (term) JOIN given_norm gn ON gn.template = g.template JOIN norm ON norm.unit = l.unit GROUP BY ALL
), best AS (SELECT * FROM cosines WHERE cosine >= {COSINE} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, template) = 1),
matched AS (SELECT row, kind, license, cosine, template, n_words FROM units JOIN counted USING (terms) JOIN best USING (unit)),
own AS (
  SELECT row, arg_max(license, (cosine, -template)) AS license, max(cosine) AS cosine, bool_or(kind = 'whole') AS whole,
         greatest(coalesce(sum(n_words) FILTER (kind = 'line'), 0), coalesce(sum(n_words) FILTER (kind = 'paragraph'), 0)) AS noticed
  FROM matched GROUP BY row
), known AS (
  SELECT row, directory, name, license, cosine, whole OR noticed >= {FILE_SHARE} * {words("text")}
         OR regexp_matches(name, '(?i)^(licen[sc]e|copying|unlicense)(\.\w+)?$') AS file
  FROM rows JOIN own USING (row)
), speaking AS (
  SELECT directory AS at, license FROM known WHERE file
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, name, license) = 1
), near AS (
  SELECT d.directory, s.license AS near FROM (SELECT DISTINCT directory FROM rows) d JOIN speaking s ON d.directory = s.at OR starts_with(d.directory, s.at || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(s.at) DESC) = 1
)
SELECT doc_id, coalesce(license, near) AS license,
       CASE WHEN license IS NOT NULL THEN CASE WHEN file THEN 'file' ELSE 'header' END WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       cosine, rows.directory
FROM rows LEFT JOIN known USING (row) LEFT JOIN near ON near.directory = rows.directory
"""


OP9_SQL = _sql()
