"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory, in DataFrame functions only.

Units are the lines of a file and its blocks (headers), and the file as a whole
(licence files). Blocks are runs of two or more lines: paragraphs, which end at
lines without a term and where comments begin or end, and runs of comment lines. A unit has the licence of the template whose sparse TF-IDF vector has the
highest cosine with its own, if that reaches ``threshold``. Document counts of
the templates' terms come from all files; a term of no template weighs as one
that no file has. A cosine is at most the root of the share of the template's
squared length that the unit's terms cover, so files and lines whose terms cover
less than threshold**2 of every template are left out before terms are counted.

A licence file gives its licence to its directory: a file so named, one that is
a licence text as a whole, or one whose licence lines, those of blocks too, are half of it. Files
without a licence of their own take that of the nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import aside, cut, meet

# Public licence statements and texts, (licence, kind, text).
TEMPLATES = [
    ("MIT", "header", "Released under the MIT License."),
    ("MIT", "header", "Licensed under the MIT License."),
    ("MIT", "header", "SPDX-License-Identifier: MIT"),
    ("MIT", "file", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "file", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "file", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "header", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "header", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "header", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "header", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "header", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "file", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "file", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("GPL-2.0", "file", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "file", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "file", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "file", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("GPL-2.0", "header", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-2.1", "header", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "header", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "header", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "header", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-2-Clause", "header", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "header", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "header", "SPDX-License-Identifier: Unlicense"),
    ("CC0-1.0", "header", "SPDX-License-Identifier: CC0-1.0"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "file", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Unlicense", "file", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "header", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Apache-2.0", "title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0"),
]
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([-._][^/]*)?$"
SPLIT = "[^a-z0-9]+"
COMMENT = r"^[ \t]*(//|/\*|\*|#|--|;|%|<!--)"


def terms(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


def terms_of(column: str):
    """Terms of a text column; ASCII letters and digits count, all else parts them."""
    return F.filter(F.split(F.lower(column), SPLIT, -1), lambda t: t != "")


def document_counts(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many files there are, and how many hold each term of the templates; the vocabulary bounds what is gathered."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    held = files.select(F.explode_outer(F.array_union(F.array_intersect(terms_of("text"), words), F.array(F.lit("")))).alias("term"))
    counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


class Weights:
    """TF-IDF vectors of the templates by term, of length 1."""

    def __init__(self, templates, n_files: int, counts: dict[str, int], threshold: float):
        self.oov = math.log(n_files + 1) + 1
        vectors = []
        for name, kind, text in templates:
            tf = Counter(terms(text))
            w = {t: n * (math.log((n_files + 1) / (counts.get(t, 0) + 1)) + 1) for t, n in tf.items()}
            length = math.sqrt(sum(x * x for x in w.values()))
            vectors.append({t: x / length for t, x in w.items()})
        self.idf = {t: math.log((n_files + 1) / (counts.get(t, 0) + 1)) + 1 for v in vectors for t in v}
        self.vectors = vectors
        self.least = threshold * threshold - 1e-9

    def keep(self, units: DataFrame, column: str) -> DataFrame:
        """Units whose terms in a text column cover enough of some template. One pass over the terms for all templates."""
        vocabulary = sorted(self.idf)
        # as SQL text, which is one call; the optimiser folds it into one value
        shares = F.expr("map(" + ", ".join(f"'{t}', array({', '.join(repr(v.get(t, 0.0) ** 2) + 'D' for v in self.vectors)})" for t in vocabulary) + ")")
        nothing = F.expr(f"array({', '.join(['0D'] * len(self.vectors))})")
        held = F.array_intersect(terms_of(column), F.expr(f"array({', '.join(repr(t) for t in vocabulary)})"))
        covered = F.aggregate(held, nothing, lambda total, t: F.zip_with(total, F.try_element_at(shares, t), lambda x, y: x + y))
        return units.where(F.exists(covered, lambda x: x >= self.least))

    def table(self, spark) -> DataFrame:
        """(term, idf, parts): one row a term, with its weight in each template that has it."""
        rows = [(t, self.idf[t], [(i, v[t]) for i, v in enumerate(self.vectors) if t in v]) for t in sorted(self.idf)]
        return spark.createDataFrame(rows, "term string, idf double, parts array<struct<template:int, w:double>>")


def blocks_of(files: DataFrame) -> DataFrame:
    """(p, t, kind, run, line, raw): the lines of each block of two lines or more, as the module says."""
    file = Window.partitionBy("p", "t").orderBy("line")
    lines = files.select("p", "t", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    lines = lines.withColumns({"has": F.col("raw").rlike("[A-Za-z0-9]"), "comment": F.col("raw").rlike(COMMENT)})
    before = lambda c: F.coalesce(F.lag(c).over(file), F.lit(False))
    begins = {"paragraph": F.col("has") & (~before("has") | (F.col("comment") != before("comment"))), "comment": F.col("comment") & ~before("comment")}
    told = lines.withColumns({f"begin_{k}": v for k, v in begins.items()})
    told = told.withColumns({f"run_{k}": F.sum(F.col(f"begin_{k}").cast("int")).over(file) for k in begins})
    runs = F.filter(F.array(*[F.when(F.col(c), F.struct(F.lit(k).alias("kind"), F.col(f"run_{k}").alias("run"))) for k, c in (("paragraph", "has"), ("comment", "comment"))]), lambda x: x.isNotNull())
    rows = told.select("p", "t", "line", "raw", F.explode(runs).alias("x")).select("p", "t", "x.kind", "x.run", "line", "raw")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("p", "t", "kind", "run"))).where("n > 1").drop("n")


def cosines(units: DataFrame, weights: Weights, keys: list[str]) -> DataFrame:
    """(keys, template, score): the best template of each unit; rows (keys, text) of equal keys are one unit. Ties to the first template."""
    table = weights.table(units.sparkSession)
    counted = units.select(*keys, F.explode(terms_of("text")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    known = counted.join(F.broadcast(table), "term", "left")  # the terms of the templates
    w = F.col("tf") * F.coalesce("idf", F.lit(weights.oov))
    sparse = known.select(*keys, (w * w).alias("w2"), F.transform("parts", lambda p: F.struct(p["template"].alias("template"), (p["w"] * w).alias("x"))).alias("parts"))
    norms = sparse.groupBy(*keys).agg(F.sqrt(F.sum("w2")).alias("norm"))
    dots = sparse.select(*keys, F.explode("parts").alias("part")).groupBy(*keys, "part.template").agg(F.sum("part.x").alias("dot"))
    both = dots.join(norms, keys).select(*keys, "template", (F.col("dot") / F.col("norm")).alias("score"))
    best = both.groupBy(*keys).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("template")).alias("t"))).alias("best"))
    return best.select(*keys, (-F.col("best.t")).alias("template"), "best.score")


TAKEN = ("license", "score", "license_from", "license_dir", "license_lines")


def scan_licenses(files: DataFrame, threshold: float = 0.75, templates=None, salts: int = 32) -> DataFrame:
    """Add ``license``, ``score``, ``license_from``, ``license_dir``, ``license_lines`` to files (path, text, ...).

    ``license_from``: "own", "inherited" or "none"; a null path or text holds and
    inherits nothing by that part (a null path has no directory). Several licence
    files in a directory: the highest score, then the least path, counts. Rows
    equal in path and text are scanned once and all come back. Other columns of
    ``files`` stay; those named as a result column are replaced.
    """
    files, asked = aside(files, ["path", "text"], TAKEN)
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    slim = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_files, counts = document_counts(slim, sorted({t for _, _, x in templates for t in terms(x)}))
    weights = Weights(templates, n_files, counts, threshold)
    names = F.array(*[F.lit(t[0]) for t in templates])
    likely = weights.keep(slim, "text").withColumn("t", F.xxhash64("text"))
    likely = cut(likely.select(F.coalesce("path", F.lit("")).alias("p"), "t", "text").dropDuplicates(["p", "t"]))
    lines = cut(weights.keep(likely.select("p", "t", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")), "raw"))
    of_lines = cosines(lines.select("p", "t", "line", F.col("raw").alias("text")), weights, ["p", "t", "line"]).where(F.col("score") >= threshold)
    of_lines = cut(of_lines.join(lines.select("p", "t", "line", F.length("raw").alias("chars")), ["p", "t", "line"]))
    blocks, run = cut(blocks_of(likely)), ["p", "t", "kind", "run"]
    of_blocks = cosines(blocks.select(*run, F.col("raw").alias("text")), weights, run).where(F.col("score") >= threshold)
    of_blocks = cut(blocks.join(of_blocks, run).select(*run, "line", F.length("raw").alias("chars"), "template", "score"))
    begin = of_blocks.groupBy(*run).agg(F.min("line").alias("line"), F.first("template").alias("template"), F.first("score").alias("score"))
    hits = of_lines.select("p", "t", "line", "template", "score").unionByName(begin.select("p", "t", "line", "template", "score"))
    covered = of_lines.select("p", "t", "line", "chars").unionByName(of_blocks.select("p", "t", "line", "chars")).distinct()
    covered = covered.groupBy("p", "t").agg(F.count("*").alias("license_lines"), F.sum("chars").alias("chars"))
    headers = hits.groupBy("p", "t").agg(F.max(F.struct("score", (-F.col("line")).alias("l"), (-F.col("template")).alias("m"))).alias("best")).join(covered, ["p", "t"])
    headers = headers.withColumn("best", F.struct("best.score", "best.l", (-F.col("best.m")).alias("template")))
    whole = cosines(likely.select("p", "t", "text"), weights, ["p", "t"]).where(F.col("score") >= threshold)
    whole = whole.select("p", "t", F.struct("score", F.lit(0).alias("l"), "template").alias("whole"))
    size = likely.select("p", "t", F.length("text").alias("size"))
    own = headers.join(whole, ["p", "t"], "full").join(size, ["p", "t"])
    best = F.coalesce(F.when(F.col("best").isNull() | (F.col("whole.score") >= F.col("best.score")), F.col("whole")), F.col("best"))
    own = cut(own.select(
        "p", "t", F.get(names, best["template"]).alias("license"), best["score"].alias("score"), F.coalesce("license_lines", F.lit(0)).alias("license_lines"),
        (F.col("whole").isNotNull() | F.col("p").rlike(FILE_NAME) | (2 * F.coalesce("chars", F.lit(0)) >= F.col("size"))).alias("for_directory"),
    ))
    directory = F.regexp_replace("p", "/?[^/]*$", "")
    given = own.where("for_directory AND p != ''").withColumn("dir", directory).groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "p", "license")).alias("g")
    ).select("dir", F.col("g.license").alias("dir_license"), (-F.col("g.s")).alias("dir_score"))
    rows = files.withColumn("__p", F.coalesce(F.col("path").cast("string"), F.lit(""))).withColumn("__t", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("__dir", F.regexp_replace("__p", "/?[^/]*$", ""))
    # each directory looks up its ancestors once; files then meet their directory, salted for large ones
    dirs = rows.where("__p != ''").select(F.col("__dir").alias("of")).distinct()
    parts = F.split("of", "/", -1)
    up = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).distinct()
    # a licence high up comes to every directory below it
    counted = given.join(up.groupBy("dir").agg(F.count("*").alias("n")), "dir")
    near = meet(up, counted, ["dir"], up.count()).groupBy("of").agg(F.max_by(F.struct("dir", "dir_license", "dir_score"), F.length("dir")).alias("near"))
    near = near.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(F.col("of").alias("__of"), "__salt", F.col("near").alias("__near"))
    kept = files.columns
    slim_rows = rows.select(*kept, "__p", "__t", "__dir", F.pmod(F.xxhash64("__p", "__t"), F.lit(salts)).cast("int").alias("__s"))
    mine = own.select(F.col("p").alias("__op"), F.col("t").alias("__ot"), F.col("license").alias("__l"), F.col("score").alias("__sc"), F.col("license_lines").alias("__n"))
    joined = slim_rows.join(mine, (F.col("__p") == F.col("__op")) & (F.col("__t") == F.col("__ot")), "left")
    joined = joined.join(near, (F.col("__dir") == F.col("__of")) & (F.col("__s") == F.col("__salt")) & (F.col("__p") != ""), "left")
    has = F.col("__l").isNotNull()
    return joined.select(
        *kept, F.coalesce("__l", "__near.dir_license").alias("license"), F.coalesce("__sc", "__near.dir_score").alias("score"),
        F.when(has, "own").when(F.col("__near").isNotNull(), "inherited").otherwise("none").alias("license_from"),
        F.when(~has, F.col("__near.dir")).alias("license_dir"), F.coalesce("__n", F.lit(0)).cast("long").alias("license_lines"),
    ).toDF(*asked, *TAKEN)


def op8_license_scans(spark, sf_dir):
    """Documents as files source/lang/doc_id.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return scan_licenses(files).drop("text")


def oracle(threshold: float = 0.75) -> str:
    """The same rows in SQL: all lines and files against all templates, without the coverage filter."""
    quote = lambda x: x.replace("'", "''")
    rows = ", ".join(f"({i}, '{quote(name)}', '{t}', {n})" for i, (name, _, text) in enumerate(TEMPLATES) for t, n in sorted(Counter(terms(text)).items()))
    split = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""
WITH raw(template, license, term, tf) AS (VALUES {rows}),
files AS (SELECT doc_id, coalesce(source || '/', '') || coalesce(lang || '/', '') || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM files),
held AS (SELECT unnest(list_distinct({split.format("text")})) AS term FROM files),
df AS (SELECT term, count(*) AS df FROM held WHERE term IN (SELECT term FROM raw) GROUP BY 1),
idf AS (SELECT DISTINCT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM raw LEFT JOIN df USING (term), n),
tw AS (SELECT template, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM raw JOIN idf USING (term)),
lines AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS raw FROM files),
flags AS (SELECT *, regexp_matches(raw, '[A-Za-z0-9]') AS has, regexp_matches(raw, '^[ \\t]*(//|/\\*|\\*|#|--|;|%|<!--)') AS com FROM lines),
lagged AS (SELECT *, coalesce(lag(has) OVER w, false) AS had, coalesce(lag(com) OVER w, false) AS was FROM flags WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
runs AS (SELECT *, sum(CAST(has AND (NOT had OR com <> was) AS INT)) OVER w AS p_run, sum(CAST(com AND NOT was AS INT)) OVER w AS c_run FROM lagged WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
either AS (SELECT doc_id, 'p' || p_run AS unit, line, raw FROM runs WHERE has UNION ALL SELECT doc_id, 'c' || c_run, line, raw FROM runs WHERE com),
blocks AS (SELECT * FROM either QUALIFY count(*) OVER (PARTITION BY doc_id, unit) > 1),
units AS (SELECT doc_id, 'l' || line AS unit, line, raw AS text FROM lines UNION ALL SELECT doc_id, unit, line, raw FROM blocks UNION ALL SELECT doc_id, 'w', -1, text FROM files),
counted AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest({split.format("text")}) AS term FROM units) GROUP BY ALL),
weighed AS (SELECT doc_id, unit, term, tf * coalesce(idf, ln(n + 1) + 1) AS w FROM counted LEFT JOIN idf USING (term), n),
norms AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY 1, 2),
dots AS (SELECT doc_id, unit, template, sum(weighed.w * tw.w) AS dot FROM weighed JOIN tw USING (term) GROUP BY 1, 2, 3),
best AS (SELECT doc_id, unit, max({{'score': round(dot / norm, 9), 't': -template}}) AS b FROM dots JOIN norms USING (doc_id, unit) GROUP BY 1, 2),
hits AS (SELECT doc_id, unit, b.score AS score, -b.t AS template FROM best WHERE b.score >= {threshold}),
covered AS (SELECT DISTINCT doc_id, line, length(text) AS chars FROM hits JOIN units USING (doc_id, unit) WHERE line >= 0),
begins AS (SELECT doc_id, unit, min(line) AS line FROM units WHERE line >= 0 GROUP BY 1, 2),
of_lines AS (SELECT doc_id, max({{'score': score, 'l': -line, 't': -template}}) AS b FROM hits JOIN begins USING (doc_id, unit) GROUP BY 1),
sums AS (SELECT doc_id, count(*) AS license_lines, sum(chars) AS chars FROM covered GROUP BY 1),
whole AS (SELECT doc_id, score, template FROM hits WHERE unit = 'w'),
own AS (SELECT f.doc_id, f.path, CASE WHEN w.score IS NOT NULL AND (b IS NULL OR w.score >= b.score) THEN w.template ELSE -b.t END AS template,
  CASE WHEN w.score IS NOT NULL AND (b IS NULL OR w.score >= b.score) THEN w.score ELSE b.score END AS score, coalesce(license_lines, 0) AS license_lines,
  w.score IS NOT NULL OR 2 * coalesce(chars, 0) >= length(f.text) AS for_directory
  FROM files f LEFT JOIN of_lines USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN whole w USING (doc_id) WHERE b IS NOT NULL OR w.score IS NOT NULL),
names AS (SELECT DISTINCT template, license FROM raw),
given AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, min({{'s': -score, 'p': path, 'license': license}}) AS g FROM own JOIN names USING (template) WHERE for_directory GROUP BY 1),
up AS (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS k FROM files),
near AS (SELECT path, max_by({{'dir': dir, 'license': g.license, 'score': -g.s}}, length(dir)) AS x FROM up JOIN given ON dir = array_to_string(string_split(path, '/')[:k], '/') GROUP BY 1)
SELECT f.doc_id, f.path, coalesce(license, x.license) AS license, coalesce(o.score, x.score) AS score, CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN x IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_from,
  CASE WHEN o.doc_id IS NULL THEN x.dir END AS license_dir, coalesce(license_lines, 0) AS license_lines
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN names USING (template) LEFT JOIN near ON near.path = f.path
"""
