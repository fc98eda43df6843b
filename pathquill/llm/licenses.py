"""License scans with DataFrame operations alone.

Lines and runs of lines (headers, which may be wrapped) and whole texts (licence files) are compared to templates by the cosine of sparse TF-IDF
vectors, with document frequencies over all documents. A text can only reach the threshold if it holds an anchor, one of the heaviest terms without
which the cosine stays below it, so a scan by regular expression leaves few lines to split; and only if the squared weights
of its terms in some template sum to the squared threshold, so runs of lines are tried in few texts. A file
without a licence of its own takes the one of the nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

# License statements as they are written in files' headers.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# How the long license texts begin; a file with such lines is the license.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
]
# Short license texts, whole.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS = [
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"{_TWO} {_AS_IS}"),
    ("BSD-3-Clause", f"{_TWO} {_THIRD} {_AS_IS}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
]
#: (license, text, kind)
TEMPLATES = [(*x, kind) for kind, xs in (("header", HEADERS), ("title", TITLES), ("text", TEXTS)) for x in xs]
#: A whole file that is no more than a header speaks for its directory too; with code behind it, it doesn't.
ALONE = 0.99
#: A tag that names its license.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"
THRESHOLD = 0.75
#: What separates terms, after lower-casing.
GAP = r"[^a-z0-9\u0080-￿]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(GAP, text.lower()) if t]


VOCABULARY = sorted({t for _, text, _ in TEMPLATES for t in terms(text)})
#: Terms of a run of lines at most: of more than this, too few can be a template's.
RUN_TERMS = 4 * max(len(terms(text)) for _, text in HEADERS + TITLES)


def split_terms(text):
    return F.filter(F.split(F.lower(text), GAP), lambda t: t != "")


def vocabulary():
    """The templates' terms as one constant."""
    return F.split(F.lit(" ".join(VOCABULARY)), " ")


def document_counts(docs: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """In how many documents each template term occurs, and how many documents there are."""
    held = F.array_intersect(F.split(F.lower(text), GAP), vocabulary())
    rows = docs.select(F.explode(F.coalesce(F.array_append(held, F.lit("")), F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()  # the templates' terms
    found = {r.term: r["count"] for r in rows}
    return found, found.get("", 0)


def weighted(found: dict[str, int] | None = None, n: int = 0) -> tuple[list[tuple[int, str, str, float]], float, dict[str, float]]:
    """(template, license, term, unit weight) rows of :data:`TEMPLATES`, the idf of unknown terms, and the idf of the known.

    A term's weight is (1 + ln tf) ln(1 + N / (1 + df)), with documents counted over the whole table; terms that
    no template has weigh as the templates' mean.
    """
    found = found or {}
    idf = {t: math.log(1 + max(n, 1) / (1 + found.get(t, 0))) for t in VOCABULARY}
    rows = []
    for k, (license, text, _) in enumerate(TEMPLATES):
        x = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in x.values()))
        rows += [(k, license, t, w / norm) for t, w in sorted(x.items())]
    return rows, sum(idf.values()) / len(idf), idf


def anchors(rows: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold against any template.

    Without a template's heaviest terms, whose squared weights sum to over 1 - threshold^2, the rest of
    its vector is shorter than the threshold, and so is any cosine.
    """
    out = set()
    for k in {r[0] for r in rows}:
        lost = 0.0
        for _, _, term, w in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[2])):
            out.add(term)
            lost += w * w
            if lost > 1 - threshold**2:
                break
    return sorted(out)


def one_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at each letter once: alternatives share their beginnings."""
    ends, by_letter = "" in words, {}
    for w in words:
        if w:
            by_letter.setdefault(w[0], []).append(w[1:])
    if not by_letter:
        return ""
    inner = "|".join(re.escape(letter) + one_of(rest) for letter, rest in sorted(by_letter.items()))
    return f"(?:{inner})" + "?" * ends


def can_reach(found, rows: list[tuple[int, str, str, float]], threshold: float):
    """Whether texts with these terms can reach the threshold: a cosine is at most the length of the template's part on them."""
    tables = []
    for k in sorted({r[0] for r in rows}):
        # a constant for Spark, unlike a map of many literals
        pairs = ";".join(f"{t}:{w * w:.9f}" for j, _, t, w in rows if j == k)
        tables.append(F.str_to_map(F.lit(pairs), F.lit(";"), F.lit(":")))

    def mass(held, table):
        return F.aggregate(held, F.lit(0.0), lambda sum, t: sum + F.coalesce(F.try_element_at(table, t).cast("double"), F.lit(0.0)))

    def some(held):
        return reduce(Column.__or__, (mass(held, table) >= threshold**2 - 1e-6 for table in tables))

    # the array of one is where the terms are computed once
    return F.exists(F.array(F.array_intersect(found, vocabulary())), some)


def reaching(texts: DataFrame, rows: list[tuple[int, str, str, float]], threshold: float) -> DataFrame:
    """``file_id`` of the files whose terms can reach the threshold, as :func:`can_reach` says it, by a join with the fixed templates."""
    masses = texts.sparkSession.createDataFrame([(k, t, w * w) for k, _, t, w in rows], "template int, term string, mass double")
    known = texts.select("file_id", F.explode(F.array_intersect(split_terms("text"), vocabulary())).alias("term")).distinct()
    total = known.join(F.broadcast(masses), "term").groupBy("file_id", "template").agg(F.sum("mass").alias("mass"))
    return total.where(F.col("mass") >= threshold**2 - 1e-6).select("file_id").distinct()


def line_runs(held: DataFrame, rows: list[tuple[int, str, str, float]], threshold: float) -> DataFrame:
    """``file_id, row, i, j, unit``: runs of lines, i to j, that can reach the threshold; lines without terms aside.

    A run begins and ends at lines with a template's term, as others only lower its cosine.
    """
    def line(x):
        # one array of terms for both figures
        return F.transform(F.array(split_terms(x)), lambda t: F.struct(x.alias("line"), F.size(t).alias("n"), (F.size(F.array_intersect(t, vocabulary())) > 0).alias("known")))[0]

    lines = F.filter(F.transform(F.split("text", r"\r?\n"), line), lambda x: x["n"] > 0)
    ahead = F.flatten(F.transform(F.array(lines), lambda all: F.transform(all, lambda x, i: F.struct(i.alias("i"), x["known"].alias("known"), F.slice(all, i + 1, F.lit(RUN_TERMS)).alias("ahead")))))
    numbered = held.select("file_id", "text", F.monotonically_increasing_id().alias("row"))  # before a row becomes several
    starts = numbered.select("file_id", "row", F.explode(F.filter(ahead, lambda x: x["known"])).alias("at"))
    # how many lines from here hold RUN_TERMS terms at most; one line is a run however long
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"))
    fits = F.aggregate("at.ahead", zero, lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["lines"] + F.when(s["n"] + x["n"] <= RUN_TERMS, 1).otherwise(0)).alias("lines")), lambda s: s["lines"])
    ends = starts.select("file_id", "row", "at", F.explode(F.sequence(F.lit(1), F.greatest(fits, F.lit(1)))).alias("n"))
    ends = ends.where(F.col("at.ahead")[F.col("n") - 1]["known"])
    unit = F.array_join(F.transform(F.slice("at.ahead", F.lit(1), F.col("n")), lambda x: x["line"]), " ")
    runs = ends.select("file_id", "row", F.col("at.i").alias("i"), (F.col("at.i") + F.col("n") - 1).alias("j"), unit.alias("unit"))
    return settle(runs.where(can_reach(split_terms("unit"), rows, threshold)))


def wrapped_headers(runs: DataFrame, named: DataFrame) -> DataFrame:
    """``file_id, times, license, cosine`` of each text's best run, and how many headers of several lines it has.

    Headers are taken from the nearest, without those that overlap one already taken. One that holds a line
    which is a header alone is that line's, which is counted there.
    """
    near = runs.join(named, "unit")
    order = F.struct((-F.col("cosine")).alias("far"), (F.col("i") - F.col("j")).alias("short"), "i", "j")
    each = near.groupBy("file_id", "row").agg(F.array_sort(F.collect_list(order)).alias("found"), F.max_by("license", F.struct("cosine", "license")).alias("license"), F.max("cosine").alias("cosine"))
    taken = F.aggregate(
        F.filter("found", lambda x: x["short"] < 0),
        F.slice("found", 1, 0),
        lambda done, x: F.when(F.exists(done, lambda d: (d["i"] <= x["j"]) & (x["i"] <= d["j"])), done).otherwise(F.array_append(done, x)),
    )
    each = each.withColumn("alone", F.filter("found", lambda x: x["short"] == 0))
    own = F.filter(taken, lambda x: ~F.exists("alone", lambda d: (d["i"] >= x["i"]) & (d["i"] <= x["j"])))
    return each.select("file_id", F.size(own).cast("long").alias("times"), "license", "cosine")


def best_license(units: DataFrame, keys: list[str], text: str, threshold: float, model) -> DataFrame:
    """``keys, license, cosine, kind`` of the nearest template of each text that reaches the threshold, by its kind too.

    A file's whole text (``text``) may be near a license text, or be no more than a header; runs of lines are
    headers or titles.
    """
    spark = units.sparkSession
    rows, unknown, idf = model
    weights = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double"))  # the fixed templates
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    bag = units.select(*keys, F.explode(F.split(F.lower(text), GAP)).alias("term")).where("term != ''").groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    bag = bag.join(known, "term", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown)))
    norm = bag.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = bag.join(weights, "term").groupBy(*keys, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dot.join(norm, keys).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= threshold)
    titles = [k for k, (_, _, kind) in enumerate(TEMPLATES) if kind == "title"]
    order = F.struct("cosine", -F.col("template"))
    return near.groupBy(*keys).agg(F.max_by("license", order).alias("license"), F.max("cosine").alias("cosine"), F.max_by(F.col("template").isin(titles), order).alias("title"))


def of_kinds(rows: list[tuple[int, str, str, float]], *kinds: str) -> list[tuple[int, str, str, float]]:
    return [r for r in rows if TEMPLATES[r[0]][2] in kinds]


def license_scan(files: DataFrame, file_id: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``file_id, license, n_headers, is_license_file, inherited_from, effective_license`` for every distinct id.

    ``license`` is the nearest template of the file's best line or run of lines (the first of equal cosine), or of its
    whole text, or what a tag names; null without one. ``n_headers`` counts lines that are headers alone, headers wrapped over several, and tags. A file is a
    licence file if its whole text is near a short licence's text, if it is no more than a header, or if it has a long
    licence's title; it speaks for its directory (of several, the nearest template wins) and for all below without
    a nearer one. Null or empty texts have no licence but inherit; a null path has no directory and
    inherits nothing. Ids are taken as unique; a repeated one is one file with all its rows' lines.
    """
    docs = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    rows, unknown, idf = weighted(*document_counts(docs, "text"))
    short = of_kinds(rows, "header", "title")
    pattern = r"(?i)(?:^|[^a-z0-9\u0080-￿])" + one_of(anchors(rows, threshold)) + r"(?:$|[^a-z0-9\u0080-￿])"
    # the few texts that can be near a template are written down, and read as lines and as wholes
    anchored = docs.select("file_id", "text").where(F.col("text").rlike(pattern))
    held = settle(anchored.join(reaching(anchored, rows, threshold), "file_id", "left_semi"))
    runs = line_runs(held, short, threshold)
    lines = held.select("file_id", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.col("line").rlike(pattern))
    lines = settle(lines.groupBy("file_id", "line").agg(F.count("*").alias("times")))
    distinct = lines.select("line").union(runs.select("unit")).distinct().withColumn("unit", F.col("line"))
    named = settle(best_license(distinct, ["unit"], "line", threshold, (short, unknown, idf)))
    alone = lines.join(named.withColumnRenamed("unit", "line"), "line").select("file_id", "times", "license", "cosine")
    found = alone.union(wrapped_headers(runs, named))
    # a tag names its license, and is a header
    tags = docs.where(F.col("text").contains("SPDX-License-Identifier:")).select("file_id", F.explode(F.regexp_extract_all("text", F.lit(TAG), 1)).alias("license"))
    tags = tags.groupBy("file_id", "license").agg(F.count("*").alias("times")).select("file_id", "times", "license", F.lit(2.0).alias("cosine"))
    headers = found.union(tags).groupBy("file_id").agg(F.sum("times").alias("n_headers"), F.max_by("license", F.struct("cosine", "license")).alias("header"), F.max("cosine").alias("cosine"))
    # a whole text is near a template only if it is about as long: its norm is at most the dot over the threshold
    texts = best_license(held.select("file_id", "text"), ["file_id"], "text", threshold, (of_kinds(rows, "text"), unknown, idf)).select("file_id", "license", "cosine")
    bare = best_license(held.select("file_id", "text"), ["file_id"], "text", ALONE, (of_kinds(rows, "header"), unknown, idf)).select("file_id", "license", "cosine")
    titled = runs.select("file_id", "unit").union(lines.select("file_id", "line")).join(named.where("title"), "unit").select("file_id", "license", "cosine")
    whole = texts.union(bare).union(titled).groupBy("file_id").agg(F.max_by("license", F.struct("cosine", "license")).alias("whole"), F.max("cosine").alias("whole_cosine"))
    ids = docs.select("file_id", directory("path").alias("dir")).groupBy("file_id").agg(F.min("dir").alias("dir"))
    own = settle(ids.join(headers, "file_id", "left").join(whole, "file_id", "left"))

    speaks = own.where("whole is not null and dir is not null").groupBy("dir").agg(F.max_by("whole", F.struct("whole_cosine", "whole")).alias("dir_license"))
    above = own.select("dir").dropna().distinct().select("dir", F.explode(ancestors("dir")).alias("above"))
    nearest = above.join(speaks.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("above", F.length("above")).alias("inherited_from"), F.max_by("dir_license", F.length("above")).alias("dir_license"))
    # few directories have a licence above them, many files share one: the join may be skewed on dir, which AQE splits
    out = own.join(nearest, "dir", "left")
    license = F.coalesce("whole", "header")
    return out.select(
        F.col("file_id").alias(file_id),
        license.alias("license"),
        F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"),
        F.col("whole").isNotNull().alias("is_license_file"),
        F.when(license.isNull(), F.col("inherited_from")).alias("inherited_from"),
        F.coalesce(license, F.col("dir_license")).alias("effective_license"),
    )


def directory(path: str):
    """The part before the last slash; '' for a file at the top."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(F.col(path).isNotNull(), F.lit(""))


def ancestors(dir: str):
    """A directory, those above it, and the top ('')."""
    parts = F.split(dir, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all ``documents``, with source, language and id as the path that the table lacks; cases as in :func:`license_scan`."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return license_scan(docs.select("doc_id", "text", path.alias("path")))
