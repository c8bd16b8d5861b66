"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import BROADCAST_ROWS, written

_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Forms by which the licences are declared, as whole headers or, of the short licences, whole texts; a licence may have several.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", _BSD + _WARRANTY),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _ENDORSE + _WARRANTY),
    ("BSD-3-Clause", _BSD + _ENDORSE),
    *[(f"{k}-{v}", f"This work is licensed under the GNU {n}, version {v.removesuffix('.0')}.") for k, n, vs in (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))) for v in vs],
    *[(f"{k}-{v}", _GNU.format(n, v.removesuffix(".0"))) for k, n, vs in (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))) for v in vs],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *[(f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in ("BY", "BY-NC", "BY-SA") for v in ("3.0", "4.0")],
]
TEMPLATES += [(n, f"SPDX-License-Identifier: {n}") for n in sorted({n for n, _ in TEMPLATES})]
#: A version after a licence's name or the word; an SPDX tag's licence.
VERSION = r"(?i)(?:version|\bv\.?|gpl|mpl|apache|license|bsd|\bby(?:-(?:nc|sa|nd))*)[ ,-]*v?(\d+(?:\.\d+)?)"
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?([\w.-]+?)(?:-only|-or-later|\+)?(?:[^\w.+-]|$)"
#: A line is a header if it says one of these words.
HEADER = r"(?i)licen[sc]e|copyright|permission is hereby granted|permission to use, copy|redistribution and use|creative commons"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)(?:-\d+)?(?:\.[a-z]+)?$"


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def versions(line: Column) -> Column:
    """Versions that a text names, without a last .0."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(VERSION), F.lit(1)), lambda v: F.regexp_replace(v, r"\.0$", "")))


def spdx(line: Column) -> Column:
    """The licence that an SPDX tag names, in lower case; empty without a tag."""
    return F.lower(F.regexp_extract(line, SPDX, 1))


def pieces(text: Column) -> Column:
    """What is compared of a text: its header lines, its paragraphs with a header line and, if it is mainly licence text, the whole; comment marks go."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:(?://+|#+|/\*+|\*+/?|--+|;+)\s*)+|\s*\*/\s*$", "")))
    plain = F.array_join(lines, "\n")
    paragraphs = F.transform(F.split(plain, r"\n\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    whole = F.when(mainly_licence(text) | (F.size(F.filter(paragraphs, lambda x: x.rlike(HEADER))) > 1), F.array(F.trim(F.regexp_replace(plain, r"\s+", " ")))).otherwise(F.array())
    found = F.filter(F.concat(lines, paragraphs, whole), lambda x: x.rlike(HEADER))
    return F.array_distinct(F.transform(found, lambda x: F.when(spdx(x) != "", F.regexp_replace(x, r"(?i)(-only|-or-later|\+)(?=[^\w.+-]|$)", "")).otherwise(x)))


def _vectors(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(k, token, w) with unit length: term counts times weights."""
    counts = rows.select("k", F.explode(tokens(F.col("line"))).alias("token")).groupBy("k", "token").agg(F.count("*").alias("tf"))
    raw = counts.join(weights, "token").withColumn("w", F.col("tf") * F.col("idf"))
    return raw.join(raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size")), "k").select("k", "token", (F.col("w") / F.col("size")).alias("w"))


def header_licences(spark: SparkSession, lines: DataFrame, least: float) -> DataFrame:
    """(line, license, score): the closest template of each different header line, if its cosine reaches ``least``.

    Inverse document frequencies count the lines of all files and the templates; of equal cosines the first name wins."""
    literal = F.array(*[F.struct(F.lit(f"{n}#{i}").alias("k"), F.lit(x).alias("line")) for i, (n, x) in enumerate(TEMPLATES)])
    templates = spark.range(1).select(F.inline(literal))
    kinds = written(lines.groupBy("line").agg(F.count("*").alias("n")).withColumn("k", F.monotonically_increasing_id()))  # written, so numbers stay
    seen = kinds.select("n", F.explode(F.array_distinct(tokens(F.col("line")))).alias("token")).unionByName(templates.select(F.lit(1).cast("long").alias("n"), F.explode(F.array_distinct(tokens(F.col("line")))).alias("token")))
    total = (kinds.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES)
    weights = written(seen.groupBy("token").agg(F.sum("n").alias("df")).select("token", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")))
    target = F.broadcast(_vectors(templates, weights).select("token", F.substring_index("k", "#", 1).alias("license"), F.col("k").alias("template"), F.col("w").alias("v")))  # as large as TEMPLATES
    # a tag's licence alone counts, and a template of another version does not
    names = kinds.select("k", versions(F.col("line")).alias("said"), spdx(F.col("line")).alias("tag"))
    forms = F.broadcast(templates.select(F.col("k").alias("template"), versions(F.col("line")).alias("own")))  # as large as TEMPLATES
    cosine = _vectors(kinds, weights).join(target, "token").groupBy("k", "license", "template").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("score"))
    fits = (F.size("said") == 0) | (F.size("own") == 0) | F.arrays_overlap("said", "own")
    cosine = cosine.join(names, "k").join(forms, "template").where(F.when(F.col("tag") != "", F.col("tag") == F.lower("license")).otherwise(fits)).select("k", "license", "template", "score")
    best = cosine.groupBy("k").agg(F.max("score").alias("s"))
    best = cosine.join(best, "k").where("score = s").groupBy("k", "score").agg(F.min("license").alias("license")).where(F.col("score") >= least)
    return kinds.join(best, "k").select("line", "license", "score")


def mainly_licence(text: Column) -> Column:
    """Whether header lines make up half of the text or more."""
    heads = F.filter(F.split(text, "\n"), lambda x: x.rlike(HEADER))
    return text.rlike(HEADER) & (2 * F.length(F.array_join(heads, "")) >= F.length(text))


def scan_licenses(files: DataFrame, least: float = 0.5, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Licences of files: path, license, score, origin, from_path.

    Header lines anywhere in a file, paragraphs with one and texts that are licence text are matched to templates by TF-IDF cosine, unless they
    name another version; an SPDX tag counts for the licence that it names. The best match of a file is its own licence (origin 'header',
    or 'licence file' for a file so named). A file without one takes that of the licence file in the nearest directory above (origin
    'inherited', from_path names that directory). Files with neither are left out.

    Null and empty texts have no header but may inherit; a null path has no directory. Several licence files in one directory: highest score, then
    first licence and path. Rows that repeat a path count as one file. Empty tables give no rows. Other columns are ignored.
    """
    spark = files.sparkSession
    every = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    lines = written(every.where(F.col("text").rlike(HEADER)).select("path", F.explode(pieces(F.col("text"))).alias("line")))
    own = lines.join(header_licences(spark, lines, least), "line")
    order = W.partitionBy("path").orderBy(F.desc("score"), "license")
    own = written(own.select("path", "license", "score").distinct().withColumn("r", F.row_number().over(order)).where("r = 1").drop("r"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    order = W.partitionBy("dir").orderBy(F.desc("score"), "license", "path")
    dirs = own.where(F.col("path").rlike(LICENCE_FILE)).withColumn("dir", folder).withColumn("r", F.row_number().over(order)).where("r = 1").select("dir", "license", "score")
    dirs = written(dirs)
    origin = F.when(F.col("path").rlike(LICENCE_FILE), "licence file").otherwise("header")
    out = own.select("path", "license", "score", origin.alias("origin"), F.col("path").alias("from_path"))
    count = dirs.count()
    if not count:
        return out
    bare = every.select("path").where("path IS NOT NULL").distinct().join(own.select("path"), "path", "left_anti")
    parts = F.split(folder, "/")
    above = bare.withColumn("parts", parts).select("path", F.explode(F.expr("transform(sequence(0, size(parts)), k -> named_struct('depth', k, 'dir', array_join(slice(parts, 1, k), '/')))")).alias("a"))
    near = above.select("path", "a.depth", "a.dir").join(F.broadcast(dirs) if count <= BROADCAST_ROWS else dirs, "dir").groupBy("path").agg(F.max_by(F.struct("license", "score", "dir"), "depth").alias("x"))
    return out.unionByName(near.select("path", "x.license", "x.score", F.lit("inherited").alias("origin"), F.col("x.dir").alias("from_path")))
