"""License scans, in DataFrame functions only.

Templates are titles, notices, header texts and whole licences. A line is compared with titles and notices; a
window of as many words as the template has slides over the words of the whole file, whatever lines and comment
marks are between, for the others. The measure is the sparse TF-IDF cosine: a unit's words are joined to the
postings of the templates of its length, and products are summed. Lines and short windows are candidates if they have one of
the anchor words, others if they have as many of the templates' words as the cosine takes at least. Files without a
licence of their own inherit that of the licence file in their nearest ancestor directory, found by
joining all ancestors of each directory to the directories that have one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from importlib.resources import files as _resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Usual licence notices.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Distributed under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Use of this source code is governed by the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."),
    "MPL-2.0": ("Subject to the terms of the Mozilla Public License, Version 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "Proprietary": ("Copyright. All rights reserved.", "All rights reserved."),
}
#: Compared with whole lines only, as running text has them too.
TITLES = {
    "MIT": ("MIT License", "The MIT License (MIT)"),
    "Apache-2.0": ("Apache License 2.0", "Apache License Version 2.0"),
    "GPL-3.0": ("GNU General Public License Version 3",),
    "GPL-2.0": ("GNU General Public License Version 2",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
_GNU = "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program."
HEADERS = {
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',),
    "GPL-3.0": (_GNU.format(it="This program", name="General Public License", n=3),),
    "GPL-2.0": (_GNU.format(it="This program", name="General Public License", n=2),),
    "LGPL-3.0": (_GNU.format(it="This library", name="Lesser General Public License", n=3),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
}
#: Licences with their whole text in ``license_texts``.
WHOLE = ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
#: Counts only where no other licence is found: texts of licences have such lines as well.
LAST = "Proprietary"
ANCHORS = ("license", "licence", "licensed", "licenced", "copyright", "cc0", "rights", "permission", "redistribution", "spdx", "redistribute")
#: Longer windows start at each eighth of their length, and need no anchor word in them.
SHORT = 32
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
COSINE = 0.7
_WORD = "[a-z0-9.+]*[a-z0-9+]"


def templates() -> list[tuple[str, str, bool]]:
    """Licence, text, and whether it is compared with lines only."""
    out = [(x, t, True) for x, ts in TITLES.items() for t in ts]
    out += [(x, t, False) for table in (NOTICES, HEADERS) for x, ts in table.items() for t in ts]
    for x in NOTICES:
        if x != LAST:
            tags = [x, f"{x}-only", f"{x}-or-later"] if "GPL" in x else [x]
            out += [(x, f"SPDX-License-Identifier: {tag}", False) for tag in tags]
    return out + [(x, _resources(__package__).joinpath("license_texts", f"{x}.txt").read_text(), False) for x in WHOLE]


def _vectors(given: Sequence[tuple[str, str, bool]], cosine: float) -> tuple[dict[str, float], list, list]:
    """IDF; postings ``word, size, template, weight``; for each size (0: lines) the least number of its words that a match has, and the words."""
    counts = [Counter(re.findall(_WORD, t.lower())) for _, t, _ in given]
    seen = Counter(w for c in counts for w in c)
    idf = {w: 1 + math.log((1 + len(given)) / (1 + n)) for w, n in seen.items()}
    postings, sizes = {}, {}
    for k, ((_, _, line), tf) in enumerate(zip(given, counts, strict=True)):
        n = tf.total()
        raw = {w: (1 + math.log(m)) * idf[w] for w, m in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        part, least = 0.0, 0
        for x in sorted(raw.values(), reverse=True):
            if part >= (cosine * norm) ** 2 * (1 - 1e-6):
                break
            part, least = part + x * x, least + 1
        for size in [0] * (n <= SHORT) + [n] * (not line):
            postings |= {(w, size, k): x / norm for w, x in raw.items()}
            low, words = sizes.get(size, (least, set()))
            sizes[size] = (min(low, least), words | set(raw))
    return idf, [(*key, x) for key, x in postings.items()], [(size, low, sorted(words)) for size, (low, words) in sizes.items()]


def _anchors(given: Sequence[tuple[str, str, bool]], idf: dict[str, float]) -> list[str]:
    """The usual anchors, and the rarest word of each template that has none of them."""
    rest = [words for _, t, _ in given if (words := set(re.findall(_WORD, t.lower()))) and not words & set(ANCHORS)]
    return [*ANCHORS, *sorted({max(words, key=lambda w: (idf[w], w)) for words in rest})]


def _units(plain: DataFrame, sizes: list, anchor_words: list[str]) -> DataFrame:
    """``doc_id, path, h, size, start, line, words`` of the lines and windows that can match."""
    spark = plain.sparkSession
    some = "(?i)(?<![a-z0-9.+])(" + "|".join(map(re.escape, anchor_words)) + ")(?![a-z0-9+])" if anchor_words[len(ANCHORS) :] else "(?i)\\b(" + "|".join(ANCHORS) + ")\\b"
    texts = plain.filter(F.col("text").rlike(some)).withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "path", "h"])
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))
    key = ["doc_id", "path", "h"]
    anchors = F.array(*[F.lit(x) for x in anchor_words])
    by_size = spark.createDataFrame(sizes, "size int, least int, vocabulary array<string>")
    _, least, vocabulary = next(x for x in sizes if x[0] == 0)
    enough = lambda words, vocabulary, least: F.size(F.array_intersect(words, vocabulary)) >= least
    lines = texts.select(*key, F.posexplode(F.split("text", "\n")).alias("line", "content")).filter(F.col("content").rlike(some))
    lines = lines.select(*key, F.lit(0).alias("size"), F.col("line").alias("start"), "line", split(F.col("content")).alias("words"))
    lines = lines.filter(enough(F.col("words"), F.array(*[F.lit(w) for w in vocabulary]), F.lit(least)))
    tagged = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(split(x), lambda w: F.struct(w.alias("w"), i.alias("i")))))
    whole = texts.select(*key, tagged.alias("t")).select(*key, F.col("t.w").alias("all"), F.col("t.i").alias("at"))
    marks = F.filter(F.transform("all", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    whole = whole.withColumn("n", F.size("all")).withColumn("marks", marks)
    whole = whole.join(F.broadcast(by_size.filter("size > 0")), F.col("n") >= F.col("least"))
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    around = F.array_distinct(F.flatten(F.transform("marks", lambda p: F.sequence(F.least(F.greatest(p - F.col("size") + 1, F.lit(0)), last), F.least(p, last)))))
    grid = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.greatest(F.col("size") / 8, F.lit(1)).cast("int")), F.array(last)))
    starts = F.when(F.col("size") <= SHORT, around).otherwise(grid)
    windows = whole.select(*key, "size", "least", "vocabulary", "all", "at", F.explode(starts).alias("start"))
    windows = windows.withColumn("words", F.slice("all", F.col("start") + 1, F.col("size"))).filter(enough(F.col("words"), F.col("vocabulary"), F.col("least")))
    return lines.unionByName(windows.select(*key, "size", "start", F.col("at")[F.col("start")].alias("line"), "words"))


def scan(files: DataFrame, given: Sequence[tuple[str, str, bool]] | None = None, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """``doc_id, path, own_license, own_cosine, line, license, inherited_from`` of every row.

    ``own_license`` is the licence of the template with the highest cosine (rounded to 6 places) over all lines and
    windows of the whole text, from ``cosine`` up, ``LAST`` only if there is no other; ties go to the earlier line, then
    to the licence's name. ``line`` is that of the first word. A word that a unit has n times counts 1 + ln(n).
    ``license`` is that, or
    else the one of the nearest ancestor directory with a licence file, named in ``inherited_from``; where a
    directory has several, the highest cosine counts, then the smaller path. Null texts have none of their
    own, null paths inherit none. Rows that share id and path share the best of their lines. An empty table gives an
    empty result. Other columns are not read.
    """
    given = given_templates = templates() if given is None else given
    idf, postings, sizes = _vectors(given, cosine)
    rare = 1 + math.log(1 + len(given))
    spark = files.sparkSession
    # as many rows as the templates have words
    table = spark.createDataFrame([(w, size, given[k][0], k, x) for w, size, k, x in postings], "word string, size int, template string, k int, weight double")
    idfs = spark.createDataFrame(list(idf.items()), "word string, idf double")
    plain = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    key = ["doc_id", "path", "h", "size", "start", "line"]
    words = _units(plain, sizes, _anchors(given_templates, idf)).select(*key, F.explode("words").alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    words = words.join(F.broadcast(idfs), "word", "left").select(*key, "word", ((1 + F.log("n")) * F.coalesce("idf", F.lit(rare))).alias("w"))
    words = written(words, "licenses-words")
    norms = words.groupBy(*[F.col(c).alias(f"n_{c}") for c in key]).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = words.join(F.broadcast(table), ["word", "size"]).groupBy(*key, "template", "k").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = lambda prefix, names: [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names]
    found = dots.join(norms, same("n_", key)).select(*key, "template", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).filter(F.col("cosine") >= cosine)
    best = found.groupBy("doc_id", "path").agg(F.min(F.struct((F.col("template") == LAST).alias("last"), (-F.col("cosine")).alias("c"), F.col("line"), F.col("template"))).alias("b"))
    own = best.select("doc_id", "path", F.col("b.template").alias("own_license"), (-F.col("b.c")).alias("own_cosine"), F.col("b.line").alias("line"))
    listed = plain.select("doc_id", "path")
    named = own.select(F.col("doc_id").alias("o_doc_id"), F.col("path").alias("o_path"), "own_license", "own_cosine", "line")
    rows = listed.join(named, same("o_", ["doc_id", "path"]), "left").select("doc_id", "path", "own_license", "own_cosine", "line", _directory(F.col("path")).alias("directory"))
    given = own.filter(F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAMES)).groupBy(_directory(F.col("path")).alias("from_directory")).agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("path"), F.col("own_license"))).alias("g"))
    given = given.select("from_directory", F.col("g.own_license").alias("given"))
    directories = listed.select(_directory(F.col("path")).alias("directory")).filter("directory is not null").distinct()
    above = directories.select("directory", F.explode(_ancestors(F.col("directory"))).alias("from_directory"))
    nearest = above.join(given, "from_directory").groupBy("directory").agg(F.max_by(F.struct("from_directory", "given"), F.length("from_directory")).alias("n"))
    nearest = nearest.select(F.col("directory").alias("d"), F.col("n.from_directory").alias("from_directory"), F.col("n.given").alias("given"))
    out = rows.join(nearest, F.col("directory") == F.col("d"), "left")
    return out.select("doc_id", "path", "own_license", "own_cosine", "line", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("from_directory")).alias("inherited_from"))


def _directory(path: Column) -> Column:
    """``a/b/c`` is in ``a/b/``; a bare name in the empty directory."""
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def _ancestors(directory: Column) -> Column:
    """The directory itself and all above it, down to the empty one."""
    steps = F.split(directory, "/")
    n = F.size(steps)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
