"""Licence texts in documents: Dice coefficient over word bigrams against templates, DataFrame functions only.

A text is normalised to lower-case words, so wrapping, comment marks and punctuation don't matter. Its passages are the
windows as long as a template, at every word that begins one of the template's bigrams. With bags of bigrams, the size of
a window is known beforehand, and an occurrence of a bigram counts for the windows that begin after its c-th predecessor,
c being how often the template has it; so one sweep over such intervals gives the overlap of every window without
comparing them one by one. Templates that the size bounds exclude go first: a text must hold a telling word, and two
thirds of a template's bigrams. Of overlapping windows the best one is reported.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8
# The texts by which these licences are declared. GNU headers are made by the rule below.
GNU_HEADER = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {family}General Public License as published by the Free Software "
    "Foundation, {version}. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {family}General Public License for more details."
)
GNU = [("GPL", "", "2", "program"), ("GPL", "", "3", "program"), ("LGPL", "Lesser ", "2.1", "library"), ("LGPL", "Lesser ", "3", "library"), ("AGPL", "Affero ", "3", "program")]
DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", MIT.partition(", including")[0]),
    ("MIT", MIT),
    ("MIT", f"{MIT} {DISCLAIMER}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((f"{name}-{v}{'.0' * ('.' not in v)}", f"This work is licensed under the GNU {family}General Public License, version {v}.") for name, family, v, _ in GNU),
    *((f"{name}-{v}{'.0' * ('.' not in v)}", GNU_HEADER.format(thing=thing, family=family, version=f"either version {v} of the License, or (at your option) any later version").partition(f" This {thing} is distributed")[0]) for name, family, v, thing in GNU),
    *((f"{name}-{v}{'.0' * ('.' not in v)}", GNU_HEADER.format(thing=thing, family=family, version=f"either version {v} of the License, or (at your option) any later version")) for name, family, v, thing in GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + BSD_THIRD),
    ("ISC", ISC.partition(", provided")[0]),
    ("ISC", ISC),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


#: Words too common in any English text to tell a licence.
COMMON = frozenset("a an and any are as at be by do for free from have if in is it its may no not of on or permitted so subject that the this to under use used version with without work".split())


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_grams(text: str) -> Counter:
    w = template_words(text)
    return Counter(" ".join(p) for p in zip(w, w[1:], strict=False))


def least_shared(n: int, threshold: float) -> int:
    """The least overlap with n bigrams that can reach the threshold: the passage then consists of nothing else."""
    return next(m for m in range(1, n + 1) if 2 * m >= threshold * (n + m) - 1e-9)


def telling_words(grams: list[Counter], threshold: float) -> list[str]:
    """Few words one of which any matching passage must hold: so many of a template's bigrams touch one of them that the
    others alone fall short of the least overlap."""
    left = {i: sum(g.values()) - least_shared(sum(g.values()), threshold) + 1 for i, g in enumerate(grams)}
    rest, chosen = {i: Counter(g) for i, g in enumerate(grams)}, []
    while left:
        gain: Counter = Counter()
        for i in left:
            for gram, n in rest[i].items():
                for w in set(gram.split(" ")):
                    gain[w] += n * (w.isalpha() and w not in COMMON)
        word = min(gain, key=lambda w: (-gain[w], w))
        if not gain[word]:
            return []  # no filter fits every template
        chosen.append(word)
        for i in list(left):
            hit = [g for g in rest[i] if word in g.split(" ")]
            left[i] -= sum(rest[i].pop(g) for g in hit)
            if left[i] <= 0:
                del left[i]
    return [w for w in chosen if not any(len(o) > 3 and o != w and o in w for o in chosen)]


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each doc_id row and passage that a template matches: doc_id, start, words, license, dice.

    start counts the text's words of letters a to z and digits, from 0. A window at the end of a text may be shorter
    than its template. Of windows of a template that overlap in a chain the highest coefficient wins, then the first;
    a passage goes if one of another template overlaps it and is better (by coefficient, then number of words, then
    name). Null and empty texts, texts of fewer than two words, empty tables and an empty list of templates give no rows;
    repeated rows give repeated matches; very long texts are scanned whole; other columns are ignored.
    """
    spark, result = docs.sparkSession, "doc_id long, start int, words int, license string, dice double"
    known = [(i, name, template_words(t), template_grams(t)) for i, (name, t) in enumerate(templates)]
    known = [k for k in known if len(k[2]) > 1]
    if not known:
        return spark.createDataFrame([], result)
    least = [least_shared(len(w) - 1, threshold) for _, _, w, _ in known]
    grams = spark.createDataFrame([(i, g, c) for i, _, _, own in known for g, c in sorted(own.items())], "template int, gram string, times int")
    shape = spark.createDataFrame([(i, name, len(w), m) for (i, name, w, _), m in zip(known, least, strict=True)], "template int, license string, size int, least int")
    telling = telling_words([own for *_, own in known], threshold)
    lower = F.lower("text")
    may = F.lit(not telling)
    for w in telling:
        may = may | (lower.contains(w) if len(w) > 3 else lower.contains(w) & lower.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])"))
    rows = docs.select("doc_id", "text").filter(F.length("text") > 2 * min(least)).filter(may)
    # the row's number has to outlive lost executors, so it is stored
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_array(F.col("text")).alias("w")).filter(F.size("w") > min(least)), "licensed")
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    every = rows.select("row", "doc_id", (F.size("w") - 1).alias("n"), F.posexplode(pairs).alias("at", "gram"))
    hits = every.join(F.broadcast(grams), "gram").join(F.broadcast(shape), "template")  # as many rows as the templates have words
    key = ["row", "doc_id", "n", "template", "size", "least", "license"]
    own = Window.partitionBy("row", "template", "gram").orderBy("at")
    # an occurrence counts in the windows from behind its `times`-th predecessor up to itself, if they are long enough
    ranked = hits.withColumn("k", F.row_number().over(own))
    before = ranked.select("row", "template", "gram", (F.col("k") + F.col("times")).alias("k"), F.col("at").alias("earlier"))
    spans = ranked.join(before, ["row", "template", "gram", "k"], "left")
    first = F.greatest(F.coalesce(F.col("earlier") + 1, F.lit(0)), F.col("at") - F.col("size") + 2, F.lit(0))
    edges = F.array(F.struct(first.alias("p"), F.lit(1).alias("d"), F.lit(False).alias("start")), F.struct((F.col("at") + 1).alias("p"), F.lit(-1).alias("d"), F.lit(False).alias("start")), F.struct(F.col("at").alias("p"), F.lit(0).alias("d"), F.lit(True).alias("start")))
    swept = spans.select(*key, F.explode(edges).alias("e")).select(*key, "e.p", "e.d", "e.start")
    sweep = Window.partitionBy("row", "template").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    shared = F.sum("d").over(sweep)
    swept = swept.withColumn("shared", shared).filter("start").drop("start", "d").distinct()
    size = F.col("size") - 1 + F.least(F.col("size") - 1, F.col("n") - F.col("p"))
    found = swept.filter("shared >= least").withColumn("dice", F.round(2 * F.col("shared") / size, 6)).filter(F.col("dice") >= threshold)
    found = found.withColumn("words", F.least(F.col("size"), F.col("n") + 1 - F.col("p")))
    in_order = Window.partitionBy("row", "template").orderBy("p")
    found = found.withColumn("new", F.coalesce((F.col("p") >= F.lag("p").over(in_order) + F.col("size")).cast("int"), F.lit(0)))
    found = found.withColumn("chain", F.sum("new").over(in_order))
    best = found.groupBy("row", "doc_id", "template", "license", "chain").agg(F.min(F.struct((-F.col("dice")).alias("o"), F.col("p").alias("start"), "words")).alias("b"))
    best = written(best.select("row", "doc_id", "template", "license", "b.start", "b.words", (-F.col("b.o")).alias("dice")), "passages")
    # equi-join on neighbouring buckets of the longest template's length: few passages of a template fit into one
    width = max(len(w) for _, _, w, _ in known)
    bucket = F.floor(F.col("start") / width)
    rival = best.select("row", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), *(F.col(c).alias(f"o_{c}") for c in ("template", "license", "start", "words", "dice")))
    overlaps = (F.col("o_start") < F.col("start") + F.col("words")) & (F.col("start") < F.col("o_start") + F.col("o_words"))
    rank = lambda p: F.struct((-F.col(f"{p}dice")).alias("a"), (-F.col(f"{p}words")).alias("b"), F.col(f"{p}license").alias("c"), F.col(f"{p}start").alias("d"), F.col(f"{p}template").alias("e"))
    beaten = best.withColumn("bucket", bucket).join(rival, ["row", "bucket"]).filter(overlaps & (rank("o_") < rank(""))).select("row", "template", "start").distinct()
    return best.join(beaten, ["row", "template", "start"], "left_anti").select("doc_id", "start", "words", "license", "dice")


ORACLE_SQL = r"""
WITH templates(template, license, body) AS (VALUES {values}),
t AS (SELECT template, license, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '') w FROM templates),
tg AS (SELECT template, license, len(w) size, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) gram FROM t),
tc AS (SELECT template, license, size, gram, count(*) times FROM tg GROUP BY ALL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, len(w) - 1 n, unnest(range(len(w) - 1)) pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) gram FROM d WHERE len(w) > 1),
h AS (SELECT doc_id, n, pos, gram, template, license, size, times FROM dg JOIN tc USING (gram)),
enough AS (SELECT doc_id, template FROM h GROUP BY doc_id, template HAVING count(*) * 3 >= 2 * (any_value(size) - 1) - 3),
g AS (SELECT s.doc_id, s.n, s.pos p, s.template, s.license, s.size, o.gram, least(count(*), any_value(o.times)) m FROM (SELECT DISTINCT doc_id, n, pos, template, license, size FROM h JOIN enough USING (doc_id, template)) s
  JOIN h o ON o.doc_id = s.doc_id AND o.template = s.template AND o.pos BETWEEN s.pos AND s.pos + s.size - 2 GROUP BY s.doc_id, s.n, s.pos, s.template, s.license, s.size, o.gram),
c AS (SELECT doc_id, n, p, template, license, size, round(2.0 * sum(m) / (size - 1 + least(size - 1, n - p)), 6) dice FROM g GROUP BY doc_id, n, p, template, license, size),
f AS (SELECT *, least(size, n + 1 - p) words, CASE WHEN p >= lag(p) OVER (PARTITION BY doc_id, template ORDER BY p) + size THEN 1 ELSE 0 END new FROM c WHERE dice >= 0.8),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY p) chain FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template, chain ORDER BY dice DESC, p) r FROM k),
a AS (SELECT doc_id, p, words, license, dice, template FROM b WHERE r = 1)
SELECT doc_id, CAST(p AS INTEGER) "start", CAST(words AS INTEGER) words, license, CAST(dice AS DOUBLE) dice FROM a WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.doc_id = a.doc_id
  AND o.p < a.p + a.words AND a.p < o.p + o.words AND (o.dice > a.dice OR o.dice = a.dice AND (o.words > a.words OR o.words = a.words AND (o.license < a.license OR o.license = a.license AND (o.p < a.p OR o.p = a.p AND o.template < a.template)))))
""".replace("{values}", ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES)))
