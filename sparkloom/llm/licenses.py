"""Licence scans: phrases that name a licence, and an exact set-similarity join of text blocks with notice templates.

A document's words are cut into blocks that overlap by half. A block has twice as many words as the longest template of
its kind (templates of up to 8, 16, 32 ... words are a kind), so any place where a template can stand lies
wholly in one block, whatever the template's length. A template is found where a block's set of words contains at least
``containment`` of the template's. The join works on words in a global order: by how many documents of the
whole table hold them, rarest first. A block's words that are in templates, and each template's words, are sorted so.

- Prefix: a block can only reach the threshold for a template if it holds a word of the template's prefix (its
  first words, as many as may be missing, and one more). Words of prefixes index the templates.
- Length: the block needs as many template words as the threshold.
- Position: at the first common word, what is left of the block's words and of the template's, this
  one included, must still reach the threshold.

What remains is counted exactly. Before blocks are cut, a document must hold enough of a template's words as a whole,
which loses nothing. Everything is made of DataFrame functions; the templates are a fixed list, so their index is broadcast.
The word text is made once and written to the shared folder; counts, blocks and phrases read it there.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored

#: Phrases that count as base findings, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Texts of licences, and notices by which a licence is commonly applied. Only their words count.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial License",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ],
}
CONTAINMENT = 0.9
#: Fixed: what separates words, as a pattern of single bytes below 128.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_text(text: Column) -> Column:
    """The words, each with one space before it and one space after the last; the empty text for no words."""
    # two letters beyond A-Z become ASCII when lowered; others stand in for them, as they are no letters of a phrase
    kept = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    words = F.trim(F.regexp_replace(F.lower(kept), BREAKS, " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words_in(text: Column) -> Column:
    """Words of a piece of word text: every word has a space after it."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def stride(words: list[str]) -> int:
    """Half a block for a template of so many words: the next power of two, 8 at least."""
    return max(8, 1 << (len(words) - 1).bit_length())


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def template_index(rows: DataFrame, templates: dict[str, list[str]], containment: float) -> tuple[list[str], list[dict]]:
    """(all template words in the global order, rarest first; each template with its words so and the number that must be there).

    ``rows`` has ``known``, the template words of each document: counts as many rows as the fixed list has words.
    """
    often = {r["word"]: r["count"] for r in rows.select(F.explode("known").alias("word")).groupBy("word").count().collect()}
    rank = lambda w: (often.get(w, 0), w)
    out = []
    for label, group in sorted(templates.items()):
        for words in map(template_words, group):
            ordered = sorted(set(words), key=rank)
            out.append({"no": len(out), "label": label, "words": ordered, "need": math.ceil(containment * len(ordered) - 1e-9), "step": stride(words)})
    return sorted({w for t in out for w in t["words"]}, key=rank), out


def block_pairs(rows: DataFrame, order: list[str], index: list[dict], positional: bool = True) -> DataFrame:
    """(doc_id, block, step, template, label, size, need, have, words): each block and template left by the filters.

    ``rows`` has doc_id, wt and known. Blocks of 2 * step words start at every multiple of step.
    """
    enough = lambda t: F.size(F.array_intersect("known", _strings(t["words"]))) >= t["need"]
    kinds = {step: [t for t in index if t["step"] == step] for step in sorted({t["step"] for t in index})}
    steps = F.array_compact(F.array(*(F.when(sum((enough(t).cast("int") for t in group), F.lit(0)) > 0, F.lit(step)) for step, group in kinds.items())))
    prefixes = [(w, at, len(t["words"]), t["need"], t["no"], t["label"], t["words"], t["step"]) for t in index for at, w in enumerate(t["words"][: len(t["words"]) - t["need"] + 1])]
    prefix = rows.sparkSession.createDataFrame(prefixes, "word string, at int, size int, need int, template int, label string, words array<string>, step int")
    able = rows.where(F.arrays_overlap("known", _strings(sorted({p[0] for p in prefixes})))).select("doc_id", F.split(F.trim("wt"), " ").alias("all"), F.explode(steps).alias("step"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 1), F.col("step"))
    blocks = able.select("doc_id", "step", "all", F.posexplode(starts).alias("block", "start"))
    blocks = blocks.select("doc_id", "step", "block", F.array_intersect(_strings(order), F.slice("all", F.col("start") + 1, 2 * F.col("step"))).alias("have"))
    tokens = blocks.select("doc_id", "step", "block", "have", F.posexplode("have").alias("nth", "word"))
    pairs = tokens.join(F.broadcast(prefix), ["word", "step"]).where(F.size("have") >= F.col("need"))
    # the first common word in the order speaks for the pair
    pairs = pairs.where(F.when(F.col("at") == 0, F.lit(0)).otherwise(F.size(F.array_intersect("have", F.slice("words", 1, F.col("at"))))) == 0)
    if positional:
        pairs = pairs.where(F.least(F.size("have") - F.col("nth"), F.col("size") - F.col("at")) >= F.col("need"))
    return pairs.select("doc_id", "block", "step", "template", "label", "size", "need", "have", "words")


def find_blocks(rows: DataFrame, order: list[str], index: list[dict]) -> DataFrame:
    """(doc_id, block, step, label, template, common, containment) of every block and template at or above the threshold."""
    pairs = block_pairs(rows, order, index).withColumn("common", F.size(F.array_intersect("have", "words")))
    return pairs.where("common >= need").select("doc_id", "block", "step", "label", "template", "common", (F.col("common") / F.col("size")).alias("containment"))


def word_rows(docs: DataFrame, templates: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, wt, known), written to the shared folder: word text, its hash, and the template words in it."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", word_text(F.col("text")).alias("wt"))
    vocabulary = sorted({w for group in templates.values() for t in group for w in template_words(t)})
    return stored(rows.select("doc_id", F.xxhash64("wt").alias("h"), "wt", F.array_intersect(_strings(vocabulary), F.split(F.trim("wt"), " ")).alias("known")), "words")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each of ``docs``.

    ``score`` is the best containment, 1 if a phrase is there. A null or empty text has no words, no
    labels (empty strings) and score 0. Rows that agree in id and text have equal findings; rows of one id and different
    texts have their own. Other columns are not read.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    rows = word_rows(docs, templates, id_col, text_col)
    keyed = rows.select(F.struct("doc_id", "h").alias("doc_id"), "wt", "known")
    found = find_blocks(keyed, *template_index(rows, templates, containment))
    found = found.groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))  # a set of at most as many labels as there are

    n_words = F.greatest(F.lit(0).cast("long"), _words_in(F.col("wt")) - 1)
    cols, count, firsts, lasts, labels = [], F.lit(0).cast("long"), [], [], []
    for k, (phrase, label) in enumerate(phrases.items()):
        # between two findings at least one space is shared, so look for the phrase with the space before it and a space ahead
        pieces = F.split("wt", f" {phrase}(?= )")
        there = F.contains("wt", F.lit(f" {phrase} "))
        cols.append(F.when(there, F.struct((F.size(pieces) - 1).cast("long").alias("n"), _words_in(F.element_at(pieces, 1)).alias("first"), _words_in(F.element_at(pieces, -1)).alias("after"))).alias(f"p{k}"))
        count = count + F.coalesce(F.col(f"p{k}.n"), F.lit(0))
        size = len(phrase.split())
        firsts.append(F.col(f"p{k}.first"))
        lasts.append(F.col("n_words") - (F.col(f"p{k}.after") - 1) - size)
        labels.append(F.when(F.col(f"p{k}").isNotNull(), F.lit(label)))
    base = rows.select("doc_id", "h", n_words.alias("n_words"), *cols)
    own = F.array_compact(F.array(*labels))
    base = base.select("doc_id", "h", "n_words", count.alias("n_base"), F.array_min(F.array_compact(F.array(*firsts))).alias("first_word"), F.array_max(F.array_compact(F.array(*lasts))).alias("last_word"), own.alias("own"))
    b, f = base.alias("b"), found.alias("f")
    joined = b.join(f, F.col("b.doc_id").eqNullSafe(F.col("f.doc_id.doc_id")) & (F.col("b.h") == F.col("f.doc_id.h")), "left")
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("own")).alias("base_labels"),
        join(F.concat(F.col("own"), F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same rows without filters: every block against every template, phrases by place."""
    q = lambda s: "'" + s + "'"
    temps = ", ".join(f"({q(label)}, {stride(w)}, [{', '.join(map(q, sorted(set(w))))}])" for label, group in sorted(TEMPLATES.items()) for w in map(template_words, group))
    phrase_rows = ", ".join(f"({q(label)}, [{', '.join(map(q, p.split()))}])" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(label, step, words) AS (VALUES {temps}), p(label, words) AS (VALUES {phrase_rows}),
k AS (SELECT doc_id, w, step, unnest(range(0, len(w), step)) AS pos FROM d, (SELECT DISTINCT step FROM t) WHERE len(w) > 0),
b AS (SELECT doc_id, step, list_distinct(w[pos + 1:pos + 2 * step]) AS have FROM k),
m AS (SELECT doc_id, label, len(list_intersect(have, words)) / len(words) AS c, len(list_intersect(have, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9) AS ok FROM b JOIN t USING (step)),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS best FROM m WHERE ok GROUP BY doc_id),
i AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d),
h AS (SELECT doc_id, pos, label FROM i, p WHERE w[pos + 1:pos + len(words)] = words),
a AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN g USING (doc_id)
"""
