"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling word k-gram hashes are joined to the positions where templates hold
the same k-gram.  A hit votes for the diagonal (place in the text less place in the
template): a copied template puts all its votes on one diagonal, inserted or lost words
move the rest to a neighbour.  Diagonals of a document and template no further apart than
``max_shift`` merge into a span, and a span is verified: the template's words its hits
cover must reach ``min_cover`` of the template, the first word of every number (a version
tells templates apart) must be among them, and the span may not be longer than twice the
template.  So a notice without a version, or of another one, isn't the template's.  The label is the template's; the score is the best cover.

Templates are fixed and few, so their table is broadcast (its size is checked); votes are
counted before they are shuffled.  The contract's base phrases are counted at every place
in the text and add their own labels.

Defined cases: null or blank text has no words, no labels and score 0; a document's
repeated rows (same id and text) get the same result each; templates shorter than k words
match as one gram; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: What separates words, and the phrases of the base count.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices by which works are licensed.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or
        altered from any source distribution.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
        SUCH DAMAGE.""",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


#: The largest table of template positions that is broadcast.
MAX_GRAMS = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATOR), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hashes of the rolling k-grams; an array shorter than k has none."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]),
    )


def template_rows(templates: dict[str, list[str]], k: int) -> list[tuple[int, str, list[str], list[int]]]:
    """(number, label, words, musts) of each template; musts are the places of the words that a span has
    to cover."""
    rows = []
    for label, texts in templates.items():
        for text in texts:
            words = [w for w in re.split(SEPARATOR, text.lower()) if w]
            if len(words) < k:
                raise ValueError(f"a template of {label} has under {k} words")
            rows.append((len(rows), label, words, [i for i, w in enumerate(words) if w.isdigit() and not (i and words[i - 1].isdigit())]))
    return rows


def template_positions(spark, templates: dict[str, list[str]], k: int) -> DataFrame:
    """(template, label, t_words, musts, t_pos, h), one row per k-gram."""
    rows = template_rows(templates, k)
    if sum(len(r[2]) for r in rows) > MAX_GRAMS:
        raise ValueError(f"templates have over {MAX_GRAMS} words; they would not fit a broadcast")
    t = spark.createDataFrame(rows, "template int, label string, words array<string>, musts array<int>")
    return t.select("template", "label", F.size("words").alias("t_words"), "musts", F.posexplode(grams(F.col("words"), k)).alias("t_pos", "h"))


def spans(docs: DataFrame, templates=TEMPLATES, k=4, max_shift=3, min_cover=0.75, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, doc_hash, label, template, first_word, last_word, cover) of the verified spans."""
    positions = template_positions(docs.sparkSession, templates, k)
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("doc_hash"),
        F.posexplode(let(words_of(F.coalesce(F.col(text_col), F.lit(""))), lambda w: grams(w, k))).alias("pos", "h"),
    )
    hits = d.join(F.broadcast(positions), "h").select(
        "doc_id", "doc_hash", "template", "label", "t_words", "musts", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal")
    )
    group = ["doc_id", "doc_hash", "template", "label", "t_words", "musts"]
    lines = hits.groupBy(*group, "diagonal").agg(F.collect_set("t_pos").alias("places"), F.min("pos").alias("a"), F.max("pos").alias("z"))
    w = Window.partitionBy("doc_id", "doc_hash", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > max_shift).cast("int"), F.lit(0))
    lines = lines.withColumn("apart", apart).withColumn("span", F.sum("apart").over(w))
    merged = lines.groupBy(*group, "span").agg(F.flatten(F.collect_list("places")).alias("places"), F.min("a").alias("a"), (F.max("z") + k - 1).alias("z"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1)))))
    merged = merged.withColumn("covered", covered).withColumn("cover", F.size("covered") / F.col("t_words"))
    good = (F.col("cover") >= min_cover) & (F.size(F.array_except("musts", "covered")) == 0) & (F.col("z") - F.col("a") + 1 <= 2 * F.col("t_words"))
    return merged.where(good).select("doc_id", "doc_hash", "label", "template", F.col("a").alias("first_word"), F.col("z").alias("last_word"), "cover")


def scan(docs: DataFrame, templates=TEMPLATES, k=4, max_shift=3, min_cover=0.75, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    found = (
        spans(docs, templates, k, max_shift, min_cover, id_col, text_col)
        .groupBy("doc_id", "doc_hash")
        .agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
        .select(F.col("doc_id").alias("doc_id2"), F.col("doc_hash").alias("doc_hash2"), "more", "cover")
    )

    def places(w: Column, phrase: str) -> Column:
        first, *rest = phrase.split()
        here = lambda x, i: x == first
        hit = lambda x, i: F.when(
            here(x, i) & F.lit(True) if not rest else _all(here(x, i), *[F.coalesce(F.get(w, i + j) == r, F.lit(False)) for j, r in enumerate(rest, 1)]), i
        )
        return F.filter(F.transform(w, hit), lambda i: i.isNotNull())

    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("doc_hash"),
        let(
            words_of(F.coalesce(F.col(text_col), F.lit(""))),
            lambda w: F.struct(F.size(w).alias("n"), *[places(w, p).alias(f"p{i}") for i, p in enumerate(PHRASES.values())]),
        ).alias("w"),
    )
    lists = [F.col(f"w.p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(k)) for k, x in zip(PHRASES, lists, strict=True)]))
    every = F.concat(*lists)
    d = d.select("doc_id", "doc_hash", F.col("w.n").alias("n"), every.alias("every"), base.alias("base"))
    d = d.join(found, d.doc_id.eqNullSafe(F.col("doc_id2")) & (F.col("doc_hash") == F.col("doc_hash2")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("cover", F.lit(0.0)).alias("score"),
    )


def _all(first: Column, *rest: Column) -> Column:
    for r in rest:
        first = first & r
    return first
