"""License scans by diagonal voting.

All rolling word k-grams of all texts meet the k-grams of the templates in a Spark join. A match
at word i of a text and word j of a template votes for the diagonal i - j; votes are summed per
(document, template, diagonal), neighbouring diagonals that overlap (a word put in or left out)
are merged into a span. A span is then verified: it must hold enough of the template's grams,
each counted once however often it votes, and enough of the words from its first to its last must
be words of the template. The join compares the words of the grams themselves beside their
hashes. The three base phrases are templates of two- and three-word grams that must match whole,
on one diagonal.

Only DataFrame functions are used, and no text is shuffled: grams that match nothing end at the
broadcast of the template grams, a table fixed in this file. A text in which one pattern of all
template grams finds nothing has no gram to match; its grams are not made.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.llm.common import whole_text

K = 4
#: Word shift within which diagonals merge, and the share that a span must have of the template's grams, and
#: that the template's words must have of the span.
SHIFT, COVER = 3, 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences of public licenses, and the labels they stand for.
TEMPLATES = (
    ("this work is licensed under the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty", "gpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    # Plain notices, whatever stands ahead of them (released, licensed, available).
    ("under the mit license", "mit"),
    ("apache license version 2 0", "apache-2.0"),
    ("apache license 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("under the gnu general public license", "gpl"),
    ("under the bsd license", "bsd"),
    ("under the isc license", "isc"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("mozilla public license v 2 0", "mpl-2.0"),
    ("mozilla public license 2 0", "mpl-2.0"),
    ("cc by 4 0", "cc-by-4.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0", "cc-by-4.0"),
    ("creative commons attribution noncommercial 4 0", "cc-by-nc-4.0"),
    ("creative commons attribution sharealike 4 0", "cc-by-sa-4.0"),
    ("under the unlicense license", "unlicense"),
    ("released under the unlicense", "unlicense"),
    ("licensed under the unlicense", "unlicense"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0-1.0"),
)

# Whole texts of short public licenses and whole file notices of long ones.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
    IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
    ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
    law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License.""", "apache-2.0"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details. You should have received a copy of the GNU General Public License along with this program. If not, see
    https://www.gnu.org/licenses/.""", "gpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "mpl-2.0"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
    purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
    restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
    software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
    is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
    original software. 3. This notice may not be removed or altered from any source distribution.""", "zlib"),
)


def has_phrase(gram: list[str]) -> bool:
    return any(f" {p} " in f" {' '.join(gram)} " for p in PHRASES)


def plain_words(text: str) -> str:
    return " ".join(w for w in re.split(SEPARATORS, text.lower()) if w)


def template_rows() -> list[tuple]:
    """template, label, is_base, number of its grams, position, gram (K words, two for a base phrase)."""
    rows = []
    whole = [(plain_words(text), label) for text, label in TEXTS]
    for is_base, texts in ((True, PHRASES.items()), (False, [*TEMPLATES, *whole])):
        for text, label in texts:
            words = text.split()
            k = 2 if is_base else K
            grams = [(i, words[i : i + k]) for i in range(len(words) - k + 1)]
            rows += [(f"{'base' if is_base else 'text'} {text}", label, is_base, len(grams), i, " ".join(g)) for i, g in grams]
    return rows


def template_grams(spark: SparkSession) -> DataFrame:
    kinds = "template string, label string, is_base boolean, n_grams int, place int, template_gram string"
    return spark.createDataFrame(template_rows(), kinds)


def anchors() -> list[str]:
    """The distinct grams that no base phrase tells."""
    return sorted({row[-1] for row in template_rows() if not row[2] and not has_phrase(row[-1].split())})


def either(grams: list[str]) -> str:
    """A pattern for any of ``grams`` in lower-case text; common beginnings are written once."""
    if "" in grams:
        return ""
    heads = sorted({g[0] for g in grams})
    ways = [(SEPARATORS if h == " " else h) + either([g[1:] for g in grams if g[0] == h]) for h in heads]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def possible() -> str:
    """Found in every lower-case text with a template gram, and in few others: the ends of words are not looked at."""
    return f"(?:^|{SEPARATORS}){either([*anchors(), *PHRASES])}"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    """Words of the text, A-Z lowered."""
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS, -1), "")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` is the largest share of a template's grams in one span, 1 for a base phrase.
    Null and empty texts have no words. Rows of one doc_id are told apart by their texts; equal
    ones get equal results, and null ids count as one id. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text").cast("string")).alias("text"))
    # The digest tells rows of one id apart.
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), "text")
    counted = rows.select("doc_id", "version", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    rows = rows.filter(F.lower("text").rlike(possible())).select("doc_id", "version", words_of(F.col("text")).alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    grams = F.transform("words", lambda w, i: F.struct(
        F.concat_ws(" ", w, word(i + 1)).alias("two"), F.concat_ws(" ", w, word(i + 1), word(i + 2), word(i + 3)).alias("four")
    ))
    templates = F.broadcast(template_grams(spark).withColumn("hash", F.xxhash64("template_gram")))
    placed = rows.select("doc_id", "version", F.posexplode(grams).alias("at", "gram"))
    either = placed.select("doc_id", "version", "at", F.explode(F.array("gram.two", "gram.four")).alias("gram"))
    votes = either.join(templates, (F.xxhash64("gram") == F.col("hash")) & (F.col("gram") == F.col("template_gram")))
    key = ["doc_id", "version", "template", "label", "is_base", "n_grams"]
    diagonals = votes.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    return finish(counted, verified(diagonals))


def verified(diagonals: DataFrame) -> DataFrame:
    """Spans of merged diagonals that hold enough of their template: doc_id, version, label, is_base, start, cover.

    A diagonal has a template's places at most. So has a span: places go on in a template as words do
    in a text, but for SHIFT, so its lists are bounded by the template.
    """
    # A base phrase stands on one diagonal: each is a run of its own.
    key = ["doc_id", "version", "template", "label", "is_base", "n_grams", "line"]
    lines = diagonals.withColumn("line", F.when(F.col("is_base"), F.col("diagonal")))
    run = Window.partitionBy(*key).orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(run)) > SHIFT) | (F.col("first") - F.lag("last").over(run) > K + SHIFT)
    islands = lines.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(run))
    spans = islands.groupBy(*key, "island").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("start"), F.max("last").alias("last")
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    cover = F.size("places") / F.col("n_grams")
    tight = words >= COVER * (F.col("last") + K - F.col("start"))
    enough = F.when(F.col("is_base"), cover == 1).otherwise((cover >= COVER) & tight)
    return spans.filter(enough).select("doc_id", "version", "label", "is_base", F.col("start").cast("long").alias("start"), cover.alias("cover"))


def finish(counted: DataFrame, found: DataFrame) -> DataFrame:
    of_base = lambda c: F.when(F.col("is_base"), F.col(c))
    per_doc = found.groupBy("doc_id", "version").agg(
        F.count(of_base("start")).alias("n_base"), F.min(of_base("start")).alias("first_word"), F.max(of_base("start")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(of_base("label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    )
    same = (counted["version"] == per_doc["version"]) & counted["doc_id"].eqNullSafe(per_doc["doc_id"])
    return counted.join(per_doc, same, "left").select(
        counted["doc_id"], counted["n_words"], F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
