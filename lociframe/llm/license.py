"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined in Spark with the places of the
same k-grams in templates: short phrases and notices, and the bodies of licenses. Each
meeting votes for a diagonal, the place in the text minus the place in the template.
Votes are summed by diagonal; neighbouring diagonals, which inserted or missing words
make of one, are merged; and what they span is verified word by word: a phrase needs
all its k-grams in place; of a notice or body, k-grams in place have to cover
`least` of the template's words, and may leave no more than the rest, and NEAR, of the span's own words
uncovered.

The templates are fixed, so the side with their places is a small table of fixed size and is broadcast; k-grams
are 64-bit hashes.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. Null and
empty texts have none, no label and score 0. Each row of a repeated or null id gets its own
result. Long texts are hashed in one piece. Only the named columns are read. Empty tables give an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize
from .textops import ALNUM, Words, grams, mix, slices, utf8


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    k: int
    least: float = 1.0


# The base phrases, found wherever their words stand consecutively.
PHRASES = (
    Template("cc-by", "cc by", 2),
    Template("gpl", "general public license", 2),
    Template("reserved", "all rights reserved", 2),
)
#: Notices, found approximately.
# Published notices.
NOTICES = (
    Template("notice-apache-2.0", "licensed under the apache license version 2 0", 2, 0.7),
    Template("notice-mit", "released under the mit license", 2, 0.7),
    Template("notice-gpl-3.0", "this work is licensed under the gnu general public license version 3", 2, 0.7),
    Template("notice-cc-by-nc", "licensed under cc by nc 4 0", 2, 0.7),
    Template("grant-mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 4, 0.6),
    Template("grant-bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 4, 0.6),
    Template("notice-mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 4, 0.6),
)
#: Bodies of licenses, as published.
# Published license texts; those of Apache, GPL, MPL and CC are the notices that their licenses ask for.
BODIES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        4,
        0.7,
    ),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        4,
        0.7,
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        4,
        0.7,
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        4,
        0.7,
    ),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        4,
        0.7,
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        4,
        0.7,
    ),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        4,
        0.7,
    ),
)
TEMPLATES = PHRASES + NOTICES + BODIES
#: Words that may be inserted or missing between neighbouring diagonals, and, of long templates, the share of it.
NEAR, NEAR_SHARE = 3, 0.1
#: Each text has one such place, so a text without any k-gram of a template stays in the join.
_MARK = -1

_GRAMS = "row long, id long, n_words long, grams array<long>"


def _rolling(words: Words, ks: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each k the hashes of all k-grams, and how many each text has."""
    h = words.hashes()
    both = [grams(h, words.bound, k) for k in ks]
    return [mix(z, k) for (z, _), k in zip(both, ks)], [n for _, n in both]


def _gram_lists(ks: tuple[int, ...]):
    """Each text's k-gram hashes, those of the first k before those of the next, and a mark at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for s, e in slices(batch.column(1)):
                words = Words(*utf8(batch.column(1).slice(s, e - s)), ALNUM)
                hashes, counts = _rolling(words, ks)
                bound = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0) + 1)])
                flat = np.full(bound[-1], _MARK, np.int64)
                at = bound[:-1]
                for z, n in zip(hashes, counts):
                    flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(z))] = z.view(np.int64)
                    at = at + n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + e - s)), batch.column(0).slice(s, e - s), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(flat))], names=["row", "id", "n_words", "grams"])
                row += e - s

    return run


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(gram, label, phrase, least, length, k, at): the hash and place of every k-gram of every template."""
    rows = [(_MARK, "", True, 0.0, 0, 0, 0)]
    for t in templates:
        words = Words(*utf8(pa.array([t.words])), ALNUM)
        for i, z in enumerate(_rolling(words, (t.k,))[0][0].view(np.int64).tolist()):
            rows.append((z, t.label, t.least >= 1, t.least, int(words.count[0]), t.k, i))
    return spark.createDataFrame(rows, "gram long, label string, phrase boolean, least double, length int, k int, at int")


def _covered(places: Column, k: Column) -> Column:
    """How many words the k-grams at these places, distinct and in order, cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.least(k, x + k - a["end"])).alias("n"), (x + k).alias("end"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (row, id, n_words) for every row of docs; spans has
    (row, label, phrase, first, last, share, least) for every place where a template is found or,
    with share under least, nearly found; first and last are word numbers."""
    ks = tuple(sorted({t.k for t in templates}))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"))
    every = own.mapInArrow(_gram_lists(ks), _GRAMS).select("row", "id", "n_words", F.posexplode("grams").alias("pos", "gram"))
    found = materialize(every.join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram").drop("gram"), "license")
    votes = found.where("k > 0")
    for i, k in enumerate(ks):  # those before in the list
        before = sum((F.greatest(F.col("n_words") - (x - 1), F.lit(0)) for x in ks[:i]), F.lit(0))
        votes = votes.withColumn("pos", F.when(F.col("k") == k, (F.col("pos") - before).cast("int")).otherwise(F.col("pos")))
    votes = votes.withColumn("diag", F.col("pos") - F.col("at"))
    template = ["label", "phrase", "least", "length", "k"]
    diags = votes.groupBy("row", *template, "diag").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    phrases = diags.where("phrase and size(ats) = length - k + 1").select("row", "label", "phrase", F.col("diag").alias("first"), (F.col("diag") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("share"), "least")
    order = Window.partitionBy("row", "label").orderBy("diag", "lo")
    near = F.greatest(F.lit(NEAR), F.floor(F.col("length") * NEAR_SHARE))
    apart = F.coalesce((F.col("diag") - F.lag("diag").over(order) > near) | (F.col("lo") > F.lag("hi").over(order) + F.col("length")), F.lit(True))
    runs = diags.where("not phrase").withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    runs = runs.groupBy("row", "run", *template).agg(sets("ats").alias("ats"), sets(F.transform("ats", lambda x: x + F.col("diag"))).alias("places"), F.min("lo").alias("first"), F.max("hi").alias("hi"))
    runs = runs.withColumn("last", F.col("hi") + F.col("k") - 1).withColumn("other", F.col("last") - F.col("first") + 1 - _covered(F.col("places"), F.col("k")))
    fits = F.col("other") <= (1 - F.col("least")) * F.col("length") + NEAR
    notices = runs.select("row", "label", "phrase", "first", "last", F.when(fits, _covered(F.col("ats"), F.col("k")) / F.col("length")).otherwise(0.0).alias("share"), "least")
    return found.where("k = 0").select("row", "id", "n_words"), phrases.unionByName(notices)


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is the largest share of a template's k-grams that one place of the text holds."""
    texts, spans = scan(docs, id_col, text_col)
    base = F.col("phrase")
    good = F.col("share") >= F.col("least")
    per = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    out = texts.join(per, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
