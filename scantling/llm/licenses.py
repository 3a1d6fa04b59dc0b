"""License scans in DataFrame operations alone.

Templates of license texts are found in documents by MinHash bands over overlapping windows of words, then verified by the exact
share of a template's shingles (five words) that a window holds.

Words are runs of letters, digits, dots within, and hyphens, in lower case. Each template belongs to the smallest class of windows (a power of two
of words, starting at every half) at least twice its own length, so that any place a template can stand lies whole in a window. Of
a window's shingles only those of some template are kept: others can't add to a containment. A window of W words keeps
at most W of them, and W is under four times the template's words, so a window with the template's required share of shingles
has a Jaccard similarity of no less than ``bound()``; with one row a band and ``BANDS`` bands it is retrieved with a
probability of at least 1 - (1 - bound) ** BANDS. ``band_guarantee()`` gives that figure for a set of templates.

Null or short texts have no shingles and no rows in the result. A document gets a row for each template it holds. Windows are of a
row, not of an id: rows that repeat an id, or have none, are scanned each by itself and have results of their own. No rows: no rows.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, SHARE, BANDS = 5, 0.8, 128
WORD = r"[^\p{L}\p{N}.+-]+"
#: Wordings that license grants are known by, as their publishers give them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mit-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-full", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause-full", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause-full", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib-full", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("unlicense-full", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words of a text; dots at their ends don't count, so that the end of a sentence doesn't."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD)
    return F.filter(F.transform(parts, lambda w: F.trim(w, F.lit(".+-"))), lambda w: w != "")


def python_words(text: str) -> list[str]:
    """The same for a template, on the driver."""
    out = []
    for w in "".join(c if c.isalpha() or c.isnumeric() or c in ".+-" else " " for c in text.lower()).split():
        if w := w.strip(".+-"):
            out.append(w)
    return out


def window_words(n_words: int) -> int:
    """Words in the windows of a template of so many words."""
    return 1 << max(4, math.ceil(math.log2(2 * n_words)))


def bound(n_words: int, share: float = SHARE) -> float:
    """The least Jaccard similarity of a template and what is kept of a window that holds ``share`` of its shingles."""
    own = n_words - SHINGLE + 1
    return share * own / (window_words(n_words) - SHINGLE + 1 + own - share * own)


def band_guarantee(templates=TEMPLATES, share: float = SHARE, bands: int = BANDS) -> float:
    """The least probability with which a window that holds a template is retrieved."""
    return min(1 - (1 - bound(len(python_words(t)), share)) ** bands for _, t in templates)


def shingle_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.element_at(words, (at + (k + 1)).cast("int")) for k in range(SHINGLE)])


def signature(shingles: Column, bands: int) -> Column:
    """Least hash of a set of shingles under each of ``bands`` hash functions."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda s: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, s))))


def _windows_of(at: Column, size: int) -> Column:
    """The two windows of this many words that a place lies in."""
    last = F.floor(at / (size // 2)).cast("int")
    return F.array(*[F.struct(F.lit(size).alias("size"), k.alias("no")) for k in (last, last - 1)])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template``, ``window`` and ``shingles`` of each template. Templates of under five words are refused."""
    rows = []
    for name, text in templates:
        words = python_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"a template of under {SHINGLE} words: {name}")
        rows.append((name, window_words(len(words)), words))
    frame = spark.createDataFrame(rows, "template string, window int, words array<string>")
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: shingle_hash(F.col("words"), i)))
    return frame.select("template", "window", shingles.alias("shingles"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, share: float = SHARE, bands: int = BANDS) -> DataFrame:
    """``id_col``, ``license``, ``containment`` (the best of any window) and ``first_word`` (where the first such window's shingles begin)."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    # words of the templates: what rows are filtered by before anything is hashed. They grow slower than the templates do
    vocabulary = sorted({w for _, t in templates for w in python_words(t)})
    classes = sorted({window_words(len(python_words(t))) for _, t in templates})
    # Each step is exploded from an array of one, so that the optimizer doesn't write it into the lambdas of the next, to be
    # worked out again for each element.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    words = rows.select("row", "id", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    flagged = words.select("row", "id", "w", F.explode(F.array(F.transform("w", lambda x: x.isin(vocabulary)))).alias("v"))
    every_one = lambda i: functools.reduce(operator.and_, [F.get("v", (i + k).cast("int")) for k in range(SHINGLE)])
    starts = F.when(F.size("w") >= SHINGLE, F.filter(F.sequence(F.lit(0), F.size("w") - SHINGLE), every_one))
    placed = flagged.select("row", "id", "w", F.explode(F.array(starts)).alias("starts")).where(F.size("starts") > 0)
    hits = F.transform("starts", lambda i: F.struct(i.alias("at"), shingle_hash(F.col("w"), i).alias("h")))
    # shingles of the templates: a table as long as they are, sent to where the texts are
    every = known.select(F.explode("shingles").alias("h")).distinct()
    found = placed.select("row", "id", F.explode(hits).alias("hit")).select("row", "id", "hit.at", "hit.h").join(F.broadcast(every), "h", "left_semi")
    # each place lies in two windows of each class
    windows = F.explode(F.flatten(F.array(*[_windows_of(F.col("at"), c) for c in classes])))
    spread = found.select("row", "id", "at", "h", windows.alias("win")).select("row", "id", "at", "h", "win.size", "win.no").where(
        (F.col("no") >= 0) & (F.col("at") + SHINGLE <= (F.col("no") + 2) * (F.col("size") / 2))
    )
    # a class keeps the shingles of its own templates only
    own = known.select(F.col("window").alias("own_size"), F.explode("shingles").alias("own_h")).distinct()
    spread = spread.join(F.broadcast(own), (F.col("size") == F.col("own_size")) & (F.col("h") == F.col("own_h")))
    # a window has at most its size of places, so its set is small
    sets = spread.groupBy("row", "id", "size", "no").agg(F.collect_set("h").alias("set"), F.min("at").alias("at"))
    signed = sets.select("*", F.posexplode(signature(F.col("set"), bands)).alias("band", "least"))
    marks = known.select("template", F.col("window").alias("t_size"), F.col("shingles"), F.posexplode(signature(F.col("shingles"), bands)).alias("t_band", "t_least"))
    met = signed.join(F.broadcast(marks), (F.col("size") == F.col("t_size")) & (F.col("band") == F.col("t_band")) & (F.col("least") == F.col("t_least")))
    sure = met.select("row", "id", "template", "at", (F.size(F.array_intersect("set", "shingles")) / F.size("shingles")).alias("containment")).where(F.col("containment") >= share)
    out = sure.groupBy("row", "id", "template").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))
    return out.select(F.col("id").alias(id_col), F.col("template").alias("license"), F.round("containment", 6).alias("containment"), "first_word")


def oracle(templates=TEMPLATES, share: float = SHARE) -> str:
    """DuckDB SQL for the rows of :func:`scan` over ``documents``: every window against every template, without MinHash."""
    values = ", ".join("('{}', {}, {}, [{}])".format(n, window_words(len(w)), len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}), ", ".join(f"'{' '.join(w[i : i + SHINGLE])}'" for i in range(len(w) - SHINGLE + 1))) for n, t in templates for w in [python_words(t)])
    return rf"""
WITH template(license, win, n, shingles) AS (VALUES {values}),
template_shingle AS (SELECT DISTINCT license, win, n, unnest(shingles) AS s FROM template),
words AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}.+-]+'), lambda w: trim(w, '.+-')), lambda w: w <> '') AS w FROM documents),
shingle AS (
  SELECT doc_id, i - 1 AS pos, list_aggregate(w[i:i + {SHINGLE - 1}], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM words WHERE len(w) >= {SHINGLE})
),
hit AS (SELECT doc_id, pos, license, win, n, s FROM shingle JOIN template_shingle USING (s)),
class_hit AS (SELECT DISTINCT h.doc_id, h.pos, h.s, h.win FROM hit h),
windowed AS (
  SELECT doc_id, pos, s, win, no FROM (SELECT *, unnest([pos // (win // 2), pos // (win // 2) - 1]) AS no FROM class_hit)
  WHERE no >= 0 AND pos + {SHINGLE} <= (no + 2) * (win // 2)
),
first_at AS (SELECT doc_id, win, no, min(pos) AS pos FROM windowed GROUP BY ALL),
held AS (
  SELECT w.doc_id, w.win, w.no, t.license, count(DISTINCT w.s) * 1.0::DOUBLE / any_value(t.n) AS containment
  FROM windowed w JOIN template_shingle t ON w.s = t.s AND w.win = t.win GROUP BY ALL
)
SELECT doc_id, license, round(max(containment), 6) AS containment, CAST(min(pos) AS BIGINT) AS first_word
FROM held JOIN first_at USING (doc_id, win, no) WHERE containment >= {share} GROUP BY doc_id, license
"""
