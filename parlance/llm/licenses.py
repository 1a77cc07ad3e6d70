"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised alike: lower case, and every run of other characters than
letters and digits becomes one space. Each line of a document, and the whole of a document of
several lines, is a unit. With A and B the distinct word bigrams of unit and template, the
coefficient 2 |A and B| / (|A| + |B|) can reach the threshold t only if |A| lies between
t / (2 - t) |B| and (2 - t) / t |B|; templates outside these bounds are not compared.

All of it is a projection of each row: no shuffle, no Python. Defined results: null text and units
of fewer than two words match nothing; ties go to the template listed first; repeated rows are
reported each for itself; texts of any length are scanned whole, line by line; an empty table gives no row;
only doc_id and text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import with_ids

THRESHOLD = 0.8
NORMAL = r"[^\p{L}\p{N}\n]+"

# Licence notices and texts.
TEMPLATES = {
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def _bigrams(text: str) -> set[tuple[str, str]]:
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words, words[1:], strict=False))


def _hashed_bigrams(words: Column) -> Column:
    """Distinct hashes of neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<bigint>")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0; -1 for the whole text), license, shared, unit_bigrams, template_bigrams, dice of each match."""
    small = threshold / (2 - threshold)
    sets = {name: sorted(_bigrams(t)) for name, t in templates.items()}
    fewest = math.ceil(min(map(len, sets.values())) * small - 1e-9)
    text = F.regexp_replace(F.lower("text"), NORMAL, " ")
    words = lambda unit: F.filter(F.split(unit, " +", -1), lambda w: w != "")
    unit = "array<struct<line:int,words:array<string>>>"
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.cast("int").alias("line"), words(x).alias("words")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.struct(F.lit(-1).alias("line"), words(F.translate("text", "\n", " ")).alias("words"))))
    rows = with_ids(docs, "doc_id", "text").where("text is not null").select("doc_id", text.alias("text"))
    # explode() keeps what it is given: without it, each use below would compute words and bigrams anew
    rows = rows.select("doc_id", F.explode(F.concat(lines, F.coalesce(whole, F.array().cast(unit)))).alias("u"))
    rows = rows.select("doc_id", "u.line", "u.words").where(F.size("words") > fewest)
    rows = rows.select("doc_id", "line", F.explode(F.array(_hashed_bigrams(F.col("words")))).alias("own"))
    rows = rows.withColumn("n", F.size("own"))
    scores = []
    for i, (name, grams) in enumerate(sets.items()):
        m = len(grams)
        low, high = math.ceil(m * small - 1e-9), math.floor(m / small + 1e-9)
        theirs = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in grams])
        shared = F.size(F.array_intersect("own", theirs))
        of = F.struct((2.0 * shared / (F.col("n") + m)).alias("dice"), F.lit(-i).alias("nth"), F.lit(name).alias("license"), shared.cast("long").alias("shared"), F.lit(m).cast("long").alias("m"))
        scores.append(F.when(F.col("n").between(low, high), of))
    best = rows.select("doc_id", "line", "n", F.array_max(F.array(*scores)).alias("best")).where(F.col("best.dice") >= threshold)
    return best.select("doc_id", "line", "best.license", "best.shared", F.col("n").cast("long").alias("unit_bigrams"), F.col("best.m").alias("template_bigrams"), F.round("best.dice", 6).alias("dice"))
