"""Licence scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

Text is normalised to lower-case words of letters and digits, so line breaks, blank lines and comment marks are gone. A
template of L words is compared with windows of L words of the text (fewer at its end), wherever they stand. With threshold t, a template
of b distinct bigrams can only match a window of b*t/(2-t) to b*(2-t)/t of them, b*t/(2-t) of which are its own: templates
without that many of their bigrams in the text get no window, windows without that many places that hold one are not
looked at, and windows outside the bounds get no comparison. These bounds are proven, so the matches are those of the
Dice coefficient over every window, whatever was put in, left out or changed. The templates
are a fixed list inside the plan: nothing is joined, broadcast or shuffled before the last count.

Related licences share most of their words (BSD-2-Clause and BSD-3-Clause, the GPL family): all that reach the threshold
are told, and the largest Dice tells which one it is.

Cases: null or empty text and texts of fewer than two words match nothing; one row per document and licence with its
best score; rows that repeat a doc_id count together; an empty table gives an empty result; other columns of the input
are not looked at; texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_words(text: str) -> list[str]:
    """Normalised like the texts (templates are ASCII)."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams that can reach the threshold against n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def license_hits(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per matching window and licence: doc_id, license_id, dice, first_word (from 0) and n_words."""
    rows, everything = [], set()
    for k, text in templates.items():
        w = template_words(text)
        b = sorted({f"{x} {y}" for x, y in zip(w, w[1:], strict=False)})
        everything.update(b)
        lo, hi = bounds(len(b), threshold)
        rows.append(F.struct(F.lit(k).alias("id"), F.lit(len(w)).alias("words"), F.lit(len(b)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, b)).alias("b")))
    lowest = min(bounds(len(set(zip(w, w[1:], strict=False))), threshold)[0] for w in map(template_words, templates.values()))
    known, g = F.array(*rows), F.col("g")
    none = lambda kind: F.array().cast(f"array<{kind}>")

    def windows(t: Column) -> Column:
        own = F.filter("at", lambda i: F.array_contains(t["b"], F.get(g, i)))
        # lo places of its own bigrams in a row have to fit into a window: it begins no later than the first of them
        spans = lambda q: F.filter(F.transform(F.sequence(F.lit(0), F.size(q) - t["lo"]), lambda k: F.struct(F.get(q, k).alias("a"), F.get(q, k + t["lo"] - 1).alias("z"))), lambda s: s["z"] - s["a"] <= t["words"] - 2)
        starts_of = lambda q: F.when(F.size(q) >= t["lo"], F.array_distinct(F.flatten(F.transform(spans(q), lambda s: F.sequence(F.greatest(F.lit(0), s["z"] - t["words"] + 2), s["a"]))))).otherwise(none("int"))
        starts = F.flatten(F.transform(F.array(own), starts_of))  # named once, so that it is not made again for each place
        each = F.transform(starts, lambda i: F.struct(i.alias("i"), F.array_distinct(F.slice(g, i + 1, t["words"] - 1)).alias("d")))
        fit = F.filter(each, lambda x: F.size(x["d"]).between(t["lo"], t["hi"]))
        scored = F.transform(fit, lambda x: F.struct(t["id"].alias("license_id"), (2.0 * F.size(F.array_intersect(x["d"], t["b"])) / (F.size(x["d"]) + t["n"])).alias("dice"), x["i"].alias("first_word"), F.least(t["words"], F.size(g) + 1 - x["i"]).alias("n_words")))
        return F.filter(scored, lambda x: x["dice"] >= threshold)

    text = docs.select("doc_id", F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ").alias("w"))
    w = F.col("w")
    pairs = text.select("doc_id", F.when(F.size(w) > lowest, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(none("string")).alias("g"))
    at = pairs.select("doc_id", "g", F.filter(F.transform(g, lambda x, i: F.when(x.isin(*sorted(everything)), i)), lambda i: i.isNotNull()).alias("at"))
    near = at.select("doc_id", "g", "at", F.when(F.size("at") >= lowest, F.array_distinct(F.transform("at", lambda i: F.get(g, i)))).otherwise(none("string")).alias("own"))
    fit = F.when(F.size("own") >= lowest, F.filter(known, lambda t: F.size(F.array_intersect(F.col("own"), t["b"])) >= t["lo"])).otherwise(F.filter(known, lambda t: F.lit(False)))
    # a filter on the matches, or an inner explode, would be pushed below the projections and compute them twice
    found = near.select("doc_id", F.explode_outer(F.flatten(F.transform(fit, windows))).alias("x"))
    return found.where("x IS NOT NULL").select("doc_id", "x.*")


def op1(docs: DataFrame) -> DataFrame:
    return license_hits(docs).groupBy("doc_id", "license_id").agg(F.round(F.max("dice"), 6).alias("dice"), F.count(F.lit(1)).alias("n_windows"))
