"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text's passages are its runs of words. A passage A matches a template B if
2|A n B| / (|A| + |B|) over their sets of word bigrams reaches ``DICE``. This bounds the
passage's size to between DICE/(2-DICE) and (2-DICE)/DICE of the template's, and asks for
at least the lower bound of shared bigrams, which prunes templates before any is compared.

A best passage begins and ends with a bigram of the template, and holds neither a second
time (without it the passage would be as good and shorter). So a scan goes from each such
bigram to its next occurrence, or until the passage outgrows its bound: in a text of one
line over and over, each scan is a line long.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so
case, punctuation and layout do not matter. Null and empty texts have no licence; ties go
to the larger template, then the shorter and earlier passage; of overlapping passages of
different licences only the better counts in ``licenses``; repeated rows are scanned
alike; empty tables give empty results. Texts of any length are scanned whole. Only id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphcover.llm.words import ALNUM, batched, chunks, mapped, split_words, text_column

DICE = 0.8

#: Notices and short texts of common licences, by identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ),
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
}


def words_of(text: str) -> list[str]:
    return text.encode().translate(ALNUM).decode().split(" ")


def text_words(text: str) -> tuple[list[str], list[int]]:
    """The text's words, and the number (from 0) of each word's line."""
    words, lines = [], []
    for number, line in enumerate(text.split("\n")):
        own = [w for w in words_of(line) if w]
        words += own
        lines += [number] * len(own)
    return words, lines


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


@dataclass(frozen=True)
class Template:
    license: str
    number: int
    grams: frozenset
    least: float
    most: float


def compile_templates(texts: dict[str, tuple[str, ...]] | None = None, dice: float = DICE) -> list[Template]:
    out = []
    for license_id, own in (texts or TEMPLATES).items():
        for number, text in enumerate(own):
            grams = frozenset(bigrams(text_words(text)[0]))
            out.append(Template(license_id, number, grams, len(grams) * dice / (2 - dice), len(grams) * (2 - dice) / dice))
    return out


def best_passage(pairs: list[tuple[str, str]], at: list[int], t: Template, dice: float) -> tuple | None:
    """``dice, first, last`` of the best run of bigrams; ``at`` are the places of the template's own."""
    best = None
    for begin in at:
        seen, common = set(), 0
        for end in range(begin, len(pairs)):
            pair = pairs[end]
            if end > begin and pair == pairs[begin]:
                break
            if pair in seen:
                continue
            seen.add(pair)
            if len(seen) > t.most:
                break
            if pair in t.grams:
                common += 1
                value = 2 * common / (len(seen) + len(t.grams))
                if value >= dice and (best is None or (value, begin - end) > (best[0], best[1] - best[2])):
                    best = (value, begin, end)
        if best is not None and best[0] == 1.0:
            break
    return best


def matches(words: list[str], templates: list[Template], dice: float = DICE) -> list[tuple]:
    """``license, template, dice, first word, last word`` of each template's best passage, the best first."""
    pairs = list(zip(words, words[1:]))
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(pairs):
        places.setdefault(pair, []).append(k)
    found = []
    for t in templates:
        shared = [places[g] for g in t.grams if g in places]
        if len(shared) >= t.least and (best := best_passage(pairs, sorted(k for x in shared for k in x), t, dice)):
            found.append((t.license, t.number, best[0], best[1], best[2] + 1, len(t.grams)))
    found.sort(key=lambda m: (-m[2], -m[5], m[4] - m[3], m[3], m[0], m[1]))
    return [m[:5] for m in found]


def apart(found: list[tuple]) -> list[str]:
    """The licences of the matches, without those that overlap a better one of another licence."""
    kept: list[tuple] = []
    for m in found:
        if all(m[0] == k[0] or m[4] < k[3] or k[4] < m[3] for k in kept):
            kept.append(m)
    return sorted({m[0] for m in kept})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, tuple[str, ...]] | None = None, dice: float = DICE) -> DataFrame:
    """One row per document: ``id, license, template, dice, first_line, last_line, first_word, last_word`` of its best match, and all ``licenses``."""
    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    templates = compile_templates(texts, dice)
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in templates for g in t.grams for w in g}))}
    codes = np.array(sorted({vocabulary[a] * len(vocabulary) + vocabulary[b] for t in templates for a, b in t.grams}))
    need = min(t.least for t in templates)
    types = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    names = ["license", "template", "dice", "first_line", "last_line", "first_word", "last_word", "licenses"]

    def run(batches):
        for batch in batches:
            column, rows = text_column(batch.column(1)), []
            for a, b in chunks(column):
                part = column.slice(a, b - a)
                words, offsets = split_words(mapped(part, ALNUM))
                coded = words.dictionary_encode()
                place = np.array([vocabulary.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1])
                own = place[coded.indices.to_numpy(zero_copy_only=False)]
                pair = np.append(own[:-1] * len(vocabulary) + own[1:], -1)[: len(own)]
                known = (own >= 0) & np.append(own[1:] >= 0, False)[: len(own)] & np.isin(pair, codes)
                upto = np.concatenate(([0], np.cumsum(known)))
                for i in range(b - a):
                    low, high = int(offsets[i]), max(int(offsets[i + 1]) - 1, int(offsets[i]))
                    found = []
                    if upto[high] - upto[low] >= need and len(np.unique(pair[low:high][known[low:high]])) >= need:
                        said, lines = text_words(part[i].as_py())
                        found = matches(said, templates, dice)
                    if found:
                        first, last = found[0][3:5]
                        rows.append((*found[0][:3], lines[first], lines[last], first, last, apart(found)))
                    else:
                        rows.append((None,) * 7 + ([],))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [id_col, *names])

    return batched(slim).mapInArrow(run, f"`{id_col}` {kind}, license string, template int, dice double, first_line int, last_line int, first_word int, last_word int, licenses array<string>")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
