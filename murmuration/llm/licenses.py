"""License scans by patience alignment of texts with license templates.

A template is aligned with a stretch of a document on the words that are unique
in both; the longest increasing subsequence of these anchors is kept, and the
gaps between anchors are aligned the same way, after equal words at their ends
were taken.  The share of the template's words that are aligned is its coverage.

Only stretches that hold enough of a template's distinct words are aligned, a
bound that no stretch with the wanted coverage can miss.  A copy may be half as long
again as its template; the search goes on after its end, so any number of copies in
one text is told apart.  Documents are not shuffled.  The bank is a parameter: a list
of notices and short full texts by default, or a folder of texts (`read_bank`) of
bounded size.

Defined cases: null and empty texts have no license; repeated rows get a row each
and every copy of a license in a text counts in `n_places`; all words of a long text are scanned;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm import kernel

COVERAGE = 0.8
#: Bytes that a bank of templates may hold, as it goes to all tasks.
BANK_BYTES = 16 << 20

# Public license notices and short full texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Reserved": "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher",
}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment of two sequences: ascending pairs of equal positions."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: p for p, x in enumerate(b[k:m], k) if once_b[x] == 1}
        anchors = [(p, place[x]) for p, x in enumerate(a[i:j], i) if once_a[x] == 1 and x in place]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, q) in enumerate(anchors):
            at = bisect_left(tails, q)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [q], [n]
        chain = []
        n = ends[-1] if ends else -1
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        if not chain:
            continue
        chain.reverse()
        out += chain
        edges = [(i - 1, k - 1), *chain, (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(out)


def _scan(templates: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(templates)
        words = kernel.Words(*kernel.buffers(pa.array(list(templates.values()))), space=kernel.NO_LETTER)
        hashes = words.hashes(kernel.LOWER)
        known = [hashes[a:b].tolist() for a, b in zip(words.first, words.first[1:], strict=False)]
        alphabet = np.unique(hashes)
        member = np.zeros((len(alphabet), len(names)), bool)
        for n, t in enumerate(known):
            member[np.searchsorted(alphabet, np.array(t, np.uint64)), n] = True
        # unmatched words are at most (1 - coverage) of all, so at least this many distinct ones stay
        needed = np.array([max(1, len(set(t)) - int((1 - coverage) * len(t) + 1e-9)) for t in known])
        sieve = np.zeros(1 << 16, bool)
        sieve[alphabet >> np.uint64(48)] = True
        for batch in batches:
            rows = []
            for piece in kernel.slices(batch, "text"):
                own = kernel.Words(*kernel.buffers(piece.column("text")), space=kernel.NO_LETTER)
                tokens = own.hashes(kernel.LOWER)
                at = np.flatnonzero(sieve[tokens >> np.uint64(48)])
                code = np.minimum(np.searchsorted(alphabet, tokens[at]), len(alphabet) - 1)
                at, code = at[alphabet[code] == tokens[at]], code[alphabet[code] == tokens[at]]
                doc = np.searchsorted(own.first, at, "right") - 1
                pairs = np.unique(doc * len(alphabet) + code)
                found = np.zeros((piece.num_rows, len(names)), np.int32)
                np.add.at(found, pairs // len(alphabet), member[pairs % len(alphabet)])
                for d, n in zip(*np.nonzero(found >= needed), strict=True):
                    a, b = own.first[d], own.first[d + 1]
                    places = _places(known[n], tokens[a:b], int(needed[n]), coverage)
                    if places:
                        best = max(places, key=lambda p: (p[0], -p[1]))
                        rows.append((piece.column("key")[int(d)].as_py(), names[n], len(known[n]), best[0], best[1], best[2], len(places)))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "license", "n_words", "n_aligned", "first_word", "last_word", "n_places"])

    return run


def _places(template: list[int], tokens: np.ndarray, needed: int, coverage: float) -> list[tuple[int, int, int]]:
    """(aligned words, first word, last word) of the copies of a template, from left to right.

    A copy begins with an aligned word, and at most the share that may be missing
    stands before that word in the template.  So stretches begin at such words, after
    the end of the copy before; of three stretch lengths the best alignment counts.
    """
    m = len(template)
    least = int(np.ceil(coverage * m - 1e-9))
    hits = np.flatnonzero(np.isin(tokens, np.array(template, np.uint64)))
    opens = hits[np.isin(tokens[hits], np.array(template[: m - least + 1], np.uint64))]
    dense = np.searchsorted(hits, opens + m * 3 // 2) - np.searchsorted(hits, opens) >= least
    out: list[tuple[int, int, int]] = []
    end = -1
    for s in opens[dense].tolist():
        if s <= end:
            continue
        best: tuple[int, int, int] | None = None
        for size in (m, m * 5 // 4, m * 3 // 2):
            part = tokens[s : s + size].tolist()
            if len(set(part) & set(template)) < needed:
                continue
            pairs = align(template, part)
            if len(pairs) >= least and (best is None or len(pairs) > best[0]):
                best = len(pairs), s + pairs[0][1], s + pairs[-1][1]
        if best is not None:
            out.append(best)
            end = best[2]
    return out


def read_bank(spark: SparkSession, path: str, most_bytes: int = BANK_BYTES) -> dict[str, str]:
    """A template bank from a folder of text files, each named by its license; refused beyond `most_bytes`."""
    files = spark.read.format("binaryFile").load(path)
    held = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if held > most_bytes:
        raise ValueError(f"the bank holds {held} bytes, more than {most_bytes}")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    return {r["name"]: r["text"] for r in files.select(name.alias("name"), F.decode("content", "UTF-8").alias("text")).orderBy("name").collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, n_words, n_aligned, first_word, last_word, n_places, coverage): the licenses of each document."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = T._parse_datatype_string("key long, license string, n_words long, n_aligned long, first_word long, last_word long, n_places long")
    found = source.mapInArrow(_scan(templates or TEMPLATES, coverage), kind)
    return found.withColumn("coverage", F.col("n_aligned") / F.col("n_words")).withColumnRenamed("key", key)
