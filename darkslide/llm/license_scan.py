"""License scan: MinHash bands over overlapping windows retrieve templates, shingles verify them.

The shingles (five words) of a text are taken in half windows of H, for H = 1, 2, 4, ... up to the
longest template; two neighbouring halves are a window, so each half is in two windows. A template of n
shingles is looked for in the windows of the least H >= n, of which one holds any whole occurrence. Its
similarity to that window is over 1/4, and the number of bands is chosen for that similarity, so a
band is shared with probability RECALL or more. Windows that share a band with a template are verified:
the share of the template's distinct shingles found in the window must reach the threshold. Where another template
holds that share of the template's shingles, the ones that this other doesn't have decide: one of them at least must be
in the window, and their share must not be under that of the other's own ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.jaccard_join import choose_banding
from darkslide.llm.textbuf import arrow_map, byte_chunks, mix, shingles_of, U, words_of

# Usual notices and permission texts of public licenses.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-clauses": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Released under the BSD License",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-dedication": "the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-2.0-or-later": "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-program-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
SHINGLE, RECALL, LEAST_SIMILARITY, CONTAINMENT = 5, 0.999, 0.25, 0.8
#: Shingles of a text that are looked at together; each takes 8 bytes for every hash function.
PIECE_SHINGLES = 1 << 16
_SIEVE_BITS = 20


def _banding():
    return choose_banding(LEAST_SIMILARITY, RECALL, 128)


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    b = _banding()
    rng = np.random.default_rng(496)
    k = b.bands * b.rows
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def band_keys(mins: list[np.ndarray], half: int) -> np.ndarray:
    """(windows, bands) keys from the minima of each hash function."""
    b = _banding()
    out = np.zeros((len(mins[0]), b.bands), np.uint64)
    for band in range(b.bands):
        h = np.full(len(mins[0]), band * 4099 + half, np.uint64)
        for m in mins[band * b.rows : (band + 1) * b.rows]:
            h = mix(h * U(0x9E3779B97F4A7C15) + m)
        out[:, band] = h
    return out


@dataclass
class Templates:
    names: list[str]
    shingles: list[np.ndarray]
    halves: list[int]
    keys: np.ndarray
    owner: np.ndarray
    sieve: np.ndarray
    rivals: list[list[tuple[np.ndarray, np.ndarray]]]  # by template: (shingles that a like one doesn't have, those that only it has)


def make_templates(texts: dict[str, str]) -> Templates:
    """Templates that have a word; equal notices under two names are both kept."""
    a, b = _hashes()
    names, shingles, halves, keys, owner = [], [], [], [], []
    for name, text in texts.items():
        data = np.frombuffer(text.encode(), np.uint8)
        s = np.unique(shingles_of(words_of(data, np.array([0, len(data)])), SHINGLE)[0])
        if len(s):
            half = 1 << int(len(s) - 1).bit_length()
            k = band_keys([np.array([(s * x + y).min()]) for x, y in zip(a, b, strict=True)], half)[0]
            keys.append(k)
            owner.append(np.full(len(k), len(names)))
            names.append(name)
            shingles.append(s)
            halves.append(half)
    every = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(every, kind="stable")
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[every >> U(64 - _SIEVE_BITS)] = True
    return Templates(names, shingles, halves, every[order], np.concatenate([np.zeros(0, np.int64), *owner])[order], sieve, [rivals_of(s, shingles) for s in shingles])


def rivals_of(own: np.ndarray, shingles: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What tells a template from each one that would pass for it; one that holds all of it doesn't."""
    pairs = [(np.setdiff1d(own, r), np.setdiff1d(r, own)) for r in shingles]
    return [(a, b) for a, b in pairs if 0 < len(a) <= (1 - CONTAINMENT) * len(own) + 1e-9]


def told_apart(rivals: list[tuple[np.ndarray, np.ndarray]], window: np.ndarray) -> bool:
    for a, b in rivals:
        mine = np.isin(a, window).mean()
        if mine == 0 or (len(b) and mine < np.isin(b, window).mean()):
            return False
    return True


def scan_rows(t: Templates, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(row, template, best containment, first shingle of the best window). The shingles of long texts are taken in pieces that begin
    at multiples of the largest half window and overlap by two of them, so windows are the same as in one piece."""
    values, rows = shingles_of(words_of(data, offsets), SHINGLE)
    if not len(values) or not t.names:
        return []
    if len(values) <= 2 * PIECE_SHINGLES:
        return _scan_piece(t, values, rows)
    largest, found = max(t.halves), {}
    step = -(-PIECE_SHINGLES // largest) * largest
    for lo, hi in zip(ends := np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]), [*ends[1:], len(rows)], strict=True):
        for at in range(lo, hi, step):
            piece = slice(at, min(hi, at + step + 2 * largest))
            for row, o, share, first in _scan_piece(t, values[piece], rows[piece]):
                if share > found.get((row, o), (0.0, 0))[0]:
                    found[row, o] = (share, first + int(at - lo))
    return [(*k, *v) for k, v in sorted(found.items())]


def _scan_piece(t: Templates, values: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, float, int]]:
    a, b = _hashes()
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    begin = np.repeat(first, np.diff(np.r_[first, len(rows)]))
    at = np.arange(len(rows)) - begin
    found: dict[tuple[int, int], tuple[float, int]] = {}
    mins = [values * x + y for x, y in zip(a, b, strict=True)]
    starts, half, largest = np.arange(len(values)), 1, max(t.halves)
    while half <= largest:
        if half > 1:  # the halves of twice the size, from those before
            keep = np.flatnonzero((at[starts] // half != np.r_[-1, at[starts][:-1] // half]) | np.r_[True, rows[starts][1:] != rows[starts][:-1]])
            mins = [np.minimum.reduceat(m, keep) for m in mins]
            starts = starts[keep]
        if half in t.halves:
            pair = np.r_[rows[starts][1:] == rows[starts][:-1], False]
            window = [np.where(pair, np.minimum(m, np.r_[m[1:], m[:1]]), m) for m in mins]
            keys = band_keys(window, half)
            w, _band = np.nonzero(t.sieve[keys >> U(64 - _SIEVE_BITS)])
            some = keys[w, _band]
            lo, hi = np.searchsorted(t.keys, some, "left"), np.searchsorted(t.keys, some, "right")
            hits = {(int(x), int(o)) for x, i, j in zip(w, lo, hi, strict=True) for o in t.owner[i:j]}
            for x, o in sorted(hits):
                s = int(starts[x])
                e = min(s + 2 * half, int(np.searchsorted(rows, rows[s], "right")))
                share = float(np.isin(t.shingles[o], values[s:e]).sum()) / len(t.shingles[o])
                row = int(rows[s])
                if share >= CONTAINMENT and share > found.get((row, o), (0.0, 0))[0] and told_apart(t.rivals[o], values[s:e]):
                    found[row, o] = (share, int(at[s]))
        half *= 2
    return [(*k, *v) for k, v in sorted(found.items())]


def scan(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """key, license, containment, first_shingle of every template found in a text, best window each.

    One pass, no shuffle; the templates are a parameter of a few texts. Null and empty texts have none;
    repeated rows are each reported; an empty table gives no rows; other columns are left out. Texts of any length are scanned whole, in
    pieces (see `scan_rows`)."""
    shared = spark.sparkContext.broadcast(make_templates(TEMPLATES if templates is None else templates))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for lo, _hi, data, offsets in byte_chunks(batch.column(1)):
                found = scan_rows(t, data, offsets)
                if found:
                    row, which, share, first = zip(*found, strict=True)
                    cells = [pa.array([t.names[i] for i in which]), pa.array(share, pa.float64()), pa.array(first, pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row) + lo)), *cells], ["key", "license", "containment", "first_shingle"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.transform(arrow_map, run, f"key {kind}, license string, containment double, first_shingle bigint").withColumnRenamed("key", key)
