"""License scans by MinHash over overlapping text windows, in DataFrame functions only.

A window is WINDOW words, STRIDE words apart from the next, and so holds STRIDE shingles of WIDTH words; the windows of
a text together hold each of its shingles once. BANDS coordinates of one row each are taken of every window and joined
with those of the templates' windows. A coordinate is the least shingle hash after a rotation and an exclusive-or with
constants of the band; the rotation lets each band decide by bits of its own, so that a window with c of its STRIDE
shingles from a template keeps a template shingle in some band with probability 1 - (1 - c / STRIDE)**BANDS: 0.997 at
c = 1 (measured in the tests), and over 0.9999 for a template of two shingles or more. Candidates are then verified on
the words: of a template's distinct shingles at least CONTAINED must lie around the hit.

Words are runs of letters and digits, lower-cased. Template bands are broadcast: their number is checked first.

Defined results: null or empty texts match nothing; rows without doc_id are searched but not reported; repeated rows of
a doc_id give one row a license; among equal matches the leftmost is reported; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.columns import let
from tenderspark.llm.decontamination import texts_of, words
from tenderspark.llm.shared import written

WIDTH, STRIDE = 5, 4
WINDOW = WIDTH + STRIDE - 1
BANDS = 20
CONTAINED = 0.8
MAX_TEMPLATE_BANDS = 1_000_000
MAX_BROADCAST_TEMPLATES = 10_000

#: Notices as they are commonly written.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software.""",
}


def _constants() -> list[int]:
    """BANDS well-spread signed 64-bit values."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 63))
    return out


def _shingles(tokens: Column) -> Column:
    """array<long>: hashes of WIDTH neighbouring words."""
    def rolled(h: Column) -> Column:
        return F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WIDTH)))))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), rolled)


def _turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _bands(own: list[Column]) -> Column:
    """array<long>: the band values of a window that holds the shingles `own`; nulls are ignored. No two of them are equal
    but by chance, since each band has a constant of its own."""

    def least(turn: int, c: int) -> Column:
        turned = [_turned(x, turn).bitwiseXOR(F.lit(c)) for x in own]
        return F.least(*turned) if len(turned) > 1 else turned[0]

    return F.array(*(least(64 * k // BANDS, c) for k, c in enumerate(_constants())))


def _minima(shingles: Column, begin: Column, count: int) -> Column:
    """Distinct band values of the window whose shingles begin at `begin`; places behind the end are null and ignored."""
    return F.array_distinct(_bands([F.get(shingles, begin + k) for k in range(count)]))


def find_candidates(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, license, near): a window of the document meets one of the template, whose first word would be `near`."""
    shingled = templates.select("license", _shingles(words(F.col("text"))).alias("s")).where("s IS NOT NULL")
    def runs(n: int) -> DataFrame:
        begins = F.when(F.size("s") >= n, F.sequence(F.lit(0), F.size("s") - n))
        return shingled.select("license", F.posexplode(F.transform(begins, lambda i: _minima(F.col("s"), i, n))).alias("at", "v"))

    # A document's window may hold any run of up to STRIDE template shingles.
    bands = functools.reduce(DataFrame.union, map(runs, range(1, STRIDE + 1)))
    bands = bands.select("license", "at", F.explode("v").alias("value")).where("value IS NOT NULL").distinct()
    if bands.count() <= MAX_TEMPLATE_BANDS:
        bands = F.broadcast(bands)

    # Only the shingles of a window are laid out in a lambda, which Spark interprets; the bands are columns of its row, which
    # Spark compiles. Places behind the end repeat the first, so no value is null and no minimum changes.
    def all_windows(s: Column) -> Column:
        at = lambda i, k: F.coalesce(F.get(s, i + k), F.get(s, i), F.lit(0)).alias(f"s{k}")
        return F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(STRIDE)), lambda i: F.struct(*(at(i, k) for k in range(STRIDE))))

    windows = docs.select("doc_id", F.posexplode(let(_shingles(words(F.col("text"))), all_windows)).alias("w", "v")).select("doc_id", "w", "v.*")
    values = windows.select("doc_id", "w", F.explode(_bands([F.col(f"s{k}") for k in range(STRIDE)])).alias("value"))
    met = values.join(bands, "value")
    return met.select("doc_id", "license", (F.col("w") * STRIDE - F.col("at")).alias("near")).distinct()


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text -> doc_id, license, first_word, containment: one row for each document and license found in it."""
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
    table = table.withColumn("text", F.array_join(F.filter(words(F.col("text")), lambda w: w != ""), " ")).where(F.size(words(F.col("text"))) >= WIDTH)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    met = written(find_candidates(docs, table), "candidates")

    def joined(tokens: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(tokens) - (WIDTH - 1)), lambda i: F.array_join(F.slice(tokens, i, WIDTH), " "))

    wanted = table.select("license", words(F.col("text")).alias("t")).select("license", F.size("t").alias("n"), F.array_distinct(joined(F.col("t"))).alias("wanted"))
    few = table.count() <= MAX_BROADCAST_TEMPLATES
    laid = met.join(texts_of(met, docs), "doc_id").join(F.broadcast(wanted) if few else wanted, "license").withColumn("begin", F.greatest(F.col("near") - STRIDE, F.lit(0)))

    def judged(r: Column) -> Column:
        share = lambda found: F.size(F.array_intersect("wanted", found)) / F.size("wanted")
        first = lambda found: F.array_position(F.transform(found, lambda x: F.array_contains("wanted", x)), True) - 1
        return F.when(F.size(r) >= WIDTH, let(joined(r), lambda found: F.struct(share(found).alias("share"), (F.col("begin") + first(found)).alias("first"))))

    region = lambda tokens: F.slice(tokens, F.col("begin") + 1, F.col("near") + F.col("n") + STRIDE - F.col("begin"))
    scored = laid.select("doc_id", "license", let(region(words(F.col("text"))), judged).alias("j")).select("doc_id", "license", "j.*").where(F.col("share") >= CONTAINED)
    best = scored.groupBy("doc_id", "license").agg(F.max(F.struct("share", (-F.col("first")).alias("back"))).alias("top"))
    return best.selectExpr("doc_id", "license", "-top.back first_word", "top.share containment")
