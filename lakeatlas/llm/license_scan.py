"""License scan: MinHash bands over overlapping windows find templates, exact containment of shingles verifies them.

A text's words are cut into windows a quarter longer than a template, a quarter apart, so that each occurrence lies whole in
one window. There, ``containment`` of the template's shingles bounds the Jaccard likeness from below; the number of bands
(of one row) follows from this bound and the wanted probability of a collision. Windows that meet a template in a band are
compared with it exactly. Templates of nearly one length share their windows; of siblings, which are templates that share
half of their shingles, the one that a window and those beside it hold most of is what they state.

Windows without any anchor word are left out beforehand, at no loss: the anchors of a template are words so chosen that
more of its shingles have one than a match may lack.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import text_or_empty

WIDTH = 3
#: Bytes of template words, for each band once, up to which templates are broadcast.
SIDE_BYTES = 16 << 20
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
#: Notices by which texts state their license, and the wording of short licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "Proprietary": ["All rights reserved"],
}


#: Licenses whose texts hold those of another, which they stand for.
EXTENDS = {"BSD-3-Clause": "BSD-2-Clause"}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    k = min(WIDTH, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def anchors_of(words: list[str], containment: float) -> list[str]:
    """The longest words until more shingles have one of them than a match may lack."""
    shingles = shingles_of(words)
    lack = len(shingles) - math.ceil(containment * len(shingles))
    chosen: list[str] = []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.append(w)
        if sum(any(c in s for c in chosen) for s in shingles) > lack:
            break
    return chosen


def siblings_of(templates: list[tuple[int, str, list[str]]]) -> dict[int, int]:
    """The group of each template (number, license, words): templates of different licenses that share half of their shingles."""
    sets = {i: shingles_of(w) for i, _, w in templates}
    name = {i: n for i, n, _ in templates}
    group = {i: i for i in sets}

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and name[a] != name[b] and 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b])):
                group[root(b)] = root(a)
    return {i: root(i) for i in sets}


def window_lengths(templates: list[tuple[int, str, list[str]]]) -> dict[int, int]:
    """For each template the length that its windows are cut for: the longest of those up to a tenth longer, and one for siblings."""
    lengths = sorted({len(w) for _, _, w in templates}, reverse=True)
    of: dict[int, int] = {}
    for n in lengths:
        longest = min((c for c in set(of.values()) if n >= 0.9 * c), default=n)
        of[n] = longest
    group = siblings_of(templates)
    own = {i: of[len(w)] for i, _, w in templates}
    return {i: max(own[k] for k in own if group[k] == group[i]) for i in own}


def n_bands(lengths: list[tuple[int, int]], containment: float, probability: float) -> int:
    """Bands of one row with which a match collides with the given probability, at the least likeness it can have; for (words of
    the template, length that its windows are cut for)."""
    least = min(containment * s / (max(1, c + step(c) - WIDTH + 1) + (1 - containment) * s) for n, c in lengths for s in [max(1, n - WIDTH + 1)])
    return math.ceil(math.log(1 - probability) / math.log(1 - least))


def step(length: int) -> int:
    return max(1, length // 4)


def _hashes(words: Column) -> Column:
    """Distinct hashes of the runs of WIDTH words; of fewer, of the one run of all."""
    last = F.greatest(F.size(words) - WIDTH, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WIDTH)))))


def _bands(hashes: Column, n: int) -> Column:
    def low(i: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(i))))

    return F.array(*(F.struct(F.lit(i).alias("band"), low(i).alias("low")) for i in range(n)))


def _starts(length: int, anchors: list[str]) -> Column:
    """Starts of the windows for templates of a length, of those that have an anchor."""
    every = F.sequence(F.lit(0), F.greatest(F.size("words") - length + step(length) - 1, F.lit(0)), F.lit(step(length)))
    own = F.array(*(F.lit(a) for a in anchors))
    return F.filter(every, lambda s: F.arrays_overlap(F.slice("words", s + 1, F.lit(length + step(length))), own))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = 0.8, probability: float = 0.9999) -> DataFrame:
    """``(doc_id, license, containment)``: one row for each license of which a template is found in ``docs(doc_id, text, ...)``.

    containment: the greatest share of a template's shingles in one window; of siblings in windows
    up to two steps (half a template) apart those with the greatest share alone count, and a license of which another is an extension (BSD-2-Clause of BSD-3-Clause) is left
    out beside it. Rows of one doc_id count together; a null
    doc_id is one of its own. Null and empty texts hold nothing. An empty table gives no rows. Other columns are not
    looked at. ``templates`` is a dictionary of the caller, which is part of the plan; beyond ``SIDE_BYTES`` of words it is
    joined by shuffle instead of broadcast.
    """
    spark: SparkSession = docs.sparkSession
    known = [(i, name, w) for i, (name, t) in enumerate((n, t) for n, ts in (templates or TEMPLATES).items() for t in ts) if (w := words_of(t))]
    group, cut_for = siblings_of(known), window_lengths(known)
    lengths = sorted(set(cut_for.values()))
    bands = n_bands([(len(w), cut_for[i]) for i, _, w in known], containment, probability)
    side = spark.createDataFrame(
        [(i, name, w, cut_for[i], group[i]) for i, name, w in known],
        "template int, license string, words array<string>, length int, siblings int",
    ).withColumn("own", _hashes(F.col("words")))
    small = sum(len(x) for _, _, w in known for x in w) * bands <= SIDE_BYTES
    side = (F.broadcast if small else lambda df: df)(
        side.select(
            "template",
            "siblings",
            "license",
            "length",
            "own",
            F.explode(_bands(F.col("own"), bands)).alias("b"),
        ).select("template", "siblings", "license", "length", "own", "b.band", "b.low")
    )

    anchors = {n: sorted({a for i, _, w in known if cut_for[i] == n for a in anchors_of(w, containment)}) for n in lengths}
    low = docs.select("doc_id", F.lower(text_or_empty()).alias("text"))
    some = F.lit(False)
    for a in sorted({a for x in anchors.values() for a in x}):
        some = some | F.contains("text", F.lit(a))
    words = low.where(some).select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    starts = F.array(*(F.struct(F.lit(n).alias("length"), F.lit(n + step(n)).alias("size"), _starts(n, anchors[n]).alias("starts")) for n in lengths))
    cut = F.flatten(
        F.transform(
            starts,
            lambda c: F.transform(c["starts"], lambda s: F.struct(c["length"].alias("length"), s.alias("start"), F.slice("words", s + 1, c["size"]).alias("window"))),
        )
    )
    windows = words.where("size(words) > 0").select("doc_id", "text_hash", F.explode(cut).alias("w")).select(
        "doc_id",
        "text_hash",
        "w.length",
        "w.start",
        F.col("w.window").alias("window"),
    ).withColumn("hashes", _hashes(F.col("window")))
    banded = windows.select(
        "doc_id",
        "text_hash",
        "length",
        "start",
        "hashes",
        F.explode(_bands(F.col("hashes"), bands)).alias("b"),
    ).select("doc_id", "text_hash", "length", "start", "hashes", "b.band", "b.low")
    met = banded.join(side, ["length", "band", "low"])
    share = F.size(F.array_intersect("hashes", "own")) / F.size("own")
    held = met.withColumn("containment", share).where(F.col("containment") >= containment)
    steps = (F.col("start") / F.greatest(F.floor(F.col("length") / 4), F.lit(1))).cast("int")
    near = Window.partitionBy("doc_id", "text_hash", "length", "siblings").orderBy("steps").rangeBetween(-2, 2)
    best = held.withColumn("steps", steps).withColumn("most", F.max("containment").over(near)).where("containment = most")
    found = best.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
    extended = F.create_map(*(F.lit(x) for pair in EXTENDS.items() for x in pair))
    named = found.groupBy("doc_id").agg(F.collect_list(F.struct("license", "containment")).alias("all"))
    beside = F.transform("all", lambda x: F.element_at(extended, x["license"]))
    kept_ = F.filter("all", lambda x: ~F.array_contains(F.array_compact(beside), x["license"]))
    return named.select("doc_id", F.explode(kept_).alias("x")).select("doc_id", "x.license", "x.containment")
