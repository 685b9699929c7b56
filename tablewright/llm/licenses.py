"""License notices in texts, found by MinHash over windows and proven by containment.

Texts become words of letters and digits in lower case, words become shingles of five
(a template of fewer words is one shingle of its own length), and shingles are hashed.
Templates of similar length share a window length, twice the longest of them, and windows
overlap by half, so that wherever a notice stands one window holds all of it. Each window's
MinHash signature is cut into bands of one row; a window and a template that agree in a
band are a candidate pair. A window that holds the wanted share of a template has at least
the similarity ``least_similarity`` with it, and the number of bands is taken so that such a
pair is missed with a probability of at most ``MISSED``. Candidates are then verified by
exact containment. Windows without any shingle of any template cannot agree in a band and
get no signature, and texts with none of the words that every
sufficient share of a template has (:func:`anchors`) are not hashed at all. A license has
several wordings; of licenses whose wordings differ by a version or a word (``FAMILIES``) the
one that a window, or one that overlaps it, holds best is reported. All of it is DataFrame
functions; the templates are a parameter and so a small, fixed table.

Defined results: null and empty texts, and texts without notices, give no row; rows with
equal ids are scanned each for itself; columns other than id and text are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import bound, text_of

SHINGLE = 5
CONTAINED = 0.75
MISSED = 1e-6

#: fixed values: the wordings by which texts state a license
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}
#: licenses whose wordings differ by a version or a word: of these the best in a place is reported
FAMILIES = {
    "GPL-2.0": "GNU", "GPL-3.0": "GNU", "LGPL-2.1": "GNU", "LGPL-3.0": "GNU", "AGPL-3.0": "GNU",
    "CC-BY-4.0": "CC", "CC-BY-NC-4.0": "CC", "CC-BY-SA-4.0": "CC",
}


def plain_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def wordings(notices: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(name, text) for name, texts in notices.items() for text in texts]


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _hashes(words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words, in order."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _signature(hashes: Column, bands: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), bands), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))
    )


def _windows(hashes: Column, group: int, longest: int, words: int, bands: int, known: list[int]) -> Column:
    """The windows of a document that hold a shingle of some template."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - longest - 1, F.lit(0)), F.lit(longest))
    each = F.transform(
        starts,
        lambda s: F.struct(
            F.lit(group).alias("group"), s.alias("start"), F.lit(words).alias("words"), F.lit(bands).alias("bands"),
            F.slice(hashes, s + 1, 2 * longest).alias("hashes"),
        ),
    )
    return F.filter(each, lambda w: F.arrays_overlap(w["hashes"], F.lit(known)))


def template_groups(notices: dict[str, tuple[str, ...]] = NOTICES) -> dict[tuple[int, int], list[tuple[str, str]]]:
    """The wordings by (shingle size, most shingles of a template of the group)."""
    groups: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for name, text in wordings(notices):
        words = len(plain_words(text))
        size = min(SHINGLE, words)
        groups.setdefault((size, 2 ** math.ceil(math.log2(words - size + 1))), []).append((name, text))
    return groups


def anchors(notices: dict[str, tuple[str, ...]] = NOTICES) -> list[str]:
    """Words of which a text must have one to hold the wanted share of any template.

    For each template its longest words are taken until the shingles with one of them are
    more than may be missing.
    """
    chosen: set[str] = set()
    for _, text in wordings(notices):
        words = plain_words(text)
        size = min(SHINGLE, len(words))
        shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        own: set[str] = {w for w in words if w in chosen}
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(bool(own & set(s)) for s in shingles) > (1 - CONTAINED) * len(shingles):
                break
            own.add(word)
        chosen |= own
    return sorted(chosen)


def least_similarity(longest: int) -> float:
    """Of a window of twice ``longest`` shingles and a template of its group that it contains
    to the wanted share; the shortest of a group has over half as many shingles."""
    shortest = longest // 2 + 1 if longest > 1 else 1
    return CONTAINED * shortest / (2 * longest + (1 - CONTAINED) * shortest)


def bands_for(longest: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - least_similarity(longest)))


def find_licenses(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, families: dict[str, str] = FAMILIES, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per document and license: id, ``license``, ``containment`` (largest), ``first_word``
    and ``last_word`` (of the first such window), ``windows`` (that hold it)."""
    spark = docs.sparkSession
    groups = template_groups(notices)
    sizes = sorted({size for size, _ in groups})
    rows = [
        (number, size, bands_for(longest), longest, name, families.get(name, name), wording)
        for number, ((size, longest), texts) in enumerate(sorted(groups.items()))
        for name, wording in texts
    ]
    lines = spark.createDataFrame(rows, "group int, size int, bands int, longest int, license string, family string, notice string")
    words = _words(F.col("notice"))
    shingles = F.coalesce(*[F.when(F.col("size") == s, _hashes(words, s)) for s in sizes])
    templates = lines.coalesce(1).select("group", "size", "bands", "longest", "license", "family", F.array_distinct(shingles).alias("template"))
    known: dict[int, list[int]] = {size: [] for size in sizes}
    for row in templates.select("size", "template").collect():  # of the parameter, not of the corpus
        known[row.size].extend(row.template)
    body = text_of(text)
    base = docs.where(F.lower(body).rlike("|".join(anchors(notices)))).select(
        F.col(id).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        bound(_words(body), lambda w: F.struct(*[_hashes(w, s).alias(f"h{s}") for s in sizes])).alias("h"),
    ).select("doc_id", "row", *[F.col(f"h.h{s}").alias(f"h{s}") for s in sizes])
    windows = [
        _windows(F.col(f"h{size}"), number, longest, 2 * longest + size - 1, bands_for(longest), known[size])
        for number, (size, longest) in enumerate(sorted(groups))
    ]
    keys = templates.select("group", "longest", "license", "family", "template", F.posexplode(_signature(F.col("template"), F.col("bands"))).alias("band", "key"))
    hits = (
        base.select("doc_id", "row", F.explode(F.concat(*windows)).alias("w"))
        .select("doc_id", "row", "w.*")
        .select("*", F.posexplode(_signature(F.col("hashes"), F.col("bands"))).alias("band", "key"))
        .join(F.broadcast(keys), ["group", "band", "key"])
        .select("*", (F.size(F.array_intersect("hashes", "template")) / F.size("template")).alias("containment"))
        .where(F.col("containment") >= CONTAINED)
        # a pair comes once for each band in which it agrees, and for each wording
        .groupBy("row", "doc_id", "group", "family", "license", "start", "words", "longest")
        .agg(F.max("containment").alias("containment"))
    )
    # a window and those that overlap it: where a license of the family is held better, others are not meant
    place = F.floor(F.col("start") / F.col("longest"))
    near = Window.partitionBy("row", "group", "family").orderBy(place).rangeBetween(-1, 1)
    best = hits.withColumn("best", F.max(F.struct("containment", "license")).over(near))
    return (
        best.where((F.col("best.containment") <= F.col("containment")) | (F.col("best.license") == F.col("license")))
        .groupBy("row", "doc_id", "license")
        .agg(
            F.max("containment").alias("containment"),
            F.min(F.struct("start", "words")).alias("first"),
            F.count_distinct("start", "words").alias("windows"),
        )
        .select(
            "doc_id", "license", "containment", F.col("first.start").alias("first_word"),
            (F.col("first.start") + F.col("first.words") - 1).alias("last_word"), "windows",
        )
    )
