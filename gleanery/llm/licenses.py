"""License scans by MinHash over overlapping text windows, in DataFrame functions only.

Templates fall into classes by length. For a class, a text's words are seen
through overlapping windows, just longer than the class's longest template and
so close that every passage of that length lies whole in some window. Windows
and templates are reduced to `BANDS` minima of their five-word shingles; one
equal minimum retrieves the template. A window that holds 0.8 of a template's
shingles resembles it by `least_resemblance()` at least, so a band misses it
with one less that chance and all bands with its power: below 1e-6 for every
template, which templates() asserts. Exact containment of shingles decides.

A template of fewer than five words is one shingle, the whole of it, and is in
a class with those of its own length. Its windows are five words at every word,
and each of their runs of that length is a key, in place of the bands.

Only windows with a telling word are looked at. That loses nothing: more than
a fifth of each template's shingles hold a telling word, so no 0.8 of them can
do without one; templates() asserts that too.
"""

from __future__ import annotations

from math import ceil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text

SHINGLE, CONTAINED, BANDS = 5, 0.8, 48
#: Notices as public licenses ask for them or as they are commonly written.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "rights-reserved": "All rights reserved.",
    "rights-reserved-publication": "Copyright holder. All rights reserved. No part of this publication may be reproduced without permission.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-gpl2": "SPDX-License-Identifier: GPL-2.0",
    "spdx-lgpl21": "SPDX-License-Identifier: LGPL-2.1",
    "spdx-agpl3": "SPDX-License-Identifier: AGPL-3.0",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
    "apache-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        'required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "mpl-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "cc0-notice": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
        "neighboring rights to this work."
    ),
    "bsd-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
}
TELLING = (
    "license licensed licenses licence licenced sublicense copyright permission permitted permissions warranty warranties "
    "redistribution redistributions redistribute distributed conditions software spdx gnu apache rights reserved reproduced"
).split()


def split_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else " " for c in text))


def runs(words: list[str], size: int) -> set[str]:
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def shingles(words: list[str]) -> set[str]:
    """All that a template can share with these words: runs of SHINGLE words and, for short templates, of fewer."""
    return set().union(*(runs(words, size) for size in range(1, SHINGLE + 1)))


def steps(longest: int) -> tuple[int, int]:
    """Words in a window of the class, and between the starts of two."""
    if longest < SHINGLE:
        return SHINGLE, 1
    stride = max(1, longest // 4)
    return longest + stride - 1, stride


def least_resemblance(n_words: int, longest: int) -> float:
    """Of a template and a window of its class that holds CONTAINED of it."""
    own, window = n_words - SHINGLE + 1, steps(longest)[0] - SHINGLE + 1
    common = ceil(CONTAINED * own)
    return common / (window + own - common)


def templates(notices: dict[str, str] = NOTICES) -> list[tuple[str, int, list[str]]]:
    """(name, longest of its class, shingles); the classes' lengths grow by a quarter, below SHINGLE each length is one."""
    words = {name: split_words(text) for name, text in notices.items()}
    limits: list[int] = []
    for n in sorted(set(map(len, words.values())), reverse=True):
        if not limits or n * 1.25 < limits[-1] or n < SHINGLE:
            limits.append(n)
    found = []
    for name, own in words.items():
        if not own:
            raise ValueError(f"{name} has no words")
        longest = min(x for x in limits if x >= len(own))
        grams = runs(own, min(len(own), SHINGLE))
        telling = sum(any(w in TELLING for w in g.split()) for g in grams)
        if telling <= (1 - CONTAINED) * len(grams):
            raise ValueError(f"{name}: too few shingles hold a telling word")
        if len(own) >= SHINGLE and (1 - least_resemblance(len(own), longest)) ** BANDS > 1e-6:
            raise ValueError(f"{name}: the bands would miss it too often")
        found.append((name, longest, sorted(grams)))
    return found


def band_keys(grams: Column, longest: Column) -> Column:
    """One key for each band: its number, the class and the smallest hash of a shingle; of a short class each shingle is a key."""
    bands = F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda j: F.xxhash64(j, longest, F.array_min(F.transform(grams, lambda g: F.xxhash64(j, g)))),
    )
    return F.when(longest < SHINGLE, F.transform(grams, lambda g: F.xxhash64(F.lit(0), longest, g))).otherwise(bands)


def template_table(spark: SparkSession, notices: dict[str, str] = NOTICES) -> DataFrame:
    rows = [(name, longest, grams) for name, longest, grams in templates(notices)]
    return spark.createDataFrame(rows, "license string, longest int, t_grams array<string>")


def windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, _row, longest, start, words) of all windows that hold a telling word; _row is the text's hash."""
    told = id_text(docs).filter(F.rlike("text", F.lit("(?i)" + "|".join(TELLING))))
    worded = told.select("doc_id", F.xxhash64("text").alias("_row"), F.regexp_extract_all(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", " ")), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    telling = F.array(*map(F.lit, TELLING))
    at = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(telling, x), i)), lambda i: i.isNotNull())
    placed = worded.withColumn("_at", at).filter(F.size("_at") > 0)
    made = None
    for longest in lengths:
        size, stride = steps(longest)
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - (size - 1)) / stride)).cast("int")  # noqa: B023, E731
        last = lambda p: F.least(F.floor(p / stride), F.floor(F.greatest(F.size("w") - SHINGLE, F.lit(0)) / stride)).cast("int")  # noqa: B023, E731
        of_word = lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>"))  # noqa: B023, E731
        numbers = F.array_distinct(F.flatten(F.transform("_at", of_word)))
        own = F.transform(numbers, lambda k: F.struct(F.lit(longest).alias("longest"), (k * stride).alias("start"), F.slice("w", k * stride + 1, size).alias("words")))  # noqa: B023
        made = own if made is None else F.concat(made, own)
    return placed.select("doc_id", "_row", F.explode(made).alias("x")).select("doc_id", "_row", "x.longest", "x.start", "x.words")


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): each document and template that it holds.

    A template is held where a window of its class contains at least 0.8 of its
    five-word shingles (ASCII letters and digits, in lower case); one of fewer
    words has to be there as a whole. containment
    is the best window's, first_word the number of the earliest such window's
    first word, n_windows how many there are. Null, empty and short texts hold
    none, and documents that hold none have no row. Rows that repeat a doc_id
    are taken together. Other columns are ignored.

    Templates are a parameter and their table is broadcast; documents without a
    telling word go at the scan, and all else stays with its document until
    the last aggregation of the matches.
    """
    spark = docs.sparkSession
    table = template_table(spark, notices)
    lengths = sorted({longest for _, longest, _ in templates(notices)})
    seen = windows(docs, lengths)
    width = F.least(F.col("longest"), F.lit(SHINGLE))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.array_join(F.slice("words", i, width), " "))
    seen = seen.filter(F.size("words") >= width).withColumn("grams", grams)
    keyed = seen.withColumn("key", F.explode(band_keys(F.col("grams"), F.col("longest"))))
    banded = table.select("license", "t_grams", F.explode(band_keys(F.col("t_grams"), F.col("longest"))).alias("key"))
    met = keyed.join(F.broadcast(banded), "key").dropDuplicates(["doc_id", "_row", "longest", "start", "license"])
    share = F.size(F.array_intersect("grams", "t_grams")) / F.size("t_grams")
    held = met.select("doc_id", "license", "start", share.alias("share")).filter(F.col("share") >= CONTAINED)
    return held.groupBy("doc_id", "license").agg(
        F.round(F.max("share"), 6).alias("containment"),
        F.min("start").cast("long").alias("first_word"),
        F.count("*").alias("n_windows"),
    )


def op3_licenses(spark, sf_dir):
    return scan(documents(spark, sf_dir))
