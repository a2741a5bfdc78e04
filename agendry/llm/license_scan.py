"""License scans with DataFrame functions only.

Texts become hashes of five-word shingles. Positions whose hash is that of some template's shingle are
found in the row; only windows around them can contain a template. Windows overlap by half and hold
twice the shingles of a template's size class, so each occurrence lies whole in one window. MinHash
bands of a window meet the bands of the templates in a broadcast join; what meets is verified by exact
containment of the template's shingles.

Sister licenses share most of their words: a GPL notice holds 0.87 of the AGPL's. So of matches of different
licenses that cover one another by half or more, the one of the largest containment stays, then the longer.

A window that holds 0.8 of a template of its class has a Jaccard similarity of at least 0.19 with it
(0.8 t common of at most 2 c + 0.2 t shingles, where c / 2 < t <= c). With 64 bands of one MinHash
each, such a window is missed with a chance below (1 - 0.19) ** 64, about one in 700,000.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from agendry.llm.decontam import words_of

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64

# Statements and short notices of public licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def template_shingles(text: str) -> list[tuple[str, ...]]:
    """Distinct five-word shingles of a template, in order; it needs five words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    return list(dict.fromkeys(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def chained_hash(words: tuple[str, ...]) -> int:
    """Spark's xxhash64 of an array of strings: the hash of each is the seed of the next."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return _signed(h)


def size_class(n: int) -> int:
    return 1 << (n - 1).bit_length()


def _min_hashes(hashes: Column) -> Column:
    """One (band, value) for each band; the value is the least of the shingles' hashes under the band's seed."""
    least = lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))
    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("value")) for b in range(BANDS)])


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word) for each license that a row of ``docs`` holds.

    ``containment`` is the largest share of a template's shingles in one window, ``n_windows`` the
    windows that reach the limit with some template of the license, ``first_word`` the number, from 1,
    of the first word of the first of them. A match that a better one of another license covers is not
    counted (see above). Rows without a license (null and empty texts among them) give none; repeated
    rows and null ids give their own. Matches do not depend on case, spacing or punctuation. The
    templates are parameters of known size, not data: their table is always small.
    """
    listed = [(name, n, [chained_hash(s) for s in template_shingles(t)]) for name, texts in (templates or TEMPLATES).items() for n, t in enumerate(texts)]
    spark = docs.sparkSession
    known = spark.createDataFrame([(name, n, size_class(len(h)), h) for name, n, h in listed], "license string, variant int, cls int, shingles array<bigint>")
    table = F.broadcast(known.select("license", "variant", "cls", "shingles", F.explode(_min_hashes(F.col("shingles"))).alias("b")).select("license", "variant", "cls", "shingles", "b.band", "b.value"))
    by_class: dict[int, set[int]] = {}
    for _, _, h in listed:
        by_class.setdefault(size_class(len(h)), set()).update(h)

    worded = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words_of(F.col("text")).alias("words"))
    n = F.size("words")
    hashed = worded.select("row_id", "doc_id", F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(SHINGLE))))).otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    every = sorted(set().union(*by_class.values()))
    touched = hashed.withColumn("at", F.array_compact(F.transform("hashes", lambda h, i: F.when(h.isin(every), i)))).where(F.size("at") > 0)

    def windows(cls: int, own: set[int]) -> Column:
        # Window k holds the shingles from k * cls on, 2 * cls of them; a position lies in windows k and k - 1.
        mine = F.filter("at", lambda i: F.element_at("hashes", i + 1).isin(sorted(own)))
        k = lambda i: F.floor(i / cls).cast("int")
        numbers = F.array_distinct(F.flatten(F.transform(mine, lambda i: F.when(k(i) > 0, F.array(k(i) - 1, k(i))).otherwise(F.array(k(i))))))
        return F.transform(numbers, lambda w: F.struct(F.lit(cls).alias("cls"), (w * cls).alias("start"), F.array_distinct(F.slice("hashes", w * cls + 1, F.lit(2 * cls))).alias("held")))

    each = touched.select("row_id", "doc_id", F.explode(F.concat(*[windows(c, own) for c, own in sorted(by_class.items())])).alias("w"))
    banded = each.select("row_id", "doc_id", "w.cls", "w.start", "w.held", F.explode(_min_hashes(F.col("w.held"))).alias("b"))
    met = banded.join(table, ["cls"], "inner").where("b.band = band and b.value = value")
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    # Where in its window a match begins and ends, counted in shingles of the text.
    places = F.filter(F.transform("held", lambda h, i: F.when(F.array_contains("shingles", h), i)), lambda i: i.isNotNull())
    at = lambda end: F.col("start") + F.element_at(places, end)
    verified = met.withColumn("containment", share).where(F.col("containment") >= containment).select(
        "row_id", "doc_id", "license", "start", "containment", F.size("shingles").alias("size"), at(1).alias("lo"), at(-1).alias("hi")
    ).distinct()
    every = verified.groupBy("row_id", "doc_id").agg(F.collect_list(F.struct("license", "start", "containment", "size", "lo", "hi")).alias("all"))
    common = lambda m, o: F.least(m["hi"], o["hi"]) - F.greatest(m["lo"], o["lo"]) + 1
    covers = lambda m, o: 2 * common(m, o) >= F.least(m["hi"] - m["lo"], o["hi"] - o["lo"]) + 1
    better = lambda m, o: (o["license"] != m["license"]) & (F.struct(o["containment"], o["size"], o["license"]) > F.struct(m["containment"], m["size"], m["license"])) & covers(m, o)
    best = F.filter("all", lambda m: ~F.exists("all", lambda o: better(m, o)))
    return every.select("row_id", "doc_id", F.explode(best).alias("m")).groupBy("row_id", "doc_id", F.col("m.license").alias("license")).agg(
        F.max("m.containment").alias("containment"), F.count_distinct("m.start").alias("n_windows"), (F.min("m.start") + 1).cast("long").alias("first_word")
    ).drop("row_id")
