"""License scans with Spark expressions only.

Text is normalised (lower case, everything but letters and digits parts words) and cut into segments: its lines, runs of
up to RUN of them, its sentences, its paragraphs, and the whole; sentences and paragraphs also over line ends. A segment and a
template are compared by the Dice coefficient of their word bigrams, counted with repeats. At a coefficient of t the sizes m
and n obey t / (2 - t) <= m / n <= (2 - t) / t, so only templates within these bounds are compared, and a segment counts for the one that it is most like.

At least t / (2 - t) of a template's bigrams are common, so of any set of more than the rest of them one is. For each template
such a set is chosen that few, rare words cover: a document without any of these words is done, and so is a segment without
any bigram of the sets. Templates are a fixed list of one row each, so words and bigrams are constants of the plan. Longer
licenses are known by their telling paragraphs and by the notices that refer to them.

Cases: null and empty texts hold no license; a segment of one word is one bigram of that word alone; texts of any
length are scanned whole; ties go to the license that sorts first; repeated rows are reported alike; a null
doc_id keeps its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .native import fixed, numbered

SIMILARITY = 0.8
#: The most lines that are taken together as one segment, beside sentences.
RUN = 3
#: Public notices and paragraphs of licenses, by SPDX identifier; some have several wordings. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", 'Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
#: Words that most texts have; they are the last to be chosen.
PLAIN = frozenset("the of under by in to and or a an this is for with at be that can you may not use file work as any it its all on no 0 1 2 3 4 are must from".split())


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words


def signature(grams: list[str], similarity: float = SIMILARITY) -> tuple[list[str], list[str]]:
    """(words, bigrams): rare words of a template, and its bigrams with them; every text that is similar has one of them."""
    need = math.floor(len(grams) * (1 - similarity / (2 - similarity)) + 1e-9) + 1
    words: list[str] = []
    covered: list[str] = []
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in PLAIN, -len(w), w)):
        if len(covered) >= need:
            break
        words.append(w)
        covered = [g for g in grams if not set(words).isdisjoint(g.split())]
    return words, covered


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: str) -> Column:
    return F.when(F.size(words) < 2, F.transform(words, lambda w: F.xxhash64(w))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))
    )


def segments(keyed: DataFrame) -> DataFrame:
    """keyed (doc_id, text_hash, _t): (doc_id, text_hash, segment), the distinct segments of each text."""
    keyed = fixed(keyed, "_lines", F.split("_t", "\n", -1))
    text = F.col("_t")
    sentences, unwrapped = (
        F.split(F.regexp_replace(x, r"([.!?;])[\x20\x09-\x0D]+", "$1\n"), "\n", -1) for x in (text, F.translate(text, "\n", " "))
    )
    paragraphs = F.split(text, r"\n[^\pL\pN\n]*\n", -1)

    def runs(k: int) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.size("_lines") >= k, F.transform(F.sequence(F.lit(1), F.size("_lines") - k + 1), lambda i: F.array_join(F.slice("_lines", i, F.lit(k)), " "))).otherwise(none)

    every = F.concat("_lines", *[runs(k) for k in range(2, RUN + 1)], sentences, unwrapped, paragraphs, F.array(text))
    keyed = keyed.select("doc_id", "text_hash", F.explode(F.array(every)).alias("all"))
    return keyed.select("doc_id", "text_hash", F.explode(F.array_distinct("all")).alias("segment"))


def find(docs: DataFrame, templates=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, license, dice): the best coefficient of each license that a document holds."""
    spark = docs.sparkSession
    sizes = [len(bigrams(plain_words(t))) for _, t in templates]
    least, most = similarity / (2 - similarity), (2 - similarity) / similarity
    lo, hi = max(1, math.ceil(min(sizes) * least)), math.floor(max(sizes) * most)
    frame = spark.createDataFrame([(name, plain_words(t)) for name, t in templates], "license string, words array<string>").coalesce(1)
    frame = frame.withColumn("grams", _bigrams("words")).withColumn("template", numbered("grams")).select("license", "template")
    telling = [signature(bigrams(plain_words(t)), similarity) for _, t in templates]
    words, grams = sorted({w for ws, _ in telling for w in ws}), sorted({g for _, gs in telling for g in gs})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("_t"))
    keyed = keyed.where(F.arrays_overlap(F.split(F.lower("_t"), r"[^\p{L}\p{N}]+", -1), F.array(*[F.lit(w) for w in words])))
    # A segment under the largest template's bound in words is short, whatever its characters are.
    own = segments(keyed).where(F.regexp_count("segment", F.lit(r"[\p{L}\p{N}]+")) .between(lo, hi + 1))
    own = fixed(own, "words", F.split(_normal(F.col("segment")), " ", -1)).drop("segment")
    own = fixed(own, "grams", _bigrams("words")).drop("words").where(F.size("grams").between(lo, hi))
    own = own.where(F.arrays_overlap("grams", F.array(*[F.xxhash64(F.lit(g)) for g in grams])))
    own = fixed(own, "own", numbered("grams")).select("doc_id", "text_hash", "own")
    m, n = F.size("own"), F.size("template")
    pairs = own.join(F.broadcast(frame), (m >= n * least) & (m <= n * most))  # the size bounds; one row a template
    dice = 2 * F.size(F.array_intersect("own", "template")) / (m + n)
    pairs = pairs.select("doc_id", "text_hash", F.xxhash64("own").alias("segment"), F.struct((-dice).alias("d"), "license").alias("match")).where(F.col("match.d") <= -similarity)
    # A segment speaks for the license that it is most like: notices of one family are alike.
    best = pairs.groupBy("doc_id", "text_hash", "segment").agg(F.min("match").alias("match"))
    return best.groupBy("doc_id", "text_hash", F.col("match.license").alias("license")).agg(F.max(-F.col("match.d")).alias("dice"))


def report(docs: DataFrame, templates=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, licenses, n_licenses, best, dice): a row for each row of docs."""
    found, _ = materialize(find(docs, templates, similarity), "licenses")
    best = F.array_sort(F.collect_list(F.struct((-F.col("dice")).alias("d"), "license")))
    found = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("license")).alias("all"), F.get(best, F.lit(0)).alias("top"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = keys.join(found, keys["doc_id"].eqNullSafe(found["_id"]) & (keys["text_hash"] == found["_hash"]), "left")
    return joined.select(
        "doc_id",
        F.array_join(F.coalesce("all", F.array().cast("array<string>")), ",").alias("licenses"),
        F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_licenses"),
        F.coalesce(F.col("top")["license"], F.lit("")).alias("best"),
        F.coalesce(-F.col("top")["d"], F.lit(0.0)).alias("dice"),
    )
