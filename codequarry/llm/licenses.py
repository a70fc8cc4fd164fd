"""Licence statements: a trained paragraph classifier with a class for unknown licences, confirmed by comparison with templates.

DataFrame and SQL functions only, training included (multinomial logistic regression of Spark's ML library).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import written

NONE, UNKNOWN = "none", "unknown"
WINDOW, STRIDE = 64, 32  # words of a window, and from one window to the next: a statement of 33 words is whole in one
FRAME = 0.25  # weight of a gram that does not tell a family from others; one that does has 1
COMMON = 0.01  # share of ordinary windows from which on a word says nothing of licences
#: Statements by which licences are declared, their titles and short forms.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "MIT License", "This project is MIT licensed.", "Distributed under the terms of the MIT licence.", "License: MIT", "Available under MIT.", "under MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0", "Released under the Apache 2.0 license.", "Apache License 2.0", "Licensed under Apache-2.0.", "under the Apache License", "under Apache 2.0", "License: Apache 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE", "Licensed under the GPLv3.", "Released under the GPLv2.", "GNU GPL", "SPDX-License-Identifier: GPL-2.0-only", "GPL-3.0", "GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "License: GPL", "under the GPL"],
    "LGPL": ["This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE", "Licensed under the LGPL.", "under the LGPL", "Licensed under the LGPLv3.", "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "License: LGPL", "SPDX-License-Identifier: LGPL-3.0-or-later", "GNU Library General Public License"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE", "Released under the AGPL.", "under the AGPL", "Licensed under the AGPLv3.", "AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "License: AGPL"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License", "The BSD License", "BSD licensed", "under BSD", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD", "governed by a BSD-style license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "Licensed under the MPL 2.0.", "Mozilla Public License", "under the MPL", "License: MPL"],
    "CC-BY": ["Licensed under CC BY 4.0.", "Shared under CC BY 4.0.", "Published under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Attribution-ShareAlike", "CC BY-SA", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Attribution-NonCommercial", "CC BY-NC", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work. This work is dedicated to the public domain.", "CC0 1.0 Universal", "under CC0", "SPDX-License-Identifier: CC0-1.0", "Creative Commons Zero", "Dedicated to the public domain under CC0."],
    "proprietary": ["Copyright. All rights reserved.", "Copyright (c). All rights reserved.", "No part of this publication may be reproduced or distributed without prior written permission of the publisher.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.", "Proprietary and confidential."],
}
#: Statements of licences of no family above; they teach the class of unknown licences.
OTHERS = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the European Union Public Licence.",
    "This software is provided as-is, without any express or implied warranty; permission is granted to anyone to use this software for any purpose, subject to the following restrictions.", "This is free and unencumbered software released into the public domain.", "Distributed under the Boost Software License.",
    "Subject to the Common Development and Distribution License.", "Licensed under the Artistic License.", "Published under the Open Font License.", "Use of this text is governed by a licence that can be found in the LICENSE file.", "Released under the terms of the Sleepycat license.", "Licensed under the Academic Free License.",
    "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: BSL-1.0", "Eclipse Public License 2.0", "Licensed under the Server Side Public License, version 1.", "Released under the Elastic License 2.0.",
    "Licensed under the PostgreSQL License.", "Common Public License Version 1.0", "This package is under the Ruby license.", "License: ISC", "Licensed under the Python Software Foundation License Version 2.", "Distributed under the Microsoft Public License.", "Use of this software is governed by the Community Source License.", "Business Software License 2.0", "Public Source License 1.2", "SPDX-License-Identifier: CDDL-1.1",
]
#: Sentences that speak of licences, rights or permission without declaring a licence.
TALK = [
    "he needed a driving license to apply", "the license plate was new", "copyright is a hard subject for many", "they discussed permission and licensing for an hour", "the public library has a domain of its own", "a fishing licence costs little", "copyright law and its history",
    "all rights reserved by the owner of the house for changes of the plan", "the club reserved all rights to change the date", "she granted permission to use the public hall", "they gave permission to copy and distribute the letter", "students of MIT met in the library", "the general public was not admitted", "the version of the story that was released",
    "you can redistribute the seats", "the terms of the contract were public", "the apache helicopter landed", "a licensed teacher of the lesser known school", "the software was distributed on disks", "the source of the river is open to the public", "creative people in common rooms", "the mozilla foundation was mentioned", "a permission from the publisher arrived", "conditions of use are posted in the hall", "the board granted licences to fishermen", "free of charge to any person",
]
BLANK = r"\R[ \t]*+\R\s*+"


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often functions inside ``f`` use it."""
    return F.transform(F.array(value), f)[0]


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct word 1-, 2- and 3-grams."""
    def run(w: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.array_distinct(F.concat(run(w, 1), run(w, 2), run(w, 3))))


def windows_of(words: Column) -> Column:
    """Overlapping windows that cover all words."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - STRIDE), F.lit(STRIDE))
    return let(words, lambda w: F.transform(starts(w), lambda i: F.slice(w, i, WINDOW)))


def bigrams(grams: Column) -> Column:
    return F.filter(grams, lambda g: F.size(F.split(g, " ")) == 2)


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _marks(text: str) -> set[str]:
    """Words and word bigrams of a statement."""
    return {g for g in _grams(text) if g.count(" ") < 2}


def _weighed() -> list[dict]:
    """``family, marks (gram, weight)`` of every template: a gram tells much where one family's statements alone have it.

    What other families, licences that are none of them, or ordinary sentences have too is a frame, and says little; a
    word alone says little too, as it is in the family's bigrams.
    """
    owners: dict[str, set[str]] = {}
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS), (NONE, TALK)]:
        for text in texts:
            for g in _marks(text):
                owners.setdefault(g, set()).add(family)
    weight = lambda g, family: FRAME if " " not in g or owners[g] != {family} else 1.0
    return [{"family": f, "marks": [{"g": g, "w": weight(g, f)} for g in sorted(_marks(t))]} for f, ts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for t in ts]


def _templates(spark: SparkSession) -> DataFrame:
    """``family, marks`` of every template and of the statements of other licences."""
    return _local(spark, _weighed(), "family string, marks array<struct<g: string, w: double>>")


def _grams(text: str) -> set[str]:
    w = re.findall(r"[^\W_]+", text.lower())
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def telling(word: str) -> bool:
    """Words that a statement can be found by: of five letters or more, or a licence's short name."""
    return len(word) >= 5 or word in {f.lower().split("-")[0] for f in TEMPLATES}


def cover(grams: list[str]) -> list[str]:
    """Telling words of which every gram has at least one, found greedily."""
    left, found = [{w for w in g.split(" ") if telling(w)} for g in grams], []
    while left:
        votes: dict[str, int] = {}
        for g in left:
            for w in g:
                votes[w] = votes.get(w, 0) + 1
        best = max(votes, key=lambda w: (votes[w], w))
        found.append(best)
        left = [g for g in left if best not in g]
    return sorted(found)


def holds(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains any of the words, as a part of others too; one that contains another is left out."""
    words = [w for w in words if not any(x != w and x in w for x in words)]
    return let(text, lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in words], F.lit(False)))


@dataclass
class LicenseModel:
    families: list[str]
    weights: DataFrame  # gram, w array<double>
    bias: list[float]
    temperature: float
    cover: list[str]  # every gram with a weight holds one of these; other windows are of class none whatever else they hold


def fit_licenses(docs: DataFrame, negatives: int = 2000) -> LicenseModel:
    """Train on variants of the templates, of other licences' statements, and on at most about ``negatives`` ordinary windows.

    A variant drops every seventh word from some offset on.  Features are the templates' word 1- to 3-grams that have a
    telling word (of five letters, or a licence's short name) of less than COMMON of the ordinary windows.  The temperature that calibrates the
    probabilities minimises the log loss of a first model on templates kept out of it whole; the model is then trained
    anew on all.  Ties go to the first class; an empty table gives a model without ordinary windows.
    """
    spark = docs.sparkSession
    total = docs.count()
    share = min(1.0, negatives / max(total, 1))
    sampled = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(1e6 * share))
    plain = sampled.select(F.explode(windows_of(words_of(F.col("text")))).alias("words")).where("size(words) > 0").withColumn("draw", F.pmod(F.xxhash64("words", F.lit(7)), F.lit(1_000_000)))
    n = plain.count()
    plain = plain.where(F.col("draw") < int(1e6 * min(1.0, negatives / max(n, 1)))).select("words", grams_of(F.col("words")).alias("grams"))
    known = F.array(*[F.array(*map(F.lit, sorted(g for g in _grams(t) if g.count(" ") == 1))) for t in [*sum(TEMPLATES.values(), []), *OTHERS] if " " in t])
    like = F.array_max(F.transform(known, lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)))
    plain = written(plain.where(like < 0.3), "plain")
    n = plain.count()
    vocabulary = sorted(set().union(*[_grams(t) for t in [*sum(TEMPLATES.values(), []), *OTHERS]]))
    often = plain.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin([g for g in vocabulary if " " not in g])).groupBy("w").count().where(F.col("count") >= max(2.0, COMMON * n))
    often = {r["w"] for r in often.collect()}
    vocabulary = [g for g in vocabulary if any(telling(w) and w not in often for w in g.split(" "))]
    rows = [{"family": f, "text": t, "part": p, "k": k} for f, ts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for p, t in enumerate(ts) for k in range(8)]
    rows += [{"family": NONE, "text": t, "part": p, "k": k} for p, t in enumerate(TALK) for k in range(6)]
    kept = let(words_of(F.col("text")), lambda v: F.filter(v, lambda w, i: (F.col("k") == 0) | ((i + F.col("k")) % 7 != 6)))
    made = _local(spark, rows, "family string, text string, part int, k int").select("family", grams_of(kept).alias("grams"), (F.col("part") % 4 == 1).alias("held"))
    ordinary = plain.select(F.lit(NONE).alias("family"), "grams", (F.pmod(F.xxhash64("grams"), F.lit(4)) == 1).alias("held"))
    families = [NONE, UNKNOWN, *TEMPLATES]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = written(made.union(ordinary).withColumn("label", label.cast("double")).coalesce(2), "training")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    first = _fitted(vectors, rows.where("not held"), families)
    z = written(_logits(rows.where("held").select(F.monotonically_increasing_id().alias("id"), "grams", "label"), first, ["id", "label"]), "held")
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    losses = z.agg(*[F.avg(_log_loss(t)).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    model = _fitted(vectors, rows, families)
    model.temperature = min(zip((x if x is not None else 1e9 for x in losses), grid))[1]
    return model


def _fitted(vectors: CountVectorizerModel, rows: DataFrame, families: list[str]) -> LicenseModel:
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.3, maxIter=25).fit(vectors.transform(rows))
    matrix = fitted.coefficientMatrix.toArray()
    grams = [{"gram": g, "w": [float(x) for x in matrix[:, k]]} for k, g in enumerate(vectors.vocabulary) if abs(matrix[:, k]).max() > 1e-6]
    bias = [float(x) for x in fitted.interceptVector.toArray()]
    words = cover([g["gram"] for g in grams]) if bias[0] == max(bias) else [""]
    return LicenseModel(families, written(_local(rows.sparkSession, grams, "gram string, w array<double>"), "weights"), bias, 1.0, words)


def _log_loss(t: float) -> Column:
    top = F.array_max("z")
    return F.log(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))) - (F.get("z", F.col("label").cast("int")) - top) / t


def _logits(rows: DataFrame, model: LicenseModel, keys: list[str]) -> DataFrame:
    """Keys and z: the classes' logits of rows with a column grams; the weights are at most the templates' grams."""
    hit = rows.select(*keys, F.explode(F.concat(F.array(F.lit("")), "grams")).alias("gram")).join(F.broadcast(model.weights), "gram", "left")
    n = len(model.families)
    sums = hit.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"_{k}") for k in range(n)])
    return sums.select(*keys, F.array(*[F.col(f"_{k}") + model.bias[k] for k in range(n)]).alias("z"))


def scan_licenses(docs: DataFrame, model: LicenseModel, sure: float = 0.7, alike: float = 0.6) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_licenses, licenses, n_unknown, best_probability, unknown_probability``.

    A paragraph is a block between blank lines, its lines joined; it is judged by overlapping windows of WINDOW words that
    cover it.  In a window, each licence family counts whose own calibrated probability, against that of no licence and
    of an unknown one, reaches ``sure``, and of one of whose templates the window holds a share of at least ``alike`` of
    the weighed marks (words and bigrams; those that tell the family from others weigh most), half of the telling ones
    among them.  So a paragraph of two
    licences has both.  A paragraph without a family is unknown where a window is likelier of some licence than of none,
    and holds half of any statement's marks.  best_probability is that of the likeliest family in this sense, whether
    it was confirmed or not.  Windows without a gram that
    has a weight are of class none by the model; only they are left out.  licenses: the families, distinct, in
    alphabetical order, comma-joined; n_licenses counts them in each paragraph.

    Null and empty texts have none; equal rows get equal results, rows with a null doc_id and rows that repeat one too;
    other columns are ignored; an empty table gives an empty result.
    """
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")))
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_row", key)
    blocks = docs.where(holds(F.lower("text"), model.cover)).select("_row", F.posexplode(F.split("text", BLANK)).alias("paragraph", "block"))
    near = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, model.cover))) if model.cover != [""] else F.lit(True)
    windows = blocks.where(holds(F.lower("block"), model.cover)).select("_row", "paragraph", F.posexplode(windows_of(words_of(F.col("block")))).alias("window", "words"))
    found = windows.where(near(F.col("words"))).dropDuplicates(["_row", "paragraph", "window"])
    found = written(found.select("_row", "paragraph", "window", grams_of(F.col("words")).alias("grams")), "windows")
    z = _logits(found, model, ["_row", "paragraph", "window"])
    top = F.array_max("z")
    odds = F.transform("z", lambda x: F.exp((x - top) / model.temperature))
    z = z.select("_row", "paragraph", "window", odds.alias("o")).withColumn("all", F.aggregate("o", F.lit(0.0), lambda a, x: a + x))
    z = z.select("_row", "paragraph", "window", F.transform("o", lambda x: x / F.col("all")).alias("ps")).where("ps[0] < 0.5")
    templates = _templates(docs.sparkSession).groupBy("family").agg(F.collect_list("marks").alias("templates"))
    known = F.broadcast(templates)  # as many rows as families
    names = F.array(*map(F.lit, model.families[1:]))
    against = lambda p: p / (p + F.col("ps")[0] + F.col("ps")[1])
    each = z.join(found, ["_row", "paragraph", "window"]).select("_row", "paragraph", "window", "grams", "ps", F.explode(F.arrays_zip(names.alias("family"), F.slice("ps", 2, len(model.families)).alias("p"))).alias("e"))
    total = lambda marks: F.aggregate(marks, F.lit(0.0), lambda a, m: a + m["w"])
    telling = lambda marks: total(F.filter(marks, lambda m: m["w"] == 1.0))

    def held(marks: Column) -> Column:
        here = F.filter(marks, lambda m: F.array_contains("grams", m["g"]))
        tells = (telling(here) * 2 >= telling(marks)) & (telling(here) > 0)
        return F.struct((F.when(tells, total(here)).otherwise(0.0) / total(marks)).alias("near"), (total(here) / total(marks)).alias("any"))

    each = each.select("_row", "paragraph", "window", "ps", "e.family", "e.p", "grams").join(known, "family").withColumn("held", F.transform("templates", held))
    each = each.withColumns({"near": F.array_max("held.near"), "any": F.array_max("held.any")})
    each = each.withColumn("named", F.when(F.col("family") != UNKNOWN, against(F.col("p"))))
    ok = F.when((F.col("named") >= sure) & (F.col("near") >= alike), F.col("family"))
    judged = each.groupBy("_row", "paragraph", "window").agg(F.collect_set(ok).alias("f"), F.max("any").alias("near"), F.max("named").alias("p"), F.max(F.col("ps")[1]).alias("unknown"))
    per = judged.groupBy("_row", "paragraph").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("f"), F.max("near").alias("near"), F.max("p").alias("p"), F.max("unknown").alias("u"))
    per_doc = per.groupBy("_row").agg(
        F.sum(F.size("f").cast("long")).alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))), ",").alias("licenses"), F.sum(((F.size("f") == 0) & (F.col("near") >= 0.5)).cast("long")).alias("n_unknown"), F.max("p").alias("p"), F.max("u").alias("u")
    )
    out = docs.select("doc_id", "_row").join(per_doc, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", zero("n_licenses").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), zero("n_unknown").alias("n_unknown"), F.round(F.coalesce("p", F.lit(0.0)), 4).alias("best_probability"), F.round(F.coalesce("u", F.lit(0.0)), 4).alias("unknown_probability"))
