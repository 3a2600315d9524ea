"""Licence scans, in DataFrame functions and Spark's own logistic regression.

A sparse multinomial model on word 1- and 2-grams tells the licence family of a paragraph and of each of its lines.  A
paragraph is a run of lines between lines without a letter or digit, so notices may be wrapped, and comment leaders don't matter.  It is
trained on the notices below and, for the class of unknown paragraphs, on a bounded sample of the corpus.  Its
features are n-grams of the notices that hold a cue word, any word of the notices but numbers and English function words; so a
paragraph without cue words has no feature, is unknown by construction, and needs no scoring.  What is scored thus depends
on the notices alone; the sample, of distinct lines and paragraphs, decides the weights.
Probabilities are calibrated by a temperature found on notices and lines that a first fit didn't see; the fit in use sees
all.  Of equally probable families the first in the list is told.  A family is
confirmed if 80 of 100 of the 5-word shingles of one of its notices are in the paragraph, predicted or not, as a paragraph
may hold several.  A paragraph has a row for each family that is predicted or confirmed, of its best line or of the whole.

Paragraphs and lines of equal features and notice shingles are scored once, however many documents hold them.

Edge cases: null text is empty.  Texts without a licence give no row.  Notices of fewer than five words
are one shingle, looked up among the paragraph's runs of as many words.  Null and repeated ids are kept as they are, a row for each.
Very long texts are scanned whole, a text's words in one row.  Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dim_join, packed, unit_hash

UNKNOWN = "unknown"
TEMPERATURES = [0.25 * 1.25**i for i in range(20)]
#: Well-known notices of licence families.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Zlib": [
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0).",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
#: Paragraphs that speak of licences but grant none.
OTHERS = [
    "All rights reserved.",
    "The driver showed a licence and drove on with the copy of the form.",
    "A software license may be expensive, and the version matters.",
    "He was granted permission to use the public library free of charge.",
    "The work was released to the general public under another name.",
    "This version of the program is distributed in several countries.",
    "Common terms and conditions of sale are published by the foundation.",
    "Licensed under the terms of a commercial agreement with the vendor.",
    "Released under our own proprietary license, version 2.0.",
    "Licensed under the Example Public License 1.0.",
    "This software is licensed under another license; see the file for details.",
    "The source code is governed by the terms of your contract.",
]
#: Words of the notices that are no cues.
FUNCTION_WORDS = "a above all along an and any are as at be been by can for from have if in is it may must no not of on or provided should such that the this to under unless with without you".split()


def tokens(text: Column) -> Column:
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+", -1)
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


def constant(values: list[str]) -> Column:
    """An array of strings without line feeds as one literal, which the optimiser takes apart once."""
    return F.split(F.lit("\n".join(values)), "\n", -1)


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_grams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""

    def grams(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.concat(w, pairs))

    return bound(words, grams)


def shingles(words: Column, k: int = 5) -> Column:
    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " ")))

    return bound(words, runs)


def telling(word: str) -> list[str]:
    """The runs of letters and digits in a word that may make it a cue: with a letter, longer than one, no function words."""
    return [r for r in re.findall(r"[^\W_]+", word) if len(r) > 1 and not r.isdigit() and r not in FUNCTION_WORDS]


def may_hold(text: Column, cues: list[str]) -> Column:
    """False only if no token of the text is a cue: a cue's longest telling run would be a run there."""
    runs = sorted({max(telling(c), key=len) for c in cues})
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), constant(runs))


@dataclass(frozen=True)
class Model:
    classes: list[str]
    cues: list[str]
    features: list[str]
    weights: DataFrame  # (feature, w array<double>), at most as many rows as the notices have n-grams
    bias: list[float]
    temperature: float


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def notice_rows(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in NOTICES.items() for text in texts] + [(UNKNOWN, text) for text in OTHERS]
    return spark.createDataFrame(rows, "family string, line string")


def paragraphs_of(docs: DataFrame, text_col: str) -> Column:
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?im)^[\x20\t]*+(?:dnl|rem)(?=[\x20\t\r\n]|\z)", "")  # leaders that are words
    return F.split(text, r"\n(?:[^\p{L}\p{N}\n]*+\n)++", -1)


def units(paragraph: Column) -> Column:
    """A paragraph and its lines."""
    return F.array_distinct(F.concat(F.array(paragraph), F.split(paragraph, "\n", -1)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_unknown: int = 3000) -> Model:
    """Fit on the notices and at most max_unknown paragraphs of the corpus, drawn by a hash."""
    spark = docs.sparkSession
    n = docs.count()
    notices = notice_rows(spark).withColumn("words", tokens(F.col("line")))
    # Short lines that stand in a notice, such as headings, are no unknown ones.
    runs = F.concat(*(shingles(F.col("words"), k) for k in range(1, 6)))
    known = [r[0] for r in notices.where(F.col("family") != UNKNOWN).select(F.explode(runs)).distinct().collect()]
    some = docs.where(unit_hash(F.col(id_col).cast("string"), seed=23) < min(1.0, max_unknown / 8 / max(1, n)))
    some = some.select(F.explode(paragraphs_of(docs, text_col)).alias("paragraph")).select(F.explode(units(F.col("paragraph"))).alias("line")).distinct().withColumn("words", tokens(F.col("line"))).where(F.size("words") > 0)
    some = some.where(~F.arrays_overlap(shingles(F.col("words")), constant(known))).orderBy(F.xxhash64("line")).limit(max_unknown)
    some = cut(some.select(F.lit(UNKNOWN).alias("family"), "line", "words"))
    cues = notices.where(F.col("family") != UNKNOWN).select(F.explode("words").alias("word")).distinct()
    cues = sorted(r[0] for r in cues.collect() if telling(r[0]))
    has_cue = lambda g: F.arrays_overlap(F.split(g, " "), constant(cues))
    # Notices weigh as much as the sample: each stands several times.
    every = notices.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("copy").unionByName(some)
    every = every.withColumn("features", F.filter(n_grams(F.col("words")), has_cue)).withColumn("held", unit_hash("line", seed=29) < 0.2)
    classes = [UNKNOWN, *NOTICES]
    every = every.withColumn("label", F.array_position(F.lit(classes), F.col("family")).cast("double") - 1)
    of_notices = every.where("family <> 'unknown'")
    size = of_notices.select(F.explode("features")).distinct().count()
    vectors = CountVectorizer(inputCol="features", outputCol="vector", binary=True, vocabSize=max(1, size)).fit(of_notices)
    every, _ = packed(vectors.transform(every).select("label", "features", "vector", "held", "family", "line"))  # few: the notices, max_unknown

    def fitted(rows: DataFrame, temperature: float) -> Model:
        got = LogisticRegression(featuresCol="vector", labelCol="label", family="multinomial", elasticNetParam=0.5, regParam=2e-4, maxIter=60, standardization=False).fit(rows)
        table, bias = got.coefficientMatrix.toArray(), [float(x) for x in got.interceptVector]
        if len(bias) < len(classes):
            raise ValueError("the model has fewer classes than there are families")
        weighed = [(f, [float(x) for x in table[:, i]]) for i, f in enumerate(vectors.vocabulary) if table[:, i].any()]
        return Model(classes, cues, [f for f, _ in weighed], spark.createDataFrame(weighed, "feature string, w array<double>"), bias, temperature)

    # A model that has seen neither the held notices nor the held lines tells how far to trust one; the model
    # that is used then learns from all.  The first notice of a family is never held.
    firsts = F.col("line").isin([texts[0] for texts in NOTICES.values()])
    seen = ~F.col("held") | firsts
    trial = fitted(every.where(seen), 1.0)
    held = cut(every.where(~seen).select("label", "features", "line").distinct().withColumn("key", F.monotonically_increasing_id().cast("string")))  # written, so the keys are fixed
    z = logits(held.select("key", "features"), trial).join(held.select("key", "label"), "key")
    loss = lambda t: F.avg(-F.log(F.greatest(F.element_at(softmax(F.transform("z", lambda x: x / F.lit(t))), F.col("label").cast("int") + 1), F.lit(1e-9))))
    losses = z.agg(*(loss(t).alias(str(i)) for i, t in enumerate(TEMPERATURES))).first()
    best = min(zip(losses, TEMPERATURES))[1] if losses[0] is not None else 1.0
    return fitted(every, best)


def logits(rows: DataFrame, model: Model) -> DataFrame:
    """(key, z) of rows (key, features): weights are joined to features and summed by key."""
    n = len(model.classes)
    hits = rows.select("key", F.explode("features").alias("feature")).join(F.broadcast(model.weights), "feature")
    sums = hits.groupBy("key").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n)))
    z = F.array(*(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(model.bias[i]) for i in range(n)))
    return rows.select("key").join(sums, "key", "left").select("key", z.alias("z"))


def license_scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, percent: int = 80) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): the licences of all paragraphs, numbered from 0."""
    spark = docs.sparkSession
    notices = notice_rows(spark).where(F.col("family") != UNKNOWN).select("family", "line", F.explode(shingles(tokens(F.col("line")))).alias("shingle"), F.size(shingles(tokens(F.col("line")))).alias("total"))
    rows = notices.select("shingle").distinct().collect()  # fixed
    listed = sorted(r[0] for r in rows)
    lengths = sorted({len(x.split(" ")) for x in listed})  # of short notices, less than 5

    def told_by(words: Column) -> Column:
        """Features and notice shingles of a unit; null without a cue."""

        def parts(w: Column) -> Column:
            features = F.array_sort(F.array_intersect(n_grams(w), constant(model.features)))
            known = F.array_sort(F.array_intersect(F.concat(*(shingles(w, k) for k in lengths)), constant(listed)))
            return F.when(F.arrays_overlap(w, constant(model.cues)), F.struct(features.alias("features"), known.alias("known")))

        return bound(words, parts)

    # Texts, then their paragraphs, then lines are looked at closely only if they may hold a cue at all.
    whole = docs.where(may_hold(F.col(text_col), model.cues))
    whole = whole.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(paragraphs_of(docs, text_col)).alias("paragraph", "body"))
    parts = whole.where(may_hold(F.col("body"), model.cues)).select("doc_id", "row", "paragraph", F.explode(units(F.col("body"))).alias("line")).where(may_hold(F.col("line"), model.cues))
    parts = parts.select("doc_id", "row", "paragraph", told_by(tokens(F.col("line"))).alias("told"))
    hits = parts.select("doc_id", "row", "paragraph", "told.*").where("size(features) > 0 or size(known) > 0")
    hits = cut(hits.select("doc_id", "row", "paragraph", "features", "known", F.sha2(F.concat(F.array_join("features", "\n"), F.lit("\n\n"), F.array_join("known", "\n")), 256).alias("key")))
    once = cut(hits.groupBy("key").agg(F.first("features").alias("features"), F.first("known").alias("known")))
    p = softmax(F.transform("z", lambda x: x / F.lit(model.temperature)))
    scores = cut(logits(once.select("key", "features"), model).select("key", p.alias("p")))
    best = scores.withColumn("probability", F.array_max("p"))
    best = best.withColumn("family", F.element_at(F.lit(model.classes), F.array_position("p", F.col("probability")).cast("int")))
    predicted = best.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least)).select("key", "family", F.lit(True).alias("predicted"))
    shared = once.select("key", F.explode("known").alias("shingle")).join(F.broadcast(notices), "shingle")
    alike = shared.groupBy("key", "family", "line", "total").agg(F.count(F.lit(1)).alias("common"))
    alike = alike.groupBy("key", "family").agg(F.max(F.col("common") * 100 / F.col("total")).alias("similarity"))
    verdicts = predicted.join(alike, ["key", "family"], "full").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    verdicts = verdicts.where(F.col("predicted") | (F.col("similarity") >= percent)).join(scores, "key")
    verdicts = verdicts.select("key", "family", "similarity", F.element_at("p", F.array_position(F.lit(model.classes), F.col("family")).cast("int")).alias("probability"))
    out = dim_join(hits.drop("features", "known"), verdicts, ["key"])
    out = out.groupBy("row", "paragraph", "family").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("similarity", "probability")).alias("best"))
    return out.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("best.probability", 4).alias("probability"), F.round(F.col("best.similarity") / 100, 4).alias("similarity"), (F.col("best.similarity") >= percent).alias("confirmed"))
