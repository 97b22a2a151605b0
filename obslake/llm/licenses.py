"""Licence scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are described by their word pairs, with marks at both ends. A paragraph ends at a blank line or at a line that ends a sentence, so
a notice whose lines are wrapped is one paragraph. A multinomial logistic regression, trained here with Spark's ML library on sentences of
licence notices and on paragraphs of no licence, gives each paragraph a family or `unknown`. The least probability of the family named is
calibrated on rows that the training didn't see: a second, one-dimensional regression tells from the log-odds of the family whether a
held-out row is a licence. A prediction stands if enough of the word pairs of one of the family's templates, or of the paragraph, are in the other.

Only DataFrame functions. Pairs are hashed to 64 bits and looked up in a broadcast table whose size the templates bound. A
paragraph without any known pair has the scores of an empty one, which is unknown, so only known pairs go on from there: the texts
themselves are never shuffled, since a template's pairs are all known ones.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sample

#: Documents (those with the smallest hash of doc_id) and paragraphs of no licence that the fit takes from the corpus at most; half of them are held out.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 400, 2_000
#: Share of word pairs that must agree.
OVERLAP = 0.5
UNKNOWN = "unknown"

#: Sentences of licences and licence notices by family and licence.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit", "MIT", "Released under the MIT License."),
    ("mit", "MIT", "Licensed under the MIT license, see the file LICENSE for details."),
    ("mit", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    ("apache", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl", "GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl", "GPL-2.0", "Distributed under the terms of the GNU General Public License v2"),
    ("gpl", "GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("bsd", "BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("mpl", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "ISC", "Released under the ISC License."),
    ("epl", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."),
    ("cc-by", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("proprietary", "All-Rights-Reserved", "All rights reserved."),
    ("proprietary", "All-Rights-Reserved", "Copyright 2020 Example Inc. All rights reserved."),
    ("proprietary", "All-Rights-Reserved", "No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission."),
    ("proprietary", "All-Rights-Reserved", "This document is confidential and proprietary; unauthorized copying or distribution is prohibited."),
)
#: Paragraphs that share words with licences and are none.
NO_LICENCE = (
    "He renewed his driver license at the office and paid the fee.",
    "The permission to copy files was granted to the user by the administrator.",
    "The public library is free and open to any person in the city.",
    "This work was done under the direction of the general manager.",
    "The version of the file may be used for any purpose in the test.",
    "Apache helicopters and the Mozilla browser were in the news.",
    "The software is distributed to all copies of the system over the network.",
    "The university license plate program is subject to the terms of the state.",
)


#: Characters that part words.
_MARKS = ".,;:!?\"'()[]{}<>/*#|\t\n\r“”„«»"


def words(text: Column) -> Column:
    """Lower-case words between marks for the paragraph's ends; punctuation parts words, dashes don't."""
    plain = F.translate(F.lower(text), _MARKS, " " * len(_MARKS))
    return F.filter(F.split(F.concat(F.lit("^ "), plain, F.lit(" $")), " ", -1), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Adjacent words."""
    return F.slice(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)), 1, F.size(w) - 1)


def pair_hashes(w: Column) -> Column:
    """XXH64 of adjacent words, as xxhash64() chains them."""
    return F.slice(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b)), 1, F.size(w) - 1)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, key long, paragraph int, text); key tells texts under one doc_id apart."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.posexplode(F.split(F.col("text"), r"(?<=[.!?:;])[ \t]*[\n\r]+|[\n\r]+[ \t]*[\n\r]+")).alias("paragraph", "text"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("licence"), F.lit(c).alias("text")) for a, b, c in TEMPLATES))
    return spark.range(1).select(F.inline(rows))


class Model:
    """N-gram weights by family, and the least probability."""

    def __init__(self, families: list[str], weights: DataFrame, intercepts: list[float], least: float) -> None:
        self.families, self.weights, self.intercepts, self.least = families, weights, intercepts, least


def fit(docs: DataFrame) -> Model:
    """Trains on TEMPLATES (each whole, and each of its halves), NO_LICENCE and a bounded sample of the corpus, and calibrates on what is held out.

    Held out are the middles of long templates, short ones in another sentence, and half of the sample. Sampled paragraphs that hold a word of
    licensing (licen.., copyright, permitted, warrant..) are left out, since they may be licences.
    """
    spark = docs.sparkSession
    known = _templates(spark).withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    half, quarter = F.ceil(F.col("n") / 2).cast("int"), F.ceil(F.col("n") / 4).cast("int")
    long = F.col("n") >= 14
    parts = F.when(long, F.array(F.col("w"), F.slice("w", 1, half), F.slice("w", half + 1, F.col("n")))).otherwise(F.array(F.col("w")))
    positive = known.select("family", F.lit(False).alias("held"), F.explode(parts).alias("w"))
    unseen = known.select("family", F.lit(True).alias("held"), F.when(long, F.slice("w", quarter, half)).otherwise(words(F.concat(F.lit("Our file is new. "), F.col("text")))).alias("w"))
    few = sample(docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text"), "doc_id", "text", n=SAMPLE_DOCS)
    taken = paragraphs(few).filter(~F.lower("text").rlike("licen[sc]|copyright|permi|warrant|redistribut|rights")).orderBy(F.xxhash64("key", "paragraph"), "key", "paragraph").limit(SAMPLE_PARAGRAPHS)
    none = spark.range(1).select(F.posexplode(F.array(*map(F.lit, NO_LICENCE))).alias("key", "text")).select((F.col("key") % 4 == 3).alias("held"), "text")
    negative = none.unionByName(taken.select((F.pmod("key", F.lit(2)) == 1).alias("held"), "text")).select(F.lit(UNKNOWN).alias("family"), "held", words(F.col("text")).alias("w"))
    families = [UNKNOWN, *sorted({f for f, _, _ in TEMPLATES})]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = positive.unionByName(unseen).unionByName(negative).select("held", number.alias("label"), pairs(F.col("w")).alias("grams")).coalesce(1).persist()
    train = rows.filter("not held")
    # the vocabulary is that of the licence sentences, all of it: other n-grams tell nothing about families
    grams = train.filter("label > 0")
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=max(1, grams.select(F.explode("grams")).distinct().count()), binary=True).fit(grams)
    table = counter.transform(train).withColumn("weight", F.when(F.col("label") == 0, 0.1).otherwise(1.0))
    fitted = LogisticRegression(regParam=0.0005, maxIter=50, family="multinomial", weightCol="weight", standardization=False).fit(table)
    matrix, intercepts = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()
    least = _calibrated(fitted.transform(counter.transform(rows.filter("held"))))
    rows.unpersist()
    entries = json.dumps([{"gram": g, "w": [round(matrix[c][k], 9) for c in range(len(families))]} for k, g in enumerate(counter.vocabulary)])
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(entries), "array<struct<gram:string,w:array<double>>>")))
    parts = F.split("gram", " ")
    weights = weights.select(F.xxhash64(parts[0], parts[1]).alias("pair"), "w")
    return Model(families, weights, intercepts, least)


def _calibrated(held: DataFrame) -> float:
    """The least probability of the family named, from held-out rows (label, probability): where being that family and not is as likely."""
    p = _as_array("probability")
    best = F.array_max(F.slice(p, 2, F.size(p)))
    sure = F.least(F.greatest(best, F.lit(1e-9)), F.lit(1 - 1e-9))
    right = (F.col("label") > 0) & (F.element_at(p, (F.col("label") + 1).cast("int")) == best)
    table = held.select(array_to_vector(F.array(F.log(sure / (1 - sure)))).alias("features"), right.cast("double").alias("label"))
    # both classes weigh alike, however many paragraphs of no licence the corpus gave
    n = {r.label: r.n for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return 0.5
    table = table.withColumn("weight", F.when(F.col("label") == 1, 1 / n[1.0]).otherwise(1 / n[0.0]))
    line = LogisticRegression(regParam=0.001, weightCol="weight").fit(table)
    slope = float(line.coefficients[0])
    # a family has to be likelier than all else together
    return max(0.5, 1 / (1 + math.exp(line.intercept / slope))) if slope > 0 else 0.5


def _as_array(name: str) -> Column:
    return vector_to_array(F.col(name))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, key long, paragraph int, family, licence string, probability, overlap double) of the confirmed licence paragraphs."""
    at = ["doc_id", "key", "paragraph"]
    split = paragraphs(docs).select(*at, words(F.col("text")).alias("w"))
    each = split.select(*at, (F.size("w") - 1).alias("n_pairs"), F.explode(pair_hashes(F.col("w"))).alias("pair"))
    hits = each.join(F.broadcast(model.weights), "pair")  # as many rows as the templates have pairs
    # little data, much arithmetic: a number of partitions of its own, and both aggregations on it
    session = docs.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    once = hits.repartition(tasks, *at).groupBy(*at, "pair").agg(F.first("n_pairs").alias("n_pairs"), F.first("w").alias("w"))
    n = len(model.families)
    sums = once.groupBy(*at).agg(F.first("n_pairs").alias("n_pairs"), F.collect_set("pair").alias("own"), *(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)))
    scores = F.array(*(F.col(f"s{k}") + F.lit(b) for k, b in enumerate(model.intercepts)))
    # behind a generator, so that later steps don't evaluate the scores again
    scored = sums.select(*at, "n_pairs", "own", F.explode(F.array(scores)).alias("s")).withColumn("best", F.array_max(F.slice("s", 2, n - 1)))
    probability = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(F.least(x - F.col("best"), F.lit(700.0))))
    named = F.element_at(F.array(*map(F.lit, model.families)), F.array_position(F.slice("s", 2, n - 1), F.col("best")).cast("int") + 1)
    predicted = scored.filter(F.col("best") > F.col("s")[0]).select(*at, "n_pairs", "own", named.alias("family"), probability.alias("probability")).filter(F.col("probability") >= model.least)
    template = _templates(session).select("family", "licence", F.array_distinct(pair_hashes(words(F.col("text")))).alias("t"))
    met = predicted.join(F.broadcast(template), "family")  # a fixed list
    met = met.withColumn("overlap", F.size(F.array_intersect("own", "t")) / F.least("n_pairs", F.size("t"))).filter(F.col("overlap") >= OVERLAP)
    best = met.groupBy(*at).agg(F.max_by(F.struct("family", "licence", "probability", "overlap"), F.struct("overlap", "licence")).alias("b"))
    return best.select(*at, "b.*")


def licences(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id long, family, licence string (`unknown` if none), probability, overlap double (0), n_paragraphs long.

    Of several licences in a document the most probable is named, ties by the earlier paragraph. Null or empty text: unknown.
    Rows that share a doc_id are told apart by their text. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    best = scan(rows, model).groupBy("doc_id", "key").agg(F.max_by(F.struct("family", "licence", "probability", "overlap"), F.struct("probability", -F.col("paragraph"))).alias("b"), F.count("*").alias("n"))
    best = best.withColumnsRenamed({"doc_id": "found_id", "key": "found_key"})
    at = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    out = at.join(best, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    return out.select("doc_id", *(F.coalesce(F.col(f"b.{c}"), F.lit(UNKNOWN)).alias(c) for c in ("family", "licence")), *(F.round(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)), 6).alias(c) for c in ("probability", "overlap")), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))
