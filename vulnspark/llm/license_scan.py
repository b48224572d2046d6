"""Licence notices in documents, by a trained paragraph classifier. DataFrame functions only.

Notices of each family and paragraphs that only look like them train a multinomial logistic
regression over word n-grams. Its features are n-grams that hold a cue word, so a paragraph
without one has no feature and is of the unknown class, which is decided by a search for the
cues; the others are scored with the weights as literals in the row. Held-out notices set the
probability below which a paragraph is unknown, and a family is reported when the paragraph
also holds enough of one of its notices.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.functions.text import let
from vulnspark.llm.common import Store, text_of

UNKNOWN = "unknown"
#: Stems one of which every notice below holds.
CUES = ("licen", "copyright", "redistribut", "permission", "warrant", "public domain", "spdx", "commons")
#: Notices by family, as they are published; short forms as people write them.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation.",
        "Released under the GPL license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL license.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL license.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal license.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Proprietary": (
        "Copyright. All rights reserved.",
        "Copyright by the author. All rights reserved. No part may be reproduced without permission.",
    ),
}
#: Sentences with the cue words that are no notices.
OTHERS = (
    "The driver lost his license after the accident.",
    "She is a licensed nurse and works at the hospital.",
    "You need a fishing license to fish in this lake.",
    "The museum asked for permission to open on Sunday.",
    "Copyright law differs between countries.",
    "The seller gives a warranty of two years.",
    "The house of commons voted on the public license fee.",
    "The pilot renewed her license in version two of the test.",
    "A license to sell apache helicopters was refused.",
    "The school was granted permission by the general public.",
    "Redistribution of land was planned by the government.",
    "He wrote about copyright and the history of print.",
    "Professors at MIT hold a license for the patent.",
    "The walls of the tavern show an old liquor license.",
    "Their work is not under any license that I know.",
)
VARIANTS = 20
LONGEST = 6
LEAST_COVER = 0.6
LEAST_PROBABILITY = 0.5
#: The unknown class is also learned from so many lines at most, of so many documents at most, both
#: in hash order; the lines are taken whole.
SAMPLE, LINES = 500, 2_000
#: The first words of the notices that are wrapped over lines: one of them begins another notice.
WRAPPED, OPENING = 12, 3
VOCABULARY = 2_000


def _literal(value, kind: str) -> Column:
    """A constant of any size as one node of the plan: it is folded before the rows are read."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    many = F.size(words) - (n - 1)
    at = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(n)]))


def has_cue(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.exists(F.array(*map(F.lit, CUES)), lambda cue: F.contains(low, cue)))


def _cued_grams(words: Column) -> Column:
    """The n-grams of up to `LONGEST` words that hold a cue; only those at words of a cue are made."""
    has = lambda w: has_cue(w) | F.endswith(w, F.lit("public"))
    places = F.filter(F.transform(words, lambda w, i: F.when(has(w), i + 1)), lambda i: i.isNotNull())

    def grams(at: Column, n: int) -> Column:
        many = F.size(words) - (n - 1)
        near = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (n - 1), F.lit(1)), F.least(i, many))))
        starts = F.when(many > 0, F.array_sort(F.array_distinct(near))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(n)]))

    return let(places, lambda at: F.filter(F.concat(*[grams(at, n) for n in range(1, LONGEST + 1)]), has_cue))


def _both(text: Column) -> Column:
    return let(_words(text), lambda words: F.struct(words.alias("words"), F.array_distinct(_cued_grams(words)).alias("features")))


def with_features(df: DataFrame, text: str) -> DataFrame:
    """Adds `words` and `features`: the distinct n-grams of up to `LONGEST` words that hold a cue."""
    return df.withColumn("_both", _both(F.col(text))).select("*", "_both.*").drop("_both")


def _may_have_cue(text: Column) -> Column:
    """As `has_cue`, with a line end or comment sign inside a cue."""
    return has_cue(text) | F.lower(text).rlike("public[^\\p{L}\\p{N}]+domain")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, first, lines): the runs of lines between those without a letter or digit, as empty
    comment lines are, that hold a cue word; `first` is the number of the first line."""
    split = docs.filter(_may_have_cue(F.col("text"))).select("doc_id", F.split("text", "\n").alias("all"))
    split = split.withColumn("full", F.transform("all", lambda line: line.rlike("[\\p{L}\\p{N}]")))
    beside = lambda i, k: F.coalesce(F.get("full", i + k), F.lit(False))
    edge = lambda k: F.filter(F.transform("full", lambda x, i: F.when(x & ~beside(i, k), i)), lambda i: i.isNotNull())
    run = lambda a, b: F.struct(a.alias("first"), F.slice("all", a + 1, b - a + 1).alias("lines"))
    runs = split.withColumn("starts", edge(-1)).withColumn("ends", edge(1))
    return runs.select("doc_id", F.inline(F.zip_with("starts", "ends", run))).filter(_may_have_cue(F.array_join("lines", " ")))


def labelled(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> DataFrame:
    """(family, held_out, paragraph): notices and other sentences, each in `VARIANTS` forms that lose
    about an eighth of their words, and sampled lines of documents that hold no cue by themselves,
    each opened by a cue: those are unknown."""
    given = [{"family": family, "text": text} for family, texts in NOTICES.items() for text in texts]
    given += [{"family": UNKNOWN, "text": text} for text in OTHERS]
    rows = _literal(given, "array<struct<family:string,text:string>>")
    forms = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(VARIANTS - 1).cast("long"))).alias("form")
    base = spark.range(1).select(F.inline(rows)).select("family", "text", forms)
    lost = lambda w, i: (F.col("form") > 0) & (F.pmod(F.xxhash64(w, i, "form"), F.lit(8)) == 0)
    thinned = base.select(
        "family", (F.col("form") % 5 == 4).alias("held_out"), F.array_join(F.filter(F.split("text", " "), lambda w, i: ~lost(w, i)), " ").alias("paragraph")
    )
    key = F.xxhash64("doc_id")
    some = docs.filter("doc_id IS NOT NULL").select("doc_id").orderBy(key, "doc_id").limit(sample).distinct()
    told = (
        docs.join(F.broadcast(some), "doc_id")
        .select(key.alias("key"), F.explode(F.split("text", "\n")).alias("line"))
        .filter(~has_cue(F.col("line")))
        .orderBy(F.xxhash64("line", "key"), "line")
        .limit(lines)
    )
    cues = F.array(*map(F.lit, CUES[:5]))
    opened = F.concat_ws(" ", F.element_at(cues, (F.pmod(F.xxhash64("line"), F.lit(5)) + 1).cast("int")), F.col("line"))
    return thinned.unionByName(told.select(F.lit(UNKNOWN).alias("family"), (F.pmod("key", F.lit(5)) == 4).alias("held_out"), opened.alias("paragraph")))


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    threshold: float


def _probabilities(model: Model, features: Column) -> Column:
    """Softmax over the families; the weights are literals, bounded by `VOCABULARY`."""
    table = _literal(model.weights, "map<string,array<double>>")
    known = F.array_intersect(features, _literal(list(model.weights), "array<string>"))
    zero = _literal(model.intercepts, "array<double>")
    margins = F.aggregate(known, zero, lambda sums, g: F.zip_with(sums, table[g], lambda a, b: a + b))
    return let(margins, lambda own: F.transform(own, lambda m: F.exp(m - F.array_max(own))))


def scored(df: DataFrame, model: Model) -> DataFrame:
    """Adds `guess` (the likeliest family, unknown included) and `probability`."""
    odds = df.withColumn("odds", _probabilities(model, F.col("features")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, b: a + b)
    best = F.array_position("odds", F.array_max("odds")).cast("int")
    names = F.array(*map(F.lit, model.families))
    return odds.withColumn("guess", F.element_at(names, best)).withColumn("probability", F.array_max("odds") / total).drop("odds")


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Model:
    """Trains on the forms that are not held out; the threshold is the least probability, 0.5 at
    least, at which no held-out paragraph of the unknown class takes a family."""
    # A few thousand rows: one partition saves the fit hundreds of tiny tasks.
    given = labelled(spark, docs, sample, lines).coalesce(1)
    sample = Store(spark).save(with_features(given, "paragraph"), "labelled")
    families = [*NOTICES, UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    train = sample.filter("NOT held_out").select(number.cast("double").alias("label"), "features")
    counter = CountVectorizer(inputCol="features", outputCol="vector", vocabSize=VOCABULARY, minDF=3, binary=True).fit(train)
    fitted = LogisticRegression(featuresCol="vector", regParam=1e-3, maxIter=60, family="multinomial").fit(counter.transform(train))
    matrix = fitted.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, k]] for k, g in enumerate(counter.vocabulary)}
    model = Model(families, weights, [float(x) for x in fitted.interceptVector.toArray()], LEAST_PROBABILITY)
    wrong = scored(sample.filter("held_out").filter(F.col("family") == UNKNOWN), model).filter(F.col("guess") != UNKNOWN)
    most = wrong.agg(F.max("probability").alias("p")).first().p
    if most is not None:
        model.threshold = max(LEAST_PROBABILITY, min(0.99, float(most) + 1e-6))
    return model


def cover(words: Column, guess: Column) -> Column:
    """The largest share of a notice's word pairs that the paragraph holds, over the family's notices."""
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    pairs_of = lambda own: sorted({f"{a} {b}" for a, b in zip(own, own[1:], strict=False)})
    cases = [{"family": f, "pairs": pairs_of(plain(t))} for f, texts in NOTICES.items() for t in texts]
    notices = F.filter(_literal(cases, "array<struct<family:string,pairs:array<string>>>"), lambda n: n["family"] == guess)
    share = lambda own: F.transform(notices, lambda n: F.size(F.array_intersect(own, n["pairs"])) / F.size(n["pairs"]))
    return let(_grams(words, 2), lambda own: F.array_max(share(own)))


def judged(model: Model, text: Column) -> Column:
    """(family, probability, cover) of a text that is a notice, else null."""
    names = F.array(*map(F.lit, model.families))

    def confirmed(both: Column, odds: Column) -> Column:
        best = F.array_max(odds)
        guess = F.element_at(names, F.array_position(odds, best).cast("int"))
        probability = best / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        sure = (guess != UNKNOWN) & (probability > model.threshold)
        share = F.when(sure, let(guess, lambda g: cover(both["words"], g)))
        found = lambda c: F.when(c >= LEAST_COVER, F.struct(guess.alias("family"), probability.alias("probability"), c.alias("cover")))
        return let(share, found)

    return let(_both(text), lambda both: let(_probabilities(model, both["features"]), lambda odds: confirmed(both, odds)))


def openings() -> list[str]:
    """The first words of the notices that are usually wrapped."""
    words = [["".join(c for c in w if c.isalnum()) for w in t.lower().split()] for ts in NOTICES.values() for t in ts]
    return sorted({f" {' '.join(w[:OPENING])} " for w in words if len(w) > WRAPPED})


def pieces(lines: Column, left: Column) -> Column:
    """The places in `left` cut before every line that holds the opening of a notice."""

    def opens(i: Column) -> Column:
        plain = F.concat(F.lit(" "), F.array_join(_words(F.get(lines, i)), " "), F.lit(" "))
        return let(plain, lambda t: F.exists(F.array(*map(F.lit, openings())), lambda o: F.contains(t, o)))

    def cut(starts: Column) -> Column:
        end = lambda n: F.coalesce(F.get(starts, n + 1), F.size(left))
        return F.transform(starts, lambda s, n: F.slice(left, s + 1, end(n) - s))

    places = F.sequence(F.lit(0), F.greatest(F.size(left) - 1, F.lit(0)))
    return let(F.filter(places, lambda k: (k == 0) | F.coalesce(opens(F.get(left, k)), F.lit(False))), cut)


def find_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, lines: int = LINES
) -> DataFrame:
    """One row per licence notice: doc_id, line (from 0, the first), family, probability, cover,
    paragraph.

    Lines that are a notice by themselves are reported one by one. What else stands in their
    paragraph, a run of lines between blank ones, is cut before every line that holds the first words
    of a long notice; each piece is judged, so notices may be wrapped, commented and follow each
    other. Where no piece is a notice, the paragraph is judged as a whole. The classifier is fitted
    on the built-in notices and at most `lines` lines of `sample` documents.

    Null and empty texts have none; very long ones are read whole; a null id is reported as null; rows repeating an id are
    scanned one by one; other columns are not read; an empty table gives no rows. One pass
    without a shuffle.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    model = fit(docs.sparkSession, docs, sample, lines)
    one = lambda line, text, x: F.when(x.isNotNull(), F.struct(line.alias("line"), x["family"].alias("family"), x["probability"].alias("probability"), x["cover"].alias("cover"), text.alias("paragraph")))
    by_line = lambda line, i: F.when(has_cue(line), let(judged(model, line), lambda x: one(F.col("first") + i, line, x)))
    alone = paragraphs(docs).withColumn("alone", F.transform("lines", by_line))
    left = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("alone", i).isNull())
    rest = alone.withColumn("left", left).withColumn("pieces", pieces(F.col("lines"), F.col("left")))
    told = F.when(F.size("pieces") > 1, F.concat("pieces", F.array("left"))).otherwise(F.col("pieces"))
    text = lambda places: F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")

    def wrapped(places: Column) -> Column:
        # A single line is judged already.
        found = lambda t: let(judged(model, t), lambda x: one(F.col("first") + F.get(places, F.lit(0)), t, x))
        return F.when(F.size(places) > 1, let(text(places), lambda t: F.when(_may_have_cue(t), found(t))))

    rest = rest.withColumn("told", F.transform(told, wrapped))
    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    own = some(F.slice("told", 1, F.size("pieces")))
    found = F.concat(some("alone"), let(own, lambda x: F.when(F.size(x) > 0, x).otherwise(some("told"))))
    return rest.select("doc_id", F.inline(found))
