"""Licence scan: a trained paragraph classifier confirmed by templates.

A paragraph is a run of lines between blank ones, or one line of it: a wrapped notice is
judged as a whole, a notice of one line among other lines by itself.  Either is the set of
its word 1-grams and 2-grams.  A sparse
multinomial logistic regression over the n-grams of known licence notices tells licence
families and ``unknown`` apart.  It is trained here, from the notices below with words
dropped at random and from paragraphs of a bounded sample of the corpus as ``unknown``; a
held-out part of the same rows sets the temperature of its probabilities.  Which words are
everyday words, and so no features, is counted over every line of the corpus.  The
likeliest family is reported where ``unknown`` has at most one half of the probability, and
confirmed where enough n-grams of the paragraph or of a notice of that family are common to
both.

Only DataFrame and SQL functions and MLlib's DataFrame API are used.  A paragraph without
any of the model's anchor words can't reach a family (the sum of all other positive weights
is too small), so whole texts are first searched for those words in one pass; that changes
no result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import bounded_sample, materialize

UNKNOWN = "unknown"
#: Short forms of public licence notices, by family.
NOTICES = {
    "MIT": ("Released under the MIT License.",
            "This project is licensed under the terms of the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; version 2 of the License."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Distributed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    "ISC": ("Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Sentences with words of notices that name no licence.
PLAIN = ("The driving licence must be renewed every ten years.", "The poet took some license with the facts.",
         "All versions of the story were released to the public in general.", "You may use this file as you please.",
         "The software is free of charge for any person.", "Version 2.0 of the plan was published under a new name.",
         "Permission was granted by the council.", "A copy of the work is kept in the source and in binary form.")
#: Variants of each notice, the share of words each one loses, and (by default) corpus
#: documents whose paragraphs are training rows of the unknown class.
VARIANTS, DROPPED, UNKNOWN_DOCS = 60, 15, 400
#: Words of more than this share of the corpus lines are no features (everyday words).
COMMON = 0.01
#: A line is a notice's own, and no evidence of everyday words, where so many words of both
#: are common: at least this number, and this share of the notice's words or of the line's.
LEAST_SHARED, NOTICE_SHARE, LINE_SHARE = 3, 0.5, 0.8
LEAST_KNOWN, LEAST_SIMILARITY = 0.5, 0.5
#: Lines are a wrapped notice if together they hold this share of its n-grams (as far as they
#: are features), and so much more than any one of them; a line that holds more than WHOLE of
#: a notice of another family is a notice of its own.
WRAPPED, MORE, WHOLE = 0.5, 0.25, 0.8
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


def words_of(text: Column) -> Column:
    """Words in order: runs of a-z or a number."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)*)"), F.lit(1))


def ngrams(text: Column) -> Column:
    """Distinct word 1-grams and 2-grams."""
    words = words_of(text)
    # a lambda that read ``words`` would cut the text anew for every word
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda v, w: F.concat(v, F.lit(" "), w))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, text): a fixed table."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(f"{f}/{k}").alias("notice"), F.lit(t).alias("text"))
            for f, texts in NOTICES.items() for k, t in enumerate(texts)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, text): lines of each text that are not blank, numbered from 0: the rows
    of the statistics and of training."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "text"))
    return lines.where(F.trim("text") != "")


def runs_of_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first, lines): runs of lines that are not blank, and the number of their first line."""
    # exploded, an array is an attribute: lambdas would cut the text anew
    cut = docs.select(F.col(id_col), F.explode(F.array(F.split(F.col(text_col), "\n"))).alias("__all"))
    blank = F.filter(F.transform("__all", lambda t, i: F.when(~t.rlike(r"\S"), i)), lambda i: i.isNotNull())
    cut = cut.select(id_col, "__all", F.explode(F.array(blank)).alias("__blank"))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "__blank"), F.concat("__blank", F.array(F.size("__all"))),
                      lambda a, b: F.struct((a + 1).alias("first"), F.slice("__all", a + 2, b - a - 1).alias("lines")))
    return cut.select(id_col, F.explode(runs).alias("__run")).select(id_col, "__run.first", "__run.lines").where(F.size("lines") > 0)


def units(runs: DataFrame, id_col: str) -> DataFrame:
    """(id, __key, __whole, paragraph, text) of each run of several lines and of each line; the
    key is that of the run."""
    whole = F.struct(F.lit(True).alias("__whole"), F.col("first").alias("paragraph"), F.concat_ws(" ", "lines").alias("text"))
    single = F.transform("lines", lambda t, i: F.struct(F.lit(False).alias("__whole"), (F.col("first") + i).alias("paragraph"), t.alias("text")))
    both = F.when(F.size("lines") > 1, F.concat(F.array(whole), single)).otherwise(single)
    return runs.select(id_col, "__key", F.explode(both).alias("__unit")).select(id_col, "__key", "__unit.*")


def _common(words: Column, own: list[str]) -> Column:
    """How many of the words are in the list."""
    return F.size(F.filter(words, lambda w: w.isin(own)))


def _of_a_notice(words: Column, own: list[list[str]], size: Column | None = None) -> Column:
    """Whether the distinct words of a line (``size`` in all) are those of a notice, whole or in part."""
    shared, size = [_common(words, o) for o in own], F.size(words) if size is None else size
    hits = [(n >= LEAST_SHARED) & ((n >= NOTICE_SHARE * len(o)) | (n >= LINE_SHARE * size)) for n, o in zip(shared, own, strict=True)]
    return reduce(Column.__or__, hits)


def notice_words(spark: SparkSession) -> list[list[str]]:
    """The distinct words of every notice (a fixed table)."""
    return [r["w"] for r in notices(spark).select(F.array_sort(F.array_distinct(words_of(F.col("text")))).alias("w")).collect()]


def everyday_words(docs: DataFrame, id_col: str, text_col: str) -> set[str]:
    """Words of notices that more than COMMON of all lines of the corpus hold; lines that are
    a notice's own are left out.  One distributed count, of as many rows as notices have words.
    (A 2-gram is in no more lines than its words, so words alone decide.)"""
    own = notice_words(docs.sparkSession)
    listed = sorted({w for o in own for w in o})
    # exploded, w is an attribute: each lambda would cut the text anew
    lines = paragraphs(docs, id_col, text_col).select(F.explode(F.array(F.array_distinct(words_of(F.col("text"))))).alias("w"))
    # of a line only the words of notices matter, and its number of words; with fewer than
    # LEAST_SHARED of them it is no notice
    lines = lines.select(F.size("w").alias("of"), F.explode(F.array(F.filter("w", lambda w: w.isin(listed)))).alias("w"))
    others = lines.where((F.size("w") < LEAST_SHARED) | ~_of_a_notice(F.col("w"), own, F.col("of")))
    # the null in each line counts the lines
    words = others.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("w"))
    n = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w for w, k in n.items() if w is not None and k > COMMON * n[None]}


def training_rows(docs: DataFrame, id_col: str, text_col: str, seed: int, unknown_docs: int = UNKNOWN_DOCS) -> DataFrame:
    """(family, grams, corpus, part): part 0 is held out for the temperature."""
    spark = docs.sparkSession

    def lessened(text: Column, variant: Column) -> Column:
        stays = lambda w, i: F.pmod(F.xxhash64(w, i, variant, F.lit(seed)), F.lit(100)) >= F.when(variant == 0, 0).otherwise(DROPPED)
        return F.concat_ws(" ", F.filter(F.split(text, " "), stays))

    known = (notices(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
             .select("family", lessened(F.col("text"), F.col("v")).alias("text"), F.col("v").alias("k")))
    plain = (spark.range(1).select(F.explode(F.array(*map(F.lit, PLAIN))).alias("t"))
             .withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
             .select(F.lit(UNKNOWN).alias("family"), lessened(F.col("t"), F.col("v")).alias("text"), F.col("v").alias("k")))
    # rows of null id are picked by their text
    own = F.coalesce(F.col(id_col), F.xxhash64(text_col).cast(docs.schema[id_col].dataType))
    picked = bounded_sample(docs.withColumn("__pick", own), "__pick", unknown_docs, seed)
    # lines that speak of licences stay, as long as no notice is in them
    lines = (paragraphs(picked, id_col, text_col).withColumn("w", F.explode(F.array(F.array_distinct(words_of(F.col("text"))))))
             .where(~_of_a_notice(F.col("w"), notice_words(spark))))
    corpus = lines.select(F.lit(UNKNOWN).alias("family"), "text", F.lit(0).alias("k"))  # equal lines are in one part
    made = known.unionByName(plain).withColumn("corpus", F.lit(False))
    rows = made.unionByName(corpus.withColumn("corpus", F.lit(True))).withColumn("grams", ngrams(F.col("text")))
    return rows.select("family", "grams", "corpus", F.pmod(F.xxhash64("text", "k"), F.lit(4)).cast("int").alias("part"))


@dataclass
class Scanner:
    families: list[str]
    vectors: CountVectorizerModel
    model: LogisticRegressionModel
    temperature: float
    anchors: list[str] | None

    @property
    def vocabulary(self) -> list[str]:
        return self.vectors.vocabulary

    def logits(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with grams) and z, the linear scores of the families."""
        scored = self.model.transform(self.vectors.transform(rows)).withColumn("z", vector_to_array(F.col("__raw")))
        return scored.drop("__raw", "__features", "__probability", "__prediction")


def _softmax(logits: Column, temperature: float) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda z: F.exp((z - top) / temperature))
    return F.transform(logits, lambda z: F.exp((z - top) / temperature) / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def anchors_of(vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, often: set[str],
               temperature: float = 0.0) -> list[str] | None:
    """Words of which a paragraph needs at least one before the families, whose probabilities
    at the temperature are added up (at 0: any one of them), can outweigh ``unknown`` (the
    last class), none of them an everyday word.  None if there is no such set."""
    gain = np.maximum(0, weights[:-1] - weights[-1])
    start = bias[:-1] - bias[-1]

    def outweighs(reach: np.ndarray) -> bool:
        top = reach.max()
        return top + (temperature * np.log(np.exp((reach - top) / temperature).sum()) if temperature else 0.0) > 0

    if outweighs(start):
        return None
    holds = {w: [i for i, g in enumerate(vocabulary) if w in g.split(" ")] for w in {w for g in vocabulary for w in g.split(" ")} - often}
    chosen: list[str] = []
    while True:
        reach = start + gain.sum(axis=1)
        worst = int(reach.argmax())
        if not outweighs(reach):
            return chosen
        if not holds:
            return None
        word = max(sorted(holds), key=lambda w: gain[worst, holds[w]].sum())
        gain[:, holds.pop(word)] = 0
        chosen.append(word)


def _as_words(words: list[str]) -> str:
    """A pattern that finds any of the words wherever ``ngrams`` would (and seldom elsewhere).  The
    boundary comes before the alternatives, so that places inside a word are passed over."""
    kinds = [("a-z", [w for w in words if not w[0].isdigit()]), ("0-9", [w for w in words if w[0].isdigit()])]
    return "|".join(f"(?<![{letters}])(?:{'|'.join(w.replace('.', chr(92) + '.') for w in own)})(?![{letters}])" for letters, own in kinds if own)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 6,
          unknown_docs: int = UNKNOWN_DOCS) -> Scanner:
    """The model for ``docs``.  ``unknown_docs`` bounds the documents whose paragraphs are
    training rows; nothing else is sampled."""
    spark = docs.sparkSession
    families = [*NOTICES, UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = materialize(training_rows(docs, id_col, text_col, seed, unknown_docs).withColumn("label", number).coalesce(2))
    often = everyday_words(docs, id_col, text_col)
    # at most as large as the notices above
    own = {r["g"] for r in notices(spark).select(F.explode(ngrams(F.col("text"))).alias("g")).distinct().collect()}
    vocabulary = sorted(g for g in own if not often.issuperset(g.split(" ")))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="__features")
    vectors.setBinary(True)
    fit = LogisticRegression(featuresCol="__features", labelCol="label", rawPredictionCol="__raw", probabilityCol="__probability",
                             predictionCol="__prediction", family="multinomial", regParam=5e-4, elasticNetParam=1.0, maxIter=50,
                             standardization=False)
    model = fit.fit(vectors.transform(rows.where("part <> 0")))
    if model.numClasses != len(families):
        raise ValueError("no paragraph of the corpus to learn the unknown class from")
    held = model.transform(vectors.transform(rows.where("part = 0"))).select("label", vector_to_array(F.col("__raw")).alias("z"))
    loss = [F.avg(-F.log(F.element_at(_softmax(F.col("z"), t), F.col("label").cast("int") + 1) + 1e-12)).alias(f"t{k}")
            for k, t in enumerate(TEMPERATURES)]
    losses = held.agg(*loss).first()
    temperature = TEMPERATURES[int(np.argmin([v if v is not None else np.inf for v in losses]))]
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return Scanner(families, vectors, model, temperature, anchors_of(vocabulary, weights, bias, often, temperature))


def _paragraphs_of_notices(named: DataFrame, scanner: Scanner) -> DataFrame:
    """Of ``named`` (units that name a family) either a run of lines or lines of it."""
    features = set(scanner.vocabulary)
    rows = notices(named.sparkSession).select("family", ngrams(F.col("text")).alias("own")).collect()  # a fixed table
    held = [(r["family"], [g for g in r["own"] if g in features]) for r in rows]
    held = [(family, own) for family, own in held if own]
    shares = F.array(*[_common(F.col("grams"), own) / F.lit(float(len(own))) for _, own in held])
    named = materialize(named.withColumn("__shares", shares))
    share = [F.get("__shares", F.lit(k)) for k in range(len(held))]
    lines, runs = named.where("not __whole"), named.where("__whole")
    most = lines.groupBy("__key").agg(F.array(*[F.max(c) for c in share]).alias("__most"))
    more = [(F.col("family") == family) & (c >= WRAPPED) & (c - F.coalesce(F.get("__most", F.lit(k)), F.lit(0.0)) >= MORE)
            for k, ((family, _), c) in enumerate(zip(held, share, strict=True))]
    runs = runs.join(most, "__key", "left").where(F.col("__most").isNull() | reduce(Column.__or__, more, F.lit(False))).drop("__most")
    runs = materialize(runs)
    of = runs.select("__key", F.col("family").alias("__run_family"))
    other = reduce(Column.__or__, [(F.col("__run_family") != family) & (c >= WHOLE) & (F.col("family") == family)
                                   for (family, _), c in zip(held, share, strict=True)], F.lit(False))
    lines = lines.join(of, "__key", "left").where(F.col("__run_family").isNull() | other).drop("__run_family")
    return runs.unionByName(lines)


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text",
         unknown_docs: int = UNKNOWN_DOCS) -> DataFrame:
    """One row per paragraph that names a licence: ``id_col``, paragraph (number of its first
    line, from 0), text (lines joined by spaces), family, probability (of that family; a
    notice that fits several has less than one half of each), similarity (overlap of n-grams
    with the family's nearest notice), confirmed.

    A run of lines is one row where it is a wrapped notice, or where none of its lines names
    a licence; otherwise its lines that name one are the rows.

    Defined cases: null, empty and blank texts have no paragraphs; a paragraph is judged by
    all its words, however long; repeated rows are scanned each; null ids are kept, also where
    all are null; a table without any paragraph gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    if scanner is None:
        if not paragraphs(texts, id_col, text_col).limit(1).count():
            return texts.limit(0).select(
                id_col, F.lit(0).alias("paragraph"), F.lit("").alias("text"), F.lit("").alias("family"),
                F.lit(0.0).alias("probability"), F.lit(0.0).alias("similarity"), F.lit(False).alias("confirmed"))
        scanner = train(texts, id_col, text_col, unknown_docs=unknown_docs)
    pattern = None if scanner.anchors is None else _as_words(scanner.anchors)

    def may(rows: DataFrame, text: Column) -> DataFrame:
        return rows if pattern is None else rows.where(F.lower(text).rlike(pattern))

    runs = may(runs_of_lines(may(texts, F.col(text_col)), id_col, text_col), F.concat_ws(" ", "lines"))
    runs = materialize(runs.withColumn("__key", F.monotonically_increasing_id()))  # written once: keys stay
    scored = scanner.logits(may(units(runs, id_col), F.col("text")).withColumn("grams", F.explode(F.array(ngrams(F.col("text"))))))
    scored = scored.withColumn("z", F.explode(F.array("z")))  # an attribute: scored once
    n = len(scanner.families) - 1
    odds = sum((F.exp((F.get("z", F.lit(k)) - F.get("z", F.lit(n))) / scanner.temperature) for k in range(n)), F.lit(0.0))
    sure = materialize(scored.where(odds >= LEAST_KNOWN / (1 - LEAST_KNOWN)))
    best = F.slice("z", 1, n)
    place = F.array_position(best, F.array_max(best)).cast("int")
    named = (sure.withColumn("probability", F.element_at(_softmax(F.col("z"), scanner.temperature), place))
             .withColumn("family", F.element_at(F.array(*map(F.lit, scanner.families)), place)))
    named = _paragraphs_of_notices(named, scanner)
    known = notices(spark).select("family", ngrams(F.col("text")).alias("own")).groupBy("family").agg(F.collect_list("own").alias("owns"))
    shared = F.transform("owns", lambda own: F.size(F.array_intersect("grams", own)) / F.least(F.size("grams"), F.size(own)))
    return (named.join(F.broadcast(known), "family")  # a fixed table of a few families
            .withColumn("similarity", F.array_max(shared))
            .select(id_col, "paragraph", "text", "family", "probability", "similarity",
                    (F.col("similarity") >= LEAST_SIMILARITY).alias("confirmed")))
