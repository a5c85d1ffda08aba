"""Licence scans with a trained paragraph classifier, in DataFrame functions and MLlib only.

Every paragraph (line) of every document is classified by a sparse logistic regression on word n-grams, with one class
per licence family and one for anything else. The regression is fitted on a bounded, labelled sample: notices written
from templates, sentences that merely use their words, and ``SAMPLE`` paragraphs of the corpus. A part of that sample is
kept out to calibrate: a temperature scales the probabilities, and below a threshold, chosen so that nothing of the
calibration part is mistaken, a paragraph is unknown. What is predicted is confirmed by comparing its word trigrams with
the templates of the predicted family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, stored

#: Corpus paragraphs that the fit may see; everything else is scored, none is left out.
SAMPLE = 4000
OTHER = "other"
CONFIRM = 0.6
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)
VOCABULARY = 4096

#: Licence notices as their texts and guides give them; {work} and {by} are filled in below.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "{work} is licensed under the MIT License.",
        "Distributed under the terms of the MIT license {by}",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "{work} is available under the Apache License 2.0 {by}",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "{work} is licensed under the GNU General Public License, version 3.",
        "{work} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL v3 {by}",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "CC": (
        "Licensed under CC BY-NC 4.0.",
        "{work} is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0 {by}",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "BSD": (
        "Distributed under the BSD 3-Clause License {by}",
        "{work} is licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL": (
        "{work} is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0 {by}",
    ),
}
WORKS = ("This work", "This project", "This program", "This file", "The software", "This text", "The data", "Our code")
BYS = ("by its authors.", "by the contributors.", "in 2021.", "see LICENSE for details.", "")
#: Sentences that use the words of notices without being one.
LOOKALIKES = (
    "All rights reserved.", "Her driver license was renewed under the new law.", "The public was free to use the general library.",
    "Please read the terms of the contract before you sign.", "Version 2.0 of the report was released in 2021.",
    "The software was distributed to all schools.", "Permission to enter the site was not granted.",
    "A copy of this letter was sent to the license office.", "The fishing license is available at the office.",
    "The general was released under guard.", "Conditions are met by the contractor.", "See the file for details.",
    "The restaurant is licensed to serve wine.", "The apache helicopter is available for visits.",
    "Students at MIT released a new paper.", "Creative minds meet in the commons.", "The gnu is a large antelope.",
    "This work is by the authors of the project.", "You may not use this door.", "Licensed professionals only.",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    ahead = [F.slice(words, F.lit(i + 1), F.greatest(F.size(words) - (n - 1), F.lit(0))) for i in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), ahead)


def ngrams(text: Column) -> Column:
    """Words and word pairs."""
    words = tokens(text)
    return F.concat(words, _runs(words, 2))


def trigrams(text: Column) -> Column:
    return F.array_distinct(_runs(tokens(text), 3))


def paragraphs(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, nth, paragraph``: the lines with a letter of every document."""
    return docs.select(F.col(id).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias(
        "nth", "paragraph")).filter(F.col("paragraph").rlike(r"\p{L}"))


def _written(spark: SparkSession) -> DataFrame:
    """``paragraph, family``: every template with every filling, and the lookalikes."""
    rows = [(family, t) for family, ts in TEMPLATES.items() for t in ts] + [(OTHER, t) for t in LOOKALIKES]
    frame = spark.createDataFrame(rows, "family string, template string")
    works = F.explode(F.array(*map(F.lit, WORKS))).alias("work")
    bys = F.explode(F.array(*map(F.lit, BYS))).alias("by")
    filled = F.replace(F.replace("template", F.lit("{work}"), F.col("work")), F.lit("{by}"), F.col("by"))
    plain = frame.select("*", works).select("*", bys).select("family", F.trim(filled).alias("paragraph")).distinct()
    # Notices also stand after or before other words, and in capitals.
    return plain.select("family", F.explode(F.array(
        F.col("paragraph"), F.upper("paragraph"), F.concat(F.lit("Note: "), "paragraph"),
        F.concat("paragraph", F.lit(" Thank you."))))
        .alias("paragraph"))


def _looks_like_notice(text: Column) -> Column:
    """Corpus paragraphs that may be notices are not taken as examples of anything else."""
    return F.lower(text).rlike(r"licen[sc]e|permission is hereby|redistribution and use|copyright")


def _labelled(lines: DataFrame, sample: int) -> DataFrame:
    """The bounded training set with ``fold``: 0 calibrates, 1 to 4 train. The sample is by hash, alike in every run."""
    order = F.xxhash64("id", "nth", "paragraph")
    corpus = lines.filter(~_looks_like_notice(F.col("paragraph"))).select("paragraph", order.alias("order"))
    # The smallest hashes. Only a few times as many rows as are wanted go on to the sort, from however many partitions.
    share = 4 * sample / max(1, lines.count())
    if share < 0.5:
        corpus = corpus.filter(F.col("order") < F.lit(int(-2**63 + share * 2**64)))
    corpus = corpus.orderBy("order", "paragraph").limit(sample)
    rows = _written(lines.sparkSession).unionByName(corpus.select(F.lit(OTHER).alias("family"), "paragraph"))
    return rows.select("family", "paragraph", F.pmod(F.xxhash64("paragraph", F.lit(7)), F.lit(5)).alias("fold"))


class Classifier:
    """Fitted vocabulary, regression, temperature and threshold."""

    def __init__(self, vocabulary: CountVectorizerModel, model: LogisticRegressionModel, families: list[str]):
        self.vocabulary, self.model, self.families = vocabulary, model, families
        self.temperature, self.threshold = 1.0, 0.5

    def margins(self, lines: DataFrame) -> DataFrame:
        """``lines`` with array ``margins``, one per family. The explode of one element keeps Spark from computing the
        margins again for each place where they are used."""
        features = self.vocabulary.transform(lines.withColumn("ngrams", ngrams(F.col("paragraph"))))
        return self.model.transform(features).select(
            *lines.columns, F.explode(F.array(vector_to_array("rawPrediction"))).alias("margins"))

    def probabilities(self, margins: Column, temperature: float) -> Column:
        top = F.array_max(margins)
        powers = F.transform(margins, lambda m: F.exp((m - top) / temperature))
        total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
        return F.transform(powers, lambda p: p / total)

    def best(self, margins: Column) -> Column:
        """``family`` and calibrated ``probability`` of the most probable class."""
        each = self.probabilities(margins, self.temperature)
        names = F.array(*map(F.lit, self.families))
        paired = F.zip_with(each, names, lambda p, f: F.struct(p.alias("probability"), f.alias("family")))
        return F.array_max(paired)


def fit(lines: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on the labelled sample and calibrate on the part of it that was kept out."""
    data = stored(_labelled(lines, sample))
    families = [*TEMPLATES, OTHER]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = data.withColumns({"ngrams": ngrams(F.col("paragraph")), "label": label}).filter(F.col("fold") > 0)
    vocabulary = CountVectorizer(inputCol="ngrams", outputCol="features", vocabSize=VOCABULARY, minDF=2, binary=True).fit(
        rows.filter(~(F.col("family") == OTHER) | F.col("paragraph").isin(list(LOOKALIKES))))
    # Families are few and small against the corpus sample: each class weighs the same in all.
    n = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    weight = F.element_at(F.create_map(*[F.lit(x) for f, c in n.items() for x in (f, 1000.0 / c)]), F.col("family"))
    model = LogisticRegression(featuresCol="features", weightCol="weight", maxIter=60, regParam=0.002, elasticNetParam=0.5,
                               family="multinomial").fit(vocabulary.transform(rows.withColumn("weight", weight)))
    found = Classifier(vocabulary, model, families)
    kept_out = stored(found.margins(data.withColumn("label", label).filter(F.col("fold") == 0)))
    true = lambda t: F.element_at(found.probabilities(F.col("margins"), t), (F.col("label") + 1).cast("int"))
    losses = kept_out.agg(*[F.avg(-F.log(F.greatest(true(t), F.lit(1e-12)))) for t in TEMPERATURES]).first()
    if losses[0] is not None:
        found.temperature = min(zip(losses, TEMPERATURES))[1]
        judged = kept_out.select("family", found.best(F.col("margins")).alias("best"))
        mistaken = judged.filter((F.col("best.family") != OTHER) & (F.col("best.family") != F.col("family")))
        found.threshold = max(0.5, min(0.99, (mistaken.agg(F.max("best.probability")).first()[0] or 0.0) + 1e-6))
    discard(data, kept_out)
    return found


def _likeness(own: Column, family: Column) -> Column:
    """Largest share of common trigrams with a template of the family, of the shorter of the two."""
    scores = []
    for name, templates in TEMPLATES.items():
        best = F.greatest(F.lit(0.0), *[_overlap(own, t) for t in templates])
        scores.append(F.when(family == name, best))
    return F.coalesce(*scores, F.lit(0.0))


def _overlap(own: Column, template: str) -> Column:
    fixed = trigrams(F.lit(template.replace("{work}", "").replace("{by}", "")))
    smaller = F.least(F.size(own), F.size(fixed))
    return F.when(smaller >= 1, F.size(F.array_intersect(own, fixed)) / smaller).otherwise(F.lit(0.0))


def notices(lines: DataFrame, classifier: Classifier, confirm: float = CONFIRM) -> DataFrame:
    """``id, nth, family, probability, likeness, known, confirmed`` of every paragraph that is more likely a notice of some
    family than anything else. Below the calibrated threshold it is not ``known``, and never ``confirmed``."""
    scored = classifier.margins(lines).withColumn("best", classifier.best(F.col("margins")))
    likely = scored.filter(F.col("best.family") != OTHER)
    likely = likely.select("id", "nth", "best.family", "best.probability",
                           F.explode(F.array(trigrams(F.col("paragraph")))).alias("own"))
    known = F.col("probability") >= classifier.threshold
    return likely.select("id", "nth", "family", "probability", _likeness(F.col("own"), F.col("family")).alias(
        "likeness"), known.alias("known")).withColumn("confirmed", F.col("known") & (F.col("likeness") >= confirm))


def license_table(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
                  confirm: float = CONFIRM) -> DataFrame:
    """``id, n_paragraphs, licenses, license, probability, n_unknown`` of every row.

    ``licenses`` are the confirmed families in order, ``license`` the most probable one (null if none), ``n_unknown`` the
    paragraphs predicted to be notices that are below the calibrated threshold or that no template confirms. Null and empty texts have no paragraphs. Rows that
    share an id share their notices, rows with a null id form one document in this. An empty table gives an empty result
    without a fit, other columns are ignored.
    """
    empty = "array<string>"
    counted = docs.select(F.col(id), F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                                                     lambda x: x.rlike(r"\p{L}"))).cast("bigint").alias("n_paragraphs"))
    if docs.isEmpty():
        return counted.select("*", F.array().cast(empty).alias("licenses"), F.lit(None).cast("string").alias("license"),
                              F.lit(None).cast("double").alias("probability"), F.lit(0).cast("bigint").alias("n_unknown"))
    lines = paragraphs(docs, id, text)
    found = notices(lines, fit(lines, sample), confirm)
    sure = F.col("confirmed")
    top = F.max(F.when(sure, F.struct("probability", "family")))
    # Families are few, so the sets stay small however many notices a document has.
    per_doc = stored(found.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(sure, F.col("family")))).alias("licenses"), top["family"].alias("license"),
        top["probability"].alias("probability"), F.count_if(~sure).alias("n_unknown"))).withColumnRenamed("id", "of_id")
    return counted.join(per_doc, F.col(id).eqNullSafe(F.col("of_id")), "left").select(
        F.col(id), "n_paragraphs", F.coalesce("licenses", F.array().cast(empty)).alias("licenses"), "license",
        "probability", F.coalesce("n_unknown", F.lit(0)).cast("bigint").alias("n_unknown"))
