"""Licence scans: a trained paragraph classifier, confirmed by templates; DataFrame functions only.

A paragraph ends at a blank line, or where a line ends with a sentence; the lines of
a wrapped notice are one paragraph, and two notices on lines of their own are two. In the code a
`line` is such a paragraph. Features are its distinct words and word pairs;
a multinomial logistic regression with an elastic-net penalty, fitted on the
paragraphs of a bounded sample of documents, gives the classes: none, unknown (licence
talk that no template covers) and one for each licence family. Vocabulary, class weights and
regression never see the fifth of the sample's paragraphs that is held out; a temperature is
fitted on that fifth. A predicted family stands only if the
paragraph holds at least `cover` of the 5-word shingles of one of its templates (all
words of a shorter template); otherwise the licence is unknown.

Only paragraphs holding a feature that the weights make necessary for leaving class none
are scored (see `required`); equal paragraphs are scored once.

Defined results: a NULL or empty text has no licence; a paragraph may be of any
length; ties between classes go to the first by name; repeated rows are reported
each; without any licence line in the sample the templates alone train the
model; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, settle

#: Notices by which licences of these families are commonly declared.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license, version 2.0", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms, with or without modification, are permitted", "released under the bsd license"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "gpl": ["licensed under the gnu general public license, version 3", "you can redistribute it and/or modify it under the terms of the gnu general public license"],
    "mit": ["released under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
}
#: Licence talk without a template teaches class unknown.
TALK = r"\b(licen[cs]ed?|copyright|all rights reserved)\b"
#: A blank line, or the line break after a sentence's end; looks back only where a line ends.
PARAGRAPH_END = r"\r?\n[\t\r ]*\n\s*|\n(?<=[.!?:;][\"')\]]{0,2}[\t\r ]{0,4}\n)"

#: Letters and digits; characters beyond ASCII belong to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def with_features(lines: DataFrame) -> DataFrame:
    """Adds `words`, and `features`: distinct words and pairs."""
    once = lines.select("*", F.explode(F.array(word_list(F.col("line")))).alias("words"))
    pairs = F.expr("transform(slice(words, 1, greatest(0, size(words) - 1)), (x, i) -> concat(x, ' ', words[i + 1]))")
    return once.withColumn("features", F.array_distinct(F.concat("words", pairs)))


def _shingles(words: str) -> str:
    return f"array_distinct(if(size({words}) < 5, array(array_join({words}, ' ')), transform(sequence(1, size({words}) - 4), i -> array_join(slice({words}, i, 5), ' '))))"


def template_match(df: DataFrame, templates: dict[str, list[str]], cover: float) -> DataFrame:
    """Adds `similarity`: for each family the largest share of a template's shingles that `words` holds."""
    made = {}
    for family, texts in templates.items():
        made[family] = [sorted({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) for w in (_plain_words(t) for t in texts)]
    out = df.select("*", F.explode(F.array(F.expr(f"if(size(words) = 0, cast(array() AS array<string>), {_shingles('words')})"))).alias("own"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))

    def share(grams: list[str]) -> Column:
        if len(grams) == 1 and grams[0].count(" ") < 4:
            return F.contains(joined, F.lit(f" {grams[0]} ")).cast("double")
        return F.size(F.array_intersect("own", F.array(*[F.lit(g) for g in grams]))) / float(len(grams))

    best = [F.struct(F.greatest(*[share(g) for g in grams], F.lit(0.0)).alias("share"), F.lit(family).alias("family")) for family, grams in made.items()]
    every = sorted({g for texts in made.values() for grams in texts for g in grams})
    short = [F.contains(joined, F.lit(f" {g} ")) for g in every if g.count(" ") < 4]
    some = reduce(Column.__or__, short, F.arrays_overlap("own", F.array(*[F.lit(g) for g in every])))
    none = F.array(*[F.struct(F.lit(0.0).alias("share"), F.lit(family).alias("family")) for family in made])
    # most lines hold no shingle of any template
    return out.withColumn("similarity", F.when(some, F.array(*best)).otherwise(none)).drop("own")


def _plain_words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out, word = [*out, word], ""
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    return id_text(docs).select("doc_id", F.xxhash64("text").alias("h"), F.explode(F.split("text", PARAGRAPH_END)).alias("line"))


def training_lines(docs: DataFrame, templates: dict[str, list[str]], sample: int, cover: float, max_bytes: int) -> DataFrame:
    """Paragraphs of the bounded sample and the templates, each with its class `label` and whether it is held out (`aside`)."""
    spark = docs.sparkSession
    # ids first: a top-k that carried texts would send `sample` texts from every task
    near = id_text(docs).where(F.octet_length("text") <= max_bytes)
    order = [F.xxhash64(F.lit("licence"), "doc_id"), F.col("doc_id")]
    ids = near.select("doc_id").distinct().orderBy(*order).limit(sample)
    picked = near.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(*order, F.xxhash64("text")).limit(sample)
    lines = lines_of(picked).select("line").where("line != ''").distinct()
    given = json.dumps([{"line": t} for texts in templates.values() for t in texts])
    told = spark.range(1).select(F.explode(F.from_json(F.lit(given), "array<struct<line:string>>")).alias("t")).select("t.line")
    # templates always train
    every = lines.withColumn("aside", F.pmod(F.xxhash64("line"), F.lit(5)) == 0).unionByName(told.withColumn("aside", F.lit(False)))
    named = template_match(with_features(every), templates, cover)
    best = F.array_max("similarity")
    label = F.when(best["share"] >= cover, best["family"]).when(F.lower("line").rlike(TALK), "unknown").otherwise("none")
    return named.select("line", "features", "aside", label.alias("label"))


class Model:
    """Weights (feature, class, w) as a small table, intercepts and temperature."""

    def __init__(self, classes: list[str], weights: list[dict], intercepts: list[float], temperature: float):
        self.classes, self.weights, self.intercepts, self.temperature = classes, weights, intercepts, temperature


def train(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, sample: int = 4000, cover: float = 0.8, max_bytes: int = 32768, vocabulary: int = 8192, steps: int = 40) -> Model:
    classes = ["none", *sorted(templates), "unknown"]
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    every = settle(training_lines(docs, templates, sample, cover, max_bytes).withColumn("y", place.cast("double")))
    rows = every.where("NOT aside")
    spark = docs.sparkSession
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(classes, [], [0.0] * len(classes), 1.0)
    # classes weigh alike up to a factor, so that rare licence lines are heard
    most = max(counts.values())
    weight = reduce(lambda acc, c: F.when(F.col("label") == c, min(50.0, (most / counts[c]) ** 0.5)).otherwise(acc), sorted(counts), F.lit(1.0))
    words = CountVectorizer(inputCol="features", outputCol="x", vocabSize=vocabulary, binary=True).fit(rows.where("label != 'none'").select("features"))
    # the sample is bounded, and a fit takes a job for each step
    x = words.transform(rows.withColumn("weight", weight)).coalesce(spark.sparkContext.defaultParallelism)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", maxIter=steps, regParam=2e-4, elasticNetParam=0.5, standardization=False).fit(x)
    matrix, terms = model.coefficientMatrix.toArray(), words.vocabulary
    named = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(terms)), "array<string>")).alias("f"))
    plain = rows.where("label = 'none'").select(F.explode("features").alias("f")).join(F.broadcast(named), "f").groupBy("f").count()
    common = {r["f"]: r["count"] for r in plain.collect()}  # at most `vocabulary` rows
    weights = [{"f": t, "c": int(c), "w": float(matrix[c, i]), "n": common.get(t, 0)} for i, t in enumerate(terms) for c in range(matrix.shape[0]) if matrix[c, i] != 0]
    intercepts = [float(v) for v in model.interceptVector.toArray()] + [-50.0] * (len(classes) - matrix.shape[0])
    fitted = Model(classes, weights, intercepts, 1.0)
    aside = scored(every.where("aside").select("line", "features", "y"), fitted)
    grid = [round(0.25 * 1.3**i, 4) for i in range(14)]
    loss = aside.select("y", "z", F.explode(F.array(*[F.lit(t) for t in grid])).alias("t")).select(
        "t", F.expr("ln(aggregate(z, 0D, (s, v) -> s + exp((v - array_max(z)) / t))) + (array_max(z) - z[int(y)]) / t AS loss")
    ).groupBy("t").agg(F.avg("loss").alias("loss")).orderBy("loss", "t").first()
    fitted.temperature = loss["t"] if loss else 1.0
    return fitted


def _weight_table(spark, model: Model) -> DataFrame:
    """At most vocabulary x classes rows, so it may be broadcast."""
    kind = "array<struct<f:string,c:int,w:double>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(model.weights)), kind)).alias("x")).select("x.f", "x.c", "x.w")


def scored(lines: DataFrame, model: Model) -> DataFrame:
    """Adds `z`, the score of each class, to distinct lines with `features`."""
    table = _weight_table(lines.sparkSession, model).groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("ws"))
    hit = lines.select("line", F.explode("features").alias("f")).join(F.broadcast(table), "f")
    sums = hit.groupBy("line").agg(*[F.sum(F.coalesce(F.element_at("ws", F.lit(c)), F.lit(0.0))).alias(f"z{c}") for c in range(len(model.classes))])
    z = F.array(*[F.coalesce(F.col(f"z{c}"), F.lit(0.0)) + float(model.intercepts[c]) for c in range(len(model.classes))])
    return lines.join(sums, "line", "left").withColumn("z", z).drop(*[f"z{c}" for c in range(len(model.classes))])


def required(model: Model, least: float = 0.5) -> list[str] | None:
    """Features of which a line must hold one to leave class none; None if the intercepts alone suffice.

    A class can only win if its margin over none exceeds a gap. Features whose
    margins add up to no more than that gap cannot close it, even all together: every other one is listed.
    The gap is filled with the features that are most frequent in lines without a licence.
    """
    none = {x["f"]: x["w"] for x in model.weights if x["c"] == 0}
    others = range(1, len(model.classes))
    slack = model.temperature * math.log(len(others) * least / (1 - least))
    common = {x["f"]: x["n"] for x in model.weights}
    found: set[str] = set()
    for c in others:
        own = {x["f"]: x["w"] for x in model.weights if x["c"] == c}
        gap = model.intercepts[0] - model.intercepts[c] - slack
        if gap <= 0:
            return None
        total = 0.0
        for f in sorted(own.keys() | none.keys(), key=lambda f: (-common[f], f)):
            margin = max(0.0, own.get(f, 0.0) - none.get(f, 0.0))
            if margin > 0 and total + margin > gap * (1 - 1e-9):
                found.add(f)
            else:
                total += margin
    return sorted(found)


def holding(lines: DataFrame, features: list[str]) -> DataFrame:
    """The rows of `lines` whose lower-cased `line` holds one of `features` as whole words.

    Features that imply another one are left out. Plain searches for the parts of a feature come before the pattern.
    """
    words = {f for f in features if " " not in f}
    least = [f for f in features if f in words or not words & set(f.split(" "))]
    if not least:
        return lines.where(F.lit(False))
    low = lines.select("*", F.explode(F.array(F.lower("line"))).alias("low"))
    parts = [reduce(Column.__and__, [F.contains(F.col("low"), F.lit(w)) for w in sorted(f.split(" "), key=len, reverse=True)]) for f in least]
    phrase = [r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(f.split(" ")) for f in least]
    whole = F.col("low").rlike(f"(?<!{WORD})(?:" + "|".join(phrase) + f")(?!{WORD})")
    return low.where(reduce(Column.__or__, parts) & whole).drop("low")


def licence_lines(docs: DataFrame, model: Model, templates: dict[str, list[str]] = TEMPLATES, cover: float = 0.8, least: float = 0.5) -> DataFrame:
    """doc_id, h (text hash), line, licence (a family or `unknown`), probability, similarity for each licence line."""
    lines = lines_of(docs)
    needed = required(model, least)
    if needed is not None:
        lines = holding(lines, needed)
    lines = settle(lines.withColumn("line", F.translate("line", "\r\n", "  ")))
    distinct = scored(settle(with_features(lines.select("line").distinct()).select("line", "words", "features")), model)
    p = F.expr(f"transform(z, v -> exp((v - array_max(z)) / {model.temperature}D))")
    probable = distinct.select("line", "words", F.explode(F.array(p)).alias("e")).withColumn("total", F.expr("aggregate(e, 0D, (s, v) -> s + v)"))
    licence = probable.withColumn("p_none", F.col("e")[0] / F.col("total")).where(F.col("p_none") < least)
    # the most probable family, which its template confirms or not; what stays unconfirmed is unknown
    families = F.slice("e", 2, len(model.classes) - 2)
    named = licence.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in model.classes[1:-1]]), F.array_position(families, F.array_max(families)).cast("int")))
    named = template_match(named, templates, cover).withColumn("same", F.expr("filter(similarity, s -> s.family = predicted)"))
    similarity = F.coalesce(F.expr("get(same, 0).share"), F.lit(0.0))
    found = named.select(
        "line", F.when(similarity >= cover, F.col("predicted")).otherwise(F.lit("unknown")).alias("licence"),
        (1 - F.col("p_none")).alias("probability"), similarity.alias("similarity"),
    )
    return lines.join(settle(found), "line")


def scan(docs: DataFrame, model: Model, templates: dict[str, list[str]] = TEMPLATES, cover: float = 0.8, least: float = 0.5) -> DataFrame:
    """A row for each row of `docs`: doc_id, licences (sorted families, comma-joined), n_licence_lines, n_unknown, probability (largest)."""
    found = licence_lines(docs, model, templates, cover, least)
    # repeated documents repeat their lines: counts are of one copy
    once = found.groupBy("doc_id", "h", "line").agg(F.max("licence").alias("licence"), F.max("probability").alias("probability"))
    by_doc = once.groupBy("doc_id", "h").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("licence") != "unknown", F.col("licence")))), ",").alias("licences"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("licence") == "unknown").alias("n_unknown"), F.max("probability").alias("probability"),
    ).withColumnsRenamed({"doc_id": "found_id", "h": "found_h"})
    base = id_text(docs).select("doc_id", F.xxhash64("text").alias("h"))
    return base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")), "left").select(
        "doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licence_lines"),
        F.coalesce("n_unknown", F.lit(0)).cast("bigint").alias("n_unknown"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
