"""Operator 8: licence scans with DataFrame functions only.

A paragraph is a line, or a block of lines between lines without a word, so that a wrapped notice
is read whole. Logistic regression over sparse word n-grams, one curve for each
licence family and one for licences of no family here, is trained on notices, on their short forms (a
name in a frame such as an SPDX line, or two names in one) and on paragraphs of the corpus; the temperature and the
unknown class are calibrated on examples held out of training. A prediction is confirmed when
the paragraph holds most of the word pairs of one of the family's templates, less those that many families
have. Only n-grams of the model count, so a paragraph without any of their rarest words needs
no join: that gate loses nothing.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.llm.store import documents, materialise

# The usual short notices of each family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is available under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "You may not use this file except in compliance with the Apache License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL v3.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "Released under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorised copying is prohibited.",
    ],
}
# The usual short names of each family, and of licences that are none of these.
NAMES = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0", "Apache 2"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-or-later", "GPLv3", "GPL v3"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-or-later", "GPLv2", "GPL v2"],
    "LGPL": ["LGPL-2.1", "LGPL-3.0", "LGPLv3", "LGPL"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "MPL-2.0": ["MPL-2.0", "MPLv2"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
    "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC0": ["CC0-1.0", "CC0"],
}
OTHER = ["ISC", "EUPL-1.2", "Zlib", "WTFPL", "EPL-2.0", "Artistic-2.0", "BSL-1.0", "OFL-1.1", "NCSA", "PostgreSQL"]
FRAMES = ["SPDX-License-Identifier: {}", "License: {}", "Licensed under {}", "{} license"]
TWO_NAMES = ["Dual licensed under {} and {}", "SPDX-License-Identifier: {} OR {}", "License: {} or {}"]
TWO_FAMILIES = [("MIT", "Apache-2.0"), ("MIT", "GPL-2.0"), ("MIT", "GPL-3.0"), ("BSD", "GPL-2.0"), ("Apache-2.0", "GPL-3.0"), ("MPL-2.0", "LGPL")]
UNKNOWN = "unknown"  #: a licence of no family here
FAMILIES = [*TEMPLATES, UNKNOWN]
SHARED = 2  #: families that may have a word pair that still confirms one of them
SAMPLE = 1500  #: documents whose paragraphs are examples of the unknown class, about
SAMPLE_BYTES = 1 << 15  #: a longer text is not among them, so the sample's size is bounded
VARIANTS = 10  #: examples made of each notice by leaving words out; the last two calibrate
HELD_FORMS = 5  #: of so many short forms one calibrates
RARE_FORMS = 6.0  #: weight of a form with two names, or with a name of no family here, of which there are few
COMMON = 0.01  #: n-grams in a larger share of unknown paragraphs are no features
STEPS = 24
RATE = 1.0
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0)
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
CONFIRM = 0.6  #: share of a template's word pairs that confirms it


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))


def grams(w: Column) -> Column:
    """Distinct words and word pairs."""
    return F.array_distinct(F.concat(w, pairs(w)))


def template_rows() -> list[tuple[list[str], str, bool, str]]:
    """(families, template, is_short, text) of notices and of short forms, those with two names last."""
    rows = [([f], f"{f}/{i}", False, t) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    rows += [([f], f"{f}/{x.format(name)}", True, x.format(name)) for f, names in {**NAMES, UNKNOWN: OTHER}.items() for name in names for x in FRAMES]
    two = [(x, y) for a, b in TWO_FAMILIES for x, y in ((a, b), (b, a))]
    return rows + [([a, b], x.format(NAMES[a][0], NAMES[b][0]), True, x.format(NAMES[a][0], NAMES[b][0])) for a, b in two for x in TWO_NAMES]


def words_of(text: str) -> list[str]:
    """What `words` makes of a template, for plans that need its n-grams as values."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def templates(spark: SparkSession) -> DataFrame:
    """families, template, is_short, w (words); a row for each template."""
    rows = [(f, t, short, words_of(text)) for f, t, short, text in template_rows()]
    return spark.createDataFrame(rows, "families array<string>, template string, is_short boolean, w array<string>")


def shapes(spark: SparkSession) -> DataFrame:
    """family, template, gram, size: the word pairs that tell a template of one family, and their number. Pairs that more than
    SHARED families have tell nothing, unless a template has no others."""
    rows, having = [], {}
    for f, t, _, text in template_rows():
        if len(f) == 1:
            w = words_of(text)
            rows.append((f[0], t, dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:]))))
            for g in rows[-1][2]:
                having.setdefault(g, set()).add(f[0])
    telling = [(f, t, [g for g in grams if len(having[g]) <= SHARED] or list(grams)) for f, t, grams in rows]
    return spark.createDataFrame([(f, t, g, len(grams)) for f, t, grams in telling for g in grams], "family string, template string, gram string, size int")


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row (of docs), doc_id, paragraph (from 0), w (its words)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    lines = rows.select("row", "doc_id", F.posexplode("lines").alias("paragraph", "line"))
    return lines.select("row", "doc_id", "paragraph", words(F.col("line")).alias("w"))


def with_blocks(docs: DataFrame, doc_id: str, text: str, gate: list[str]) -> DataFrame:
    """row (of docs), doc_id, block (its first line), paragraph (first line), n_lines, w; each line with a word of the gate, and each block of several lines that has one."""
    passes = lambda w: F.arrays_overlap(w, F.split(F.lit(" ".join(gate)), " "))  # noqa: E731  # one constant
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # most texts have no word of the gate; the others are cut into lines
    rows = rows.where(passes(words(F.col("text")))).select("row", "doc_id", F.transform(F.split("text", "\n"), words).alias("lines"))
    full = lambda i: F.coalesce(F.size(F.get("lines", i)) > 0, F.lit(False))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    starts, ends = F.filter(places, lambda i: full(i) & ~full(i - 1)), F.filter(places, lambda i: full(i) & ~full(i + 1))
    blocks = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("block"), F.slice("lines", a + 1, b - a + 1).alias("lines")))
    # not explode(), for which Spark works out the array twice
    rows = rows.select("row", "doc_id", F.explode_outer(blocks).alias("b")).select("row", "doc_id", "b.block", "b.lines").where(passes(F.flatten("lines")))
    each = F.transform("lines", lambda w, i: F.struct((F.col("block") + i).alias("paragraph"), F.lit(1).alias("n_lines"), w.alias("w")))
    whole = F.array(F.struct(F.col("block").alias("paragraph"), F.size("lines").alias("n_lines"), F.flatten("lines").alias("w")))
    every = rows.select("row", "doc_id", "block", F.explode_outer(F.when(F.size("lines") > 1, F.concat(each, whole)).otherwise(each)).alias("p"))
    return every.select("row", "doc_id", "block", "p.paragraph", "p.n_lines", "p.w").where(passes(F.col("w")))


class LicenseModel:
    """n-gram to one weight for each family; the empty n-gram is the bias. A paragraph whose greatest
    probability is below the threshold is of the unknown class."""

    def __init__(self, weights: dict[str, list[float]], temperature: float, threshold: float, gate: list[str]):
        self.weights, self.temperature, self.threshold, self.gate = weights, temperature, threshold, gate

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.weights.items()), "gram string, weights array<double>")


def value(grams: Column) -> Column:
    """Of each n-gram but the bias in an example's features."""
    return 1 / F.greatest(F.sqrt(F.size(grams) - 1), F.lit(1.0))


def probabilities(weights: list[list[float]], temperature: float = 1.0) -> Column:
    """Of rows with `grams` (numbers; 0 is the bias), the probability of each family."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<array<double>>")

    def family(i: Column) -> Column:
        add = lambda t, g: t + F.get(F.get(table, g), i) * F.when(g == 0, 1.0).otherwise(value(F.col("grams")))
        return 1 / (1 + F.exp(-F.aggregate("grams", F.lit(0.0), add) / temperature))

    return F.transform(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), family)


def fitted(n: int) -> Column:
    """Weights (n-gram by family) after STEPS of gradient ascent with a step size for each weight, from
    a row with all distinct examples, `ex` (grams, m, y): the whole loop is one expression."""
    families = F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1))
    inside = lambda g: F.filter(F.transform("ex", lambda e, j: F.struct(j.alias("j"), F.when(g == 0, 1.0).otherwise(value(e["grams"])).alias("v"), F.array_contains(e["grams"], g).alias("in"))), lambda x: x["in"])
    bind = lambda x, use: F.get(F.transform(F.array(x), use), 0)

    def wrong(w: Column) -> Column:
        def family(e: Column, i: Column) -> Column:
            add = lambda t, g: t + F.get(F.get(w, g), i) * F.when(g == 0, 1.0).otherwise(value(e["grams"]))
            return e["m"] * (F.get(e["y"], i) - 1 / (1 + F.exp(-F.aggregate(e["grams"], F.lit(0.0), add))))

        return F.transform("ex", lambda e: F.transform(families, lambda i: family(e, i)))

    def step(postings: Column):
        def run(state: Column, _: Column) -> Column:
            slope = lambda p, e, i: F.aggregate(p, F.lit(0.0), lambda t, x: t + x["v"] * F.get(F.get(e, x["j"]), i))
            slopes = bind(wrong(state["w"]), lambda e: F.transform(postings, lambda p: F.transform(families, lambda i: slope(p, e, i))))
            squares = lambda g: F.zip_with(state["q"], g, lambda a, b: F.zip_with(a, b, lambda x, y: x + y * y))
            moved = lambda g, q: F.zip_with(state["w"], F.zip_with(g, q, lambda a, b: F.zip_with(a, b, lambda x, y: RATE * x / F.sqrt(y))), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
            return bind(slopes, lambda g: bind(squares(g), lambda q: F.struct(moved(g, q).alias("w"), q.alias("q"))))

        return run

    constant = lambda x: F.array_repeat(F.array_repeat(F.lit(x), len(FAMILIES)), n)
    start = F.struct(constant(0.0).alias("w"), constant(1e-6).alias("q"))
    postings = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), inside)
    return bind(postings, lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step(p)))["w"]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LicenseModel:
    """Fit on variants of the templates and on paragraphs of about SAMPLE documents, chosen by a
    hash of their texts; sampled paragraphs that look like a template are left out. Features are
    the templates' n-grams that hold a rare word. Examples with the same features are one row, with
    their number; a gradient step is one sum over these rows."""
    spark = docs.sparkSession
    n_docs = max(1, docs.count())
    rate = math.ceil(1_000_000 * min(1.0, SAMPLE / n_docs))
    some = docs.where((F.octet_length(text) <= SAMPLE_BYTES) & (F.pmod(F.xxhash64(text, F.lit(8)), F.lit(1_000_000)) < rate))
    known, telling = templates(spark), shapes(spark)
    negative = materialise(paragraphs(some, doc_id, text).where(F.size("w") > 0).select(F.concat_ws("/", F.lit("-"), "row", "paragraph").alias("example"), "w"), "sampled")
    like = negative.select("example", F.explode(F.array_distinct(pairs(F.col("w")))).alias("gram")).join(F.broadcast(telling), "gram")
    like = like.groupBy("example", "template", "size").agg(F.count("*").alias("n")).where("2 * n >= size").select("example").distinct()
    negative = materialise(negative.join(like, "example", "left_anti"), "negatives")
    dropped = lambda i, j: F.pmod(F.xxhash64("template", i, j), F.lit(8)) == 0
    # words of a short form are not left out: without its name it is none
    variants = F.when(F.col("is_short"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))
    positive = known.select("families", "template", "is_short", "w", F.explode(variants).alias("variant"))
    kept = F.filter("w", lambda w, i: (F.col("variant") == 0) | ~dropped(i, F.col("variant")))
    held = F.when(F.col("is_short"), F.pmod(F.xxhash64("template"), F.lit(HELD_FORMS)) == 0).otherwise(F.col("variant") >= VARIANTS - 2)
    positive = positive.select(F.concat_ws("/", "template", "variant").alias("example"), "families", held.alias("held"), kept.alias("w"))
    n_negative = max(1, negative.count())
    wanted = positive.select(F.explode(grams(F.col("w"))).alias("gram")).distinct()
    seen = negative.select("example", F.explode(grams(F.col("w"))).alias("gram")).join(F.broadcast(wanted), "gram").groupBy("gram").agg((F.count("*") / n_negative).alias("share"))
    share = {r["gram"]: r["share"] or 0.0 for r in wanted.join(seen, "gram", "left").collect()}
    rarest = {g: min(g.split(" "), key=lambda w: (share.get(w, 0.0), w)) for g in share}
    vocabulary = ["", *sorted(g for g, w in rarest.items() if share[g] <= COMMON and share.get(w, 0.0) <= COMMON)]
    gate = sorted({rarest[g] for g in vocabulary[1:]})

    every = positive.unionByName(negative.select("example", F.array().cast("array<string>").alias("families"), (F.pmod(F.xxhash64("example"), F.lit(5)) == 0).alias("held"), "w"))
    numbers = spark.createDataFrame(list(zip(vocabulary, range(len(vocabulary)))), "gram string, g int")
    hits = every.select("example", "families", "held", F.explode(F.concat(F.array(F.lit("")), grams(F.col("w")))).alias("gram")).join(F.broadcast(numbers), "gram")
    alike = hits.groupBy("example", "families", "held").agg(F.sort_array(F.collect_list("g")).alias("grams")).groupBy("families", "held", "grams").agg(F.count("*").alias("n"))
    # examples of a family count as much in all as the rest
    balance = F.when(F.size("families") == 0, F.lit(1.0)).otherwise(F.lit(max(1.0, n_negative / (len(FAMILIES) * 8.0 * 4))))
    balance = balance * F.when((F.size("families") == 2) | F.array_contains("families", UNKNOWN), RARE_FORMS).otherwise(1.0)
    labels = F.array(*(F.array_contains("families", f).cast("double") for f in FAMILIES))
    examples = materialise(alike.select("held", "grams", (F.col("n") * balance).alias("m"), labels.alias("y")).coalesce(1), "examples")

    weights = examples.where("not held").agg(F.sort_array(F.collect_list(F.struct("grams", "m", "y"))).alias("ex")).select(fitted(len(vocabulary)).alias("w")).first()["w"]
    held = examples.where("held")
    loss = lambda y, p: -y * F.log(p + 1e-9) - (1 - y) * F.log(1 - p + 1e-9)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    losses = held.agg(*(F.sum(F.col("m") * total(F.zip_with("y", probabilities(weights, t), loss))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES))).first()
    temperature = min(TEMPERATURES, key=lambda t: (losses[f"t{TEMPERATURES.index(t)}"] or 0.0, t))
    # the unknown class: the threshold with the least weight of held-out examples on the wrong side or in a wrong family
    best = held.select("m", "y", probabilities(weights, temperature).alias("p")).select("m", "y", F.array_max("p").alias("top"), F.get("y", F.array_position("p", F.array_max("p")).cast("int") - 1).alias("right"))
    bad = lambda t: F.sum(F.col("m") * F.when(F.col("top") >= t, 1 - F.col("right")).otherwise(F.array_max("y")))
    errors = best.agg(*(bad(t).alias(f"t{k}") for k, t in enumerate(THRESHOLDS))).first()
    threshold = min(THRESHOLDS, key=lambda t: (errors[f"t{THRESHOLDS.index(t)}"] or 0.0, abs(t - 0.5)))
    return LicenseModel(dict(zip(vocabulary, weights)), temperature, threshold, gate)


def license_scan(docs: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per paragraph and family that has the model's threshold of probability or more there: doc_id, paragraph (number of its
    first line, from 0), family (`unknown` unless a template confirms the prediction), predicted (`unknown`: a licence
    of no family here), probability,
    template (the family's most similar one), similarity (share of its word pairs), confirmed,
    n_lines. A paragraph has a row for each family that is confirmed, or else for its likeliest one. A block of several lines has a row if it is confirmed and none of its lines is for that
    family; it then stands for those lines.

    Null and empty texts have no rows; repeated rows are all reported; a null doc_id stays null;
    an empty table gives an empty one; other columns are not read. Ties go to the first family or
    template by name.
    """
    spark = docs.sparkSession
    # stored, so that its row numbers are the same for scores and templates, whatever is computed again
    found = materialise(with_blocks(docs, doc_id, text, model.gate), "paragraphs")
    keys = ["row", "doc_id", "block", "paragraph", "n_lines"]
    every = found.select(*keys, F.explode(F.concat(F.array(F.lit("")), grams(F.col("w")))).alias("gram"))
    table = model.table(spark)
    hits = every.join(F.broadcast(table), "gram")
    real = F.col("gram") != ""
    count = F.greatest(F.sqrt(F.sum(real.cast("int"))), F.lit(1.0))
    sums = [(F.sum(F.when(real, F.col("weights")[i])) / count + F.max(F.when(~real, F.col("weights")[i]))) / model.temperature for i in range(len(FAMILIES))]
    scores = hits.groupBy(*keys).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).where("s0 is not null")
    best = F.greatest(*(F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(len(FAMILIES))))
    each = F.array(*(F.struct(F.lit(f).alias("predicted"), F.round(1 / (1 + F.exp(-F.col(f"s{i}"))), 6).alias("probability"), (F.col("best.i") == -i).alias("is_best")) for i, f in enumerate(FAMILIES)))
    scores = scores.withColumn("best", best).select(*keys, F.inline(each)).where(F.col("probability") >= model.threshold)
    match = every.join(F.broadcast(shapes(spark)), "gram").groupBy(*keys, "family", "template", "size").agg(F.count("*").alias("n"))
    match = match.groupBy(*keys, "family").agg(F.max(F.struct((F.col("n") / F.col("size")).alias("similarity"), "size", "template")).alias("m"))
    same = [scores[k].eqNullSafe(match[k]) for k in keys] + [scores["predicted"] == match["family"]]
    out = scores.join(match, same, "left").select(*(scores[k] for k in keys), "predicted", "probability", "is_best", F.col("m.template").alias("template"), F.round(F.coalesce(F.col("m.similarity"), F.lit(0.0)), 6).alias("similarity"))
    out = out.withColumn("confirmed", (F.col("similarity") >= CONFIRM) & (F.col("predicted") != UNKNOWN))
    # every family that a paragraph names; else its best one
    named = F.max("confirmed").over(Window.partitionBy("row", "block", "paragraph", "n_lines"))
    out = out.withColumn("named", named).where("confirmed or is_best and not named")
    notice = Window.partitionBy("row", "block", "predicted")
    sure = lambda of: F.max(F.col("confirmed") & of).over(notice)
    out = out.withColumn("by_line", sure(F.col("n_lines") == 1)).withColumn("by_block", sure(F.col("n_lines") > 1))
    out = out.where((F.col("n_lines") > 1) == (F.col("by_block") & ~F.col("by_line")))
    return out.select("doc_id", "paragraph", F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN).alias("family"), "predicted", "probability", "template", "similarity", "confirmed", "n_lines")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license_scan(docs, train(docs))
