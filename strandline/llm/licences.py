"""Licence scans: a trained paragraph classifier, in DataFrame operations only on the path of the data.

Paragraphs are the blocks of a text between blank lines. A notice may be a line of one or wrapped over several, beside
other lines, so what is classified are the runs of one to SPAN lines of a paragraph; a run that holds a shorter one with a
notice counts as that one. Features are the words and word bigrams of a fixed vocabulary, that of the templates below;
common ones are left to the fit to weigh down. A softmax regression over licence families and a class of unknown
paragraphs is fitted by gradient descent on the driver: on the templates, on parts of them (so that cut notices are
known), and on background lines that look like no licence; its temperature is then chosen on parts held out of the fit,
which calibrates the unknown class. Its weights are a small table: vocabulary x classes, bounded by the templates.

Scoring: a predicted family is confirmed by comparison with its templates: enough of the bigrams of a template, or of the
run, must be in the other, never fewer than two, and one of them, not of fillers alone, in no other family's templates (`licensed under the` alone
tells no family). So whole texts are first tested for a bigram of one family, then the lines, each with the next one's first
word, for where it stands, which loses none; only runs over such lines are made. Their features meet the weights in a
broadcast join and add up per run.

Null and empty texts have no licence and no paragraph. Repeated rows each give a row; rows of one doc_id are judged by their
own text. An empty table gives no rows. Extra columns are ignored. Ties between families go to the first in the alphabet.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Short public notices by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Licensed under the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["Copyright. All rights reserved.", "This material is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
#: Paragraphs that hold licence words and are none.
NEAR_MISSES = [
    "The driver showed a license at the border.", "A fishing license is required in this state.", "The museum is free and open to the public.", "Version 2.0 of the report will be published in spring.", "The contract was signed under the terms agreed before.",
    "Permission was granted by the city.", "The general public was invited.", "This work is not yet finished.", "Copyright law is taught at the faculty.", "You may use the kitchen.", "Released in 1994, the film won a prize.", "The software was distributed to all schools.",
]
#: Words that say nothing about a licence, alone or in pairs.
FILLERS = frozenset("a an and any are as at be been but by can for from has have if in is it its may must no not of on or other shall such that the their this to under was were which will with you your".split())
UNKNOWN, BACKGROUND, STEPS, SEED = "unknown", 500, 400, 3
CONFIRM, SPAN = 0.6, 4


def terms_of(text: str) -> list[str]:
    import re

    words = re.findall("[0-9a-z]+", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def pairs(ws: Column) -> Column:
    return F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def template_bigrams() -> list[str]:
    return sorted({t for ts in TEMPLATES.values() for x in ts for t in terms_of(x) if " " in t})


LICENCE_BIGRAMS = frozenset(t for t in template_bigrams() if not FILLERS.issuperset(t.split())) - {t for x in NEAR_MISSES for t in terms_of(x)}
#: family: bigrams, not of fillers alone, that templates of no other family hold.
ONLY = {f: sorted({t for x in xs for t in terms_of(x) if " " in t} - {t for g, ys in TEMPLATES.items() if g != f for y in ys for t in terms_of(y)} - {t for x in xs for t in terms_of(x) if FILLERS.issuperset(t.split())}) for f, xs in TEMPLATES.items()}
TEMPLATE_WORDS = [frozenset(terms_of(x)) - FILLERS for ts in TEMPLATES.values() for x in ts]


def licence_like(line: str) -> bool:
    """Whether a line holds a template's bigram that says something, or most of its words that do are a template's, as in
    `license: MIT`: it may be a notice, so it can't teach what none is."""
    terms = set(terms_of(line))
    told = {t for t in terms if " " not in t} - FILLERS
    return bool(terms & LICENCE_BIGRAMS) or any(told and len(told & t) >= CONFIRM * len(told) for t in TEMPLATE_WORDS)


def background(docs: DataFrame, size: int = BACKGROUND, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """All lines, whole, of `size` documents drawn by a hash of their ids, for the fit alone; but for those that look like a
    licence. Without an order of their own they come sorted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    drawn = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(size)
    lines = rows.join(F.broadcast(drawn), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    return sorted(r["line"] for r in lines.collect() if not licence_like(r["line"]))  # of `size` documents


class Model:
    """classes (the unknown one last), vocabulary, weights (terms x classes, by temperature), bias."""

    def __init__(self, lines: list[str]) -> None:
        draw = np.random.default_rng(SEED)
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        self.vocabulary = sorted({t for ts in TEMPLATES.values() for x in ts for t in terms_of(x)})
        at = {t: i for i, t in enumerate(self.vocabulary)}
        unknown = len(self.classes) - 1
        rows: tuple[Counter, Counter] = (Counter(), Counter())  # fitted, held out: how often (class, terms)
        known = lambda text: frozenset(at[t] for t in terms_of(text) if t in at)
        for c, family in enumerate(self.classes[:-1]):
            for template in TEMPLATES[family]:
                told = template.split()
                rows[0][c, known(template)] += 4
                for _ in range(8):
                    n = int(draw.integers(max(2, -(-2 * len(told) // 3)), len(told) + 1))
                    a = int(draw.integers(0, len(told) - n + 1))
                    rows[draw.random() < 0.25][c, known(" ".join(told[a : a + n]))] += 1
        # as much weight as the templates have goes to the background lines, however many there are, half of them held out
        others = (Counter(), Counter())
        for line in lines:
            others[crc32(line.encode("utf-8", "surrogatepass")) & 1][known(line)] += 1
        for side, own in zip(rows, others, strict=True):
            weight, many = side.total(), own.total()
            for x in NEAR_MISSES:
                side[unknown, known(x)] += 3
            side[unknown, frozenset()] += 1
            for terms, n in own.items():
                side[unknown, terms] += weight * n / many

        def matrix(found: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.zeros((len(found), len(at)))
            for i, (_, terms) in enumerate(found):
                x[i, list(terms)] = 1
            share = np.array(list(found.values()))
            return x, np.array([c for c, _ in found]), share / share.sum()

        x, y, share = matrix(rows[0])
        weights, bias = np.zeros((len(at), len(self.classes))), np.zeros(len(self.classes))
        for step in range(STEPS):
            p = self.softmax(x @ weights + bias)
            p[np.arange(len(y)), y] -= 1
            p *= share[:, None]
            rate = 20.0 / (1 + step / 100)
            weights -= rate * (x.T @ p + 1e-5 * weights)
            bias -= rate * 0.1 * p.sum(axis=0)
        hx, hy, held = matrix(rows[1])
        loss = lambda t: -np.log(self.softmax((hx @ weights + bias) / t)[np.arange(len(hy)), hy] + 1e-12) @ held
        heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        self.weights, self.bias = weights / heat, bias / heat

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, size: int = BACKGROUND) -> Model:
    return Model(background(docs, size))


def paragraphs(text: Column | str) -> Column:
    """array<array<string>>: the lines of each block between blank lines, without blank ones."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D]", " ")))
    blocks = F.filter(F.split(F.array_join(lines, "\n"), "\n{2,}"), lambda x: F.regexp_replace(x, "\n", "") != "")
    return F.transform(blocks, lambda x: F.filter(F.split(x, "\n"), lambda y: y != ""))


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per notice: doc_id, key (of the row), paragraph and line (from 0, of the paragraph's), lines (how many), notice (the
    lines, joined), family, probability, overlap (with the best template). A run of lines is listed if a family is likelier
    than each other class, its templates confirm it, and no shorter run inside it is listed."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = F.array(*map(F.lit, template_bigrams()))
    telling = F.array(*map(F.lit, sorted({t for ts in ONLY.values() for t in ts})))
    # the words are bound once, as `pairs` names them often
    bound = lambda ws, told: F.transform(F.array(ws), told)[0]
    bigrams = lambda x: bound(words(x), lambda ws: F.struct(ws.alias("ws"), pairs(ws).alias("bs")))
    run = ("doc_id", "key", "paragraph", "line", "lines")
    none = F.array().cast("array<string>")

    def runs_of(ws: Column) -> Column:
        """Of the words of each line of a paragraph the runs to score, with their words: one expression, evaluated once."""
        onward = lambda j: F.concat(F.get(ws, j), F.slice(F.coalesce(F.get(ws, j + 1), none), 1, 1))
        told = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda j: F.arrays_overlap(pairs(onward(j)), telling))
        sizes = lambda j: F.filter(F.sequence(F.lit(1), F.lit(SPAN)), lambda n: n <= F.size(ws))
        begins = lambda j, n: F.greatest(F.lit(0), j - n + 1)
        over = lambda j: F.flatten(F.transform(sizes(j), lambda n: F.transform(F.sequence(begins(j, n), F.greatest(begins(j, n), F.least(j, F.size(ws) - n))), lambda i: F.struct(i.alias("line"), n.alias("lines")))))
        spelled = F.transform(F.array_distinct(F.flatten(F.transform(told, over))), lambda r: F.struct(r["line"].alias("line"), r["lines"].alias("lines"), F.flatten(F.slice(ws, r["line"] + 1, r["lines"])).alias("ws")))
        return F.filter(spelled, lambda r: F.exists(F.array(pairs(r["ws"])), lambda bs: (F.size(F.array_intersect(bs, own)) >= 2) & F.arrays_overlap(bs, telling)))

    runs = (
        rows.where(F.arrays_overlap(bigrams("text")["bs"], telling))
        .select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.posexplode(paragraphs("text")).alias("paragraph", "_lines"))
        .select("doc_id", "key", "paragraph", "_lines", F.explode(bound(F.transform("_lines", words), runs_of)).alias("_run"))
        .select("doc_id", "key", "paragraph", "_run.line", "_run.lines", F.array_join(F.slice("_lines", F.col("_run.line") + 1, F.col("_run.lines")), " ").alias("notice"))
        .distinct()
        .withColumn("_b", bigrams("notice"))
        .select(*run, "notice", "_b.ws", "_b.bs")
    )
    # bounded by the templates: some hundred terms, a column for each class
    table = F.broadcast(spark.createDataFrame([(t, [float(x) for x in w]) for t, w in zip(model.vocabulary, model.weights, strict=True)], "term string, w array<double>"))
    many = len(model.classes)
    sums = runs.select(*run, "notice", F.explode(F.array_distinct(F.concat("ws", "bs"))).alias("term")).join(table, "term").groupBy(*run, "notice").agg(*(F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(many)))
    z = F.array(*(F.col(f"z{c}") + float(model.bias[c]) for c in range(many)))
    likely = sums.select(*run, "notice", z.alias("z")).withColumn("top", F.array_max("z")).withColumn("best", (F.array_position("z", F.col("top")) - 1).cast("int"))
    known = likely.where(F.col("best") < many - 1).select(
        *run, "notice", F.element_at(F.array(*map(F.lit, model.classes)), F.col("best") + 1).alias("family"), F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - top))").alias("probability")
    )
    bigrams_of = lambda xs: [[t for t in dict.fromkeys(terms_of(x)) if " " in t] for x in xs]
    templates = F.broadcast(spark.createDataFrame([(f, bigrams_of(xs), ONLY[f]) for f, xs in sorted(TEMPLATES.items())], "family string, templates array<array<string>>, only array<string>"))
    overlap = F.expr("array_max(transform(templates, t -> size(array_intersect(bs, t)) / greatest(2, least(size(t), size(array_distinct(bs))))))")
    met = known.join(templates, "family").withColumn("bs", bigrams("notice")["bs"]).withColumn("overlap", overlap).where(f"overlap >= {CONFIRM} and arrays_overlap(bs, only)")
    met = stored(met.select(*run, "notice", "family", "probability", "overlap"), "licence-runs")
    # runs with a shorter one inside: each looks up its parts
    inside = F.expr("flatten(transform(sequence(1, lines - 1), n -> transform(sequence(line, line + lines - n), a -> struct(a as line, n as lines))))")
    parts = met.where("lines > 1").select(*run, F.explode(inside).alias("part"))
    same = [parts["key"] == F.col("s.key"), parts["doc_id"].eqNullSafe(F.col("s.doc_id")), parts["paragraph"] == F.col("s.paragraph"), parts["part.line"] == F.col("s.line"), parts["part.lines"] == F.col("s.lines")]
    longer = parts.join(met.select(*run).alias("s"), same, "left_semi").select(*(F.col(c).alias(f"_{c}") for c in run)).distinct()
    outer = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in run]
    return met.join(longer, outer, "left_anti")


def scan_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_paragraphs (blocks between blank lines), n_licensed (those with a notice), families (sorted),
    probability (the highest, 0 without any)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"), F.when(F.col("text").isNull(), 0).otherwise(F.size(paragraphs("text"))).cast("long").alias("n_paragraphs")
    )
    found = scan(docs, model, doc_id, text).groupBy("doc_id", "key").agg(F.countDistinct("paragraph").alias("n_licensed"), F.sort_array(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"))
    own = found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_licensed", "families", "probability")
    joined = rows.join(own.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select(
        "doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("probability", F.lit(0.0)).alias("probability")
    )
