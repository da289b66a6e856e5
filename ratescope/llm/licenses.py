"""Licence notices: a trained paragraph classifier with an unknown class, confirmed by templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ratescope.llm.common import sorted_distinct, text_of
from ratescope.runtime import settle

UNKNOWN = "unknown"
#: Notices by which texts name their licence.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
WORDS = re.compile(r"[^\W_]+")
#: Odd multipliers, one for each word of an n-gram, and one to mix.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


LINES = re.compile(r"\r?\n")
#: Pieces that are scored together, and a number of characters from which fewer are.
PIECES, CHARACTERS = 4096, 1 << 20


def _starts(words: int, most_words: int, step: int) -> range:
    """Where the windows of so many words start: at 0 only, if one window holds them."""
    return range(0, max(1, words - (most_words - step)), step) if words > most_words else range(1)


def pieces(text: str, most_words: int, step: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(paragraph, window, first line, last line, text): the lines of a text, and the paragraphs that they wrap.

    Lines that hold words are pieces of their own, long ones as windows that overlap. Lines without a line that holds no word between
    them are a paragraph; windows over its joined words follow, those that cover more than one line. A piece's
    paragraph is the number of its first line, and a paragraph's windows are numbered after those of its first line.
    """
    block: list[tuple[int, list[str]]] = []
    for number, line in enumerate(chain(LINES.split(text), [""])):
        if WORDS.search(line):
            words = line.split()
            block.append((number, words))
            for window, at in enumerate(_starts(len(words), most_words, step)):
                yield number, window, number, number, " ".join(words[at : at + most_words]) if len(words) > most_words else line
            continue
        if len(block) > 1:
            words = list(chain.from_iterable(w for _, w in block))
            lines = list(chain.from_iterable([k] * len(w) for k, w in block))
            before = len(_starts(len(block[0][1]), most_words, step))
            for window, at in enumerate(_starts(len(words), most_words, step)):
                first, last = lines[at], lines[min(at + most_words, len(words)) - 1]
                if first < last:
                    yield block[0][0], before + window, first, last, " ".join(words[at : at + most_words])
        block = []


def _in_groups(batches: Iterator[pa.RecordBatch], most_words: int, step: int) -> Iterator[tuple[list, list[str]]]:
    """(id, paragraph, window, row, first line, last line) and texts of the pieces of (id, text) batches, some thousand at a time."""
    places, texts, size, row = [], [], 0, 0
    for batch in batches:
        for identifier, text in zip(batch.column(0), batch.column(1), strict=True):
            row += 1
            for paragraph, window, first, last, piece in pieces(text.as_py() or "", most_words, step):
                places.append((identifier, paragraph, window, row, first, last))
                texts.append(piece)
                size += len(piece)
                if len(texts) >= PIECES or size >= CHARACTERS:
                    yield places, texts
                    places, texts, size = [], [], 0
    if texts:
        yield places, texts


def background_paragraphs(docs: DataFrame, text_column: str, most_words: int, step: int, most_texts: int, most: int, seed: int) -> DataFrame:
    """At most ``most`` paragraphs, those with the smallest hashes, of the ``most_texts`` different texts with the smallest hashes.

    Lines over which a notice wraps are left out, as they would teach that its parts are no notice.
    """
    texts = docs.select(text_of(text_column).alias("text")).withColumn("hash", F.xxhash64(F.lit(seed), "text"))
    smallest = F.broadcast(settle(texts.select("hash").distinct().orderBy("hash").limit(most_texts)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = list(chain.from_iterable(_template_grams().values()))
        pairs, fewest = set().union(*templates), min(len(g) for g in templates) / 2
        for batch in batches:
            for text in batch.column(1):
                every = list(pieces(text.as_py(), most_words, step))
                notice = set()
                for _, _, first, last, piece in every:
                    if first < last and len(pairs & _grams(piece)) >= fewest and agreement(piece, templates) >= 0.5:
                        notice.update(range(first, last + 1))
                found = [p for _, _, first, last, p in every if notice.isdisjoint(range(first, last + 1))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])

    every = texts.join(smallest, "hash").select("hash", "text").mapInArrow(read, "text string").distinct()
    return every.orderBy(F.xxhash64(F.lit(seed), "text"), "text").limit(most)


def _words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _hashed(texts: list[str], buckets: int, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(text number, counter) of the word n-grams of one to ``most`` words, in lower case, each pair once and in order.

    Each word that the texts have is hashed once; an n-gram's hash mixes those of its words.
    """
    words = [_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
    hashes = np.fromiter((xxh3_64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))[codes]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    found = []
    for width in range(1, most + 1):
        n = max(len(hashes) - width + 1, 0)
        total = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            total += hashes[k : n + k] * ODD[k]
        inside = owner[:n] == owner[width - 1 : n + width - 1]
        mixed = (total ^ (total >> np.uint64(29))) * ODD[-1]
        counter = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        found.append((owner[:n] * buckets + counter)[inside])
    once = sorted_distinct(np.concatenate(found))
    return once // buckets, once % buckets


def _grams(text: str) -> set[tuple[str, ...]]:
    words = _words(text)
    return {tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()


def agreement(text: str, templates: list[set[tuple[str, ...]]]) -> float:
    """The largest share of a template whose word pairs occur in the text; 0 without templates."""
    mine = _grams(text)
    return max((len(g & mine) / len(g) for g in templates), default=0.0)


def _template_grams() -> dict[str, list[set[tuple[str, ...]]]]:
    return {family: [_grams(t) for t in texts] for family, texts in TEMPLATES.items()}


class LicenceModel:
    """Family probabilities of paragraphs, with a temperature and a least probability from held-out rows."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.weights, self.bias, self.temperature, self.least = weights, bias, temperature, least

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Family numbers (0, unknown, where no family is sure) and the probabilities of the likeliest families."""
        shares = _shares(_raw(texts, self.weights, self.bias), self.temperature)
        best, top = shares.argmax(axis=1), shares.max(axis=1, initial=0.0)
        return np.where(top >= self.least, best, 0), top


def _raw(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One number per text and family: the bias and the weights of the counters that the text has."""
    owner, counter = _hashed(texts, weights.shape[1])
    return np.stack([np.bincount(owner, weights=w[counter], minlength=len(texts)) for w in weights], axis=1) + bias


def _shares(raw: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((raw - raw.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def _training_rows(spark: SparkSession, background: DataFrame, copies: int, seed: int) -> DataFrame:
    """(label, text, held): varied templates, and background paragraphs as unknown.

    A copy loses about a tenth of its words and may stand between words of background paragraphs;
    background paragraphs that hold a template are left out.
    """
    listed = [(float(FAMILIES.index(f)), k, t) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    copied = spark.createDataFrame(listed, "label double, template int, text string").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "label", "template", "copy"), F.lit(1000))
    words = F.split("text", r"\s+")
    thinned = F.filter(words, lambda w: (F.col("copy") == 0) | (F.pmod(F.xxhash64(w, "copy", F.lit(seed)), F.lit(10)) > 0))
    numbered = background.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(97)))
    around = numbered.groupBy("place").agg(F.split(F.min("text"), r"\s+").alias("lead"), F.split(F.max("text"), r"\s+").alias("tail"))
    varied = copied.withColumn("place", F.pmod(draw, F.lit(97))).join(around, "place", "left")
    alone = F.array().cast("array<string>")
    before = F.when((draw % 2 == 0) & F.col("lead").isNotNull(), F.slice("lead", F.lit(1), (draw % 53).cast("int"))).otherwise(alone)
    after = F.when((draw % 3 == 0) & F.col("tail").isNotNull(), F.slice("tail", F.lit(1), (draw % 47).cast("int"))).otherwise(alone)
    notices = varied.select("label", F.array_join(F.concat(before, thinned, after), " ").alias("text"), (draw % 5 == 0).alias("held"))

    @F.pandas_udf("double")
    def agrees(text: pd.Series) -> pd.Series:
        every = list(chain.from_iterable(_template_grams().values()))
        return text.map(lambda t: agreement(t, every)).astype("float64")

    other = background.where(agrees("text") < 0.5).select(F.lit(0.0).alias("label"), "text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"))
    return notices.union(other)


def _telling(rows: DataFrame, terms: int) -> list[int]:
    """The counters by which the families differ most (chi-square over the rows of each), in order; at least one."""
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    cells = rows.select("label", F.explode("counters").alias("counter")).groupBy("counter", "label").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hit, rest = F.sum("n"), total - F.sum("n")
    spread = F.sum(F.col("n") * F.col("n") / F.col("of_label")) * total / hit - hit
    chi = F.when(rest > 0, spread * total / rest).otherwise(0.0)
    best = cells.join(classes, "label").groupBy("counter").agg(chi.alias("chi")).orderBy(F.desc("chi"), "counter").limit(terms)
    return sorted(r["counter"] for r in best.collect()) or [0]


def fit_licences(
    docs: DataFrame,
    text_column: str = "text",
    most_words: int = 60,
    step: int = 40,
    copies: int = 60,
    most_texts: int = 2000,
    most_background: int = 4000,
    buckets: int = 1 << 15,
    terms: int = 4096,
    fit_tasks: int = 8,
    penalty: float = 1e-4,
    seed: int = 7,
) -> LicenceModel:
    """Train on varied templates and on a bounded sample of the corpus (see ``background_paragraphs``).

    The sample has at most ``most_background`` paragraphs of ``most_texts`` texts. The model is a multinomial logistic regression over
    the ``terms`` hashed word n-grams that tell the families apart best, so that what a task sends to the driver in each
    step is small; ``fit_tasks`` tasks hold the bounded training rows. On the held-out fifth a temperature is chosen by likelihood, and the least
    probability of a family is the lowest of those from 0.5 to 0.95 that are right most often, background being unknown.
    """
    background = settle(background_paragraphs(docs, text_column, most_words, step, most_texts, most_background, seed))

    @F.udf("array<int>")
    def counted(text: str) -> list[int]:
        return _hashed([text], buckets)[1].tolist()

    varied = _training_rows(docs.sparkSession, background, copies, seed).select("label", "text", counted("text").alias("counters"), "held")
    rows = settle(varied.coalesce(fit_tasks))
    train = rows.where(~F.col("held"))
    chosen = _telling(train, terms)
    places = {counter: k for k, counter in enumerate(chosen)}

    @F.udf(VectorUDT())
    def features(counters: list[int]) -> SparseVector:
        mine = [places[c] for c in counters if c in places]
        return SparseVector(len(places), mine, np.ones(len(mine)))

    regression = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=0.0, maxIter=40)
    model = regression.fit(settle(train.select("label", features("counters").alias("features")).coalesce(fit_tasks)))
    weights, bias = np.zeros((len(model.interceptVector), buckets)), model.interceptVector.toArray()
    weights[:, chosen] = model.coefficientMatrix.toArray()
    held = rows.where("held").select("label", "text").collect()
    if not held:
        return LicenceModel(weights, bias, 1.0, 0.5)
    raw, label = _raw([r["text"] for r in held], weights, bias), np.array([int(r["label"]) for r in held])
    tried = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    loss = [-np.log(np.maximum(_shares(raw, t)[np.arange(len(label)), label], 1e-12)).mean() for t in tried]
    temperature = tried[int(np.argmin(loss))]
    shares = _shares(raw, temperature)
    best, top = shares.argmax(axis=1), shares.max(axis=1)
    limits = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    least = max(limits, key=lambda limit: int((np.where(top >= limit, best, 0) == label).sum()))
    return LicenceModel(weights, bias, temperature, least)


def scan_licences(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    most_words: int = 60,
    step: int = 40,
    agree: float = 0.6,
    **settings,
) -> DataFrame:
    """Licence notices of all texts: (id, paragraph, window, family, probability, agreement, text).

    Every line is classified, long ones in overlapping windows, and so are the windows of paragraphs that wrap over
    several lines (see ``pieces``); where a line is found, windows that cover it are not found as the same family again. A prediction is kept if a template of its family agrees:
    at least the share ``agree`` of the template's word pairs occurs; where a template of another
    family agrees better, as the Lesser licence's with a notice of its own, that family is reported. Null and empty texts have no paragraphs; a
    notice that occurs in several rows is found in each. No row is found twice but by overlapping windows.
    """
    model = fit_licences(docs, text_column, most_words, step, **settings)
    identifier = docs.schema[id_column]
    schema = T.StructType([
        T.StructField(id_column, identifier.dataType),
        *[T.StructField(name, T.IntegerType()) for name in ("paragraph", "window")],
        T.StructField("family", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in ("probability", "agreement")],
        T.StructField("text", T.StringType()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _template_grams()
        current, lines = 0, set()  # the row that is read, and (line, family) of its lines that are found
        for places, texts in _in_groups(batches, most_words, step):
            families, probabilities = model.classify(texts)
            found = []
            for k in np.flatnonzero(families):
                family = FAMILIES[families[k]]
                shares = {name: agreement(texts[k], grams) for name, grams in templates.items()}
                family = max(shares, key=lambda name: (shares[name], name == family))
                share = shares[family]
                if share < agree:
                    continue
                _, _, _, row, first, last = places[k]
                if row != current:
                    current, lines = row, set()
                if first == last:
                    lines.add((first, family))
                elif any((line, family) in lines for line in range(first, last + 1)):
                    continue
                found.append((k, family, float(probabilities[k]), share))
            if found:
                kept = [places[k] for k, *_ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i.as_py() for i, *_ in kept], kept[0][0].type),
                        *[pa.array([p[c] for p in kept], pa.int32()) for c in (1, 2)],
                        pa.array([f for _, f, _, _ in found], pa.string()),
                        *[pa.array([row[c] for row in found], pa.float64()) for c in (2, 3)],
                        pa.array([texts[k] for k, *_ in found], pa.string()),
                    ],
                    names=schema.names,
                )

    return docs.select(id_column, text_column).mapInArrow(scan, schema)
