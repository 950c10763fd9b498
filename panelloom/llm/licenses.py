"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A text's paragraphs are its lines. Features are the words and word pairs of the paragraph
that the learning texts use, hashed to a fixed number of buckets; a multinomial logistic
regression tells license families from ``unknown``. It learns from disturbed copies of the
templates and, for ``unknown``, from a bounded sample of the corpus. A temperature fitted on
held-out copies calibrates the probabilities. A prediction counts as confirmed when the
paragraph shares enough words and word pairs with a template of the predicted family. SPDX
tags are read as what they are: each identifier names its family.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from panelloom.llm.common import batch_rows, column

UNKNOWN = "unknown"
BUCKETS = 1 << 18
#: Corpus paragraphs for the unknown class, in expectation; each stands for itself.
BACKGROUND = 6000
COPIES = 60  # disturbed copies per template
CONFIRMED = 0.6
RESOLUTION = 10_000_000
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
#: An SPDX tag, and families by the identifiers that start so (the longest counts).
_NAME = r"[( ]*[a-z0-9][a-z0-9.+-]*[) ]*"
TAG = re.compile(rf"SPDX-License-Identifier:\s*({_NAME}(?:\b(?:and|or|with)\b{_NAME})*)", re.I)
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
SPDX = {
    "agpl": "AGPL", "apache-2.0": "Apache-2.0", "bsd": "BSD", "0bsd": "BSD", "cc-by-nc": "CC-BY-NC",
    "cc-by-sa": "CC-BY-SA", "cc-by": "CC-BY", "cc0": "CC0", "epl": "EPL", "gpl": "GPL", "isc": "ISC",
    "lgpl": "LGPL", "mit": "MIT", "mpl-2.0": "MPL-2.0", "bsl-1.0": "BSL-1.0",
    "unlicense": "Unlicense", "zlib": "Zlib",
}
#: Notices by which licenses are named, and sentences from their texts.
TEMPLATES = {
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "This code is released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 2-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL v3 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "proprietary": [
        "All rights reserved. No part of this document may be reproduced without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # UNKNOWN is the first
    words: frozenset[str]  # of the templates: paragraphs without any are unknown
    weights: dict[int, np.ndarray]  # by bucket, already divided by the temperature
    bias: np.ndarray
    templates: dict[str, list[frozenset[str]]]


def words_in(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]}


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (BUCKETS - 1)


def similarity(own: frozenset[str] | set[str], template: frozenset[str]) -> float:
    """Share of the smaller set that both have, so a notice inside a longer line still counts."""
    return len(own & template) / max(1, min(len(own), len(template)))


def _copies(text: str, rng: np.random.Generator, filler: list[str]) -> Iterator[list[str]]:
    words = words_in(text)
    for _ in range(COPIES):
        kept = [w for w in words if rng.random() > 0.06] or words
        before = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))]
        after = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))]
        yield before + kept + after


def fit(background: list[str], seed: int = 3, rounds: int = 400, rate: float = 0.3) -> Model:
    """Full-batch logistic regression by Adam; every fifth row calibrates."""
    rng = np.random.default_rng(seed)
    families = (UNKNOWN, *sorted(TEMPLATES))
    templates = {
        f: [frozenset(grams(words_in(t))) for t in TEMPLATES[f]] for f in families[1:]
    }
    named = [t for rows in templates.values() for t in rows]
    plain = [
        w for w in map(words_in, background)
        if w and max(similarity(grams(w), t) for t in named) < CONFIRMED
    ]
    filler = sorted({w for words in plain for w in words}) or ["text"]
    rows, labels = [], []
    for number, family in enumerate(families[1:], 1):
        for text in TEMPLATES[family]:
            for words in _copies(text, rng, filler):
                rows.append(words)
                labels.append(number)
    # Words of licenses alone say nothing: mixtures of them are unknown as well.
    vocabulary = sorted({w for f in TEMPLATES.values() for t in f for w in words_in(t)})
    for _ in range(len(rows) // 2):
        size = rng.integers(1, 12)
        rows.append([vocabulary[i] if rng.random() < 0.5 else filler[rng.integers(0, len(filler))]
                     for i in rng.integers(0, len(vocabulary), size)])
        labels.append(0)
    rows += plain
    labels += [0] * len(plain)
    known = {bucket_of(g) for t in named for g in t}
    place = {b: i for i, b in enumerate(sorted(known))}
    x = np.zeros((len(rows), len(place)), np.float32)
    for i, words in enumerate(rows):
        at = [place[b] for b in map(bucket_of, grams(words)) if b in place]
        x[i, at] = 1
    y = np.array(labels)
    held = np.arange(len(y)) % 5 == 0
    target = np.eye(len(families), dtype=np.float32)[y]
    weights = np.zeros((len(place), len(families)), np.float32)
    bias = np.zeros(len(families), np.float32)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    xt, tt = x[~held], target[~held]
    for step in range(1, rounds + 1):
        error = (_softmax(xt @ weights + bias) - tt) / len(xt)
        for value, grad, first, second in (
            (weights, xt.T @ error + 1e-5 * weights, state[0], state[1]),
            (bias, error.sum(axis=0), state[2], state[3]),
        ):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad**2 - second)
            value -= rate * (first / (1 - 0.9**step)) / (
                np.sqrt(second / (1 - 0.999**step)) + 1e-8
            )
    margin = x[held] @ weights + bias
    heats = np.geomspace(0.25, 8, 41)
    losses = [
        -np.log(_softmax(margin / h)[np.arange(held.sum()), y[held]] + 1e-12).mean() for h in heats
    ]
    heat = heats[int(np.argmin(losses))]
    return Model(
        families, frozenset(vocabulary), {b: weights[i] / heat for b, i in place.items()},
        bias / heat, templates,
    )


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def tagged(paragraph: str) -> list[str] | None:
    """Families of the identifiers in SPDX tags, ``None`` without a tag."""
    tags = TAG.findall(paragraph)
    if not tags:
        return None
    found = []
    for name in (n.lower().rstrip(".") for tag in tags for n in IDENTIFIER.findall(tag)):
        starts = [k for k in SPDX if name == k or name.startswith((f"{k}-", f"{k}+"))]
        if starts:
            found.append(SPDX[max(starts, key=len)])
    return list(dict.fromkeys(found))


def classify(paragraph: str, model: Model) -> tuple[str, float, float, bool]:
    """Family, its probability, similarity to its nearest template, and whether that confirms."""
    named = tagged(paragraph)
    if named is not None:
        return (named[0], 1.0, 1.0, True) if named else (UNKNOWN, 1.0, 0.0, False)
    words = words_in(paragraph)
    if model.words.isdisjoint(words):
        return UNKNOWN, 1.0, 0.0, False
    own = grams(words)
    margin = model.bias.copy()
    for gram in own:
        weight = model.weights.get(bucket_of(gram))
        if weight is not None:
            margin = margin + weight
    chances = _softmax(margin)
    best = int(np.argmax(chances))
    family = model.families[best]
    if not best:
        return family, float(chances[0]), 0.0, False
    alike = max(similarity(own, t) for t in model.templates[family])
    return family, float(chances[best]), alike, alike >= CONFIRMED


def learn(docs: DataFrame, background: int = BACKGROUND) -> Model:
    """Fit on the templates and on about ``background`` paragraphs of ``docs(doc_id, text)``, the
    middle lines of texts chosen by a hash of the id (of a line, 2,000 characters at most teach;
    scanning reads whole lines)."""
    texts = docs.filter("text is not null")
    total = texts.count()
    share = int(RESOLUTION * min(1.0, background / max(total, 1)))
    lines = F.split("text", "\n")
    middle = F.element_at(lines, F.floor(F.size(lines) / 2 + 1).cast("int"))
    sample = texts.filter(
        F.pmod(F.xxhash64(F.lit("license"), "doc_id"), F.lit(RESOLUTION)) < share
    ).select(F.substring(middle, 1, 2000).alias("line"))
    return fit(sorted(r["line"] for r in sample.collect()))


ADDED = StructType([
    StructField("n_paragraphs", LongType()),
    StructField("family", StringType()),
    StructField("licenses", ArrayType(StructType([
        StructField("paragraph", IntegerType()), StructField("family", StringType()),
        StructField("probability", DoubleType()), StructField("similarity", DoubleType()),
        StructField("confirmed", BooleanType()),
    ]))),
])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_paragraphs`` (lines with a word),
    ``licenses`` (paragraph number from 0, family, probability, similarity, confirmed; all
    paragraphs that are not unknown; an SPDX expression of several families has an item of each) and ``family``, that of the confirmed paragraph with the
    highest probability (ties: the first), null without one. Null and empty texts have no
    paragraphs. Columns of these names are replaced."""
    batch_rows(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("text", *ADDED.names)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts, families, found = [], [], []
            for text in column(batch, "text").to_pylist():
                rows, number = [], 0
                for line in (text or "").split("\n"):
                    if not WORD.search(line):
                        continue
                    family, chance, alike, sure = classify(line, model)
                    if family != UNKNOWN:
                        for each in tagged(line) or [family]:
                            rows.append({
                                "paragraph": number, "family": each, "probability": chance,
                                "similarity": alike, "confirmed": sure,
                            })
                    number += 1
                sure = [r for r in rows if r["confirmed"]]
                counts.append(number)
                families.append(max(sure, key=lambda r: r["probability"])["family"] if sure else None)
                found.append(rows)
            item = pa.struct([
                ("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                ("similarity", pa.float64()), ("confirmed", pa.bool_()),
            ])
            yield pa.RecordBatch.from_arrays(
                [
                    *[column(batch, f.name) for f in kept], pa.array(counts, pa.int64()),
                    pa.array(families, pa.string()), pa.array(found, pa.list_(item)),
                ],
                [*[f.name for f in kept], *ADDED.names],
            )

    return docs.select(*[f.name for f in kept], "text").mapInArrow(
        run, StructType([*kept, *ADDED.fields])
    )
