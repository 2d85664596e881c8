"""Licence notices: a trained n-gram classifier over paragraphs, confirmed by templates.

Fitting looks at the templates below only and runs on the driver. The scan uses
DataFrame functions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.llm.common import Staging, texts_of

UNKNOWN = "unknown"

#: How each family is named, and sentences of its notices.
NAMES = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"),
    "bsd": ("BSD License", "3-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "cc-by-nc": (
        "CC BY-NC 4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International License",
        "CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International License",
        "CC-BY-SA-4.0",
    ),
    "cc0": ("CC0 1.0 Universal", "CC0 public domain dedication", "CC0-1.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GPLv2", "GPL-2.0"),
    "gpl-3.0": ("GNU General Public License, version 3", "GPLv3", "GPL-3.0"),
    "isc": ("ISC License",),
    "lgpl": ("GNU Lesser General Public License", "LGPLv3", "LGPL-2.1"),
    "mit": ("MIT License", "The MIT License (MIT)", "Expat License"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
NOTICES = {
    "agpl-3.0": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "cc0": (
        "has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain",
    ),
    "gpl-2.0": (
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "gpl-3.0": (
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ),
}
#: How a notice names its licence.
FRAMES = (
    "{}", "Licensed under the {}.", "Released under the {}.", "Licensed under {}.",
    "This work is licensed under the {}.", "Distributed under the terms of the {}.",
    "SPDX-License-Identifier: {}", "This software is available under the {}",
)
#: The same words where no known licence is meant.
OTHERS = (
    "You need a driving license to rent a car",
    "The license plate of the car was stolen",
    "a fishing license can be bought at the counter",
    "He holds a degree from MIT and a pilot license",
    "students of MIT built the robot",
    "the Apache helicopter landed near the town",
    "Apache web server version 2 was released in 2002",
    "the general public was not admitted",
    "the software is released every month",
    "All rights reserved. Copyright of the respective owners",
    "Copyright 2019 the authors. All rights reserved.",
    "No part of this publication may be reproduced without permission of the publisher",
    "This product comes with a two year warranty",
    "the warranty does not cover water damage",
    "use of this site is subject to the terms of service and the privacy policy",
    "you may not copy or distribute this material without written permission",
    "permission to enter the building was granted",
    "the terms of the contract were published in the gazette",
    "Licensed under the terms of the proprietary company license agreement",
    "Released under the custom license of the project",
    "Licensed under a private agreement, version 2.0.",
    "the foundation published a free version of the book",
    "the public domain contains works whose copyright has expired",
    "bank license revoked by the national authority, version 3 of the report",
    "the creative director of the commons gallery",
    "the source and the binary star in the northern sky",
    "conditions of use and redistribution of wealth",
    "cc the manager by mail at 4.0 pm",
    "software engineer with gnu make experience",
    "mozilla released a new browser",
)
#: A feature holds at least one of these words, so a paragraph without any has no feature.
ANCHORS = frozenset(
    "affero agpl agplv3 apache attribution bsd cc cc0 commons copies copyright creative "
    "derived disclaimer distributed expat fsf gnu gpl gplv2 gplv3 isc lgpl lgplv3 licence "
    "licenced license licensed licenses mit modify mozilla mpl noncommercial permission permitted "
    "redistribution redistributions released restriction sharealike software spdx sublicense "
    "unencumbered unlicense waived warranties".split()
)
LONGEST_GRAM = 3
#: Words of a window of a long line, and from the start of one to that of the next.
WIDTH, STEP = 64, 32


@dataclass(frozen=True)
class Fitting:
    """Strength of the penalty, steps of the fit, and the share of examples for calibration."""

    penalty: float = 0.02
    steps: int = 400
    rate: float = 2.0
    calibration: int = 5


@dataclass(frozen=True)
class LicenceModel:
    """Weights of the n-grams for each family, and the templates that hold each n-gram."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    templates: dict[str, tuple[int, ...]]
    template_families: tuple[str, ...]
    template_sizes: tuple[int, ...]


def words_of(text: str) -> list[str]:
    low = text.lower()
    return "".join(c if c.isascii() and c.isalnum() else " " for c in low).split()


def grams_of(text: str) -> list[str]:
    """Different runs of one to three words."""
    words = words_of(text)
    runs = (
        " ".join(words[i : i + n])
        for n in range(1, LONGEST_GRAM + 1)
        for i in range(len(words) - n + 1)
    )
    return list(dict.fromkeys(runs))


def _anchored(gram: str) -> bool:
    return not ANCHORS.isdisjoint(gram.split())


def _templates() -> Iterator[tuple[str, str]]:
    for family, names in NAMES.items():
        for name in names:
            yield family, name
    for family, notices in NOTICES.items():
        for notice in notices:
            yield family, notice


def _examples() -> list[tuple[str, str]]:
    """Labelled paragraphs: names in frames, notices and lines of them, and others."""
    found = [(f, frame.format(n)) for f, names in NAMES.items() for n in names for frame in FRAMES]
    for family, notices in NOTICES.items():
        for notice in notices:
            words = notice.split()
            found.append((family, notice))
            for width in (8, 14):
                for start in range(0, max(1, len(words) - width // 2), width // 2):
                    line = " ".join(words[start : start + width])
                    shared = any(line in n for f, ns in NOTICES.items() if f != family for n in ns)
                    found.append((UNKNOWN if shared else family, line))
    found += [(UNKNOWN, text) for text in OTHERS for _ in range(3)]
    return found


@cache
def fit(fitting: Fitting = Fitting()) -> LicenceModel:
    """Softmax regression on the n-grams with an anchor, and its temperature."""
    templates = list(_templates())
    examples = _examples()
    families = (*sorted(NAMES), UNKNOWN)
    grams = sorted({g for _, t in (*templates, *examples) for g in grams_of(t) if _anchored(g)})
    column = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(examples), len(grams) + 1))
    x[:, -1] = 1
    y = np.zeros((len(examples), len(families)))
    for i, (family, text) in enumerate(examples):
        x[i, [column[g] for g in grams_of(text) if g in column]] = 1
        y[i, families.index(family)] = 1
    held = np.arange(len(examples)) % fitting.calibration == 0
    # A rare family counts as much as a frequent one.
    share = 1 / np.maximum(1, y.sum(axis=0))
    theta = _softmax_fit(x[~held], y[~held], share, fitting)
    temperature = _temperature(x[held] @ theta, y[held])
    theta = _softmax_fit(x, y, share, fitting)
    held_by: dict[str, list[int]] = {}
    sizes = []
    for i, (_, text) in enumerate(templates):
        own = [g for g in grams_of(text) if g in column]
        sizes.append(len(own))
        for g in own:
            held_by.setdefault(g, []).append(i)
    return LicenceModel(
        families,
        {g: tuple(np.round(theta[i], 5).tolist()) for g, i in column.items()},
        tuple(np.round(theta[-1], 5).tolist()),
        temperature,
        {g: tuple(t) for g, t in held_by.items()},
        tuple(f for f, _ in templates),
        tuple(sizes),
    )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, fitting: Fitting) -> np.ndarray:
    theta = np.zeros((x.shape[1], y.shape[1]))
    weight = (y @ share)[:, None]
    weight = weight / weight.mean()
    for _ in range(fitting.steps):
        slope = x.T @ (weight * (y - _softmax(x @ theta))) / len(x)
        theta += fitting.rate * (slope - fitting.penalty / len(x) * theta)
    return theta


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor under which the held-out examples are likeliest."""
    tried = [math.exp(t) for t in np.linspace(-1.5, 1.5, 61)]
    return min(tried, key=lambda t: -float((y * np.log(_softmax(z / t) + 1e-12)).sum()))


def find_licences(
    docs: DataFrame,
    least_probability: float = 0.5,
    least_similarity: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: LicenceModel | None = None,
) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity`` of each licence notice.

    A paragraph is a line; lines count from 0. Its n-grams are joined to the model's,
    a table of a fixed few thousand rows; their weights give the likeliest family and
    its probability, or the unknown class. A prediction holds if it is confirmed by a
    template of the family: by the share of common n-grams in the smaller of both.
    A long line is judged in overlapping windows of ``WIDTH`` words, and equal families
    of a line are one row. Where a family is found, the n-grams of its templates are set
    aside and the rest is judged again, until nothing more is found.

    Null and empty texts hold no notice. Rows without id and repeated rows are
    scanned like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = model or fit()
    anchored = f"(?<![a-z0-9])({'|'.join(sorted(ANCHORS))})(?![a-z0-9])"
    low = texts_of(docs, id_col, text_col).withColumn("text", F.lower("text"))
    lines = (
        low.where(F.col("text").rlike(anchored))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
        .where(F.col("line").rlike(anchored))
    )
    words = F.filter(F.split("line", "[^a-z0-9]+"), lambda w: w != "")
    staging = Staging(spark, "licences")
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - WIDTH) / STEP).cast("int") * STEP)
    starts = F.sequence(F.lit(0), last, F.lit(STEP))
    windows = F.transform(starts, lambda i: F.slice("words", i + 1, WIDTH))
    number = F.monotonically_increasing_id()  # written down, so it stays what it is
    anchors = F.array(*[F.lit(a) for a in sorted(ANCHORS)])
    numbered = staging.keep(
        lines.select(number.alias("line"), "doc_id", "paragraph", words.alias("words"))
        .select("line", "doc_id", "paragraph", F.explode(windows).alias("words"))
        .where(F.arrays_overlap("words", anchors))
        .select(number.alias("row"), "line", "doc_id", "paragraph", "words")
    )
    # Staged as well, so that its rows do not stand in every plan.
    table = staging.keep(_table(spark, model))
    rows = numbered.select("row", "words", F.array().cast("array<string>").alias("gone"))
    found: list[DataFrame] = []
    while True:
        confirmed = _confirmed(rows, table, model, least_probability, least_similarity, staging)
        found.append(confirmed)
        if confirmed.isEmpty():
            break
        gone = F.concat("gone", F.array("family"))
        rows = staging.keep(
            rows.join(confirmed.select("row", "family"), "row").select("row", "words", gone.alias("gone"))
        )
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    best = (
        numbered.select("row", "line", "doc_id", "paragraph")
        .join(everything, "row")
        .groupBy("line", "doc_id", "paragraph", "family")
        .agg(F.max(F.struct("probability", "similarity")).alias("best"))
    )
    return staging.finish(
        best.select(
            "doc_id",
            "paragraph",
            "family",
            F.round("best.probability", 6).alias("probability"),
            F.round("best.similarity", 6).alias("similarity"),
        )
    )


def _confirmed(
    rows: DataFrame,
    table: DataFrame,
    model: LicenceModel,
    least_probability: float,
    least_similarity: float,
    staging: Staging,
) -> DataFrame:
    """The likeliest family of each row without n-grams of the families that are ``gone``, if a template confirms it."""
    hits = rows.select("row", "gone", F.explode(_grams(F.col("words"))).alias("gram")).join(
        F.broadcast(table), "gram"
    )
    named = F.array(*[F.lit(f) for f in model.template_families])
    fresh = ~F.arrays_overlap(F.transform("templates", lambda t: F.get(named, t)), "gone")
    fresh = F.coalesce(fresh, F.lit(True))
    sums = F.array(
        *[F.sum(F.when(fresh, F.get("weights", F.lit(i)))) for i in range(len(model.families))]
    )
    bias = F.array(*[F.lit(b) for b in model.bias])
    logits = F.zip_with("sums", bias, lambda w, b: (w + b) / model.temperature)
    scores = staging.keep(
        hits.groupBy("row")
        .agg(F.count("*").alias("size"), F.count_if(fresh).alias("fresh"), sums.alias("sums"))
        .where("fresh > 0")
        .select("row", "size", logits.alias("logits"))
    )
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda sum_, z: sum_ + F.exp(z - F.array_max("logits")))
    families = F.array(*[F.lit(f) for f in model.families])
    likely = scores.select(
        "row",
        "size",
        F.get(families, (F.array_position("logits", top) - 1).cast("int")).alias("family"),
        (1 / total).alias("probability"),
    ).where((F.col("family") != UNKNOWN) & (F.col("probability") >= least_probability))
    # Not named again: a family that is gone keeps the probability it was found with.
    likely = likely.join(rows.select("row", "gone"), "row").where(~F.array_contains("gone", F.col("family")))
    matched = hits.select("row", F.explode("templates").alias("template")).groupBy("row", "template")
    sizes = F.array(*[F.lit(s) for s in model.template_sizes])
    common = matched.agg(F.count("*").alias("common")).select(
        "row",
        "common",
        F.get(named, F.col("template")).alias("family"),
        F.get(sizes, F.col("template")).alias("template_size"),
    )
    similarity = F.max(F.col("common") / F.least("size", "template_size"))
    return staging.keep(
        likely.join(common, ["row", "family"])
        .groupBy("row", "family", "probability")
        .agg(similarity.alias("similarity"))
        .where(F.col("similarity") >= least_similarity)
    )


def _grams(words: Column) -> Column:
    runs = [words]
    for n in range(2, LONGEST_GRAM + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        grams = F.transform(starts, _run_from(words, n))
        runs.append(F.coalesce(grams, F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*runs))


def _run_from(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def _table(spark: SparkSession, model: LicenceModel) -> DataFrame:
    rows = [(g, list(w), list(model.templates.get(g, ()))) for g, w in model.weights.items()]
    return spark.createDataFrame(rows, "gram string, weights array<double>, templates array<int>")
