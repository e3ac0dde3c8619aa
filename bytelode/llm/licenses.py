"""License scans: a trained classifier of paragraphs, and templates that confirm what it says.

Paragraphs are separated by blank lines, so wrapped lines stay together. A paragraph of more than ``WINDOW`` words is
read in overlapping windows of as many, so that a notice is found whatever surrounds it. Every such piece is scored by a
multinomial logistic regression over its distinct word 1- to 3-grams; classes are licence families and "unknown".

Training texts are made from the fixed values below: sentences of a family, whole, cut and disturbed; grants, put
together from a verb and one of a family's names; and, as "unknown", sentences that use the same words and grants of
other licences. The scores' temperature is fitted on texts whose verbs, names and other licences training hasn't seen.

Templates confirm a family by name: all of one of its names is in the piece; or by wording: half of one of its
sentences' items is, or half of the piece's items are in its sentences, and no other family's name is there. (Items are
bigrams that aren't function words only, and names of one word.) A piece shows the families that wording confirms of at
least ``THRESHOLD`` chance, and those that names confirm of at least ``LEAST``, if all together have ``THRESHOLD``; so a
text under two licences shows both. All other pieces are unknown.

A piece without any item of a template can't be confirmed, whatever its score; such pieces are left out before
scoring, which changes no result (tests score all of them). Training runs on the driver, on the fixed values only.
Scoring uses DataFrame and SQL functions only; equal pieces are scored once. Weights and items are broadcast tables of at
most ``MAX_FEATURES`` rows and of the fixed values' items.

Null and empty texts have no paragraphs. Each row gets a row; rows of equal texts show the same. Other columns are left
out.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, table, tuned, written

MAX_FEATURES, THRESHOLD, LEAST, CONFIRM = 4096, 0.7, 0.2, 0.5
#: Words in a window, and from one to the next.
WINDOW, STEP = 40, 20
UNKNOWN = "unknown"
#: A word: letters and digits, all characters beyond ASCII among them, also around inner dots, hyphens and pluses.
_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = rf"{_CHAR}+(?:[.\-+]{_CHAR}+)*"
BLANK_LINES = r"\n[\x20\x09\x0B-\x0D]*\n"

# Names and wording of public licences.
NAMES = {
    "MIT": ["MIT license", "MIT licence", "under MIT", "under the MIT", "identifier MIT", "license MIT", "Expat license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, Version 2", "Apache Software License 2.0", "version 2.0 of the Apache License", "Apache 2.0", "Apache-2.0", "ASL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2", "GNU General Public License v2.0", "version 2 of the GNU General Public License", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPL v2", "GPL 2.0", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3", "GNU General Public License v3.0", "version 3 of the GNU General Public License", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPL v3", "GPL 3.0", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0", "Affero General Public License version 3", "version 3 of the GNU Affero General Public License", "GNU AGPL v3", "AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU Affero General Public License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "version 2.1 of the GNU Lesser General Public License", "GNU LGPL version 2.1", "LGPL 2.1", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0", "version 3 of the GNU Lesser General Public License", "GNU LGPL version 3", "LGPL 3.0", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause", "two clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause", "three clause BSD license"],
    "ISC": ["ISC License", "ISC licence", "under ISC", "identifier ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "Mozilla Public License 2.0", "version 2.0 of the Mozilla Public License", "MPL 2.0", "MPLv2", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License 2.0", "EPL 2.0", "EPLv2", "EPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0 1.0 Universal"],
    "Unlicense": ["The Unlicense", "under the Unlicense", "identifier Unlicense"],
}
TEMPLATES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided \"AS IS\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ],
    "Apache-2.0": [
        "You may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": [
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ],
    "LGPL-2.1": [
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU Lesser General Public License for more details.",
    ],
    "BSD-2-Clause": [],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"AS IS\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages however caused and on any theory of liability.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"AS IS\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CC-BY-4.0": ["To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA-4.0": ["To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC-4.0": ["To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/"],
    "CC-BY-NC-SA-4.0": ["To view a copy of this license, visit https://creativecommons.org/licenses/by-nc-sa/4.0/"],
    "CC-BY-ND-4.0": ["To view a copy of this license, visit https://creativecommons.org/licenses/by-nd/4.0/"],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to http://unlicense.org/",
    ],
}
#: Names that are part of other families' wording, so that their presence speaks against none.
GENERAL = ("GPL", "LGPL")
VERBS = ["licensed under the", "released under the", "available under the terms of the", "distributed under the", "is covered by the", "this project is licensed under the terms of the", "SPDX-License-Identifier:", "this work is licensed under the", "published under the", "license:", "you may copy it under the", "made available under the", "it is licensed under"]
#: Grants of these are "unknown".
OTHER_NAMES = ["Artistic License 2.0", "Boost Software License 1.0", "Common Development and Distribution License 1.1", "Microsoft Public License", "European Union Public Licence 1.2", "zlib License", "SIL Open Font License 1.1", "PostgreSQL License", "Academic Free License 3.0", "Open Data Commons Attribution License", "Apache License 1.1", "Mozilla Public License 1.1", "GNU Free Documentation License 1.3", "CC BY 3.0", "BSD 4-Clause License", "Python Software Foundation License 2.0", "Eclipse Public License 1.0", "terms of our customer agreement", "Business Source License 1.1", "Server Side Public License"]
#: Sentences with the same words that grant nothing.
OTHER = [
    "He had lost his driving licence and could not rent a car.",
    "The bar had its licence renewed by the town council last year.",
    "The teacher gave them permission to leave the room early.",
    "Poetic license lets a writer bend the rules of grammar.",
    "The copyright office moved to a larger building in the city.",
    "Copyright 2019 the authors. All rights reserved.",
    "The warranty on the washing machine had run out by then.",
    "A search warrant was issued by the judge on Monday.",
    "The state redistributed land to small farmers.",
    "Without permission from the museum no photographs may be taken.",
    "The region is known for its free software community and its public library.",
    "Version 2.0 of the report was published in the general public interest.",
    "Version 3 of the program runs on any kind of machine and is free of charge for students.",
    "The foundation offers creative courses and common rooms for students.",
    "A fishing license is needed from March to October.",
    "Our guide explains how to choose a licence for a public work.",
    "The warranty covers parts and labour under normal use.",
    "You may not use this file to store your own copies of the course notes.",
    "She studied at MIT and later flew an Apache in the army.",
    "In no event shall the club be liable for lost property of members.",
]
FAMILIES = (*NAMES, UNKNOWN)
FUNCTION_WORDS = frozenset("a all an and any are as at be but by do for from have in is it no not of on or so that the this to with you".split())


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams_of(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def is_item(bigram: str) -> bool:
    return not set(bigram.split()) <= FUNCTION_WORDS


def items_of(text: str) -> list[str]:
    """The items of a name or sentence."""
    words = words_of(text)
    return sorted(filter(is_item, ngrams_of(words, (2,)))) if len(words) > 1 else words


@lru_cache(1)
def templates() -> list[tuple[str, bool, list[str]]]:
    """(family, whether it is a name, items)."""
    names = [(family, True, items_of(x)) for family, own in NAMES.items() for x in own]
    return names + [(family, False, items_of(x)) for family, own in TEMPLATES.items() for x in own]


@lru_cache(1)
def all_items() -> list[str]:
    return sorted({i for *_, items in templates() for i in items})


def examples(seed: int) -> tuple[list[list[str]], np.ndarray]:
    """Texts as words, and their classes. Even seeds take verbs, names and other licences that odd ones leave out."""
    rng = np.random.default_rng(seed)
    side = seed % 2
    prose = [w for s in OTHER for w in words_of(s)]
    texts, classes = [], []

    def add(words: list[str], c: int) -> None:
        texts.append(words)
        classes.append(c)

    def some_prose() -> list[str]:
        at = int(rng.integers(0, len(prose) - 12))
        return prose[at : at + int(rng.integers(0, 12))]

    verbs = [v for k, v in enumerate(VERBS) if k % 3 != 2 - side]
    for c, family in enumerate(FAMILIES):
        if family == UNKNOWN:
            sentences, names, each, extra = OTHER, [n for k, n in enumerate(OTHER_NAMES) if k % 2 == side], 16, 6
        else:
            sentences, names = TEMPLATES[family], [n for k, n in enumerate(NAMES[family]) if len(NAMES[family]) < 6 or k % 4 != 1 + 2 * side]
            each, extra = 14, max(3, 60 // len(names))
        for sentence in sentences:
            words = words_of(sentence)
            # every part of a long sentence, and then parts at random
            for at in range(0, len(words) - 8, 5):
                add(words[at : at + 14], c)
            for k in range(each):
                own = list(words)
                if k and len(own) > 8:
                    at = int(rng.integers(0, len(own) - 6))
                    own = own[at : at + int(rng.integers(6, len(own) - at + 1))]
                for _ in range(k % 3):
                    own.insert(int(rng.integers(0, len(own) + 1)), str(rng.choice(prose)))
                add(own[:WINDOW] if k % 2 else own, c)
        for name in names:
            for k in range(extra):
                own = words_of(str(rng.choice(verbs))) + words_of(name)
                add(own if k % 3 == 0 else some_prose() + own + some_prose(), c)
    for _ in range(400):
        add([str(rng.choice(prose)) for _ in range(int(rng.integers(3, 40)))], len(FAMILIES) - 1)
    return texts, np.array(classes)


class Model:
    """Weights (features by classes), biases and temperature."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.features, self.weights, self.bias, self.temperature = features, weights, bias, temperature

    def chances(self, words: list[str]) -> np.ndarray:
        at = {f: i for i, f in enumerate(self.features)}
        own = [at[g] for g in sorted(ngrams_of(words)) if g in at]
        score = (self.bias + self.weights[own].sum(0)) / self.temperature
        e = np.exp(score - score.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(2)
def train(seed: int = 6, steps: int = 250, rate: float = 5.0, decay: float = 1e-3) -> Model:
    texts, y = examples(seed)
    grams = [sorted(ngrams_of(t)) for t in texts]
    names, counts = np.unique([g for own in grams for g in own], return_counts=True)
    # what the fixed values say comes first, then what joins their parts
    said = {g for x in [*OTHER, *(t for own in (*TEMPLATES.values(), *NAMES.values()) for t in own)] for g in ngrams_of(words_of(x))}
    order = np.lexsort((-counts, [g not in said for g in names.tolist()]))
    features = names[order][:MAX_FEATURES].tolist()
    at = {f: i for i, f in enumerate(features)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(features)), np.float32)
        for i, own in enumerate(rows):
            x[i, [at[g] for g in own if g in at]] = 1
        return x

    x, one = matrix(grams), np.eye(len(FAMILIES), dtype=np.float32)
    w, b = np.zeros((len(features), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    share = 1 / np.bincount(y, minlength=len(FAMILIES))[y]
    share = (share / share.sum())[:, None].astype(np.float32)
    for _ in range(steps):
        gap = (_softmax(x @ w + b) - one[y]) * share
        w -= rate * (x.T @ gap + decay * w)
        b -= rate / 10 * gap.sum(0)
    held, held_y = examples(seed + 1)
    z = matrix([sorted(ngrams_of(t)) for t in held]) @ w + b
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(held_y)), held_y] + 1e-12).mean() for t in np.geomspace(0.1, 4, 40)}
    return Model(features, np.round(w.astype(np.float64), 6), np.round(b.astype(np.float64), 6), round(float(min(loss, key=loss.get)), 6))


def ngrams_column(words: Column, n: int) -> Column:
    """The n-grams of an array of words. (No lambda here reads the array from outside: if that is an expression, it would
    be evaluated anew for each element.)"""
    if n == 1:
        return words
    left = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(ngrams_column(words, n - 1), 1, left), F.slice(words, n, left), lambda a, b: F.concat(a, F.lit(" "), b))


def has_item(words: Column) -> Column:
    """Whether a template's item is among the words and bigrams; the longest word of each is asked for first, which is cheap."""
    items = all_items()
    parts = sorted({max(set(i.split()) - FUNCTION_WORDS, key=lambda w: (len(w), w)) for i in items})
    singles = [i for i in items if " " not in i]
    return F.exists(words, lambda w: w.isin(parts)) & (F.exists(words, lambda w: w.isin(singles)) | F.exists(ngrams_column(words, 2), lambda g: g.isin(items)))


def windows(words: Column) -> Column:
    """The windows of an array of words that have an item."""
    none = F.array().cast("array<array<string>>")

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / STEP), F.lit(0)).cast("int"))
        return F.when(has_item(w), F.filter(F.transform(starts, lambda i: F.slice(w, i * STEP + 1, WINDOW)), has_item)).otherwise(none)

    # the lambda's variable holds the words, whatever expression they come from
    return F.flatten(F.transform(F.array(words), of))


def pieces(docs: DataFrame, text_col: str) -> DataFrame:
    """(digest, paragraph, piece) of pieces that a template could confirm; piece: its words, joined by one space."""
    blocks = docs.select(F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"), F.posexplode(F.split(text_col, BLANK_LINES)).alias("paragraph", "block"))
    found = blocks.select("digest", "paragraph", F.explode(windows(F.regexp_extract_all(F.lower("block"), F.lit(WORD), 0))).alias("window"))
    return found.select("digest", "paragraph", F.array_join("window", " ").alias("piece")).distinct()


def confirmed_families(grams: DataFrame) -> DataFrame:
    """(piece, confirmed): the families that templates confirm, and whether by name. grams: (piece, n_items, gram), items of distinct pieces."""
    spark = grams.sparkSession
    rows = [(item, k, c, name, len(items) if name else math.ceil(CONFIRM * len(items))) for k, (family, name, items) in enumerate(templates()) for c in [FAMILIES.index(family)] for item in items]
    # a row for each item of each template: fixed values
    known = spark.createDataFrame(rows, "gram string, template int, family int, is_name boolean, need int")
    hits = grams.join(F.broadcast(known), "gram")
    by_template = hits.groupBy("piece", "n_items", "template", "family", "is_name", "need").agg(F.collect_set("gram").alias("own"))
    full = F.size("own") >= F.col("need")
    by_family = by_template.groupBy("piece", "n_items", "family").agg(F.bool_or(full & F.col("is_name")).alias("named"), F.bool_or(full & ~F.col("is_name")).alias("half"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("is_name"), F.col("own")))))).alias("shared"))
    worded = F.col("half") | (F.col("shared") >= CONFIRM * F.col("n_items"))
    general = [FAMILIES.index(f) for f in GENERAL]
    by_family = by_family.select("piece", F.struct("family", "named", worded.alias("worded")).alias("f"))
    listed = by_family.groupBy("piece").agg(F.collect_list("f").alias("all"))
    named = F.filter("all", lambda f: f["named"] & ~f["family"].isin(general))
    stands = F.filter("all", lambda f: f["named"] | (f["worded"] & ~F.exists(F.col("names"), lambda o: o["family"] != f["family"])))
    return listed.withColumn("names", named).select("piece", F.transform(stands, lambda f: F.struct(f["family"].alias("family"), f["named"].alias("named"))).alias("confirmed"))


def scored(distinct: DataFrame) -> DataFrame:
    """(piece, chances, confirmed) of distinct pieces: the chance of each class, and the confirmed classes."""
    spark, model = distinct.sparkSession, train()
    words = F.split("piece", " ")
    items, features = all_items(), model.features
    singles, pairs = F.filter(words, lambda w: w.isin(items)), F.array_distinct(ngrams_column(words, 2))
    n_items = F.size(F.filter(pairs, lambda g: ~(F.split(g, " ")[0].isin(*FUNCTION_WORDS) & F.split(g, " ")[1].isin(*FUNCTION_WORDS))))
    own_items = F.array_distinct(F.concat(singles, F.filter(pairs, lambda g: g.isin(items))))
    confirmed = confirmed_families(distinct.select("piece", n_items.alias("n_items"), F.explode(own_items).alias("gram")))
    weights = spark.createDataFrame(list(zip(features, model.weights.tolist(), strict=True)), "gram string, weight array<double>")
    known = F.filter(F.array_distinct(F.concat(words, ngrams_column(words, 2), ngrams_column(words, 3))), lambda g: g.isin(features))
    grams = distinct.select("piece", F.explode_outer(known).alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = grams.groupBy("piece").agg(*(F.sum(F.coalesce(F.col("weight")[c], F.lit(0.0))).alias(f"s{c}") for c in range(len(FAMILIES))))
    z = F.array(*(F.round((F.col(f"s{c}") + float(model.bias[c])) / model.temperature, 6) for c in range(len(FAMILIES))))
    powers = sums.select("piece", z.alias("z")).select("piece", F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    chances = powers.select("piece", F.transform("e", lambda v: F.round(v / total, 6)).alias("chances"))
    return chances.join(confirmed, "piece", "left")


def shown(distinct: DataFrame) -> DataFrame:
    """(piece, families): (family, chance) of the families that a piece shows; none is unknown."""
    enough = F.filter("confirmed", lambda c: F.get("chances", c["family"]) >= F.when(c["named"], LEAST).otherwise(THRESHOLD))
    sure = F.transform(F.coalesce(enough, F.array().cast("array<struct<family: int, named: boolean>>")), lambda c: c["family"])
    total = F.aggregate("sure", F.lit(0.0), lambda a, c: a + F.get("chances", c))
    names = F.array(*map(F.lit, FAMILIES))
    found = F.transform("sure", lambda c: F.struct(F.get(names, c).alias("family"), F.get("chances", c).alias("chance")))
    return scored(distinct).withColumn("sure", sure).where(total >= THRESHOLD).select("piece", found.alias("families"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, paragraph, family, chance), written: the families of paragraphs, counted from 0, of texts named by SHA-256."""
    tuned(docs.sparkSession)
    own = written(pieces(docs, text_col), "license-pieces", compact=True)
    known = written(shown(own.select("piece").distinct()), "license-families", compact=True)
    found = own.join(known, "piece").select("digest", "paragraph", F.explode("families").alias("f"))
    out = written(found.groupBy("digest", "paragraph", F.col("f.family").alias("family")).agg(F.max("f.chance").alias("chance")), "licenses", compact=True)
    forget(own, known)
    return out


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as (id_col, n_paragraphs, n_licensed, families): paragraphs with a word, those that show a
    licence, and the sorted names, comma-joined."""
    found = scan(docs, text_col).groupBy("digest").agg(F.count_distinct("paragraph").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    n = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), BLANK_LINES), lambda x: x.rlike(_CHAR))).cast("long")
    own = docs.select(F.col(id_col), n.alias("n_paragraphs"), F.sha2(F.col(text_col).cast("binary"), 256).alias("__own"))
    return own.join(found, F.col("__own") == F.col("digest"), "left").select(id_col, "n_paragraphs", F.coalesce("n_licensed", F.lit(0).cast("long")).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
