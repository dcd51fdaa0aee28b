"""Licence notices: a sparse word n-gram classifier whose findings templates confirm.

A notice is a line or a run of consecutive lines, as in wrapped text. Softmax regression on words and word pairs tells the licence families and an unknown class; its
chances are calibrated by a temperature on held-out rows. A finding counts if its chance reaches
a threshold and a template of the same family shares enough of its word pairs with the notice.
SPDX lines name their licences by identifier; they are read as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import FOLDED, STEP, Spans, buffer_of, mix, pieces, word_hashes, word_spans

# Short notices, and the paragraphs of the standard notices. What several families share
# word for word (the warranty of MIT and the Unlicense, that of the GNU licences) tells none of them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS 'AS IS' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
OTHER = [
    "You need a valid driving licence to rent a car.", "The software is released every month.",
    "She was granted permission to leave.", "The public library is open to all.",
    "This work was done under the general manager.", "Version 2.0 of the report is out.", "The terms of the contract were clear.",
]
SPDX = re.compile(rb"SPDX-License-Identifier:([^\r\n]*)", re.I)
# Identifiers without -only, -or-later and +, in lower case.
SPDX_IDS = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-3.0": "GPL-3.0", "gpl-2.0": "GPL-2.0", "lgpl-2.0": "LGPL", "lgpl-2.1": "LGPL",
    "lgpl-3.0": "LGPL", "agpl-3.0": "AGPL-3.0", "bsd-1-clause": "BSD", "bsd-2-clause": "BSD", "bsd-3-clause": "BSD",
    "bsd-4-clause": "BSD", "mpl-2.0": "MPL-2.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0",
    "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc0-1.0": "CC0-1.0", "unlicense": "Unlicense",
}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
SAMPLE_LINES = 3000  # most document lines that serve as rows of the unknown class
SAMPLE_DOCS = 500  # documents these lines come from
VARIANTS = 60  # altered copies of each template
LEAST_CHANCE = 0.5
LEAST_SHARED = 0.6  # of a template's word pairs that a notice must have
SPREAD = 1.5  # times the pairs of a template, and 10 words: the most that a notice of several lines spans

FOUND = "doc_id bigint, n_paragraphs bigint, n_licensed bigint, licence string, licences string, probability double"


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with their text, and word pairs with their text, as hashes."""
    words, first = word_hashes(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.flatnonzero(text[1:] == text[:-1]) if len(text) else text
    return words, text, mix(words[at] * STEP[0] + words[at + 1] * STEP[1]), text[at]


def distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted by row and feature."""
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
    return rows[new], features[new]


def of_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each line, with its number, sorted by it; and the pairs alone as such."""
    data, offsets = buffer_of(pa.array(lines, pa.string()))
    words, w_text, pairs, p_text = grams(data, offsets)
    rows, features = distinct(np.concatenate([w_text, p_text]), np.concatenate([words, pairs]))
    return rows, features, [np.unique(pairs[p_text == i]) for i in range(len(lines))]


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # feature by family; the last row is the bias
    temperature: float
    pairs: np.ndarray  # sorted hashes of all word pairs of templates
    templates: list[tuple[int, np.ndarray]]  # family and sorted word pairs

    def chances(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        known = self.features[place] == features
        return softmax(logits(rows[known], place[known], n, self.weights) / self.temperature)


def logits(rows: np.ndarray, places: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Row sums of weights, scaled by the root of a row's features, plus the bias."""
    out = np.zeros((n, weights.shape[1]))
    if len(rows):
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[begin]] = np.add.reduceat(weights[places], begin, axis=0)
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))[:, None]
    return out / size + weights[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def variants(line: str, words: np.ndarray, rng: np.random.Generator) -> Iterator[str]:
    """The line, and copies with words dropped, replaced or added around it."""
    yield line
    own = line.split()
    for _ in range(VARIANTS):
        kept = [w if rng.random() > 0.05 else str(rng.choice(words)) for w in own if rng.random() > 0.04]
        lead = rng.choice(words, rng.integers(0, 4)).tolist()
        tail = rng.choice(words, rng.integers(0, 6)).tolist()
        yield " ".join([*lead, *kept, *tail])


def fit(lines: list[str], steps: int = 100, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Fit on altered templates and on lines that share under a third of any template's pairs."""
    rng = np.random.default_rng(11)
    flat = [(FAMILIES.index(family), text) for family, texts in TEMPLATES.items() for text in texts]
    _, _, template_pairs = of_lines([text for _, text in flat])
    templates = [(family, pairs) for (family, _), pairs in zip(flat, template_pairs)]
    everything = np.unique(np.concatenate(template_pairs))
    _, _, pairs_of = of_lines(lines) if lines else (None, None, [])
    pairs_of = [p[np.isin(p, everything)] for p in pairs_of]
    other = [line for line, p in zip(lines, pairs_of) if not len(p) or all(np.isin(t, p).sum() < len(t) / 3 for t in template_pairs)]
    words = np.array([w for line in [*other[:500], *OTHER] for w in line.split()[:40]])
    texts, labels = [], []
    for family, text in flat:
        for variant in variants(text, words, rng):
            texts.append(variant)
            labels.append(family)
    telling = np.array([w for _, text in flat for w in text.split()])
    mixed = [" ".join(rng.choice(telling if i % 2 else words, rng.integers(4, 16))) for i in range(600)]
    unknown = [*other, *OTHER * 5, *mixed]
    texts += unknown
    labels += [len(FAMILIES) - 1] * len(unknown)
    y = np.array(labels)
    rows, features, _ = of_lines(texts)
    vocabulary, counts = np.unique(features, return_counts=True)
    vocabulary = vocabulary[counts > 1]
    places = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
    common = vocabulary[places] == features
    rows, places = rows[common], places[common]
    held = rng.random(len(y)) < 0.2
    weights = np.zeros((len(vocabulary) + 1, len(FAMILIES)))
    squares = np.full(weights.shape, 1e-8)
    train = np.flatnonzero(~held[rows])
    t_rows, t_places = rows[train], places[train]
    order = np.argsort(t_places, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(t_places[order]) > 0]))
    size = np.sqrt(np.maximum(np.bincount(t_rows, minlength=len(y)), 1))[:, None]
    target = np.eye(len(FAMILIES))[y]
    for _ in range(steps):
        error = softmax(logits(t_rows, t_places, len(y), weights)) - target
        error[held] = 0
        gradient = decay * weights
        gradient[t_places[order][starts]] += np.add.reduceat((error / size)[t_rows[order]], starts, axis=0) / 100
        gradient[-1] = error.sum(axis=0) / 100
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
    test = held[rows]
    z = logits(rows[test], places[test], len(y), weights)[held]
    loss = {t: -np.log(softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
    return Model(vocabulary, weights, float(min(loss, key=loss.get)), everything, templates)


def spdx_families(line: bytes) -> set[str]:
    """The families that an SPDX line names; identifiers of others say nothing."""
    said = b" ".join(SPDX.findall(line)).decode("utf-8", "replace").lower()
    return {SPDX_IDS[i] for i in (re.sub(r"(-only|-or-later|\+)$", "", w) for w in re.split(r"[\s()/,;*]+", said)) if i in SPDX_IDS}


def windows(at: np.ndarray, pairs: np.ndarray, least: float, spread: float) -> Iterator[tuple[int, int, int]]:
    """First and last place, and number of distinct pairs, of each stretch of at most `spread` words that has enough.

    Of stretches that overlap, that with the most pairs; of these the last and shortest.
    """
    counts: dict[int, int] = {}
    sizes, high = [], 0
    for low in range(len(at)):
        while high < len(at) and at[high] - at[low] <= spread:
            counts[pairs[high]] = counts.get(pairs[high], 0) + 1
            high += 1
        sizes.append(len(counts))
        counts[pairs[low]] -= 1
        if not counts[pairs[low]]:
            del counts[pairs[low]]
    low = 0
    while low < len(at):
        if sizes[low] < least:
            low += 1
            continue
        start = i = low
        while i < len(at) and at[i] - at[low] <= spread:
            start = i if sizes[i] >= sizes[start] else start
            i += 1
        own, end = set(), start
        for end in range(start, len(at)):
            own.add(pairs[end])
            if len(own) == sizes[start]:
                break
        yield at[start], at[end], len(own)
        low = end + 1


def _found(model: Model):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    seen = np.zeros(1 << 16, bool)
    seen[(model.pairs & np.uint64(0xFFFF)).astype(int)] = True
    owner = np.concatenate([np.full(len(t), i) for i, (_, t) in enumerate(model.templates)])
    owned = np.searchsorted(model.pairs, np.concatenate([t for _, t in model.templates]))
    owner, owned = owner[np.argsort(owned, kind="stable")], np.sort(owned)
    least = np.array([LEAST_SHARED * len(t) for _, t in model.templates])
    family_of = np.array([family for family, _ in model.templates])
    n_templates = len(model.templates)
    spdx = np.unique(grams(*buffer_of(pa.array(["spdx license"])))[2])

    def sharing(group: np.ndarray, template: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Group and template, as one number, where a group has enough of a template's pairs."""
        keys, _ = distinct(group * n_templates + template, pair)
        keys, n = np.unique(keys, return_counts=True)
        return keys[n >= least[keys % n_templates]]

    def regions(w_line: np.ndarray, at: np.ndarray, run: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """First line, last line, template, first word, last word and pairs of each line and run that a template confirms."""
        maybe = np.flatnonzero(seen[(pairs & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(model.pairs, pairs[maybe])
        hit = model.pairs[np.minimum(place, len(model.pairs) - 1)] == pairs[maybe]
        place, begin = place[hit], at[maybe[hit]]
        left = np.searchsorted(owned, place, "left")
        n = np.searchsorted(owned, place, "right") - left
        template = owner[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place, begin = np.repeat(place, n), np.repeat(begin, n)
        found = []
        inner = w_line[begin] == w_line[begin + 1]
        for group, single in ((np.where(inner, w_line[begin], -1), True), (run[begin], False)):
            key = np.where(group < 0, -1, group * n_templates + template)
            wanted = np.flatnonzero(np.isin(key, sharing(group[group >= 0], template[group >= 0], place[group >= 0])))
            wanted = wanted[np.lexsort((begin[wanted], key[wanted]))]
            for part in np.split(wanted, np.flatnonzero(np.diff(key[wanted])) + 1) if len(wanted) else []:
                t, first, last = int(template[part[0]]), int(begin[part[0]]), int(begin[part[-1]])
                if single:
                    found.append((w_line[first], w_line[first], t, first, last + 1, len(np.unique(place[part]))))
                elif w_line[first] < w_line[last + 1]:
                    spread = SPREAD * len(model.templates[t][1]) + 10
                    for low, high, n in windows(begin[part].tolist(), place[part].tolist(), least[t], spread):
                        if w_line[low] < w_line[high + 1]:
                            found.append((w_line[low], w_line[high + 1], t, low, high + 1, n))
        return np.array(found, np.int64).reshape(-1, 6)

    def piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[float, str]]], dict[int, set[int]]]:
        """Lines of each text; for texts with findings, their chances and families, and their lines."""
        cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        lines = np.diff(np.searchsorted(cuts, offsets))
        start, end, first = word_spans(data, offsets)
        words, text = Spans(data, FOLDED).hash(start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        w_line = np.searchsorted(cuts, start, "right") - 1
        joined = (text[1:] == text[:-1]) & (w_line[1:] - w_line[:-1] <= 1)  # a line without words ends a run
        at = np.flatnonzero(joined)
        run = np.concatenate([[0], np.cumsum(~joined)])
        pairs = mix(words[at] * STEP[0] + words[at + 1] * STEP[1])
        found: dict[int, list[tuple[float, str]]] = {}
        covered: dict[int, set[int]] = {}

        def add(chance: float, family: str, low: int, high: int) -> None:
            t = int(np.searchsorted(offsets, cuts[low], "right")) - 1
            found.setdefault(t, []).append((chance, family))
            covered.setdefault(t, set()).update(range(low, high + 1))

        for line in np.unique(w_line[at[np.isin(pairs, spdx)]]).tolist():
            stop = cuts[line + 1] if line + 1 < len(cuts) else len(data)
            for family in spdx_families(data[cuts[line] : stop].tobytes()):
                add(1.0, family, line, line)
        rows = regions(w_line, at, run, pairs)
        if len(rows):
            spans, row = np.unique(rows[:, :2], axis=0, return_inverse=True)
            row = row.reshape(-1)
            low, high = np.searchsorted(w_line, spans[:, 0]), np.searchsorted(w_line, spans[:, 1], "right")
            p_low, p_high = np.searchsorted(at, low), np.searchsorted(at, high - 1)
            owners = np.concatenate([np.repeat(np.arange(len(spans)), high - low), np.repeat(np.arange(len(spans)), p_high - p_low)])
            own = [words[a:b] for a, b in zip(low, high)] + [pairs[a:b] for a, b in zip(p_low, p_high)]
            chances = model.chances(*distinct(owners, np.concatenate(own)), len(spans))
            best = np.argmax(chances, axis=1)
            sure = np.flatnonzero((best[row] == family_of[rows[:, 2]]) & (chances[row, best[row]] >= LEAST_CHANCE))
            taken = np.full(len(words), -1)
            # Words belong to one family: that of the notice with the most pairs.
            for i in sure[np.lexsort((-chances[row[sure], best[row[sure]]], -rows[sure, 5]))].tolist():
                family, own_words = int(best[row[i]]), taken[rows[i, 3] : rows[i, 4] + 1]
                if ((own_words == -1) | (own_words == family)).all():
                    own_words[:] = family
                    add(float(chances[row[i], family]), FAMILIES[family], int(rows[i, 0]), int(rows[i, 1]))
        return lines, found, covered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            rows = []
            for low, high in pieces(offsets):
                lines, found, covered = piece(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for i in range(high - low):
                    hits = found.get(i, [])
                    top = max(hits) if hits else (None, None)
                    rows.append((int(lines[i]), len(covered.get(i, ())), top[1], ",".join(sorted({f for _, f in hits})), top[0]))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=names
            )

    return run


def sampled(rows: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """The rows with text of at most n ids, those with the smallest hashes.

    The ids are chosen without their texts, so no task has to hold the texts of all chosen documents; an
    id that repeats brings all its rows. Rows without an id are not chosen.
    """
    ids = rows.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    return rows.filter(F.col("doc_id").isin([r.doc_id for r in ids]) & F.col("text").isNotNull())


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, licence, licences, probability: one row per document.

    A paragraph is a line; `n_licensed` counts those that a confirmed notice covers, which is a line
    or a run of consecutive lines without a wordless one between. `licence` and `probability` are
    those of the likeliest confirmed notice (nulls: none), `licences` lists the families found,
    sorted. Only lines and runs that share enough word pairs with a template can be confirmed, so
    only these are classified; SPDX lines count with probability 1. The unknown class is trained on
    at most 3000 lines of 500 documents, those with the smallest hashes of ids; without documents that
    have ids, on fixed lines alone. Null and empty texts have no paragraphs. Repeated rows are scanned each on their
    own; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = sampled(rows).select(F.explode(F.split("text", "\n")).alias("line")).filter("length(line) between 3 and 400").distinct()
    sample = [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()]
    return rows.mapInArrow(_found(fit(sample)), FOUND)
