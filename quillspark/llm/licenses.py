"""License scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import HASH_BYTES, ODD, HashedWords, as_strings, hashed_words, mix, text_chunks

# Well-known notices of the licence families.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.", "Licensed under the GNU General Public License, version 2."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "Licensed under the GNU Affero General Public License, version 3."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the copyright owner."],
}
# Short names of the families.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache 2.0"],
    "MIT": ["MIT", "the MIT License"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-or-later", "GPLv3", "GNU GPL version 3"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPLv2", "GNU GPL version 2"],
    "LGPL": ["LGPL-3.0", "LGPL-2.1", "LGPLv3", "GNU Lesser General Public License"],
    "AGPL-3.0": ["AGPL-3.0", "AGPLv3", "GNU Affero General Public License"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause License"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0"],
    "ISC": ["ISC", "the ISC License"],
    "CC-BY": ["CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0": ["CC0-1.0", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense", "the Unlicense"],
    "Proprietary": [],
}
FORMS = ["SPDX-License-Identifier: {}", "SPDX-License-Identifier: {} OR", "License: {}", "Licensed under {}", "Released under {}", "Distributed under the terms of {}", "This work is licensed under {}", "available under {}", "licence {}", "dual {}"]
# Names of licences of no family above, and ways to put any other; their notices are unknown.
OTHERS = ["Boost Software License", "zlib License", "Microsoft Public License", "PostgreSQL License", "SIL Open Font License", "Academic Free License", "Python Software Foundation License", "European Union Public Licence", "University of Illinois License", "X Consortium License", "{} License", "{} Public License", "{} {} License", "{} Software Licence", "{} Community Agreement"]
OTHER_FORMS = ["Licensed under the {}.", "Licensed under the {}, version 1.", "Licensed under the {} v{}.0.", "Licensed under the {} 2.0.", "Released under the {}.", "This program is distributed under the terms of the {}, version {}.", "SPDX-License-Identifier: {}", "This material is licensed under the terms of a {} between the parties.", "This work is licensed under the {} {}.0 International."]
# Sentences with words of licences that aren't any.
ORDINARY = [
    "Use of this service is subject to our terms and conditions and privacy policy.",
    "The license fee is due within thirty days of the date of the invoice.",
    "Drivers must carry a valid license and insurance at all times.",
    "You may copy this document for personal use only.",
    "Please contact the copyright owner for permission to reprint this article.",
    "The software is provided by the vendor under a separate agreement.",
    "The general public was free to use the library without permission.",
    "The source code of the program was published under the name of its author.",
    "A copy of the report can be obtained at the following address.",
    "The students of the MIT and of other schools read the same text.",
    "The public domain is a term of law, and the commons belong to all.",
]
NONE, UNKNOWN = "none", "unknown"
#: Share of a template's word pairs that a region must hold to confirm it, and that an unknown licence has of any.
CONFIRM, LIKE = 0.75, 0.3
#: Words of a window and between the starts of two: every paragraph is covered by windows of each size.
WINDOWS = ((6, 3), (16, 5), (40, 10))
#: Least calibrated probability of a family that isn't taken for unknown, and of prose.
SURE, PROSE = 0.5, 0.2
#: Window starts worked off at once.
PART = 1 << 14

_LETTERS = np.isin(np.arange(256), np.r_[48:58, 65:91, 97:123]) | (np.arange(256) >= 128)
_INNER = np.isin(np.arange(256), [43, 45, 46])  # + - . count inside words
_KEPT = np.where(_LETTERS | _INNER | (np.arange(256) == 10), np.arange(256), 32).astype(np.uint8)


def normal(texts: pa.Array) -> pa.Array:
    """The same texts byte by byte, all but letters, digits, line breaks and inner + - . made blanks."""
    texts = as_strings(texts)
    if not len(texts):
        return texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _KEPT[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    letter = _LETTERS[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    data[_INNER[data] & ~(before & after)] = 32
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(bounds - bounds[0])), pa.py_buffer(data)])


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words[:-1] * ODD + words[1:])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class LicenseModel:
    """Weights of word and word-pair features by their sorted hashes; the last two rows are the share of strange words and the bias."""

    families: list[str]
    grams: np.ndarray
    weights: np.ndarray
    temperature: float
    templates: dict[str, list[np.ndarray]]
    distinctive: dict[str, np.ndarray]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the weights, -1 for grams that aren't known."""
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        return np.where(self.grams[at] == hashes, at, -1)

    def probabilities(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(windows, families): calibrated probabilities of the windows words[begin:end]."""
        single = self.look_up(words)
        pairs = np.append(self.look_up(_pair_hashes(words)), -1) if len(words) else single
        # Sums over the known grams alone: a word's own, then its pair with the next word.
        both = np.stack([single, pairs], axis=1).ravel()
        known = np.flatnonzero(both >= 0)
        sums = np.concatenate([np.zeros((1, len(self.families))), np.cumsum(self.weights[both[known]], axis=0)])
        before = np.concatenate([[0], np.cumsum(both >= 0)])
        low, high = before[2 * begin], before[np.maximum(2 * end - 1, 2 * begin)]  # the last word's pair is outside
        words_known = np.concatenate([[0], np.cumsum(single >= 0)])
        strange = 1 - (words_known[end] - words_known[begin]) / np.maximum(end - begin, 1)
        z = (sums[high] - sums[low]) / np.sqrt(np.maximum(high - low, 1))[:, None] + strange[:, None] * self.weights[-2] + self.weights[-1]
        return _softmax(z / self.temperature)

    def verdict(self, p: np.ndarray) -> np.ndarray:
        """The family of each window by its index: unknown unless one is sure, none unless it is likely no prose."""
        none, unknown = len(self.families) - 1, len(self.families) - 2
        k = p.argmax(1)
        return np.where(p[:, none] >= PROSE, none, np.where((k < unknown) & (p[np.arange(len(p)), k] >= SURE), k, unknown))

    def similarity(self, family: str, words: np.ndarray) -> float:
        """The largest share of the word pairs of a template of the family that the words hold."""
        have = _pair_hashes(words) if len(words) > 1 else words
        return max((float(np.isin(t, have).mean()) for t in self.templates.get(family, [])), default=0.0)


def _words(text: str) -> np.ndarray:
    return hashed_words(normal(pa.array([text]))).hashes


def _variants(text: str, r: np.random.Generator, n: int, prose: np.ndarray) -> list[str]:
    """A notice whole, cut short, with words lost or put in, among other words."""
    words, out = text.split(), []
    for i in range(n):
        w = list(words)
        if i and len(w) > 14:
            a = int(r.integers(0, len(w) - 11))
            w = w[a : a + int(r.integers(11, len(w) - a + 1))]
        if i > 1 and len(w) > 8:
            w = [x for x in w if r.random() > 0.06]
        if i % 3 == 2:
            w = list(r.choice(prose, int(r.integers(0, 8)))) + w + list(r.choice(prose, int(r.integers(0, 10))))
        out.append(" ".join(w))
    return out


def _strange(r: np.random.Generator, n: int) -> np.ndarray:
    letters = r.integers(97, 120, (n, 8)).astype(np.uint8).tobytes().decode()
    return np.array([letters[8 * i : 8 * i + k] for i, k in enumerate(r.integers(2, 9, n).tolist())])


def _examples(r: np.random.Generator, variants: int) -> list[tuple[str, int, bool]]:
    """(text, class, held out). Of the other licences, whole names are held out, so that unknown is learnt as unknown."""
    families = [*TEMPLATES, UNKNOWN, NONE]
    strange, rows = _strange(r, 3_000), []

    def add(texts: list[str], k: int, held: bool | None = None) -> None:
        rows.extend((t, k, i % 4 == 3 if held is None else held) for i, t in enumerate(texts))

    known = sorted({w.strip(".,;:()\"").lower() for t in TEMPLATES.values() for x in t for w in x.split()} | {w.lower() for t in NAMES.values() for x in t for w in x.split()})
    for k, name in enumerate(TEMPLATES):
        for text in TEMPLATES[name]:
            add(_variants(text, r, variants, strange), k)
        for form in FORMS:
            for short in NAMES[name]:
                add(_variants(form.format(short), r, 6, strange), k)
    for i, name in enumerate(OTHERS):
        for form in OTHER_FORMS:
            for j in range(3):
                made = form.format(name.format(*(x.capitalize() for x in _strange(r, 2))), int(r.integers(1, 6)))
                add(_variants(made, r, 3, strange), len(families) - 2, held=i % 5 == 4)
    for text in ORDINARY:
        add(_variants(text, r, variants, strange), len(families) - 1)
    names = np.array(known)
    short = np.array([w for w in known if len(w) <= 3 and w.isalpha()])
    for i in range(2_500):  # prose: words of notices, out of their order, some again and again, among others
        n, share = int(r.integers(1, 45)), r.choice([0.0, 0.1, 0.3, 0.5, 1.0], p=[0.15, 0.25, 0.25, 0.2, 0.15])
        some = r.choice(short if i % 2 else names, int(r.choice([1, 2] if share == 1 else [1, 2, 5, 40])))
        add([" ".join(np.where(r.random(n) < share, r.choice(some, n), r.choice(strange, n)))], len(families) - 1, held=i % 4 == 3)
    for i, word in enumerate(known):  # words and pairs of words said again and again
        add([f"{word} " * int(r.integers(2, 30)), f"{word} {r.choice(short)} " * int(r.integers(2, 15)), f"{r.choice(short)} {r.choice(short)} " * 8], len(families) - 1, held=i % 4 == 3)
    return rows


def train(seed: int = 5, variants: int = 16, steps: int = 150) -> LicenseModel:
    """Multinomial logistic regression on sparse word and word-pair counts of notices, look-alikes and plain prose.

    A fourth of the variants, and all notices of some other licences, are held out; the temperature that makes the
    probabilities fit them best is chosen. The training data are made from the lists above, so they have a fixed size.
    """
    r = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN, NONE]
    rows = _examples(r, variants)
    found = hashed_words(normal(pa.array([t for t, _, _ in rows])))
    words = [found.hashes[a:b] for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    y, held = np.array([k for _, k, _ in rows]), np.array([h for *_, h in rows])
    both = [np.concatenate([w, _pair_hashes(w)]) if len(w) else w for w in words]
    # The features are the grams of the notices as they are, not those of the words among which they are put.
    plain = [*(x for t in TEMPLATES.values() for x in t), *(f.format(n) for t in NAMES.values() for n in t for f in FORMS), *ORDINARY]
    plain += [f.replace("{}", n.replace("{}", "").strip(), 1).replace("{}", "1") for n in OTHERS[:-1] for f in OTHER_FORMS]
    grams = np.unique(np.concatenate([np.concatenate([w, _pair_hashes(w)]) for w in map(_words, plain)]))
    model = LicenseModel(families, grams, np.zeros((len(grams) + 2, len(families))), 1.0, {}, {})
    at = [model.look_up(g) for g in both]
    strange = np.array([1 - (model.look_up(w) >= 0).mean() if len(w) else 1.0 for w in words])
    at = [np.append(x[x >= 0], [len(grams), len(grams) + 1]) for x in at]
    scale = [np.append(np.full(len(x) - 2, 1 / np.sqrt(max(1, len(x) - 2))), [s, 1.0]) for x, s in zip(at, strange, strict=True)]

    def scores(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat, value = np.concatenate([at[i] for i in rows]), np.concatenate([scale[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), [len(at[i]) for i in rows])
        return flat, value, owner, np.flatnonzero(np.diff(owner, prepend=-1))

    fit = np.flatnonzero(~held)
    flat, value, owner, starts = scores(fit)
    wanted, memory = np.eye(len(families))[y[fit]], np.full(model.weights.shape, 1e-6)
    for _ in range(steps):
        p = _softmax(np.add.reduceat(model.weights[flat] * value[:, None], starts)) - wanted
        gradient = np.stack([np.bincount(flat, weights=p[owner, k] * value, minlength=len(model.weights)) for k in range(len(families))], axis=1) / len(fit) + 1e-6 * model.weights
        memory += gradient * gradient
        model.weights -= 0.5 * gradient / np.sqrt(memory)
    test = np.flatnonzero(held)
    flat, value, _, starts = scores(test)
    z = np.add.reduceat(model.weights[flat] * value[:, None], starts)
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    kept = {f: [_words(x) for x in [*TEMPLATES[f], *(form.format(n) for n in NAMES[f] for form in FORMS), *(n for n in NAMES[f] if " " in n)]] for f in TEMPLATES}
    model.templates = {f: [np.unique(_pair_hashes(w)) for w in x] for f, x in kept.items()}
    own = {f: np.unique(np.concatenate(x)) for f, x in kept.items()}
    every, count = np.unique(np.concatenate(list(own.values())), return_counts=True)
    model.distinctive = {f: np.intersect1d(x, every[count <= 2]) for f, x in own.items()}
    return model


def paragraphs_of(found: HashedWords) -> np.ndarray:
    """The first word of each paragraph: a block of lines between blank ones; wrapped lines are one paragraph."""
    at = found.text_of_word
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1]) | (found.line[1:] - found.line[:-1] > 1)
    return np.flatnonzero(opens)


def _windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, paragraph) of windows that cover every word of every paragraph, a short paragraph as a whole."""
    out = []
    for width, step in WINDOWS:
        use = np.flatnonzero((ends - starts >= width) | (width == WINDOWS[0][0]))
        count = np.maximum(0, -(-(ends[use] - starts[use] - width) // step)) + 1
        owner = np.repeat(use, count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begin = np.minimum(starts[owner] + place * step, np.maximum(ends[owner] - width, starts[owner]))
        out.append((begin, np.minimum(begin + width, ends[owner]), owner))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _named(model: LicenseModel, words: np.ndarray, near: np.ndarray, said: dict[int, tuple[int, int, float]]) -> Iterator[tuple[int, int, int, float, float]]:
    """(family, begin, end, probability, similarity) of one stretch of ``words``; ``said`` has what its windows were taken for.

    The family whose templates the words around (``near``) hold most comes first. Another one counts if a word is left by
    which it is known, once those of the families before it are taken out; what is then left is classified again, for
    families that no window shows alone.
    """
    unknown = len(model.families) - 2
    like = {k: model.similarity(model.families[k], near) for k in said if k != unknown}
    if not like:
        nearest = max(model.similarity(f, near) for f in model.templates)
        if nearest >= LIKE:
            yield unknown, *said[unknown], nearest
        return
    left, first = words, True
    todo = sorted(like, key=lambda k: (like[k], said[k][2]), reverse=True)
    while todo:
        k = todo.pop(0)
        own = model.distinctive[model.families[k]]
        b, e, p = said.get(k, (0, len(words), 0.0))
        if not first:
            again = model.probabilities(left, np.zeros(1, np.int64), np.array([len(left)])) if len(left) else None
            p = max(p, float(again[0, k])) if again is not None else p
            like[k] = model.similarity(model.families[k], near)
        if first or np.isin(own, left).any() and (p >= 0.9 or like[k] >= CONFIRM):
            yield k, b, e, p, like[k]
        first, left = False, left[~np.isin(left, own)]
        if not todo and len(left) and k in said:
            other = int(model.verdict(model.probabilities(left, np.zeros(1, np.int64), np.array([len(left)])))[0])
            todo = [other] if other < unknown and other not in said else []


def find(model: LicenseModel, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, str, float, float, bool]]:
    """(paragraph, first word, word after the last, family, probability, similarity, confirmed) of all regions."""
    none = len(model.families) - 1
    ends = np.append(starts[1:], len(words))
    begin, end, owner = _windows(starts, ends)
    order = np.argsort(begin, kind="stable")
    begin, end, owner = begin[order], end[order], owner[order]
    family, best = np.full(len(begin), none), np.zeros(len(begin))
    for a in range(0, len(begin), PART):
        b, e = begin[a : a + PART], end[a : a + PART]
        low, high = b.min(), e.max()
        p = model.probabilities(words[low:high], b - low, e - low)
        family[a : a + PART] = model.verdict(p)
        best[a : a + PART] = p[np.arange(len(p)), family[a : a + PART]]
    out = []
    hits = np.flatnonzero(family != none)
    hits = hits[np.lexsort((begin[hits], owner[hits]))]
    reach = np.maximum.accumulate(end[hits]) if len(hits) else hits
    apart = np.flatnonzero((owner[hits][1:] != owner[hits][:-1]) | (begin[hits][1:] > reach[:-1])) + 1
    for group in np.split(hits, apart) if len(hits) else []:
        paragraph, low, high = int(owner[group[0]]), int(begin[group].min()), int(end[group].max())
        said = {}
        for i in group.tolist():
            k, old = int(family[i]), said.get(int(family[i]), (high, low, 0.0))
            said[k] = min(old[0], int(begin[i])), max(old[1], int(end[i])), max(old[2], float(best[i]))
        near = words[max(int(starts[paragraph]), low - 40) : min(int(ends[paragraph]), high + 40)]
        said = {k: (b - low, e - low, p) for k, (b, e, p) in said.items()}
        named = list(_named(model, words[low:high], near, said))
        for k, b, e, p, like in named:
            b, e = (b + low, e + low) if len(named) > 1 else (low, high)
            while b < e - 1 and model.look_up(words[b : b + 1])[0] < 0:
                b += 1
            while e > b + 1 and model.look_up(words[e - 1 : e])[0] < 0:
                e -= 1
            out.append((paragraph, b, e, model.families[k], p, like, k < len(model.families) - 2 and like >= CONFIRM))
    return out


FOUND = "doc_id long, paragraph int, start int, length int, family string, probability double, similarity double, confirmed boolean"


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row per licence found in a paragraph: where it stands, its family or unknown, probability, similarity, confirmed.

    A paragraph is a block of lines between blank lines, its wrapped lines joined; every word of it stands in a
    classified window. A paragraph that names several families has a row for each. ``start`` and ``length`` are in
    characters of the text. Null and empty texts have none; repeated rows are each scanned; an empty table gives an
    empty result. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=HASH_BYTES):
            texts = as_strings(batch.column("text"))
            found = hashed_words(normal(texts))
            starts = paragraphs_of(found)
            at = found.text_of_word
            first = np.searchsorted(at[starts], np.arange(len(texts))) if len(starts) else np.zeros(len(texts), np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))])
            ids, out = batch.column("doc_id"), []
            for paragraph, b, e, *verdict in find(sent.value, found.hashes, starts) if len(starts) else []:
                d = int(at[b])
                raw = texts[d].as_buffer().to_pybytes()
                start, stop = (len(raw[: int(x - bounds[d])].decode()) for x in (found.begin[b], found.end[e - 1]))
                out.append((ids[d].as_py(), paragraph - int(first[d]), start, stop - start, *verdict))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, FOUND)
