"""Licence notices in documents: a paragraph classifier confirmed by templates.

A paragraph is a line; one of over ``longest`` words is read as its sentences, joined up to that length. Sparse word
1- and 2-grams (numbers alike) go into a multinomial logistic regression over licence families and an unknown class. It
is fitted on the driver: on variations of the notices below, and on a bounded sample of paragraphs of the
documents (``sample_docs``, a parameter) that are unlike any notice, as the unknown class. A temperature, fitted on
held-out rows, calibrates its probabilities. A prediction counts only if a template of the family confirms it: enough
of the template's word pairs are in the paragraph, or of a longer paragraph's in the template. Parts of a paragraph are
classified too, so a dual notice names both its families.

Defined results: null or empty text: no finding; repeated rows have findings each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, row_draws, text_blocks

TOKEN = re.compile(r"\w+(?:\.\d+)*")
NUMBER = re.compile(r"[v\d][\d.]*\d|\d|v\d")
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
BITS = 14
UNKNOWN = "unknown"

#: Notices as licences and their users word them, by family.
TEMPLATES: dict[str, list[str]] = {
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "This project is licensed under the Apache License 2.0.", "Released under the Apache-2.0 license.", "Apache License Version 2.0, January 2004",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license.", "Distributed under the terms of the MIT License.", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v2.0.", "Released under the GPL version 2 or later.", "License: GPL-3.0",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3.",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Licensed under a BSD 2-clause license.", "Released under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "Released under the MPL 2.0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License 2.0."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0 Universal public domain dedication."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Copyright 2020 Example Inc. All rights reserved.", "Proprietary and confidential."],
}
# The short forms: identifiers, alone after a verb and as source files tag them.
IDENTIFIERS = {"Apache": ["Apache-2.0"], "MIT": ["MIT"], "GPL": ["GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later"], "LGPL": ["LGPL-2.1", "LGPL-3.0-or-later"], "AGPL": ["AGPL-3.0", "AGPL-3.0-only"],
               "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "MPL": ["MPL-2.0"], "EPL": ["EPL-2.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "CC0": ["CC0-1.0"], "CC-BY": ["CC-BY-4.0"],
               "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"], "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0"]}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [form.format(name) for name in _names for form in ("Licensed under {}", "SPDX-License-Identifier: {}")]
PART = re.compile(r"(?<=[.!?;])\s+|\s+(?:and/or|and|or)\s+", re.IGNORECASE)
VERB = re.compile(r"\b(?:licen[sc]ed|released|distributed|available)\s+under\b|SPDX-License-Identifier:", re.IGNORECASE)
OPENINGS = ["This project is", "The code is", "This document is", "This dataset is", "All content is", "Unless otherwise noted, this work is", "Software"]


def tokens(text: str) -> list[str]:
    return ["#" if NUMBER.fullmatch(w) else w for w in TOKEN.findall(text.lower())]


def feature(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << BITS) - 1)


def grams(words: list[str]) -> list[int]:
    return sorted({feature(w) for w in words} | {feature(a + " " + b) for a, b in zip(words, words[1:], strict=False)})


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False)) or set(zip(words, words, strict=True))


def paragraphs(text: str, longest: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the paragraphs of a text, blank ones left out."""
    at, number = 0, 0
    for line in text.split("\n"):
        if line.strip():
            if len(line) <= 2 * longest or len(line.split()) <= longest:
                yield number, at, at + len(line)
            else:
                begin = end = 0
                words = 0
                for m in [*SENTENCE.finditer(line), None]:
                    stop = m.start() if m else len(line)
                    n = len(line[end:stop].split())
                    if words and words + n > longest:
                        yield number, at + begin, at + end
                        begin, words = end, 0
                    words, end = words + n, stop
                if line[begin:end].strip():
                    yield number, at + begin, at + end
        at += len(line) + 1
        number += 1


@dataclass
class Scanner:
    families: list[str]  # the unknown class first
    weights: np.ndarray  # (features + 1, families); the last row is the bias
    temperature: float
    least: float = 0.5
    confirm: float = 0.6

    def __post_init__(self):
        self.templates = {f: [(t, pairs(tokens(t))) for t in ts] for f, ts in TEMPLATES.items()}
        self.words_of = {f: {w for t in ts for w in tokens(t)} for f, ts in TEMPLATES.items()}
        every = [tokens(t) for ts in TEMPLATES.values() for t in ts]
        self.vocabulary = {w for t in every for w in t}
        self.known_pairs = {p for ts in self.templates.values() for _, ps in ts for p in ps}

    def confirmed(self, family: str, words: list[str]) -> tuple[str, float]:
        """The family's closest template and how much of it, or of a longer paragraph in it, agrees."""
        own = pairs(words)
        best = ("", 0.0)
        for text, ps in self.templates[family]:
            shared = len(own & ps)
            best = max(best, (text, max(shared / len(ps), shared / len(own) if len(own) >= 6 else 0.0)), key=lambda x: x[1])
        return best

    def find(self, words: list[str]) -> tuple[str, float, str, float] | None:
        """(family, probability, template, agreement) of a paragraph, None if it is unknown or not confirmed."""
        # No template can confirm a paragraph that shares no word pair with any.
        if len(self.vocabulary & set(words)) < 2 or not (pairs(words) & self.known_pairs):
            return None
        z = (self.weights[grams(words)].sum(0) + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        if k == 0 or p[k] < self.least:
            return None
        template, agreement = self.confirmed(self.families[k], words)
        return (self.families[k], float(p[k]), template, agreement) if agreement >= self.confirm else None


    def find_all(self, text: str) -> list[tuple[str, float, str, float]]:
        """The findings of a paragraph, one a family: that of the whole, and those of its parts between sentences, "and" and "or".

        A part is also read after the paragraph's verb ("licensed under"). Beside the whole's family a part's needs a word
        in its template that no template of the former has; parts alone count if they name two families and a verb is there."""
        words = tokens(text)
        if len(self.vocabulary & set(words)) < 2 or not (pairs(words) & self.known_pairs):
            return []
        whole, verb, parts = self.find(words), VERB.search(text), PART.split(text)
        found = {whole[0]: whole} if whole else {}
        if len(parts) > 1:
            opening = tokens(verb[0]) if verb else []
            for part in parts:
                own = tokens(part)
                hit = self.find(own) or (self.find(opening + own) if opening and not VERB.search(part) else None)
                if hit and hit[0] not in found and (whole is None or set(own) & set(tokens(hit[2])) - self.words_of[whole[0]]):
                    found[hit[0]] = hit
            if whole is None and (verb is None or len(found) < 2):
                return []
        return list(found.values())


def variations(rng: np.random.Generator, filler: list[list[str]], copies: int) -> tuple[list[list[str]], list[str]]:
    """Notices with words dropped, openings added and words of ordinary paragraphs around them."""
    # Only words that many families use may be dropped: without its rare ones a notice is another family's, or nobody's.
    uses = Counter(w for ts in TEMPLATES.values() for w in {w for t in ts for w in tokens(t)})
    texts, labels = [], []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            for c in range(copies):
                words = tokens(notice)
                if c:
                    words = [w for w in words if uses[w] <= 4 or rng.random() > 0.1]
                    if rng.random() < 0.3:
                        words = tokens(OPENINGS[rng.integers(len(OPENINGS))]) + words
                    for side in (0, 1):
                        if filler and rng.random() < 0.4:
                            extra = filler[rng.integers(len(filler))][:int(rng.integers(1, 20))]
                            words = extra + words if side else words + extra
                texts.append(words)
                labels.append(family)
    return texts, labels


def fit_rows(ordinary: list[str], copies: int = 16, steps: int = 150, l2: float = 1e-4, seed: int = 3) -> Scanner:
    """Fit on variations of the notices and ordinary paragraphs; every fifth row is held out for the temperature."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *TEMPLATES]
    scanner = Scanner(families, np.zeros(((1 << BITS) + 1, len(families))), 1.0)
    plain = [tokens(t) for t in ordinary]
    plain = [w for w in plain if w and all(scanner.confirmed(f, w)[1] < 0.5 for f in TEMPLATES)]
    texts, labels = variations(rng, plain, copies)
    # Words of notices out of order are ordinary too, else a single one of them would do.
    stock = sorted(scanner.vocabulary)
    mixed = [[*w[:20], *(stock[k] for k in rng.integers(0, len(stock), 3))] for w in plain[:1500]] + [[stock[k] for k in rng.integers(0, len(stock), 6)] for _ in range(300)]
    texts, labels = texts + plain + mixed, labels + [UNKNOWN] * (len(plain) + len(mixed))
    x = [grams(w) for w in texts]
    y = np.array([families.index(f) for f in labels])
    held = np.arange(len(x)) % 5 == 4
    row, col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate([np.array(v) for v in x])
    weight = np.where(held, 0.0, 1.0 / np.bincount(y, minlength=len(families))[y] ** 0.5)
    weight /= weight.sum()
    w, total = scanner.weights, np.full_like(scanner.weights, 1e-10)
    gold = np.eye(len(families))[y]

    def logits() -> np.ndarray:
        return np.stack([np.bincount(row, w[col, k], len(x)) for k in range(len(families))], axis=1) + w[-1]

    for _ in range(steps):
        z = logits()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = weight[:, None] * (gold - p)
        g = np.concatenate([np.stack([np.bincount(col, d[row, k], 1 << BITS) for k in range(len(families))], axis=1), d.sum(0, keepdims=True)]) - l2 * w / len(x)
        total += g * g
        w += 0.5 * g / np.sqrt(total)
    z = logits()[held]
    if len(z):
        loss = lambda t: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - (z - z.max(1, keepdims=True))[np.arange(len(z)), y[held]] / t))
        scanner.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return scanner


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 150, longest: int = 80, **options) -> Scanner:
    """Fit with the paragraphs of about ``sample_docs`` documents, drawn by row, as ordinary text."""
    rows = docs_of(docs, id_col, text_col).where("text is not null")
    n = rows.count()
    drawn = row_draws(rows, "doc_id", "text").where(F.col("_draw") < min(1.0, sample_docs / max(n, 1)))
    got = sorted(r.text for r in drawn.select("text").collect())
    return fit_rows([t[a:b] for t in got for _, a, b in paragraphs(t, longest)], **options)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", longest: int = 80) -> DataFrame:
    """One row per confirmed paragraph and family: where it is, its family, calibrated probability, version, closest template and agreement."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # of fixed size: a hashed table and the templates
    names = ["doc_id", "paragraph", "start", "end", "family", "probability", "version", "template", "agreement"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for ids, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for doc, text in zip(ids, texts, strict=True):
                    for number, start, end in paragraphs(text or "", longest):
                        for hit in s.find_all(text[start:end]):
                            version = re.search(r"(?<![\w.])v?(\d+(?:\.\d+)?)(?![\w])", text[start:end])
                            out.append((doc, number, start, end, hit[0], hit[1], version[1] if version else None, hit[2], hit[3]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, paragraph long, start long, end long, family string, probability double, version string, template string, agreement double")
