"""Licence notices: held-out wordings, ordinary text left alone, paragraphs, edge rows, the driver's notices."""
import re

import pytest

from riskweave.llm import licences
from riskweave.llm.queries import op8_licences

ORDINARY = ["The meeting moved to Tuesday because of the rain.", "She renewed her driver license in the spring.", "Terms and conditions of the sale are public.", "Version 3 of the plan is general enough.",
            "Das Haus ist unter der Brücke und wurde verkauft.", "Work on the software is done under time pressure.", "La casa fue vendida en el año nuevo."] * 20


@pytest.fixture(scope="module")
def scanner():
    return licences.fit_rows(ORDINARY)


@pytest.mark.parametrize(("text", "family"), [
    ("Our library is licensed under the Apache License, Version 2.0, see below", "Apache"), ("released under the mit license", "MIT"), ("This work is licensed under the GNU General Public License version 2", "GPL"),
    ("The dataset is licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("licensed under the GNU Lesser General Public License, version 3", "LGPL"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT"),
])
def test_other_wordings(scanner, text, family):
    assert scanner.find(licences.tokens(text))[0] == family


@pytest.mark.parametrize("text", ["A license to drive is issued by the state.", "general public opinion is under review", "The MIT campus is open to the public", "version 2.0 of the work was released in May", "the the the", "#"])
def test_ordinary_text(scanner, text):
    assert scanner.find(licences.tokens(text)) is None


def test_probability_is_calibrated(scanner):
    import numpy as np
    texts, labels = licences.variations(np.random.default_rng(99), [licences.tokens(t) for t in ORDINARY], 12)
    found = [(scanner.find(w), f) for w, f in zip(texts, labels, strict=True)]
    sure = [(h[1], h[0] == f) for h, f in found if h]
    assert len(sure) > 0.85 * len(found) and sum(ok for _, ok in sure) / len(sure) > 0.97
    assert sum(p for p, _ in sure) / len(sure) < sum(ok for _, ok in sure) / len(sure) + 0.05


def test_paragraphs_cover_the_text():
    text = "one line\n\n  \n" + "A sentence of five words. " * 60 + "\nlast"
    parts = list(licences.paragraphs(text, 20))
    assert re.sub(r"\s", "", "".join(text[a:b] for _, a, b in parts)) == re.sub(r"\s", "", text)
    assert all(len(text[a:b].split()) <= 20 for _, a, b in parts) and parts[0] == (0, 0, 8) and parts[-1][0] == 4


def test_rows(spark, scanner, docs_schema):
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, None), (3, ""), (None, "x\n" + notice), (4, "word " * 50_000 + ". " + notice + " " + "word " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in rows], docs_schema)
    got = licences.scan(df, scanner).collect()
    assert sorted((r.doc_id or 0, r.family) for r in got) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (4, "MIT")]
    assert next(r for r in got if r.doc_id is None).paragraph == 1
    assert licences.scan(df.limit(0), licences.fit(df.limit(0))).collect() == []


def test_query_finds_every_planted_notice(spark):
    d = "/root/testdata/sf0.01"
    want = {(r.doc_id, k) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for k, line in enumerate(r.text.split("\n"))
            if re.search(r"(Licensed|Released) under|is licensed under", line)}
    got = op8_licences(spark, d).collect()
    assert {(r.doc_id, r.paragraph) for r in got} == want and all(r.agreement >= 0.6 for r in got)


@pytest.mark.parametrize(("text", "families"), [
    ("Licensed under the MIT License or the Apache License, Version 2.0.", {"MIT", "Apache"}), ("Dual licensed under MIT and GPL-3.0.", {"MIT", "GPL"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"BSD"}), ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache"}),
    ("Code is released under the MIT License. Text is licensed under CC BY-SA 4.0.", {"MIT", "CC-BY-SA"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", {"GPL"}),
    ("Licensed under the GNU General Public License v2.0.", {"GPL"}), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", {"ISC"}),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", {"BSD"}), ("The tool is available under pressure and the sale is public or private.", set())])
def test_every_family_of_a_paragraph(scanner, text, families):
    found = scanner.find_all(text)
    assert {f[0] for f in found} == families and len(found) == len(families)
