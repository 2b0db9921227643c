import re

import pyarrow.parquet as pq

from tidemark.llm import license_scan as ls
from tidemark.llm import queries

RULES = {"gpl": "GNU General Public License, version", "cc-by-nc": "Licensed under CC BY-NC", "mit": "under the MIT License", "apache": "under the Apache License", "proprietary": "^All rights reserved"}


def test_every_notice_of_the_table_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    want = set()
    for r in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        for k, line in enumerate((r["text"] or "").split("\n")):
            want |= {(r["doc_id"], k, f) for f, rule in RULES.items() if re.search(rule, re.sub("[!%*$&#]+", "", line), re.I)}
    got = {(r.doc_id, r.paragraph, r.family) for r in queries.op6_license_classifier(spark, sf).collect()}
    assert want and got == want


def test_held_out_accuracy():
    pool = [f"some prose of line {i} that says nothing at all".encode() for i in range(300)]
    m = ls.fit(pool)
    fresh = [(t, y) for t, y in ls.notices(pool, each=30, seed=99)]
    found = [((m.classify(t) or ("none",))[0], ls.FAMILIES[y]) for t, y in fresh]
    named = [(a, b) for a, b in found if b not in ("none", ls.UNKNOWN)]
    assert sum(a == b for a, b in named) >= 0.9 * len(named)
    assert sum(a not in (b, "none", ls.UNKNOWN) for a, b in found) < 0.02 * len(found)
    assert sum(a != "none" for a, b in found if b == "none") < 0.02 * sum(b == "none" for _, b in found)
    unknown = [a for a, b in found if b == ls.UNKNOWN]
    assert unknown.count(ls.UNKNOWN) > 0.5 * len(unknown)
    for text, family in (
        ("This project is licensed under the terms of the ISC license.", ls.UNKNOWN), ("Licensed under the Example Custom License 9.", ls.UNKNOWN),
        ("This work is licensed under the EUPL license, version 1.2.", ls.UNKNOWN), ("Distributed under CC BY 4.0.", "cc-by"),
        ("Released under the MIT License.", "mit"), ("All rights reserved.", "proprietary"),
    ):
        assert (m.classify(text.encode()) or ("none",))[0] == family, (text, m.classify(text.encode()))
    for text in (b"he copied the licence plate", b"the public domain of numbers is large", b"permission to land was given", b"a b", b"free of charge to any person", b""):
        assert m.classify(text) is None


def test_edges(spark):
    texts = [None, "", "\n\n", "Released under the MIT License.", "x " * 30_000, "a\nLicensed under CC BY-NC 4.0.\nb"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(3, texts[3], "f")], "doc_id long, text string, family string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in ls.scan(df).collect())
    assert got == [(3, 0, "mit"), (3, 0, "mit"), (5, 1, "cc-by-nc")]
    assert ls.scan(df.limit(0)).count() == 0


def test_notices_without_a_frequent_cue_and_hard_wrapped(spark):
    wrapped = "Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software and\nassociated documentation files"
    texts = ["Distributed under CC BY 4.0.", f"some prose\n\n{wrapped}\n\nmore prose", f"{wrapped}\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family, r.text) for r in ls.scan(df).collect())
    assert got == [(0, 0, "cc-by", texts[0]), (1, 2, "mit", wrapped), (2, 0, "mit", wrapped)]


def test_notices_of_other_words(spark):
    """Two words are enough, no cue word is needed, and a whole scan gives what each paragraph alone gives."""
    want = {
        "License: MIT": "mit", "SPDX-License-Identifier: MIT": "mit", "GNU Affero General Public License v3": "agpl",
        "Use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements": "apache",
        "he may not use this file": None, "the terms of the deal": None,
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.family for r in ls.scan(df).collect()}
    assert {t: got.get(i) for i, t in enumerate(want)} == want


def test_scan_is_that_of_each_paragraph():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    m = ls.fit([b"some prose of a line that says nothing at all"] * 20)
    seen = 0
    for r in table:
        text = (r["text"] or "").encode()
        got = [(k, f) for k, f, *_ in m.notices(text)]
        each = {k: y[0] for k, line in enumerate(text.split(b"\n")) if (y := m.classify(line))}
        assert {k: f for k, f in got if k in each} == each
        seen += len(each)
    assert seen
