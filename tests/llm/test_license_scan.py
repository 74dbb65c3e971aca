"""Licence places against a plain scan of all words."""

import random
import re

from mediaframe.llm import license_scan as ls
from mediaframe.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    words, places = plain_words(text), []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return words, places


def same(row, text):
    words, places = plain_base(text)
    starts = [i for i, _ in places]
    labels = sorted({label for _, label in places})
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
    assert set(labels) <= set(row.labels.split(",")) if labels else True
    assert row.labels == ",".join(sorted(set(filter(None, row.labels.split(","))))) and 0 <= row.score <= 1 and (row.score == 1) >= bool(labels)


def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        same(r, texts[r.doc_id])


def test_random_texts_of_licence_words(spark):
    rng = random.Random(3)
    pool = ["GNU", "general", "public", "license", "apache", "CC", "by", "MIT", "license.", "-", "the", "é"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in ls.digest(ls.scan_licenses(docs)).collect():
        same(r, rows[r.doc_id][1])


def plain_find(words, index):
    """Every start of every template, without the index."""
    codes = ls.codes_of(" ".join(words), index.vocabulary)
    out = set()
    for k, t in enumerate(index.templates):
        n = len(index.codes[k])
        if t.exact:
            continue
        for at in range(1 - n, len(codes)):
            there = [any(0 <= at + q + s < len(codes) and codes[at + q + s] == index.codes[k][q] for s in range(-2, 3)) for q in range(n)]
            if index.worth[k][there].sum() >= index.limit * index.worth[k].sum() - 1e-12:
                window = codes[max(0, at - 2):at + n + 2].tolist()
                if all(any(window[i:i + len(p)] == p.tolist() for i in range(len(window))) for p in index.phrases[k]):
                    out.add(t.label)
    return out


def test_notices_with_changes(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "licensed under Apache License version 2.0", "This work is licensed under the GNU General Public License, version 3.",
             "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and its documentation files (the Software), to deal in the Software without restriction",
             "Licensed under CC BY-NC 4.0.", "the apache of the license version", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
             "license license license", "x " * 50 + "licensed under GNU Affero General Public License version 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = ls.fit_index(docs)
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in ls.digest(ls.scan_licenses(docs, index)).collect()}
    assert got[0] == {"apache", "apache-2.0"} and "apache-2.0" in got[1] and "gpl-3.0" in got[2] and "mit-text" in got[3] and got[4] == {"cc-by", "cc-by-nc-4.0"}
    assert not got[5] and got[6] == {"bsd"} and not got[7] and got[8] >= {"agpl-3.0"}
    for i, t in enumerate(texts):
        assert got[i] - set(PHRASES) == plain_find(plain_words(t), index)


def test_pieces_of_long_texts(spark, monkeypatch):
    index = ls.fit_index(spark.createDataFrame([("MIT License",)], "text string"))
    text = "filler é words " * 40 + "Apache License " + "x" * 300 + " cc-by"
    whole = ls.codes_of(text, index.vocabulary)
    monkeypatch.setattr(ls, "PIECE", 16)
    assert ls.codes_of(text, index.vocabulary).tolist() == whole.tolist() and len(whole) == len(plain_words(text))


def test_edge_rows(spark, docs, no_docs):
    texts = [r.text for r in docs.collect()]
    rows = ls.digest(ls.scan_licenses(docs)).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(plain_words(t)) for t in texts)
    assert all(r.n_base == 0 and r.first_word is None and r.labels == "" and r.score == 0 for r in rows)
    assert ls.digest(ls.scan_licenses(no_docs)).count() == 0
