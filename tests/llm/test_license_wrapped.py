"""Licence statements that are broken over lines, against brute force."""

import textwrap

import pyarrow as pa

from strataview.llm import license_scan
from strataview.llm import textkit as K
from strataview.llm.queries import op8_license_scan

from .helpers import ALNUM, SF, hard_docs, lower
from .test_operators import meets

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice"""
MPL = """// This Source Code Form is subject to the terms of the
// Mozilla Public License, version 2.0. If a copy of the
// MPL was not distributed with this file"""


def brute(text):
    """Labels of all lines, and of all windows of template size, that meet a template."""
    blocks = [set(ALNUM.findall(x)) for x in lower(text or "").split("\n")]
    w = ALNUM.findall(lower(text or ""))
    labels = {x for p, x in license_scan.PHRASES if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
    for t in license_scan.TEMPLATES:
        n = len(ALNUM.findall(lower(t.text)))
        if not meets(set(w), t._replace(never="")):
            continue  # no window has what the whole text lacks
        windows = [set(w[k : k + n]) for k in range(max(1, len(w)))]
        if any(meets(b, t) for b in blocks + windows):
            labels.add(t.label)
    return ",".join(sorted(labels))


def test_published_texts(spark):
    df = spark.createDataFrame([("mit", MIT), ("bsd", BSD), ("mpl-2.0", MPL)], "doc_id string, text string")
    got = {r.doc_id: r for r in license_scan.scan(df, wrapped=True).collect()}
    assert {i: (r.labels, round(r.score, 2)) for i, r in got.items()} == {"mit": ("mit", 1.0), "bsd": ("bsd", 1.0), "mpl-2.0": ("mpl-2.0", got["mpl-2.0"].score)}
    assert got["mpl-2.0"].score > 0.9 and [(b.label, b.first_word) for b in got["mit"].blocks] == [("mit", 2)]


def test_windows_against_brute_force(spark):
    texts = ["", None, "x\n" * 50, "Released under\n\nthe MIT", "rights\nreserved all", "Released under the MIT License\nReleased under"]
    for width in (8, 17, 30, 60):
        texts += ["Some words before it, and a line.\n" + textwrap.fill(t[: len(t) * k // 5], width) + "\nafter" for t in [x.text for x in license_scan.TEMPLATES] for k in (4, 5)]
    texts.append("\n".join(texts[6:12]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2).unionByName(hard_docs(spark).selectExpr("cast(doc_id + 1000 as int) as doc_id", "text"))
    got = sorted((r.doc_id or 0, r.labels) for r in license_scan.scan(df, wrapped=True).collect())
    assert got == sorted((r.doc_id or 0, brute(r.text)) for r in df.collect())


def test_query_takes_wrapped_statements(spark, tmp_path):
    spark.createDataFrame([(1, MIT)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.labels for r in op8_license_scan(spark, str(tmp_path)).collect()] == ["mit"]
    assert op8_license_scan(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def labels_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.labels for r in sorted(license_scan.scan(df, wrapped=True).collect(), key=lambda r: r.doc_id)]


def test_licenses_of_one_family_are_told_apart(spark):
    assert labels_of(spark, [
        "Released under the Apache License", "Released under the MIT License", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY-NC 4.0",
        "This work is licensed under the GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 2",
        "This work is licensed under the GNU Lesser General Public License, version 3", "Licensed under the Apache License, Version 2.0", "All rights reserved to\nno one",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
    ]) == ["", "mit", "cc-by,cc-by-4.0", "cc-by,cc-by-sa-4.0", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "gpl,gpl-2.0", "gpl", "apache-2.0", "all-rights-reserved,reserved", "cc-by-sa"]


def test_whole_texts_wrapped_and_edited(spark):
    """Every long text, wrapped at several widths behind comment signs, with one word in twelve lost."""
    texts, want = [], []
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        if len(words) > 30:
            own = {*t.must.split(), "version", "3", "2.1", "2"}
            cut = [w for k, w in enumerate(words) if k % 12 != 7 or set(ALNUM.findall(lower(w))) & own]
            for width, some in ((40, words), (72, words), (60, cut)):
                texts.append("intro line\n\n# " + textwrap.fill(" ".join(some), width).replace("\n", "\n# ") + "\n\nimport this")
                want.append(t.label)
    got = labels_of(spark, texts)
    assert all(w in g.split(",") for w, g in zip(want, got, strict=True)) and len(texts) > 40
    told = {w: [x for x in g.split(",") if x.startswith(("gpl-", "lgpl-", "agpl-", "cc-by-"))] for w, g in zip(want, got, strict=True)}
    assert all(v in ([], [k]) for k, v in told.items()), told


def test_only_indexed_pairs_are_looked_at(monkeypatch):
    """A text that has no prefix token of a template is never compared with it."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, {}, license_scan.THRESHOLD)
    seen = []
    share = license_scan.Scanner._share
    monkeypatch.setattr(license_scan.Scanner, "_share", lambda self, own, t: seen.append(t) or share(self, own, t))
    w = K.words(pa.array(["nothing of any kind"] * 50 + ["Released under the MIT License"]), K.ALNUM)
    found = scanner.blocks(scanner.ranks(w.hashes), w.text_of())
    assert {scanner.labels[t] for _, t, _ in found} == {"mit"}
    prefixed = {t for b, t in scanner.pairs(scanner.ranks(w.hashes), w.text_of())}
    assert set(seen) == prefixed and len(seen) == len(scanner.pairs(scanner.ranks(w.hashes), w.text_of()))
