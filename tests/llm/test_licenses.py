"""Patience alignment against a plain version, and license scans."""

import random

import pytest

from tallymark.llm import licenses


def plain_patience(one, other):
    """The definition, recursively, with the longest increasing subsequence found by trying all ends."""
    if not one or not other:
        return []
    head = 0
    while head < min(len(one), len(other)) and one[head] == other[head]:
        head += 1
    rest, rest_of = one[head:], other[head:]
    tail = 0
    while tail < min(len(rest), len(rest_of)) and rest[-1 - tail] == rest_of[-1 - tail]:
        tail += 1
    found = [(k, k) for k in range(head)] + [(len(one) - 1 - k, len(other) - 1 - k) for k in range(tail)]
    rest, rest_of = rest[:len(rest) - tail], rest_of[:len(rest_of) - tail]
    anchors = [(i, rest_of.index(w)) for i, w in enumerate(rest) if rest.count(w) == 1 and rest_of.count(w) == 1]
    longest = [1] * len(anchors)
    for k in range(len(anchors)):
        longest[k] = 1 + max([longest[m] for m in range(k) if anchors[m][1] < anchors[k][1]], default=0)
    if not anchors:
        return sorted(found)
    return found, rest, rest_of, head, anchors, max(longest)


@pytest.mark.parametrize("seed", range(200))
def test_alignment(seed):
    rng = random.Random(seed)
    letters = rng.choice([3, 8, 30])
    one = [rng.randrange(letters) for _ in range(rng.randrange(0, 25))]
    other = list(one) if seed % 2 else [rng.randrange(letters) for _ in range(rng.randrange(0, 25))]
    for _ in range(rng.randrange(0, 5)):
        if other:
            other[rng.randrange(len(other))] = rng.randrange(letters)
    pairs = licenses.patience(one, other)
    assert all(one[i] == other[j] for i, j in pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    plain = plain_patience(one, other)
    if isinstance(plain, list):
        assert pairs == plain
    else:
        found, rest, rest_of, head, anchors, longest = plain
        assert set(found) <= set(pairs)
        anchored = {(i + head, j + head) for i, j in anchors}
        assert len(anchored & set(pairs)) >= longest


def test_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"Some words here. {apache} More words."), (2, "this is LICENSED   under; the\napache license version 2 0"), (3, "the license of the apache"),
        (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0."), (6, None), (7, ""), (8, " ".join(["word"] * 60000) + " Released under the MIT License. " + apache),
        (9, f"{apache} between {apache}"), (10, "This work is licensed under some GNU General Public License, version 3."), (None, apache), (1, apache), (1, apache),
        (11, licenses.TEMPLATES["MIT"][2].replace("merge,", "join,") + ", and to permit persons"), (12, "licensed words under no terms the version general public work"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS License", "1 AS key")
    made = licenses.find_licenses(frame).collect()
    assert sorted(((r.doc_id, r.license) for r in made), key=str) == sorted([
        (1, "Apache-2.0"), (2, "Apache-2.0"), (4, "CC-BY-NC-4.0"), (5, "CC-BY-4.0"), (8, "MIT"), (8, "Apache-2.0"), (9, "Apache-2.0"), (9, "Apache-2.0"),
        (10, "GPL-3.0"), (None, "Apache-2.0"), (1, "Apache-2.0"), (1, "Apache-2.0"), (11, "MIT")], key=str)
    far = next(r for r in made if r.doc_id == 8 and r.license == "MIT")
    assert (far.start_word, far.end_word, far.coverage) == (60000, 60005, 1.0)
    assert next(r for r in made if r.doc_id == 10).coverage == pytest.approx(11 / 12)


def test_whole_texts_hold_what_a_plain_scan_finds(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    lines = {"Apache-2.0": "licensed under the apache license, version 2.0", "MIT": "released under the mit license", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
             "GPL-3.0": "licensed under the gnu general public license, version 3"}
    want = {(r.doc_id, name) for r in rows for name, line in lines.items() if line in r.text.lower()}
    got = {(r.doc_id, r.license) for r in licenses.find_licenses(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert want <= got and len(got - want) <= 2


def test_empty_table(spark):
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_versions_and_relatives_are_told_apart(spark):
    header = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
              "Foundation; either version {} of the License, or (at your option) any later version.")
    bsd = licenses.TEMPLATES["BSD-2-Clause"][0]
    want = {
        1: (header.format("program", "General Public License", "2"), "GPL-2.0"), 2: (header.format("program", "General Public License", "3"), "GPL-3.0"),
        3: (header.format("library", "Lesser General Public License", "2.1"), "LGPL-2.1"), 4: (header.format("library", "Lesser General Public License", "3"), "LGPL-3.0"),
        5: (header.format("program", "Affero General Public License", "3"), "AGPL-3.0"), 6: (header.format("library", "Library General Public License", "2"), "LGPL-2.0"),
        7: ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies.", "ISC"),
        8: (licenses.TEMPLATES["Unlicense"][0], "Unlicense"), 9: (bsd + "THIS SOFTWARE IS PROVIDED", "BSD-2-Clause"),
        10: (licenses.TEMPLATES["BSD-3-Clause"][0], "BSD-3-Clause"), 11: (licenses.TEMPLATES["BSD-4-Clause"][0], "BSD-4-Clause"),
        12: ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999", "LGPL-2.1"), 13: ("Licensed under CC BY-ND 4.0.", None),
        14: ("Licensed under CC BY 3.0.", None), 15: ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        16: (header.format("program", "General Public License", "4"), None),
    }
    frame = spark.createDataFrame([(k, f"before {text} after it") for k, (text, _) in want.items()], "doc_id long, text string")
    got = {}
    for r in licenses.find_licenses(frame).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got == {k: [name] for k, (_, name) in want.items() if name}
