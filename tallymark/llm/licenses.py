"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a license's template anchor the alignment; of the anchors the longest
increasing subsequence is kept, and the gaps between them are aligned in the same way, down to common beginnings and ends.
The share of the template's words that are aligned is its coverage. Stretches are found by the template's signature words,
those that are not everyday words: an occurrence with enough coverage cannot lack more of them than coverage allows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import byte_rules, text_chunks, word_hashes
from tallymark.llm.tiling import normal_words

MIN_COVERAGE = 0.8
#: Words that a stretch may have more than its template, as a share of the template.
SLACK = 0.5

_LATER = (
    "This {} is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software "
    "Foundation; either version {} of the License, or (at your option) any later version.")
_GRANT = "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_ADVERTISE = "All advertising materials mentioning features or use of this software must display the following acknowledgement "
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.")

#: Sentences by which public licenses are named or granted.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _GRANT.format("GNU General Public License version 3"),
        "GNU General Public License Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _LATER.format("program", "GNU General Public License", "2"),
        _GRANT.format("GNU General Public License version 2"),
        "GNU General Public License Version 2, June 1991",
    ],
    "LGPL-3.0": [
        _LATER.format("library", "GNU Lesser General Public License", "3"),
        _GRANT.format("GNU Lesser General Public License version 3"),
        "GNU Lesser General Public License Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        _LATER.format("library", "GNU Lesser General Public License", "2.1"),
        _GRANT.format("GNU Lesser General Public License version 2.1"),
        "GNU Lesser General Public License Version 2.1, February 1999",
    ],
    "LGPL-2.0": [
        _LATER.format("library", "GNU Library General Public License", "2"),
        "GNU Library General Public License Version 2, June 1991",
    ],
    "AGPL-3.0": [
        _LATER.format("program", "GNU Affero General Public License", "3"),
        _GRANT.format("GNU Affero General Public License version 3"),
        "GNU Affero General Public License Version 3, 19 November 2007",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [_BSD + _ENDORSE],
    "BSD-4-Clause": [_BSD + _ADVERTISE + _ENDORSE],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
}

#: Words that tell a license from its relatives: a template that holds them is found only where they stand as they are.
TELLING = {
    "Apache-2.0": ["version 2 0"], "MPL-2.0": ["v 2 0"],
    "GPL-3.0": ["gnu general public license", "version 3"], "GPL-2.0": ["gnu general public license", "version 2", "version 2 of"],
    "LGPL-3.0": ["gnu lesser general", "version 3"], "LGPL-2.1": ["gnu lesser general", "version 2 1"],
    "LGPL-2.0": ["gnu library general", "version 2", "version 2 of"], "AGPL-3.0": ["gnu affero general", "version 3"],
    "BSD-3-Clause": ["endorse or promote"], "BSD-4-Clause": ["endorse or promote", "advertising materials"],
    "CC-BY-NC-4.0": ["cc by nc 4 0"], "CC-BY-SA-4.0": ["cc by sa 4 0"], "CC-BY-4.0": ["cc by 4 0"], "CC0-1.0": ["cc0 1 0"],
}

_EVERYDAY = "a an and any are as at be by for from in is it of on or that the this to was with you under not may use work"
_SPACES = byte_rules(b" ", lower=False)


def word_ids(texts: list[str]) -> list[list[int]]:
    """Hashes of the normal words of each text."""
    found = []
    for first, last, data, begins in text_chunks(normal_words(pa.array(texts, pa.string()))):
        hashes, at = word_hashes(data, begins, _SPACES)
        found += [hashes[at[k]:at[k + 1]].tolist() for k in range(last - first)]
    return found


def patience(one: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (of ``one``, of ``other``), both rising."""
    pairs, work = [], [(0, len(one), 0, len(other))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and one[a] == other[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(one[a:b]), Counter(other[c:d])
        place = {word: k for k, word in enumerate(other[c:d], c) if there[word] == 1}
        anchors = [(k, place[word]) for k, word in enumerate(one[a:b], a) if here[word] == 1 and word in place]
        # The longest increasing subsequence: tails[n] is the smallest end of one of n + 1 anchors.
        tails: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(anchors):
            at = bisect_left(tails, j)
            tails[at:at + 1], ends[at:at + 1] = [j], [k]
            before.append(ends[at - 1] if at else -1)
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(anchors[k])
            k = before[k]
        for i, j in chain:
            pairs.append((i, j))
            work.append((i + 1, b, j + 1, d))
            b, d = i, j
        if chain:
            work.append((a, b, c, d))
    return sorted(pairs)


def _told(pairs: list[tuple[int, int]], telling: list[tuple[int, int]]) -> bool:
    """Whether the stretches of the template are aligned word by word, with nothing in between."""
    place = {j: i for i, j in pairs}
    return all(a in place and all(place.get(j) == place[a] + j - a for j in range(a, b)) for a, b in telling)


class Templates:
    """Templates as hashes, with what of them must be found at least."""

    def __init__(self, templates: Mapping[str, list[str]], min_coverage: float) -> None:
        everyday = {w[0] for w in word_ids(_EVERYDAY.split())}
        flat = [(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)]
        self.entries = []
        for (name, k, _), words in zip(flat, word_ids([t for _, _, t in flat])):
            if not words:
                continue
            signature = {w for w in words if w not in everyday} or set(words)
            held = sum(w in signature for w in words)
            need = int(np.ceil(min_coverage * len(words) - 1e-9))
            least = max(1, need - (len(words) - held))
            phrases = word_ids(TELLING.get(name, []))
            telling = [(j, j + len(p)) for p in phrases for j in range(len(words) - len(p) + 1) if words[j:j + len(p)] == p]
            self.entries.append((name, k, words, telling, signature, least, need))
        self.signatures = np.array(sorted({w for e in self.entries for w in e[4]}), np.uint64)
        self.fewest = min((e[5] for e in self.entries), default=1)

    def find(self, words: list[int], hits: list[int]) -> list[tuple[str, int, int, int, int, int]]:
        """(name, template, start, end, matched, words of the template) of stretches that do not overlap, best first.

        ``hits`` are the positions of signature words. A stretch begins at most as far before its first signature word, and
        reaches at most as far after its last, as the template and the slack allow.
        """
        found = []
        for name, k, template, telling, signature, least, need in self.entries:
            own = [p for p in hits if words[p] in signature]
            reach = int(len(template) * (1 + SLACK)) + 1
            taken_to = first = 0
            while first + least <= len(own):
                if own[first + least - 1] - own[first] >= reach:
                    first += 1
                    continue
                start = max(taken_to, own[first] - (len(template) - 1))
                pairs = patience(words[start:own[first] + reach], template)
                if len(pairs) >= need and _told(pairs, telling):
                    a, b = start + pairs[0][0], start + pairs[-1][0] + 1
                    found.append((name, k, a, b, len(pairs), len(template)))
                    taken_to = b
                    first = bisect_left(own, b)
                else:
                    first += 1
        best: list[tuple[str, int, int, int, int, int]] = []
        for entry in sorted(found, key=lambda e: (-e[4], -e[4] / e[5], e[2], e[0], e[1])):
            if all(entry[3] <= e[2] or e[3] <= entry[2] for e in best):
                best.append(entry)
        return best


def find_licenses(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", templates: Mapping[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """doc, license, template (its number), start_word, end_word, matched, coverage: one row per stretch that a template covers.

    Words are lower-cased runs of letters and digits of the whole text. Of stretches that overlap, the one with most matched
    words stays. Null and empty texts have none; rows that share an id, and repeated rows, are scanned one by one.
    """
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates if templates is not None else TEMPLATES, min_coverage))
    kind = dict(docs.dtypes)[doc]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = known.value
        for batch in batches:
            rows, found = [], []
            for first, last, data, begins in text_chunks(normal_words(batch.column(1))):
                hashes, at = word_hashes(data, begins, _SPACES)
                hits = np.flatnonzero(np.isin(hashes, templates.signatures))
                owners, counts = np.unique(np.searchsorted(at, hits, "right") - 1, return_counts=True)
                for k in owners[counts >= templates.fewest].tolist():
                    own = hits[np.searchsorted(hits, at[k]):np.searchsorted(hits, at[k + 1])] - at[k]
                    stretches = templates.find(hashes[at[k]:at[k + 1]].tolist(), own.tolist())
                    rows += [first + k] * len(stretches)
                    found += stretches
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.string(), *[pa.int64()] * 5]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            shares = pa.array([m / w for m, w in zip(columns[4], columns[5])], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *arrays[:5], shares],
                ["key", "license", "template", "start_word", "end_word", "matched", "coverage"])

    rows = docs.select(F.col(doc).alias("key"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(scan, f"key {kind}, license string, template long, start_word long, end_word long, matched long, coverage double")
    return made.withColumnRenamed("key", doc)
