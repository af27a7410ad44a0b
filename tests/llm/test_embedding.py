"""Edit fingerprints: the walk against a plain one, edited texts, and links between near texts."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tallymark.llm import embedding
from tallymark.llm.common import mixed


def plain_print(text):
    level = max(0, int(np.floor(np.log2(max(1, 2 * len(text)) / embedding.SAMPLES))))
    values = [(int(mixed(np.array([ord(c) + 1], np.uint64))[0]) >> 32) | 1 for c in text]
    multipliers, zeros = embedding._steps(0, 4 * len(text) + 200)
    at, step, out = 0, 0, ""
    while at < len(text):
        if zeros[step] >= level:
            out += "0123456789abcdef"[values[at] >> 16 & 15]
        at += (values[at] * int(multipliers[step]) & 0xFFFFFFFF) >> 31
        step += 1
    return f"{level:02d}:{out}"


def texts(seed, count=40):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcde fghié\U0001f44d\0") for _ in range(rng.choice([0, 1, 2, 30, 127, 128, 129, 700, 3000]))) for _ in range(count)]


def test_walk_is_the_plain_one():
    some = texts(1)
    assert embedding.fingerprints(some) == [plain_print(t) for t in some]
    assert embedding.fingerprints(["abc"]) + embedding.fingerprints(["x" * 5000]) == embedding.fingerprints(["abc", "x" * 5000])


def test_walk_in_chunks_holds_little(monkeypatch):
    many = ["abcdefgh\U0001f44d\0" * 30 * (k % 7) for k in range(2_000)]
    whole, held = embedding.fingerprints(many), []
    tracemalloc.start()
    try:
        embedding.fingerprints(many)
        held.append(tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert held[0] < 15 * sum(map(len, many))
    monkeypatch.setattr(embedding, "CHUNK_CHARS", 7)
    assert embedding.fingerprints(many[:50]) == whole[:50]


def test_likeness_follows_edits():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    bases = [" ".join(word() for _ in range(700)) for _ in range(30)]

    def edited(text, edits):
        for _ in range(edits):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "Z", "ZZ"]) + text[at + 1:]
        return text

    def mean(others):
        prints = embedding.fingerprints(bases + others)
        return np.mean([embedding.likeness(a, b) for a, b in zip(prints, prints[len(bases):])])

    assert mean(bases) == 1.0
    assert mean([edited(t, 1) for t in bases]) > 0.9
    assert 0.7 < mean([edited(t, 5) for t in bases]) < mean([edited(t, 1) for t in bases])
    assert mean([bases[k - 1] for k in range(30)]) < 0.25
    assert mean([t + " " + bases[0][:len(t) // 5] for t in bases]) > 0.75  # some of them on another level
    assert embedding.likeness(*embedding.fingerprints(["", "abc"])) == 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        a, b, c = embedding.fingerprints([text, edited, following])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, embedding.likeness(a, b), embedding.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [12_000_000, 2_000, 400])
def test_documents(spark, monkeypatch, chars):
    monkeypatch.setattr(embedding, "BUCKET_CHARS", chars)
    rows = [(k * 7 % 41 + 3, t) for k, t in enumerate(texts(2))] + [(None, "no id"), (10, None), (11, "same id"), (11, "same id"), (11, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS tail", "'z' AS Doc")
    made = embedding.document_prints(frame).collect()
    assert sorted((tuple(r) for r in made), key=str) == expected(rows)


def test_small_tables(spark):
    frame = spark.createDataFrame([(1, "alone in here")], "doc_id long, text string")
    only = embedding.document_prints(frame).first()
    assert only.near_next == 1.0 and only.n_chars == 13
    assert embedding.document_prints(frame.limit(0)).count() == 0


def test_near_documents(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(2500))
    rows = [(3, base), (5, base[:1200] + "x" + base[1200:]), (8, base), (9, "".join(rng.choice("qrstuvw xyz") for _ in range(2500))), (12, ""), (None, base)]
    prints = embedding.document_prints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc, r.leader) for r in embedding.near_documents(prints).collect()} == {(5, 3), (8, 3)}


@pytest.mark.parametrize("chars", [12_000_000, 400])
def test_large_ids_beside_a_null(spark, monkeypatch, chars):
    """Ids beyond what a fraction can hold keep all their digits."""
    monkeypatch.setattr(embedding, "BUCKET_CHARS", chars)
    rows = [((1 << 60) + k * 3, t) for k, t in enumerate(texts(4))] + [(None, "no id"), (-(1 << 62), "least"), (7, "small")]
    made = embedding.document_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in made), key=str) == expected(rows)
