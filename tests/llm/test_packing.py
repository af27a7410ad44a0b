"""Packing: ids against the tokenizer, the plan against its histogram, and the packed rows put together again."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallymark.llm import packing

DEFINITION = packing.default_tokenizer()
TEXTS = [
    "Plain words, and more: it's DON'T we'll 12 3½ x²", "<|endoftext|> inside <|startoftext|>", "a\x1cb\x1fc", "ΑΣ ας Σ", "İstanbul ñ Ⅷ ŉ",
    "éa ́ é", "日本語 test ﬁ ǅ ª", "﻿x  y​z᠎", " a b c\x85d e", "", " \n\t", "emoji 👍🏽 ok", "##!! a_b-c/d" * 50, "ÀÉÎ öäüß",
]


def test_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_str(DEFINITION)
    rng = np.random.default_rng(3)
    letters = list("abcXYZ 019.,!'-_\n\té ßÖñ½² <|>\x1c")
    texts = TEXTS + ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(400)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in packing.encoder(DEFINITION)(texts)] == want


@pytest.mark.parametrize("seed", range(8))
def test_plan_takes_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([16, 64, 2048]))
    lengths = rng.integers(1, window + 1, int(rng.integers(0, 3000))) if seed else np.full(5000, 700)
    histogram = Counter(lengths.tolist())
    planned = packing.plan(histogram, window)
    back = Counter()
    for combination, used in planned:
        assert used > 0 and sum(combination) <= window
        for length in combination:
            back[length] += used
    assert back == histogram
    sequences = sum(used for _, used in planned)
    if seed and lengths.sum() > 50 * window:
        assert sequences <= lengths.sum() / window * (1.03 if len(lengths) > 2000 else 1.08) + 2


def test_least_squares_solves_and_stays_positive():
    rows, columns = np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1])
    x = packing.least_squares(rows, columns, np.array([3.0, 8.0, 5.0]), 2)
    assert np.allclose(x, [3, 5], atol=1e-3)
    assert (packing.least_squares(rows, columns, np.array([-3.0, 1.0, 0.0]), 2) >= 0).all()


def check(rows, docs, window):
    tokenizer = Tokenizer.from_str(DEFINITION)
    want = Counter()
    for key, text in docs:
        want[key, zlib.crc32(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    sequences, per_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        per_doc[r.row].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return want, per_doc, sequences


def test_documents(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (101, "word " * 9000), (102, "word " * 2047), (7, "the id again"), (7, "the id again"), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS Length", "2 AS row", "'x' AS salt")
    rows = packing.pack(frame, "text", "doc_id", DEFINITION).collect()
    want, per_doc, sequences = check(rows, docs, 2048)
    tokenizer = Tokenizer.from_str(DEFINITION)
    for key, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        copies = sum(d == (key, text) for d in docs)
        for start in range(0, len(ids), 2048):
            piece = ids[start:start + 2048]
            found = [r for r in per_doc[key] if (r.start, r.length, r.ids_crc32, r.doc_tokens) == (start, len(piece), zlib.crc32(piece.tobytes()), len(ids))]
            assert len(found) == copies
    assert len(rows) == sum(-(-len(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) // 2048) for _, t in docs)
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= tokens / 2048 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), "text", "doc_id", DEFINITION).count() == 0
