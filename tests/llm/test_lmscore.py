"""Cross-entropy difference against plain counting of words."""

import math
import random
from collections import Counter

import pytest

from tallymark.llm import lmscore


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")




def model(token_lists, known, size, scale_to=None):
    kind = lambda w: f"<{lmscore.KINDS[w.encode()[-1]]}>"
    pairs = Counter()
    for ws in token_lists:
        ids = ["<0>"] + [w if w in known else kind(w) for w in ws] + ["<0>"]
        pairs.update(zip(ids, ids[1:]))
    total = sum(pairs.values())
    factor = scale_to / total if scale_to else 1.0
    after, before = Counter(), Counter()
    for (a, b), n in pairs.items():
        after[b] += n * factor
        before[a] += n * factor

    def loss(ws):
        ids = ["<0>"] + [w if w in known else kind(w) for w in ws] + ["<0>"]
        steps = []
        for a, b in zip(ids, ids[1:]):
            unigram = (after[b] + 1) / (total * factor + size)
            steps.append(-math.log((pairs[a, b] * factor + lmscore.STRENGTH * unigram) / (before[a] + lmscore.STRENGTH)))
        return sum(steps) / len(steps)

    return loss, total


def test_scores_are_those_of_plain_models(spark):
    rng = random.Random(3)
    vocabulary = [f"word{k}" for k in range(12)] + ["Odd!", "x,", "12", "naïveé", "**"]
    rows = [(k, " ".join(rng.choice(vocabulary[: 8 if k % 2 else 17]) for _ in range(rng.randrange(0, 40)))) for k in range(60)]
    rows += [(60, None), (61, ""), (61, "word1 word2"), (None, "word3"), (62, "word1 " * 30000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS Key")
    good = spark.createDataFrame([(k,) for k in range(1, 60, 2)] + [(None,), (999,), (3,)], "doc_id long")
    size = lmscore.CLASSES + 200  # every word is known, so ties at the edge of the vocabulary play no part
    found = lmscore.score(frame, lmscore.fit(frame, good, size=size))
    token_lists = [[w for w in words_of(t) if w] for _, t in rows]
    known = {w for ws in token_lists for w in ws}
    targets = [ws for (d, _), ws in zip(rows, token_lists) if d is not None and d < 60 and d % 2]
    target, total = model(targets, known, size)
    background, _ = model(token_lists, known, size, total)
    want = sorted(((d, len(ws), target(ws), background(ws)) for (d, _), ws in zip(rows, token_lists)), key=lambda r: (str(r[0]), r[1]))
    got = sorted(((r.doc_id, r.tokens, r.target_loss, r.background_loss) for r in found.collect()), key=lambda r: (str(r[0]), r[1]))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-4)


def test_unknown_words_fall_in_classes(spark):
    frame = spark.createDataFrame([(1, "often often often rare1 Rare, rare! ñ"), (2, "often")], "doc_id long, text string")
    models = lmscore.fit(frame, frame.select("doc_id"), size=lmscore.CLASSES + 1)
    assert len(models.words) == 1 and models.target.shape == (8, 8)
    assert all(abs(r.score) < 1e-6 for r in lmscore.score(frame, models).collect())  # target and background are the same


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert lmscore.score(none, lmscore.fit(none, none.select("doc_id"))).count() == 0
    assert lmscore.score(docs, lmscore.fit(docs, none.select("doc_id"))).count() == 1


def test_separates_quality(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    rows = lmscore.score(docs, lmscore.fit(docs, half.where("quality = 1").select("doc_id"))).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.8


@pytest.mark.parametrize("hot, flush", [(4096, 3_000_000), (10, 50), (1, 1)])
def test_every_word_counts(spark, monkeypatch, hot, flush):
    monkeypatch.setattr(lmscore, "HOT", hot)
    monkeypatch.setattr(lmscore, "FLUSH_WORDS", flush)
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.3)) % 9000}" for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    rows += [(300, None), (301, ""), (301, "w1 W2"), (None, "w3"), (302, "w1 " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS flush")
    good = spark.createDataFrame([(k,) for k in range(1, 300, 2)] + [(None,), (999,), (3,)], "doc_id long")
    token_lists = [[w for w in words_of(t) if w] for _, t in rows]
    known = {w for ws in token_lists for w in ws}
    assert len(known) > lmscore.VOCABULARY
    target, total = model([ws for (d, _), ws in zip(rows, token_lists) if d is not None and d < 300 and d % 2], known, len(known) + 1)
    background, _ = model(token_lists, known, len(known) + 1, total)
    want = sorted(((d, len(ws), target(ws), background(ws)) for (d, _), ws in zip(rows, token_lists)), key=lambda r: (str(r[0]), r[1]))
    got = sorted(((r.doc_id, r.tokens, r.target_loss, r.background_loss) for r in lmscore.score_corpus(frame, good).collect()), key=lambda r: (str(r[0]), r[1]))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-4)


def test_rare_words_tell_documents_apart_in_the_query(spark, tmp_path):
    from tallymark.llm.queries import QUERIES

    rows = [(0, " ".join(f"common{k} common{k}" for k in range(1100))), (1, "rareone raretwo"), (2, "rarethree rarefour")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r.score for r in QUERIES["op7_lm_score"](spark, str(tmp_path)).collect()}
    assert found[1] < found[2] - 0.1


def test_every_word_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert lmscore.score_corpus(none, none.select("doc_id")).count() == 0
    assert lmscore.score_corpus(docs, none.select("doc_id")).count() == 1
