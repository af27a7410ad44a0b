"""Quality: statistics, boosted trees, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa

from tallymark.llm import quality


def test_statistics():
    names = quality.STATISTICS
    rows = quality.statistics(pa.array(["The cat. the cat!\nLine 2", None, "", "a a a a", "\n\n", "word " * 300_000]))
    first = dict(zip(names, rows[0]))
    assert first["log_words"] == np.log1p(6) and first["distinct_words"] == 6 / 6 - 1 / 6 and first["capital_words"] == 2 / 6
    assert first["shout"] == 1 / 24 and first["words_per_line"] == 3 and first["digit_words"] == 1 / 6 and first["word_length"] == 19 / 6
    assert not rows[1].any() and not rows[2].any()
    assert dict(zip(names, rows[3]))["top_word"] == 1.0 and dict(zip(names, rows[3]))["distinct_pairs"] == 1 / 3
    assert dict(zip(names, rows[4]))["line_break"] == 1.0 and dict(zip(names, rows[5]))["log_words"] == np.log1p(300_000)


def plain_predict(trees, row):
    margin = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        margin += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-margin))


def test_trees_learn_and_walk_like_plain_ones():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 6))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    trees = quality.grow(rows[:2000], labels[:2000])
    got = quality.predict(trees, rows)
    assert ((got[2000:] > 0.5) == labels[2000:]).mean() > 0.95
    assert np.allclose(got[:50], [plain_predict(trees, r) for r in rows[:50]])


def test_trees_without_two_labels():
    rows = np.ones((10, 3))
    assert quality.predict(quality.grow(rows, np.ones(10)), rows)[0] > 0.8
    assert quality.predict(quality.grow(np.zeros((0, 3)), np.zeros(0)), rows)[0] == 0.5


def test_held_out_accuracy(spark, folder):
    larger = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    made = quality.classify(docs, labels)
    assert made.count() == docs.count()
    rows = made.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_held_out_labels_are_not_learnt(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS string) AS binary)), 4) = 2 THEN 1 - quality ELSE quality END AS quality")
    one, other = ({(r.doc_id, r.score) for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert one == other


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "x"), (3, ""), (3, "same id"), (3, "same id")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS Statistics")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and next(r for r in rows if r.doc_id is None).held_out is False
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == 6
