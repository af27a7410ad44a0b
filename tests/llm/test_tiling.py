"""Greedy string tiling against a plain version, and leaks over Spark."""

import numpy as np
import pytest
from pyspark.sql import Row

from tallymark.llm import tiling


def plain_tiling(doc, item, size):
    """Longest unmarked common stretch, first in the item, then first in the document; again until none is left."""
    in_doc, in_item, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not in_item[i + n] and not in_doc[d + n]):
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return found
        d, i, n = best
        in_doc[d:d + n], in_item[i:i + n] = [True] * n, [True] * n
        found.append(best)


@pytest.mark.parametrize("seed", range(60))
def test_tiles_match_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    size, letters = int(rng.integers(2, 5)), int(rng.integers(2, 6))
    item = rng.integers(0, letters, rng.integers(size, 14)).tolist()
    doc = rng.integers(0, letters, rng.integers(1, 40)).tolist()
    if seed % 3 == 0:
        cut = len(item) // 2
        doc[5:5] = item[cut:] + [9] + item[:cut]
    code = lambda words: hash(tuple(words)) & (2**63 - 1)
    own = [code(item[i:i + size]) for i in range(len(item) - size + 1)]
    hits = [(p, code(doc[p:p + size])) for p in range(len(doc) - size + 1)]
    hits = [h for h in hits if h[1] in own]
    assert tiling.tiles([h[0] for h in hits], [h[1] for h in hits], own, size) == plain_tiling(doc, item, size)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def test_leaks(spark):
    passage = " ".join(WORDS)
    turned = " ".join(WORDS[8:]) + " in between " + " ".join(WORDS[:8])
    docs = [
        (1, f"Before it. {passage.upper()}! After."), (2, turned), (3, " ".join(WORDS[:7])), (4, None), (5, ""), (6, "x " * 50000 + passage),
        (6, "another row of that id"), (None, passage), (7, " ".join(reversed(WORDS))), (1, f"Before it. {passage.upper()}! After."),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS whole", "2 AS Tiles")
    items = spark.createDataFrame([(10, passage), (11, "too short"), (12, None), (10, passage), (None, "x " * 20)], "item_id long, text string")
    rows = tiling.leaks(frame, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == sorted([(1, 10), (2, 10), (6, 10), (None, 10), (6, None)], key=str)
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert by[1, 10].tiles == [Row(doc_start=2, item_start=0, length=15)] and by[1, 10].coverage == 1.0
    assert sorted(t.length for t in by[2, 10].tiles) == [7, 8] and by[2, 10].covered_tokens == 15
    assert by[6, 10].tiles[0].doc_start == 50000


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert tiling.leaks(docs.limit(0), items).count() == 0
    assert tiling.leaks(docs, items.limit(0)).count() == 0
    assert tiling.leaks(docs, items).count() == 1


def test_a_shared_opening_brings_nothing_together(spark):
    """Items are met by their rarest seeds only: an opening in every text and item makes no pair, a leak behind it is found."""
    opening = "please answer the following question in one word"
    items = [(i, f"{opening} " + " ".join(f"item{i}x{k}" for k in range(20))) for i in range(60)]
    docs = [(d, f"{opening} " + " ".join(f"text{d}x{k}" for k in range(20))) for d in range(400)] + [(1000, "so: " + items[7][1]), (1001, opening)]
    found = tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.coverage) for r in found.collect()] == [(1000, 7, 1.0)]
    short = [(1, opening)]
    found = tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(short, "item_id long, text string"))
    assert found.count() == len(docs)
