"""The Jaccard join against all pairs, in memory and over Spark, with cells of every kind."""

import random
import re

import numpy as np
import pytest

from tallymark.llm import jaccard
from tallymark.llm.common import components


def plain(rows, words=3, percent=90):
    """(n_shingles, component) per row by comparing all pairs."""
    sets = []
    for _, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(found[i:i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[m][0] for m in groups[find(k)] if rows[m][0] is not None]
        out.append((doc, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, count, groups, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 12, 30, 60, 150, 400]))] for _ in range(groups)]
    rows = []
    for k in range(count):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, edits + 1)):
            at = rng.randrange(len(words) + 1)
            change = rng.random()
            if change < 0.4 and words:
                words[at % len(words)] = rng.choice(vocabulary)
            elif change < 0.7:
                words.insert(at, rng.choice(vocabulary))
            elif words:
                del words[at % len(words)]
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append((k * 3 + 1, text))
    return rows


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_sets_share_a_region(percent):
    rng = np.random.default_rng(percent)
    sizes = jaccard.Sizes(percent)
    for _ in range(1500):
        size = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        most = sizes.differing(len(base))
        drop = int(rng.integers(0, most + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, most - drop + 1)), dtype=np.uint64)]))
        shared, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
        if 100 * shared < percent * union or np.array_equal(base, other):
            continue
        assert len(np.intersect1d(jaccard.region_keys(base, sizes), jaccard.region_keys(other, sizes)))


@pytest.mark.parametrize("seed", range(25))
def test_cells_keep_every_connection(seed):
    rng = np.random.default_rng(seed)
    bases = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(3)]
    sets = []
    for _ in range(90):
        base = bases[rng.integers(0, 3)]
        kept = rng.permutation(base)[int(rng.integers(0, 8)):]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, int(rng.integers(0, 6)), dtype=np.uint64)])))
    sets = list({s.tobytes(): s for s in sets}.values())
    cell = jaccard.Cell(sets, 90)
    cell.join()
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j])):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    assert all((cell.label[i] == cell.label[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(i))


@pytest.mark.parametrize("seed,cell", [(1, 1_000_000), (2, 3000), (3, 400)])
def test_documents(spark, seed, cell):
    rows = corpus(seed, 260, 8, 8) + [(None, "a b c d"), (5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "One"), (5005, "a b c d"), (5005, "other words here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS set_id", "2 AS N", "3 AS cell")
    made = jaccard.group_documents(frame, cell_shingles=cell).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made), key=str) == plain(rows)


def test_shared_shingles_are_counted_by_cell(spark, monkeypatch):
    sets = {1: (10, [-5, 1, 2, 3]), 2: (10, [1, 2, 7]), 3: (10, [2, 8]), 4: (11, [1, 2]), 5: (11, [2, 9]), 6: (12, [])}
    frame = spark.createDataFrame([(c, i, s) for i, (c, s) in sets.items()], "cell long, set_id long, shingles array<long>")
    for flush in (250_000, 2):
        monkeypatch.setattr(jaccard, "FLUSH_KEYS", flush)
        found = [(r.set_id, r.held, r.shingle) for r in jaccard._held(frame, 3).collect()]
        assert sorted(f[:2] for f in found) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (4, 2), (5, 2)]
        assert len({f[2] for f in found}) == 3  # shingles 1 and 2 of cell 10, 2 of cell 11


def test_five_words(spark):
    rows = corpus(7, 150, 6, 12)
    made = jaccard.group_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made), key=str) == plain(rows, 5, 80)


def test_empty_table(spark):
    assert jaccard.group_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 200), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
