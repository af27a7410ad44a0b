"""The pipeline's stages against plain versions, each on its own input."""

import re
from collections import Counter
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tallymark.llm import lines as line_operator
from tallymark.llm import packing, quality, tiling
from tallymark.llm.common import stage

from test_jaccard import plain as plain_groups
from test_lines import plain as plain_lines
from test_tiling import plain_tiling


@pytest.fixture(scope="module")
def kept(spark, folder):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs = [docs]
    for name, step in pipeline.STAGES:
        inputs.append(stage(step(spark, inputs[-1], folder), name))
    return inputs


def rows_of(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.collect()]


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "pack"]
    for frame in kept[:5]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, folder, kept):
    scores = {r.doc_id: r.score for r in quality.classify(kept[0], spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {d for d, _, _ in rows_of(kept[1])} == {d for d, s in scores.items() if s >= pipeline.KEEP}
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert len(good - {d for d, _, _ in rows_of(kept[1])}) <= 0.02 * len(good)


def test_lines(kept):
    want = {(d, t) for d, t, _, gone in plain_lines(rows_of(kept[1]), line_operator.MIN_SITES) if not gone or t.strip()}
    assert {(d, t) for d, t, _ in rows_of(kept[2])} == want


def test_near_duplicates(kept):
    groups = plain_groups([(d, t) for d, t, _ in rows_of(kept[2])], 5, 80)
    assert {d for d, _, _ in rows_of(kept[3])} == {d for d, _, c in groups if c is None or c == d}


def test_decontamination(spark, folder, kept):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = set()
    for doc, text, _ in rows_of(kept[3]):
        own = words(text)
        grams = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
        for item in items:
            if sum(tuple(item[i:i + 5]) in grams for i in range(len(item) - 4)) == 0:
                continue
            spots = [i for i in range(len(own) - 4) if tuple(own[i:i + 5]) in {tuple(item[k:k + 5]) for k in range(len(item) - 4)}]
            near = sorted({p for i in spots for p in range(max(0, i - 1), min(len(own), i + 6))})
            doc_words = [own[p] if k == 0 or near[k - 1] == p - 1 else None for k, p in enumerate(near)]
            covered = sum(t[2] for t in plain_tiling([w if w else object() for w in doc_words], item, 5))
            if covered >= tiling.MIN_COVERAGE * len(item):
                leaked.add(doc)
    assert {d for d, _, _ in rows_of(kept[4])} == {d for d, _, _ in rows_of(kept[3])} - leaked
    assert leaked


def test_pack(kept):
    tokenizer = Tokenizer.from_str(packing.default_tokenizer())
    lengths = Counter()
    for r in kept[5].collect():
        lengths[r.doc_id] += r.length
    assert dict(lengths) == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t, _ in rows_of(kept[4])}


def test_run_is_the_stages(spark, folder, kept):
    as_rows = lambda f: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in f.collect())
    assert as_rows(pipeline.run(spark, folder)) == as_rows(kept[5])


def test_null_and_repeated_ids(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(30))
    copy, clean = " ".join(f"copy{k}" for k in range(60)), " ".join(f"clean{k}" for k in range(60))
    docs = spark.createDataFrame(
        [(None, item, "x"), (None, clean, "x"), (1, item, "x"), (1, clean + " more of it", "x"), (2, "other " + clean[::-1], "x")],
        "doc_id long, text string, source string")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, clean), (1, clean + " more of it"), (2, "other " + clean[::-1])])
    copies = spark.createDataFrame(
        [(None, copy), (None, copy), (None, clean), (None, clean), (5, copy), (5, copy), (7, copy), (7, "a clean row of its own"), (8, ""), (9, None)],
        "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in pipeline.jaccard_join(spark, copies, str(tmp_path)).collect()))
    assert kept == sorted([(5, copy), (0, clean), (7, "a clean row of its own"), (8, ""), (9, "")])


def test_near_copies_leave_no_texts_or_shingles_on_disk(spark, tmp_path):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:50 + k] + ["other"] + base[50 + k:]) if k % 2 else f"text {k} " + " ".join(base[k * 7:k * 7 + 9])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    kept = [r.doc_id for r in pipeline.jaccard_join(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == [0, 1, *range(2, 20, 2)]
    left = {p.name: spark.read.parquet(str(p)).columns for p in set(shared.glob("*")) - before if any(p.glob("*.parquet"))}
    assert left and not any({"text", "shingles"} & set(columns) for columns in left.values()), left


def test_copies_are_settled_by_id(spark, tmp_path):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"a{k}" for k in range(1, 61))
    rows = [(None, one), (None, one), (None, two), (3, two), (3, two), (3, one), (4, one), (None, "  "), (None, "  "), (None, None), (3, "")]
    docs = spark.createDataFrame([(d, t, str(k)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, source string")
    made = pipeline.jaccard_join(spark, docs, str(tmp_path))
    kept = made.collect()
    assert made.columns == docs.columns and len(kept) == 5
    assert [r.doc_id for r in kept if r.text in (one, two)] == [3]
    assert sum(r.text is None or not r.text.strip() for r in kept) == 4
