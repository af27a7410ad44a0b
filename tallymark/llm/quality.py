"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics are computed once per document and written as a narrow table; the trees are grown on a bounded sample of labelled rows
(``TRAIN_ROWS``, the smallest hashes of their ids) from histograms of binned statistics, and flattened into arrays, so that a
batch of documents walks a tree level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import PLAIN_WORDS, byte_rules, give_back, span_hashes, stage, text_chunks, windows, word_spans

#: Labelled rows that the trees are grown on at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 64, 0.15, 5.0
ACCEPT = 0.7

_LINES = byte_rules(b"\n", lower=False)
#: Bytes counted as a share of the text, by name.
GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r", "line_break": b"\n",
    "stop": b".,;:?", "shout": b"!", "bar": b"|", "symbol": b"#$%&*@^~+=<>/\\_", "quote": b"\"'()[]{}", "far": range(128, 256),
}
STATISTICS = (
    "log_bytes", "log_words", "word_length", "long_words", "one_letter_words", "words_per_line", "distinct_words", "top_word",
    "distinct_pairs", "distinct_lines", "short_lines", "word_end_marks", "capital_words", "digit_words", *GROUPS,
)
_GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _k, _bytes in enumerate(GROUPS.values()):
    _GROUP_OF[list(_bytes)] = _k


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS per text; all zeros for a null or empty one."""
    blocks = [np.zeros((0, len(STATISTICS)))]
    for first, last, data, begins in text_chunks(texts):
        count = last - first
        table = np.zeros((count, len(STATISTICS)))
        blocks.append(table)
        if not len(data):
            continue
        size = np.diff(begins)
        some = np.maximum(size, 1)
        starts, stops = word_spans(data, begins, PLAIN_WORDS[0])
        words_at = np.searchsorted(starts, begins)
        words = np.diff(words_at)
        many = np.maximum(words, 1)
        hashes = span_hashes(data, starts, stops, PLAIN_WORDS[1])
        pairs = windows(hashes, 2)
        line_starts, line_stops = word_spans(data, begins, _LINES[0])
        lines_at = np.searchsorted(line_starts, begins)
        lines = np.diff(lines_at)
        line_hashes = span_hashes(data, line_starts, line_stops, _LINES[1])
        length = stops - starts

        def share(flags: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return (total[at[1:]] - total[at[:-1]]) / of

        ends, heads = _GROUP_OF[data[stops - 1]], _GROUP_OF[data[starts]]
        columns = {
            "log_bytes": np.log1p(size), "log_words": np.log1p(words), "word_length": share(length, words_at, many),
            "long_words": share(length > 12, words_at, many), "one_letter_words": share(length == 1, words_at, many),
            "words_per_line": words / np.maximum(lines, 1), "short_lines": share(line_stops - line_starts < 20, lines_at, np.maximum(lines, 1)),
            "word_end_marks": share(ends >= 6, words_at, many), "capital_words": share(heads == 0, words_at, many),
            "digit_words": share(heads == 2, words_at, many),
        }
        for name, values in columns.items():
            table[:, STATISTICS.index(name)] = values
        owner = np.repeat(np.arange(count), size)
        groups = np.bincount(owner * (len(GROUPS) + 1) + _GROUP_OF[data], minlength=count * (len(GROUPS) + 1)).reshape(count, -1)
        table[:, len(STATISTICS) - len(GROUPS):] = groups[:, :len(GROUPS)] / some[:, None]
        distinct, top, two, lone = (STATISTICS.index(n) for n in ("distinct_words", "top_word", "distinct_pairs", "distinct_lines"))
        for k in np.flatnonzero(words):
            a, b = words_at[k], words_at[k + 1]
            counts = np.unique(hashes[a:b], return_counts=True)[1]
            table[k, distinct], table[k, top] = len(counts) / (b - a), counts.max() / (b - a)
            table[k, two] = len(np.unique(pairs[a:b - 1])) / (b - a - 1) if b - a > 1 else 1.0
            own = line_hashes[lines_at[k]:lines_at[k + 1]]
            table[k, lone] = len(np.unique(own)) / len(own)
    return np.concatenate(blocks)


class Trees(NamedTuple):
    """Complete trees of one depth: inner nodes by level, leaves after them; a row goes right where its value exceeds."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Second-order boosting of the logistic loss from histograms of binned columns."""
    count, width = rows.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    rate = (labels.sum() + 1) / (count + 2)
    base = float(np.log(rate / (1 - rate)))
    if not count or labels.min() == labels.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    cells = binned + np.arange(width) * bins
    margin = np.full(count, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - labels, p * (1 - p)
        node = np.zeros(count, np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            flat = ((node - first)[:, None] * (width * bins) + cells).ravel()
            g, h = (
                np.bincount(flat, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2)
                for v in (gradient, hessian)
            )
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g * total_g / (total_h + RIDGE)
            gain[(h < 1) | (total_h - h < 1)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            worth = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            cut = np.full(nodes, bins)
            for k in np.flatnonzero(worth):
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k], cut[k] = f, edges[f][b], b
            at = node - first
            right = binned[np.arange(count), feature[t, node]] > cut[at]
            node = 2 * node + 1 + right
        at = node - inner
        value = -np.bincount(at, gradient, leaves) / (np.bincount(at, hessian, leaves) + RIDGE)
        leaf[t] = RATE * value
        margin += leaf[t, at]
    return Trees(base, feature, threshold, leaf)


def predict(trees: Trees, rows: np.ndarray) -> np.ndarray:
    """Probability of label 1; every tree is walked for all rows at once, one level at a time."""
    margin = np.full(len(rows), trees.base)
    index = np.arange(len(rows))
    inner = trees.feature.shape[1]
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        node = np.zeros(len(rows), np.int64)
        while len(node) and node[0] < inner:
            node = 2 * node + 1 + (rows[index, feature[node]] > threshold[node])
        margin += leaf[node - inner]
    return 1 / (1 + np.exp(-margin))


def document_statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and ``statistics`` (an array), one row per row of ``docs``."""
    kind = dict(docs.dtypes)[doc]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(batch.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["key", "statistics"])

    rows = docs.select(F.col(doc).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(measure, f"key {kind}, statistics array<double>").withColumnRenamed("key", doc)


def fold(doc: str) -> "F.Column":
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4))


def fit(measured: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from labelled rows whose fold is not 2; rows without a label, with a null id, or of no document are left out."""
    known = labels.select(F.col(doc).alias("key"), F.col(label).cast("double").alias("label")).where("key is not null and label is not null")
    rows = known.join(measured.select(F.col(doc).alias("key"), "statistics"), "key").where(fold("key") != 2)
    sample = rows.orderBy(F.xxhash64("key"), "key", "label").limit(train_rows).toArrow()
    values = np.array(sample["statistics"].combine_chunks().flatten() if len(sample) else [], float).reshape(-1, len(STATISTICS))
    return grow(values, (sample["label"].to_numpy() > 0).astype(float))


def fit_sample(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """The trees of ``fit``, with statistics of the sampled documents only: at most ``train_rows`` labelled ids are picked first and broadcast."""
    known = labels.select(F.col(doc).alias("key"), F.col(label).cast("double").alias("label")).where("key is not null and label is not null")
    known = known.where(fold("key") != 2)
    order = (F.xxhash64("key"), "key", "label")
    present = known.join(docs.select(F.col(doc).alias("key")), "key", "left_semi")
    picked = stage(present.orderBy(*order).limit(train_rows), "picked").withColumnRenamed("key", "picked")
    named = docs.select(F.col(doc).alias("key"), F.col(text).alias("text"))
    chosen = named.join(F.broadcast(picked.select("picked").distinct()), F.col("key") == F.col("picked"), "left_semi")
    return fit(document_statistics(chosen, "key", "text"), picked.select(F.col("picked").alias("key"), "label"), "key", "label", train_rows)


def accepted(docs: DataFrame, trees: Trees, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows, as they are, whose text has at least the probability ``least`` of label 1; one pass, nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield part.filter(pa.array(predict(shared.value, statistics(part.column(at).cast(pa.string()))) >= least))
        give_back()

    return docs.mapInArrow(judge, docs.schema)


def score(measured: DataFrame, trees: Trees, doc: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """doc, held_out (fold 2; false for a null id), score, predicted (1 from ``accept`` on), one row per row."""
    shared = measured.sparkSession.sparkContext.broadcast(trees)
    kind = dict(measured.dtypes)[doc]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(predict(shared.value, rows))], ["key", "held_out", "score"])

    rows = measured.select(F.col(doc).alias("key"), F.coalesce(fold(doc) == 2, F.lit(False)).alias("held_out"), "statistics")
    scored = rows.mapInArrow(judge, f"key {kind}, held_out boolean, score double")
    return scored.select(F.col("key").alias(doc), "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every document; null and empty texts have statistics of zero and are scored like any other."""
    measured = stage(document_statistics(docs, doc, text), "statistics")
    return score(measured, fit(measured, labels, doc), doc)
