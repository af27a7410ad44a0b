"""LM scoring by cross-entropy difference.

Two bigram models share one vocabulary, one smoothing and one size: the target model is counted over documents known to be
good, the background model over all documents, scaled down to as many words as the target has. A document's score is its loss
per word under the target model minus that under the background model: the lower, the more like the target.

``score_corpus`` takes every word of the corpus into the vocabulary; words and pairs are counted and judged in buckets whose
number grows with the corpus. ``fit`` and ``score`` make small models of a fixed size that can be kept and applied to other texts:
the most frequent words, one class for the end of a text, and a class for all other words by the kind of their last character.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import PLAIN_WORDS, bitmap, in_bitmap, mixed, span_hashes, stage, text_chunks, word_spans

VOCABULARY = 1024
#: Words that the unigram model counts for in every context.
STRENGTH = 8.0
#: Class 0 is the end of a text; unknown words are classed by their last byte.
END = 0
KINDS = np.full(256, 1, np.int64)
KINDS[[*range(48, 58)]] = 2
KINDS[[*b".,;:?'\")]}"]] = 3
KINDS[[*b"!"]] = 4
KINDS[[*range(128, 256)]] = 5
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\")]}!"]] = 6
CLASSES = 7


class Models(NamedTuple):
    words: np.ndarray  # sorted hashes of the known words
    ids: np.ndarray  # their ids
    target: np.ndarray  # loss of a word (column) after a word (row)
    background: np.ndarray


def _ids(data: np.ndarray, begins: np.ndarray, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of some texts, an end before the first text and after each, and where each text's ids begin."""
    ends, values = PLAIN_WORDS
    if not len(data):
        return np.full(len(begins), END, np.int64), np.arange(len(begins))
    starts, stops = word_spans(data, begins, ends)
    found = KINDS[data[stops - 1]]
    if len(words):
        hashes = span_hashes(data, starts, stops, values)
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        known = words[at] == hashes
        found[known] = ids[at[known]]
    firsts = np.searchsorted(starts, begins)
    all_ids = np.insert(found, np.concatenate([[0], firsts[1:]]), END)
    return all_ids, firsts + np.arange(len(begins))


def vocabulary(docs: DataFrame, text: str, size: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words of all documents (ties: smaller hash) and their ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for _, _, data, begins in text_chunks(batch.column(0)):
                if len(data):
                    starts, stops = word_spans(data, begins, PLAIN_WORDS[0])
                    hashes.append(span_hashes(data, starts, stops, PLAIN_WORDS[1]))
            words, counts = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word long, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(max(0, size - CLASSES)).toArrow()
    words = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], order + CLASSES


def bigrams(docs: DataFrame, text: str, words: np.ndarray, ids: np.ndarray, size: int = VOCABULARY) -> np.ndarray:
    """How often each id stands after each: summed in a table per task, then over the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((words, ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, data, begins in text_chunks(batch.column(0)):
                found, _ = _ids(data, begins, *known)
                table += np.bincount(found[:-1] * size + found[1:], minlength=size * size)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], ["cell", "n"])

    summed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return table.reshape(size, size)


def losses(counts: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """-log p(word | word before), Dirichlet-smoothed towards the add-one unigram model."""
    size = len(counts)
    unigram = (counts.sum(axis=0) + 1) / (counts.sum() + size)
    return -np.log((counts + strength * unigram) / (counts.sum(axis=1, keepdims=True) + strength)).astype(np.float32)


def _targets(docs: DataFrame, targets: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, text of the target documents.

    The ids go over a bitmap of bounded size before the exact join, so texts that are no targets are not shuffled.
    """
    wanted = targets.select(F.col(doc).alias("wanted")).where("wanted is not null").distinct()
    table = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("wanted").alias("h")), "h"))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = in_bitmap(table.value, batch.column(2).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(inside)).select([0, 1])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    admitted = rows.withColumn("h", F.xxhash64("doc")).mapInArrow(admit, rows.schema)
    # The number of labels has no bound: they are merged at every size, never broadcast.
    return admitted.join(wanted.hint("merge"), F.col("doc") == F.col("wanted"), "left_semi")


def fit(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", size: int = VOCABULARY) -> Models:
    """Both models; ``targets`` holds the ids (``doc``) of documents known to be good, ids that are null or unknown do nothing."""
    words, ids = vocabulary(docs, text, size)
    target = bigrams(_targets(docs, targets, doc, text), "text", words, ids, size)
    background = bigrams(docs, text, words, ids, size)
    if target.sum():
        background = background * (target.sum() / background.sum())
    return Models(words, ids, losses(target), losses(background))


def score(docs: DataFrame, models: Models, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tokens, target_loss, background_loss, score (their difference), one row per row of ``docs``.

    The end of a text is predicted like a word, so empty and null texts have a score too, that of the end alone; ``tokens``
    counts words only. Rows that share an id are scored one by one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = dict(docs.dtypes)[doc]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for _, _, data, begins in text_chunks(batch.column(1)):
                found, at = _ids(data, begins, known.words, known.ids)
                for k, table in enumerate((known.target, known.background)):
                    step = np.concatenate([[0.0], np.cumsum(table[found[:-1], found[1:]].astype(np.float64))])
                    columns[k].append(step[at[1:]] - step[at[:-1]])
                columns[2].append(np.diff(at))
            target, background, steps = (np.concatenate(c) if c else np.zeros(0) for c in columns)
            arrays = [pa.array((steps - 1).astype(np.int64)), pa.array(target / steps), pa.array(background / steps), pa.array((target - background) / steps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", "tokens", "target_loss", "background_loss", "score"])

    rows = docs.select(F.col(doc).alias("key"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(judge, f"key {kind}, tokens long, target_loss double, background_loss double, score double")
    return made.withColumnRenamed("key", doc)


# ---- every word in the vocabulary ----------------------------------------------------------------

#: Words and pairs that make up this share of the corpus, one in HOT, are hot: there are HOT of each at most.
HOT = 4096
#: Words that a task gathers before it deals them out, and rows of them at most.
FLUSH_WORDS, FLUSH_ROWS = 1_500_000, 60_000
#: Words of the corpus in a bucket.
BUCKET_WORDS = 2_000_000
END_WORD = np.uint64(0)


class Corpus(NamedTuple):
    size: int  # distinct words and the end of a text
    target: int  # words of the target documents, ends included
    background: int
    hot: np.ndarray  # sorted hashes of the hot words
    hot_target: np.ndarray  # their counts
    hot_background: np.ndarray
    pairs: np.ndarray  # sorted cells of the hot pairs: place in ``hot`` of the word before, times their number, plus that of the word
    pair_losses: np.ndarray  # a row for the target, one for the background

    def losses(self, pair_t: np.ndarray, pair_b: np.ndarray, word_t: np.ndarray, word_b: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
        """Losses of pairs under both models, from their counts and those of their second words.

        The normaliser is that of the second word, not of the first: every text begins and ends with the end of a text, so its
        words stand first in as many pairs as second, and the sum over a text is the same.
        """
        scale = self.target / self.background if self.target else 1.0
        made = []
        for pair, word, total in ((pair_t, word_t, self.target), (pair_b * scale, word_b * scale, self.background * scale)):
            made.append(np.log(word + strength) - np.log(pair + strength * (word + 1) / (total + self.size)))
        return np.stack(made)


def _sequence(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, an end before the first text and after each, and where each text's words begin."""
    if not len(data):
        return np.full(len(begins), END_WORD, np.uint64), np.arange(len(begins))
    starts, stops = word_spans(data, begins, PLAIN_WORDS[0])
    firsts = np.searchsorted(starts, begins)
    hashes = span_hashes(data, starts, stops, PLAIN_WORDS[1])
    return np.insert(hashes, np.concatenate([[0], firsts[1:]]), END_WORD), firsts + np.arange(len(begins))


def _places(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value among the sorted ones, and whether it is one of them."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


def _counted(docs: DataFrame, good: DataFrame, keys) -> DataFrame:
    """key, n, t: how often each key occurs in all texts and in those of the targets, summed per batch before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys(*_sequence(data, begins)) for _, _, data, begins in text_chunks(batch.column(0))]
            values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

    sides = [side.select("text").mapInArrow(count, "key long, n long") for side in (docs, good)]
    both = sides[0].withColumn("t", F.lit(0).cast("long")).unionByName(sides[1].select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("t")))
    return both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _corpus(docs: DataFrame, good: DataFrame) -> Corpus:
    words = stage(_counted(docs, good, lambda ids, at: ids[1:]), "words")
    size, background, target = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    top = words.where(F.col("n") * HOT >= background).toArrow()
    hashes = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hot, hot_b, hot_t = hashes[order], top["n"].to_numpy()[order], top["t"].to_numpy()[order]

    def cells(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        places, known = _places(hot, ids)
        both = known[:-1] & known[1:]
        return (places[:-1][both] * len(hot) + places[1:][both]).astype(np.uint64)

    # Both words of a hot pair are hot.
    pairs = _counted(docs, good, cells).where(F.col("n") * HOT >= background).toArrow()
    order = np.argsort(pairs["key"].to_numpy())
    found = pairs["key"].to_numpy()[order]
    corpus = Corpus(size, target, background, hot, hot_t, hot_b, found, np.zeros((2, 0)))
    second = found % max(1, len(hot))
    return corpus._replace(pair_losses=corpus.losses(pairs["t"].to_numpy()[order], pairs["n"].to_numpy()[order], hot_t[second], hot_b[second]))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


_DEALT = pa.schema([
    ("flush", pa.int64()), ("bucket", pa.int32()), ("target", pa.bool_()), ("head", pa.binary()),
    ("words", pa.binary()), ("runs", pa.binary()), ("befores", pa.binary()), ("rows", pa.binary())])
_SUMMED = pa.schema([("flush", pa.int64()), ("head", pa.binary()), ("rows", pa.binary()), ("sums", pa.binary())])


def _dealer(corpus, buckets: int, target: bool):
    """Deals the pairs of texts into buckets by their second word, those of hot second words by the pair; hot pairs are judged at once."""

    def emit(flush: int, parts: list, docs: list) -> Iterator[pa.RecordBatch]:
        known = corpus.value
        one, two, rows = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        count = sum(len(d) for d in docs)
        words = np.bincount(rows, minlength=count) - 1
        (at_one, hot_one), (at_two, hot_two) = _places(known.hot, one), _places(known.hot, two)
        at, judged = _places(known.pairs, at_one * len(known.hot) + at_two)
        judged &= hot_one & hot_two
        if not target:
            sums = [np.bincount(rows[judged], weights=loss[at[judged]], minlength=count).astype(float) for loss in known.pair_losses]
            head = pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(words), *map(pa.array, sums)], ["doc", "tokens", "t", "b"])
            yield pa.RecordBatch.from_pylist([{"flush": flush, "bucket": flush % buckets, "target": False, "head": _packed(head)}], _DEALT)
        one, two, rows, hot_two = (x[~judged] for x in (one, two, rows, hot_two))
        to = (mixed(np.where(hot_two, _pair(one, two), two)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(two)
        order = order[np.argsort(to[order], kind="stable")]
        one, two, to = one[order], two[order], to[order]
        rows = rows[order].astype(np.uint16 if count <= 1 << 16 else np.uint32)
        begins = np.flatnonzero(np.concatenate([[True], (two[1:] != two[:-1]) | (to[1:] != to[:-1])])) if len(two) else np.zeros(0, np.int64)
        runs = np.diff(np.append(begins, len(two))).astype(np.uint32)
        for bucket in np.unique(to).tolist():
            a, b = np.searchsorted(to, np.array([bucket, bucket + 1]))
            c, d = np.searchsorted(begins, [a, b])
            blobs = two[begins[c:d]], runs[c:d], one[a:b], rows[a:b] if not target else rows[:0]
            yield pa.RecordBatch.from_pylist([{
                "flush": flush, "bucket": bucket, "target": target, **{n: x.tobytes() for n, x in zip(("words", "runs", "befores", "rows"), blobs)}}], _DEALT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, parts, docs, held = TaskContext.get().partitionId() << 32, [], [], [0, 0]
        for batch in batches:
            for first, last, data, begins in text_chunks(batch.column(1)):
                ids, at = _sequence(data, begins)
                parts.append((ids[:-1], ids[1:], np.repeat(np.arange(last - first, dtype=np.int32) + np.int32(held[1]), np.diff(at))))
                docs.append(batch.column(0).slice(first, last - first))
                held = [held[0] + len(ids) - 1, held[1] + last - first]
                if held[0] >= FLUSH_WORDS or held[1] >= FLUSH_ROWS:
                    yield from emit(flush, parts, docs)
                    flush, parts, docs, held = flush + 1, [], [], [0, 0]
        if docs:
            yield from emit(flush, parts, docs)

    return deal


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mixed(mixed(one + np.uint64(1)) + two)


def _bucket_judge(corpus):
    """Counts the pairs and second words of a bucket, which has all of each, and sums the losses of every row in it."""

    def judge(group: pa.Table) -> pa.Table:
        known = corpus.value
        heads = group.filter(pc.is_valid(group["head"]))
        dealt = group.filter(pc.is_null(group["head"])).to_pylist()
        out = [{"flush": f, "head": h} for f, h in zip(heads["flush"].to_pylist(), heads["head"].to_pylist())]
        if dealt:
            two = np.concatenate([np.repeat(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["runs"], np.uint32)) for r in dealt])
            sizes = [len(r["befores"]) // 8 for r in dealt]
            one = np.concatenate([np.frombuffer(r["befores"], np.uint64) for r in dealt])
            good = np.repeat([r["target"] for r in dealt], sizes)
            _, first, pair = np.unique(_pair(one, two), return_index=True, return_inverse=True)
            words, word = np.unique(two, return_inverse=True)
            of_pair = word[first]
            (pair_b, pair_t), (word_b, word_t) = (
                [np.bincount(x[side], minlength=size) for side in (~good, good)] for x, size in ((pair, len(first)), (word, len(words))))
            at, hot = _places(known.hot, words)
            word_b[hot], word_t[hot] = known.hot_background[at[hot]], known.hot_target[at[hot]]
            losses = known.losses(pair_t, pair_b, word_t[of_pair], word_b[of_pair])
            end = 0
            for r, size in zip(dealt, sizes):
                begin, end = end, end + size
                if r["target"]:
                    continue
                rows = np.frombuffer(r["rows"], np.uint16 if len(r["rows"]) == 2 * size else np.uint32)
                held = np.unique(rows)
                sums = np.stack([np.bincount(rows, weights=loss[pair[begin:end]])[held] for loss in losses]).astype(np.float32)
                out.append({"flush": r["flush"], "rows": held.astype(np.uint32).tobytes(), "sums": sums.tobytes()})
        return pa.Table.from_pylist(out, _SUMMED)

    return judge


def score_corpus(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``score`` gives, by models that know every word of ``docs``: no word is merged with another.

    Counts of words and pairs grow with the corpus and are never gathered in one place. Each task deals the pairs of its texts
    into buckets by their second word; a bucket counts them, which settles their losses, and sends back one sum per text.
    Pairs behind hot words are dealt one by one, and the few hot pairs are counted first and judged where they stand.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    good = stage(_targets(docs, targets, doc, text), "targets")
    corpus = _corpus(rows, good)
    buckets = max(16, -(-corpus.background // BUCKET_WORDS))
    shared = spark.sparkContext.broadcast(corpus)
    binary = "head binary, words binary, runs binary, befores binary, rows binary"
    dealt = [side.mapInArrow(_dealer(shared, buckets, of), f"flush long, bucket int, target boolean, {binary}") for side, of in ((rows, False), (good, True))]
    summed = dealt[0].unionByName(dealt[1]).groupBy("bucket").applyInArrow(
        _bucket_judge(shared), "flush long, head binary, rows binary, sums binary")

    def gather(group: pa.Table) -> pa.Table:
        head, parts = None, []
        for r in group.to_pylist():
            if r["head"] is not None:
                head = pa.ipc.open_stream(r["head"]).read_all()
            else:
                parts.append((np.frombuffer(r["rows"], np.uint32), np.frombuffer(r["sums"], np.float32).reshape(2, -1)))
        steps = head["tokens"].to_numpy() + 1
        sums = [head["t"].to_numpy().copy(), head["b"].to_numpy().copy()]
        for held, losses in parts:
            for total, loss in zip(sums, losses):
                total[held] += loss
        target, background = (total / steps for total in sums)
        return pa.table([head["doc"], head["tokens"], pa.array(target), pa.array(background), pa.array(target - background)],
                        ["key", "tokens", "target_loss", "background_loss", "score"])

    kind = dict(docs.dtypes)[doc]
    made = summed.groupBy("flush").applyInArrow(gather, f"key {kind}, tokens long, target_loss double, background_loss double, score double")
    return made.withColumnRenamed("key", doc)
