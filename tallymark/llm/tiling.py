"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items become 64-bit Karp-Rabin hashes, runs of ``min_match`` words become seeds. Documents'
seeds pass a bitmap of the benchmark's seeds (bounded, whatever the benchmark's size) and are then joined with it exactly, so
only shared seeds are shuffled. Of each item only the rarest seeds are joined on, as many as any sufficient cover has to touch.
Each pair of a document and an item that such a seed brings together is tiled: the longest matches of unmarked
words are marked first, found by Karp-Rabin scans with falling lengths. Tiles may lie in any order, so reordered passages
count; an item is leaked when tiles cover enough of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bitmap, byte_rules, in_bitmap, stage, text_chunks, windows, word_hashes

MIN_MATCH = 5
MIN_COVERAGE = 0.6

_SPACES = byte_rules(b" ", lower=False)
_FACTOR = 0x9E3779B97F4A7C15
_WHOLE = (1 << 64) - 1


def normal_words(texts: pa.Array) -> pa.Array:
    """Lower case, everything but letters, digits and marks as single spaces."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    return pc.replace_substring_regex(lowered, pattern=r"[^\pL\pN\pM]+", replacement=" ")


def word_windows(docs: DataFrame, key: str, text: str, size: int, table=None) -> DataFrame:
    """key, whole (a hash of the text), words, at (positions) and seeds (hashes) of the runs of ``size`` words.

    With a bitmap only texts with an admitted seed come out, and only admitted seeds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = dict(docs.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admitted = shared.value
        for batch in batches:
            texts = normal_words(batch.column(2))
            for first, last, data, begins in text_chunks(texts):
                hashes, at = word_hashes(data, begins, _SPACES)
                seeds = windows(hashes, size)
                index = np.arange(len(seeds))
                text_of = np.searchsorted(at, index, "right") - 1
                wanted = index + size <= at[text_of + 1] if len(seeds) else np.zeros(0, bool)
                if admitted is not None:
                    wanted &= in_bitmap(admitted, seeds)
                chosen = np.flatnonzero(wanted)
                owner = text_of[chosen]
                counts = np.bincount(owner, minlength=last - first)
                rows = np.flatnonzero(counts) if admitted is not None else np.arange(last - first)
                ends = np.concatenate([[0], np.cumsum(counts[rows])]).astype(np.int32)
                some = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(some), batch.column(1).take(some), pa.array((at[1:] - at[:-1])[rows].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((chosen - at[owner]).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(seeds[chosen].view(np.int64))),
                ], ["key", "whole", "words", "at", "seeds"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("whole"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"key {kind}, whole long, words long, at array<int>, seeds array<long>")


def _prints(seeds: list[int]) -> list[int]:
    """Running sums from which the Karp-Rabin print of any stretch follows."""
    total, sums, power = 0, [0], 1
    for value in seeds:
        total = (total + value * power) & _WHOLE
        sums.append(total)
        power = power * _FACTOR & _WHOLE
    return sums


_powers = [1]


def _print(sums: list[int], start: int, count: int, last: int) -> int:
    """Print of ``count`` seeds from ``start``, brought to the common place ``last``."""
    while len(_powers) <= last:
        _powers.append(_powers[-1] * _FACTOR & _WHOLE)
    return (sums[start + count] - sums[start]) * _powers[last - start] & _WHOLE


def tiles(at: list[int], seeds: list[int], item: list[int], size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item with a document: (document word, item word, length), longest first.

    The document is given by the positions and hashes of its runs of ``size`` words that may match, in order, the item by the
    hashes of all its runs. No word is in two tiles; tiles have at least ``size`` words. Of equally long matches the first in the
    item is marked first, then the first in the document.
    """
    runs: list[tuple[int, list[int]]] = []
    for place, value in zip(at, seeds):
        if runs and place == runs[-1][0] + len(runs[-1][1]):
            runs[-1][1].append(value)
        else:
            runs.append((place, [value]))
    marked_doc: set[int] = set()
    marked_item = bytearray(len(item) + size - 1)
    item_sums, run_sums = _prints(item), [_prints(values) for _, values in runs]
    longest = max((len(v) for _, v in runs), default=0)
    last, search = max(len(item), longest), min(len(item), longest)
    found: list[tuple[int, int, int]] = []
    while search >= 1:
        words = search + size - 1
        prints: dict[int, list[int]] = {}
        for i in range(len(item) - search + 1):
            if not any(marked_item[i:i + words]):
                prints.setdefault(_print(item_sums, i, search, last), []).append(i)
        queue: list[tuple[int, int, int]] = []
        for (begin, values), sums in zip(runs, run_sums) if prints else ():
            for d in range(len(values) - search + 1):
                for i in prints.get(_print(sums, d, search, last), ()):
                    if values[d:d + search] != item[i:i + search] or not marked_doc.isdisjoint(range(begin + d, begin + d + words)):
                        continue
                    if d and i and values[d - 1] == item[i - 1] and not marked_item[i - 1] and begin + d - 1 not in marked_doc:
                        continue  # part of the match that begins one word earlier
                    count = search
                    while (d + count < len(values) and i + count < len(item) and values[d + count] == item[i + count]
                           and not marked_item[i + count + size - 1] and begin + d + count + size - 1 not in marked_doc):
                        count += 1
                    queue.append((-(count + size - 1), i, begin + d))
        heapq.heapify(queue)
        while queue:
            negative, i, d = heapq.heappop(queue)
            free = [k for k in range(-negative) if not marked_item[i + k] and d + k not in marked_doc]
            if len(free) == -negative:
                marked_item[i:i + len(free)] = b"\1" * len(free)
                marked_doc.update(range(d, d + len(free)))
                found.append((d, i, len(free)))
                continue
            first = 0  # what longer tiles have left of it goes back into the queue
            for k in range(1, len(free) + 1):
                if k == len(free) or free[k] != free[k - 1] + 1:
                    if k - first >= words:
                        heapq.heappush(queue, (first - k, i + free[first], d + free[first]))
                    first = k
        search //= 2
    return found


def telling_seeds(items: DataFrame, present: DataFrame, min_match: int, min_coverage: float) -> DataFrame:
    """item, item_whole, seed: the rarest seeds of each item without which it can't be covered as far as is asked.

    ``present`` has the item's seeds that texts hold, with the number of ``texts``. Seeds are taken out from the rarest on until what the others can
    cover is too little; a text in which the item leaks holds one of those taken out. An opening that thousands of texts share is
    thus never what brings a text and an item together, unless it makes up most of the item.
    """
    kinds = dict(items.dtypes)
    listed = present.groupBy("item", "item_whole").agg(F.array_sort(F.collect_list(F.struct("texts", "seed"))).alias("found"))
    both = items.alias("i").join(listed.alias("l"), F.expr("i.item <=> l.item and i.item_whole = l.item_whole")).select(
        "i.item", "i.item_whole", "i.item_words", "i.item_seeds", F.col("l.found.seed").alias("present"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for words, own, rare_first in zip(*(batch.column(c).to_pylist() for c in ("item_words", "item_seeds", "present"))):
                places: dict[int, list[int]] = {}
                for i, seed in enumerate(own):
                    places.setdefault(seed, []).append(i)
                over, taken = np.zeros(words, np.int64), []
                for seed in rare_first:
                    for i in places[seed]:
                        over[i:i + min_match] += 1
                for seed in rare_first:
                    if np.count_nonzero(over) < min_coverage * words:
                        break
                    taken.append(seed)
                    for i in places[seed]:
                        over[i:i + min_match] -= 1
                chosen.append(taken)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.list_(pa.int64()))], ["item", "item_whole", "chosen"])

    made = both.mapInArrow(choose, f"item {kinds['item']}, item_whole long, chosen array<long>")
    return made.select("item", "item_whole", F.explode("chosen").alias("seed"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """Pairs of a document and a benchmark item of whose words tiles cover at least ``min_coverage``.

    doc and item under their own names, ``whole`` (a hash of the document's text, which tells rows that share an id apart),
    item_tokens, covered_tokens, coverage, tiles (doc_start, item_start, length in words). Items with fewer than ``min_match``
    words hold no seed and are never leaked; null and empty texts neither leak nor are leaked; ids may be null; rows
    of the benchmark that share an id and a text count once; each of several texts under one id is an item of its own.
    """
    items = stage(
        word_windows(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), "item", "text", min_match)
        .where(F.size("seeds") > 0).dropDuplicates(["key", "whole"])
        .select(F.col("key").alias("item"), F.col("whole").alias("item_whole"), F.col("words").alias("item_words"), F.col("seeds").alias("item_seeds")),
        "items",
    )
    seeds = items.select("item", "item_whole", F.explode(F.array_distinct("item_seeds")).alias("seed"))
    table = bitmap(seeds, "seed")
    scanned = stage(word_windows(docs, doc, text, min_match, table).dropDuplicates(["key", "whole"]), "scanned")
    held = scanned.select("key", "whole", F.explode(F.array_distinct("seeds")).alias("seed"))
    telling = telling_seeds(items, seeds.join(held.groupBy("seed").agg(F.count("*").alias("texts")), "seed"), min_match, min_coverage)
    pairs = held.join(telling, "seed").select("key", "whole", "item", "item_whole").distinct()
    paired = (
        pairs.alias("p").join(scanned.alias("s"), F.expr("p.key <=> s.key and p.whole = s.whole"))
        .join(items.alias("i"), F.expr("p.item <=> i.item and p.item_whole = i.item_whole"))
        .select("p.key", "p.whole", "p.item", "i.item_words", "i.item_seeds", "s.at", "s.seeds")
    )
    kinds = dict(paired.dtypes)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, covers, found = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("item_words", "item_seeds", "at", "seeds")]
            for k, (words, own, at, values) in enumerate(zip(*columns)):
                # No tiling covers more words than the item's shared seeds do: the rest need not be tiled.
                present, most = set(values), bytearray(words)
                for i, seed in enumerate(own):
                    if seed in present:
                        most[i:i + min_match] = b"\1" * min_match
                if sum(most) < min_coverage * words:
                    continue
                wanted = set(own)
                hits = [(a, v) for a, v in zip(at, values) if v in wanted]
                got = tiles([a for a, _ in hits], [v for _, v in hits], own, min_match)
                covered = sum(t[2] for t in got)
                if covered >= min_coverage * words:
                    rows.append(k)
                    covers.append(covered)
                    found.append([dict(zip(("doc_start", "item_start", "length"), t)) for t in got])
            some = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(some) for c in ("key", "whole", "item", "item_words")]
                + [pa.array(covers, pa.int64()), pa.array(found, pa.list_(pa.struct([(n, pa.int32()) for n in ("doc_start", "item_start", "length")])))],
                ["key", "whole", "item", "item_tokens", "covered_tokens", "tiles"])

    made = paired.mapInArrow(
        tile, f"key {kinds['key']}, whole long, item {kinds['item']}, item_tokens long, covered_tokens long, "
        "tiles array<struct<doc_start:int,item_start:int,length:int>>")
    return made.select(
        F.col("key").alias(doc), "whole", F.col("item").alias(item), "item_tokens", "covered_tokens",
        (F.col("covered_tokens") / F.col("item_tokens")).alias("coverage"), "tiles",
    )
