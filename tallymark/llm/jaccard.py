"""N-gram Jaccard join in the metric space of shingle sets, exact at every size.

Jaccard distance is a metric. Unrelated texts all lie at distance 1 from each other, so cells around documents of the whole
corpus would separate nothing: every window would hold everything. Regions are therefore made on two levels.

1. *Projections.* The space of shingles is cut into k parts by hash. Two sets that are close enough differ in fewer shingles than
   there are parts, so in at least one part they are at distance 0: their projections are the same point. Each distinct
   projection is a pivot, its region are the sets that project onto it. k follows from the sizes: sets of a size class
   and the next larger one, which the threshold lets them reach, use the same parts; a set on the boundary is replicated to
   the classes on both sides.
2. *Voronoi cells.* Sets whose regions are connected form a cell. Inside, documents are pivots: each set goes to the nearest
   pivot and, by the triangle inequality, also to every pivot that is at most twice the radius farther away, so no link is cut.
   Cells are split again until they are small, or until one component is left; what cannot be split is compared block by block.
   Large cells are first cut along shingles that are rare in them, so that a passage many texts share holds none together.

Only links that connect are kept, never all pairs of a group. Copies count once: equal sets are one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import (
    bitmap, components, give_back, in_bitmap, mixed, release_shuffles, shingle_sets, shuffle_partitions, small_batches, stage, stage_in,
)
from tallymark.session import drop_folder

#: Shingles in a cell that one task joins in memory; larger cells are split over tasks.
CELL_SHINGLES = 1_000_000
#: Keys that a task gathers before it sorts them and sends them on.
FLUSH_KEYS = 250_000
#: Rows whose keys one bucket gathers, about.
BUCKET_ROWS = 2_000
#: Shingles of large cells that one bucket counts, about.
BUCKET_TOKENS = 500_000
#: Pivots that split a large cell.
PIVOTS = 8

_PART = np.uint64(0xD6E8FEB86659FD93)
_LEVEL = np.uint64(0xA5A5A5A5A5A5A5A7)


class Sizes:
    """Size classes for a threshold in percent; classes and parts of a level are the same on every machine."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(self.bounds[-1] * 100 // percent + 1)

    def differing(self, smaller: int) -> int:
        """Shingles in which two linked sets differ at most: 100 i >= p (i + d) and i <= smaller."""
        return smaller * (100 - self.percent) // self.percent

    def level_of(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def parts(self, level: int) -> tuple[int, int]:
        """(parts, differences at most) of pairs whose smaller set is in the class; a few parts more than needed may be empty."""
        most = self.differing(self.bounds[level + 1] - 1)
        count = most + 1
        for _ in range(4):
            count = most + 3 + int(np.ceil(2 * count * np.exp(-self.bounds[level] / count)))
        return count, most


def set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a set; empty sets all have the same."""
    total = np.array([mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * _LEVEL], np.uint64)
    return int(mixed(total).view(np.int64)[0])


def region_keys(shingles: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Keys of the projections of a set, on the level of its class and on the one below.

    With more than ``most`` parts that are not empty one of them must be untouched, so empty parts are keys only for
    the rare set that has fewer.
    """
    own = sizes.level_of(len(shingles)) if len(shingles) else -1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles ^ _PART))])
    found = []
    for level in (own, own - 1):
        if level < 0:
            continue
        count, most = sizes.parts(level)
        if most == 0:
            continue  # such sets are linked only when they are equal
        part = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        ends = np.append(starts[1:], len(part))
        salt = np.array([level], np.uint64) * _LEVEL
        found.append(mixed((sums[ends] - sums[starts]) ^ mixed(part[starts] * _PART + salt)))
        if len(starts) <= most:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), part[starts])
            found.append(mixed(mixed(empty * _PART + salt)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


# ---- joining a cell in memory --------------------------------------------------------------------


class Cell:
    """Distinct sets of one cell, and which of them are known to be connected."""

    def __init__(self, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> None:
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.label = np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.radius = (100 - percent) / 100 + 1e-9

    def shared(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot with the members."""
        if len(members) == len(self.sets):
            flat, begins = self.flat, self.at[:-1]
        else:
            flat = np.concatenate([self.sets[m] for m in members])
            begins = np.concatenate([[0], np.cumsum(self.size[members])])[:-1]
        own = self.sets[pivot]
        inside = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        return np.add.reduceat(inside.astype(np.int64), begins)

    def meet(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Distances of the pivot to the members; links it to those within the radius."""
        shared = self.shared(pivot, members)
        union = self.size[pivot] + self.size[members] - shared
        near = members[100 * shared >= self.percent * union]
        for other in near[self.label[near] != self.label[pivot]].tolist():
            if self.label[other] != self.label[pivot]:
                self.links.append((pivot, other))
                self.label[self.label == self.label[other]] = self.label[pivot]
        return 1 - shared / union

    def settled(self, members: np.ndarray) -> bool:
        return len(members) < 2 or bool((self.label[members] == self.label[members[0]]).all())

    def central(self, members: np.ndarray) -> int:
        """The member whose shingles are the most common ones in the cell: the likely origin of copies."""
        flat = np.concatenate([self.sets[m] for m in members])
        _, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
        begins = np.concatenate([[0], np.cumsum(self.size[members])])[:-1]
        return int(np.argmax(np.add.reduceat(counts[code], begins) / self.size[members]))

    def join(self) -> list[tuple[int, int]]:
        work = [np.arange(len(self.sets))]
        while work:
            members = work.pop()
            if self.settled(members):
                continue
            if len(members) <= 12:
                self.sweep(members, [])
                continue
            one = self.central(members)
            to_one = self.meet(int(members[one]), members)
            if self.settled(members):
                continue
            two = int(np.argmax(to_one))
            to_two = self.meet(int(members[two]), members)
            if self.settled(members):
                continue
            # A set's cell is that of its nearest pivot; a set that links into the other cell is at most 2 r farther from there.
            first = members[(to_one <= to_two) | (to_one <= to_two + 2 * self.radius)]
            second = members[(to_two < to_one) | (to_two <= to_one + 2 * self.radius)]
            if max(len(first), len(second)) > 0.9 * len(members):
                self.sweep(members, [to_one, to_two])
            else:
                work += [first, second]
        return self.links

    def sweep(self, members: np.ndarray, known: list[np.ndarray]) -> None:
        """Every member meets those after it that are not connected with it yet, may be by size, and by their distances to pivots."""
        for k, pivot in enumerate(members[:-1].tolist()):
            rest = np.arange(k + 1, len(members))
            rest = rest[self.label[members[rest]] != self.label[pivot]]
            if not len(rest):
                continue
            small, large = np.minimum(self.size[members[rest]], self.size[pivot]), np.maximum(self.size[members[rest]], self.size[pivot])
            fits = 100 * small >= self.percent * large
            for distance in known:
                fits &= np.abs(distance[rest] - distance[k]) <= self.radius
            if fits.any():
                self.meet(pivot, members[rest[fits]])
                if self.settled(members):
                    return


# ---- Spark ---------------------------------------------------------------------------------------


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))


def document_sets(docs: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """doc, set_id and n (shingles) of every row."""
    kind = dict(docs.dtypes)[doc]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(set_id(s), len(s)) for s in shingle_sets(batch.column(1), words)]
            arrays = [pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc", "set_id", "n"])
        give_back()

    return _texts(docs, doc, text).mapInArrow(measure, f"doc {kind}, set_id long, n long")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key: distinct keys, the smallest id of each, and links (id, smallest id) of all others."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    leader = ids[np.flatnonzero(first)][np.cumsum(first) - 1] if len(ids) else ids
    other = ids != leader
    return keys[first], ids[first], np.unique(np.stack([ids[other], leader[other]], axis=1), axis=0)


def region_links(docs: DataFrame, text: str, words: int, percent: int, buckets: int) -> DataFrame:
    """Distinct pairs (a, b) of set ids that share a region: each set with the smallest id there.

    A task sorts its own keys first, so a region that a third of all sets lie in leaves it as one key and one link per
    set. Keys are sent as packed numbers, a row for each bucket.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            distinct, leaders, links = _stars(np.concatenate(keys), np.concatenate(ids))
            to = (distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, distinct[x:y].tobytes() + leaders[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            # Links need no further work; they travel with one of the buckets.
            data = [(b, 0, blob) for b, blob in rows]
            if len(links):
                data.append((int(distinct[0] % np.uint64(buckets)), 1, links.tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in data], pa.int32()), pa.array([d[1] for d in data], pa.int32()), pa.array([d[2] for d in data], pa.binary())],
                ["bucket", "kind", "data"])

        for batch in batches:
            for shingles in shingle_sets(batch.column(0), words):
                found = region_keys(shingles, sizes)
                if len(found):
                    keys.append(found)
                    ids.append(np.full(len(found), set_id(shingles), np.int64))
                    held += len(found)
                if held >= FLUSH_KEYS:
                    yield flush()
                    keys.clear()
                    ids.clear()
                    held = 0
        if held:
            yield flush()
        keys.clear()
        ids.clear()
        give_back()

    def gather(group: pa.Table) -> pa.Table:
        keys, ids, links = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for kind, data in zip(group["kind"].to_pylist(), group["data"]):
            data = data.as_buffer()
            if kind:
                links.append(np.frombuffer(data, np.int64).reshape(-1, 2))
            else:
                half = len(data) // 2
                keys.append(np.frombuffer(data[:half], np.uint64))
                ids.append(np.frombuffer(data[half:], np.int64))
        links.append(_stars(np.concatenate(keys), np.concatenate(ids))[2])
        found = np.unique(np.concatenate(links), axis=0)
        keys.clear()
        ids.clear()
        give_back()
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    packed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(emit, "bucket int, kind int, data binary")
    return packed.groupBy("bucket").applyInArrow(gather, "a long, b long").distinct()


def _sets_of(docs: DataFrame, doc: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """set_id, n and shingles of the rows whose hash is in the bitmap of ``wanted``; more rows may come out."""
    table = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "h"))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = in_bitmap(table.value, batch.column(1).to_numpy().view(np.uint64))
            texts = batch.column(0).filter(pa.array(inside))
            for first in range(0, len(texts), 500):
                sets = list(shingle_sets(texts.slice(first, 500), words))
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array(sizes), listed], ["set_id", "n", "shingles"])
        give_back()

    rows = _texts(docs, doc, text).select("text", F.xxhash64("doc").alias("h"))
    return rows.mapInArrow(admit, "set_id long, n long, shingles array<long>")


def _unpacked(shingles: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column of lists."""
    return [
        flat[a:b] for chunk in shingles.chunks for flat, ends in [(chunk.values.to_numpy().view(np.uint64), chunk.offsets.to_numpy())]
        for a, b in zip(ends[:-1], ends[1:])]


def _joined(members: DataFrame, group: str, percent: int) -> DataFrame:
    """Links (a, b) inside the cells of each group; ``members``: group, cell, set_id, shingles, label."""

    def join(rows: pa.Table) -> pa.Table:
        cells = rows["cell"].to_numpy()
        order = np.argsort(cells, kind="stable")
        ids, labels = rows["set_id"].to_numpy(), rows["label"].to_numpy()
        sets = _unpacked(rows["shingles"])
        a, b = [], []
        for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1) if len(order) else ():
            own, first = np.unique(ids[part], return_index=True)
            part = part[first]
            cell = Cell([sets[k] for k in part], percent, labels[part])
            for x, y in cell.join():
                a.append(int(own[x]))
                b.append(int(own[y]))
        del sets, rows
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy(group).applyInArrow(join, "a long, b long")


def _distances(members: DataFrame, percent: int) -> DataFrame:
    """cell, set_id, n, shingles, far (a distance for each pivot of the cell) and pivots; the pivots are drawn by hash."""
    drawn = members.groupBy("cell").agg(
        *[F.min(F.struct(F.xxhash64("set_id", F.lit(k)).alias("h"), "set_id"))["set_id"].alias(f"p{k}") for k in range(PIVOTS)],
        F.max("chunks").alias("chunks"),
    )
    chosen = drawn.select("cell", "chunks", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("set_id"))
    pivots = chosen.join(members.select("cell", "set_id", "shingles"), ["cell", "set_id"])
    spread = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("cell", "chunk", "set_id", "shingles")
    spread = spread.toDF("cell", "chunk", "set_id", "shingles")  # columns of its own

    def measure(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        order = np.argsort(pivots["set_id"].to_numpy())
        names = pivots["set_id"].to_numpy()[order]
        drawn = _unpacked(pivots["shingles"])
        sets = [drawn[k] for k in order] + _unpacked(rows["shingles"])
        cell = Cell(sets, percent)
        every = np.arange(len(sets))
        far = np.stack([cell.meet(k, every)[len(names):] for k in range(len(names))], axis=1)
        return pa.table({
            "cell": rows["cell"], "set_id": rows["set_id"], "n": rows["n"], "shingles": rows["shingles"], "label": rows["label"],
            "pivots": pa.array([names.tolist()] * len(far), pa.list_(pa.int64())), "far": pa.array(far.tolist(), pa.list_(pa.float64())),
        })

    return members.groupBy("cell", "chunk").cogroup(spread.groupBy("cell", "chunk")).applyInArrow(
        measure, "cell long, set_id long, n long, shingles array<long>, label long, pivots array<long>, far array<double>")


def _held(members: DataFrame, buckets: int) -> DataFrame:
    """set_id, shingle and held (sets of its cell that have it, more than one) of the shared shingles of every set.

    ``members``: cell, set_id, shingles. A shingle is a hash of the cell and the shingle, sent as packed numbers with the set's id.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flushes = np.cumsum(batch.column(2).value_lengths().to_numpy()) // FLUSH_KEYS
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(flushes)) + 1) if len(batch) else ():
                rows = batch.slice(part[0], len(part))
                sizes = rows.column(2).value_lengths().to_numpy()
                cells = mixed(rows.column(0).to_numpy().view(np.uint64))
                keys = mixed(rows.column(2).flatten().to_numpy().view(np.uint64) ^ np.repeat(cells, sizes))
                order = np.argsort(keys)
                keys, ids = keys[order], np.repeat(rows.column(1).to_numpy(), sizes)[order]
                cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                data = [(b, keys[x:y].tobytes() + ids[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in data], pa.int32()), pa.array([d[1] for d in data], pa.binary())], ["bucket", "data"])
        give_back()

    def count(group: pa.Table) -> pa.Table:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for data in group["data"]:
            data = data.as_buffer()
            keys.append(np.frombuffer(data[:len(data) // 2], np.uint64))
            ids.append(np.frombuffer(data[len(data) // 2:], np.int64))
        _, code, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        held = counts[code]
        some = held > 1
        found = [np.concatenate(ids)[some], np.concatenate(keys)[some].view(np.int64), held[some].astype(np.int32)]
        del keys, ids, code, counts, held
        give_back()
        return pa.table(dict(zip(("set_id", "shingle", "held"), map(pa.array, found))))

    packed = members.mapInArrow(emit, "bucket int, data binary")
    return packed.groupBy("bucket").applyInArrow(count, "set_id long, shingle long, held int")


def _refined(members: DataFrame, percent: int) -> DataFrame:
    """The same members in finer cells: sets are connected only by shingles that are rare in their cell.

    In any one order of the shingles, linked sets share one of their first ``n - ceil(p n) + 1``. The order is by how many sets
    of the cell hold a shingle, so a passage that many texts share comes last and no longer connects them; shingles that
    one set alone holds use up places, and a set whose places are all used up has no link.
    """
    spark = members.sparkSession
    tokens = members.agg(F.sum("n")).first()[0] or 0
    held = _held(members.select("cell", "set_id", "shingles"), max(64, 2 * shuffle_partitions(spark), tokens // BUCKET_TOKENS))
    shared = held.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
    own = shared.join(members.select("set_id", "n"), "set_id")
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    first = F.slice("shared", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))
    keys = stage(own.select("set_id", F.explode(first["shingle"]).alias("shingle")), "rare_keys")
    release_shuffles(spark)
    leaders = keys.groupBy("shingle").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last")).where("leader < last")
    links = stage(keys.join(leaders, "shingle").where("set_id > leader").select("set_id", "leader").distinct(), "rare_links")
    release_shuffles(spark)
    cells = stage(components(links, "set_id", "leader"), "rare_cells")
    # Most sets have no link left: only those whose id is in a bitmap are shuffled, and the join is exact.
    table = spark.sparkContext.broadcast(bitmap(cells, "node"))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(table.value, batch.column(0).to_numpy().view(np.uint64))))
        give_back()

    rows = members.select("set_id", "n", "shingles", "label")
    near = rows.mapInArrow(admit, rows.schema)
    return near.join(cells, F.col("set_id") == F.col("node")).select(F.col("root").alias("cell"), "set_id", "n", "shingles", "label")


def _split_large(members: DataFrame, percent: int, most: int) -> list[DataFrame]:
    """Links of cells with more than ``most`` shingles; ``members``: cell, set_id, n, shingles, label."""
    found, level = [], 0
    radius = (100 - percent) / 100 + 1e-9
    while True:
        weights = members.groupBy("cell").agg(F.sum("n").alias("weight"), F.count_distinct("label").alias("kinds"))
        open_ = weights.where("kinds > 1").select("cell", "weight")
        members = stage(members.join(open_, "cell").withColumn("chunks", F.ceil(F.col("weight") / most)).withColumn(
            "chunk", F.pmod(F.xxhash64("set_id", F.lit(level)), F.col("chunks"))), "members")
        if members.isEmpty():
            return found
        small = members.where("chunks = 1")
        found.append(_joined(small.withColumn("group", F.col("cell")), "group", percent))
        large = members.where("chunks > 1")
        if large.isEmpty():
            return found
        far = stage(_distances(large.select("cell", "set_id", "n", "shingles", "label", "chunks", "chunk"), percent), "distances")
        links = far.select(F.col("set_id").alias("a"), F.explode(F.arrays_zip("pivots", "far")).alias("to")).where(
            F.col("to.far") <= radius).select("a", F.col("to.pivots").alias("b")).where("a <> b")
        links = stage(links, "pivot_links")
        found.append(links)
        near = components(links, "a", "b")
        known = far.join(near, F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "label")).drop("node", "root")
        cells = F.filter(
            F.transform("far", lambda d, k: F.struct(d.alias("d"), F.xxhash64("cell", k, F.lit(level)).alias("cell"))),
            lambda x: x["d"] <= F.array_min("far") + 2 * radius)
        moved = stage(known.withColumn("to", F.explode(cells)).select(
            F.col("cell").alias("was"), F.col("to.cell").alias("cell"), "set_id", "n", "shingles", "label"), "cells")
        before = large.groupBy(F.col("cell").alias("was")).agg(F.max("weight").alias("whole"))
        after = moved.groupBy("was", "cell").agg(F.sum("n").alias("weight")).join(before, "was")
        stuck = after.where(F.col("weight") > 0.9 * F.col("whole")).select("was").distinct()
        # Cells that the pivots cannot split are compared chunk by chunk, every pair of chunks in a task of its own.
        whole = known.select("cell", "set_id", "n", "shingles", "label").join(stuck.withColumnRenamed("was", "cell"), "cell", "left_semi")
        whole = whole.join(large.select("cell", "set_id", "chunk", "chunks"), ["cell", "set_id"])
        blocks = whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn(
            "group", F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")))
        found.append(_joined(blocks.select("group", F.col("group").alias("cell"), "set_id", "shingles", "label"), "group", percent))
        members = moved.join(stuck, "was", "left_anti").drop("was")
        level += 1


def group_documents(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90, cell_shingles: int = CELL_SHINGLES,
) -> DataFrame:
    """doc, n_shingles and component_id of every row: the smallest id that links lead to, its own included.

    Two rows are linked when ``100 * shared >= percent * all`` distinct shingles of ``words`` words. Words lie between ASCII white
    space, A-Z count as a-z; a text with fewer words is one shingle; null texts and texts without words have no shingles and
    are linked with nothing. Sets are told apart by 64-bit hashes. Rows that share an id are separate rows; a null id never is
    the smallest unless all are null.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        known, joined = _grouped(docs, doc, text, words, percent, cell_shingles)
    # Copies are one point, and only points with copies or links are looked up: a join that can be split where one set is a third of all rows.
    points = known.where("n > 0").groupBy("set_id").agg(F.min("doc").alias("least"), F.count("*").alias("copies"))
    placed = points.join(joined, F.col("set_id") == F.col("node"), "left").where("copies > 1 or root is not null")
    placed = stage(placed.select("set_id", "least", F.coalesce("root", "set_id").alias("label")), "placed")
    classes = placed.join(placed.groupBy("label").agg(F.min("least").alias("component")), "label").select("set_id", "component", F.lit(True).alias("joint"))
    return known.join(classes, "set_id", "left").select(
        F.col("doc").alias(doc), F.col("n").alias("n_shingles"),
        F.when(F.col("joint") & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc")).alias("component_id"))


def _grouped(docs: DataFrame, doc: str, text: str, words: int, percent: int, cell_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and node and root of those that are linked."""
    spark = docs.sparkSession
    known = stage(document_sets(docs, doc, text, words), "sets")
    buckets = max(64, 2 * shuffle_partitions(spark), known.count() // BUCKET_ROWS)
    links = stage(region_links(docs, text, words, percent, buckets), "region_links")
    release_shuffles(spark)
    cells = stage(components(links, "a", "b"), "cells")
    release_shuffles(spark)
    members, folder = stage_in(_members(docs, doc, text, words, known, cells), "members")
    release_shuffles(spark)
    weights = members.groupBy("cell").agg(F.sum("n").alias("weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    groups = max(1, total // cell_shingles + 1)
    # Cells of so many shingles are fewer than groups, so they can be broadcast, and no set is shuffled to learn which it is in.
    heavy = F.broadcast(stage(weights.where(F.col("weight") > cell_shingles).select("cell"), "heavy"))
    small = members.join(heavy, "cell", "left_anti").withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(groups)))
    found = [stage(_joined(small.select("group", "cell", "set_id", "shingles", "label"), "group", percent), "links")]
    release_shuffles(spark)
    large = members.join(heavy, "cell", "left_semi").select("cell", "set_id", "n", "shingles", "label")
    if not large.isEmpty():
        found += _split_large(_refined(large, percent), percent, cell_shingles)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    joined = stage(components(every, "a", "b"), "components")
    drop_folder(spark, folder)
    return known, joined


def _members(docs: DataFrame, doc: str, text: str, words: int, known: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, set_id, n, shingles, label of one row of every set that lies in a cell."""
    inside = known.join(cells, F.col("set_id") == F.col("node")).groupBy("set_id").agg(F.min("doc").alias("doc"))
    sets = _sets_of(docs, doc, text, words, inside.select(F.xxhash64("doc").alias("h")))
    return (
        sets.dropDuplicates(["set_id"]).join(cells, F.col("set_id") == F.col("node"))
        .select(F.col("root").alias("cell"), "set_id", "n", "shingles", F.col("set_id").alias("label"))
    )
