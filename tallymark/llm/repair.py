"""Conversation structure repair by a run-length dynamic programme.

A conversation has to read ``(system? (user assistant)+)?``. Turns are kept, given another role, deleted or inserted at costs; what a
turn may cost follows from its symbol alone (role and fault), as a min-plus transition between four states: nothing read yet,
system, user or assistant read last. Equal consecutive symbols are collapsed into runs, and a run is crossed by the binary powers of
its symbol's transition, which are computed once per worker. The choices are unrolled from the same powers, block by block:
blocks of one symbol, length, state and costs behind them are unrolled once.

Transitions compose, so a conversation of any length is cut into segments: rows are sorted over ranges of (conversation, turn), every
segment is reduced to one transition, and only those are gathered for a conversation. Texts are not sorted: what is worked on
are their hashes, and the texts of kept turns are joined at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import shuffle_partitions, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns that are reduced to one transition.
SEGMENT = 1 << 14
INF = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that follows when a turn is read as user or assistant, whichever has to come.
NEXT = (USER, USER, ASSISTANT, USER)
ACCEPTED = (0, INF, INF, 0)
#: Symbols: role (s, u, a, other) + 4 if truncated; a turn that has to go has one of its own.
ROLES = "sua"
GONE = 8

Matrix = tuple[tuple[int, ...], ...]


def product(one: Matrix, other: Matrix) -> Matrix:
    return tuple(tuple(min(min(INF, row[k] + other[k][j]) for k in range(4)) for j in range(4)) for row in one)


def applied(matrix: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(INF, row[k] + costs[k]) for k in range(4)) for row in matrix)


IDENTITY: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
_ONE = tuple(tuple(0 if i == j else INSERT if j == NEXT[i] else INF for j in range(4)) for i in range(4))
#: Any number of insertions: more than three lead to no further state.
INSERTED = product(product(_ONE, _ONE), _ONE)
#: Costs at the end of a conversation.
END = applied(INSERTED, ACCEPTED)


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of reading one turn, in the order of the edits' letters."""
    found = [("D", DELETE, state)]
    if symbol < GONE:
        role, extra = symbol % 4, TRUNCATED * (symbol // 4)
        if role == 0 and state == START:
            found.append(("K", KEEP + extra, SYSTEM))
        elif role in (1, 2) and NEXT[state] == role + 1:
            found.append(("K", KEEP + extra, role + 1))
        found.append(("R", REROLE + extra, NEXT[state]))
    return found


@lru_cache(None)
def power(symbol: int, log2: int) -> Matrix:
    """Transition of 2 ** log2 turns with the symbol, insertions before each of them included."""
    if log2:
        return product(power(symbol, log2 - 1), power(symbol, log2 - 1))
    read = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in choices(symbol, state):
            read[state][to] = min(read[state][to], cost)
    return product(INSERTED, tuple(map(tuple, read)))


def blocks(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(symbol, log2 of the length) of the blocks that make up the runs, in order."""
    return [(symbol, k) for symbol, length in runs for k in range(length.bit_length()) if length >> k & 1]


@lru_cache(1 << 14)
def _short_transition(runs: tuple[tuple[int, int], ...]) -> Matrix:
    made = IDENTITY
    for symbol, log2 in blocks(list(runs)):
        made = product(made, power(symbol, log2))
    return made


def transition(runs: list[tuple[int, int]]) -> Matrix:
    """Min-plus transition of a segment; those of a few runs recur and are kept."""
    made = IDENTITY
    for first in range(0, len(runs), 16):
        made = product(made, _short_transition(tuple(runs[first:first + 16])))
    return made


@lru_cache(1 << 10)
def _unrolled(symbol: int, log2: int, state: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """Edits of 2 ** log2 turns and the state after them, by the costs of the states behind them."""
    if log2:
        half, state = _unrolled(symbol, log2 - 1, state, _level(applied(power(symbol, log2 - 1), behind))[1])
        rest, state = _unrolled(symbol, log2 - 1, state, behind)
        return half + rest, state
    before, made = applied(power(symbol, 0), behind), ""
    while True:
        options = [(edit, cost + behind[to], to) for edit, cost, to in choices(symbol, state)]
        options.append(("I", INSERT + before[NEXT[state]], NEXT[state]))
        edit, _, state = min(o for o in options if o[1] == before[state])
        made += edit
        if edit != "I":
            return made, state


def _level(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The least cost, and what the others have above it: choices depend on differences only."""
    least = min(costs)
    return least, tuple(min(INF, c - least) if c < INF else INF for c in costs)


def unroll(runs: list[tuple[int, int]], state: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """The cheapest edits of a segment, of equally cheap ones the ASCII-least, and the state after it."""
    parts = blocks(runs)
    costs = [behind]
    for symbol, log2 in reversed(parts):
        costs.append(applied(power(symbol, log2), costs[-1]))
    made = []
    for k, (symbol, log2) in enumerate(parts):
        edits, state = _unrolled(symbol, log2, state, _level(costs[len(parts) - 1 - k])[1])
        made.append(edits)
    return "".join(made), state


def ending(state: int) -> str:
    """Insertions after the last turn."""
    made = ""
    while ACCEPTED[state]:
        made, state = made + "I", NEXT[state]
    return made


# ---- rows ----------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with known damage, by crc32 of ``conv:turn`` modulo 20: dropped, emptied, without end marks, repeated, all from the user.

    Null roles and texts are one space, and so are null ids and turns in the hash. Columns keep their names; others are dropped.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    plain = rows.select(F.col(conv).alias("c"), F.col(turn).alias("t"), spaced(role).alias("r"), spaced(text).alias("x"), kind.alias("k")).where("k <> 0")
    changed = plain.select(
        "c", "t", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("r")).alias("r"),
        F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("x", ".!?", "")).otherwise(F.col("x")).alias("x"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
    return changed.select(F.col("c").alias(conv), F.col("t").alias(turn), F.col("r").alias(role), F.col("x").alias(text))


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """The columns of both, joined on columns of equal names; nulls are equal."""
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    return left.join(other, reduce(and_, (F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names)), how).drop(*(f"__{n}" for n in names))


def marked(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest (of the text), initial, blank, cut, first (the first turn with that role and text) of conv, turn, role, text."""
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    slim = rows.select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    known = slim.where("not blank").groupBy("conv", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn")).alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return matched(slim, known, ["conv", "role", "digest"], "left").select(
        *slim.columns, F.col("first").isNotNull().alias("repeated"), F.col("first.turn").alias("first"))


ORDERED = (
    "conv {conv}, turn {turn}, role string, digest binary, part int, segment long, place int, symbol int, inner_illegal long, opening string, "
    "closing string, runs array<struct<symbol:int,length:int>>, matrix array<long>"
)


def ordered(slim: DataFrame) -> DataFrame:
    """The rows of ``marked`` in order, in segments, with their symbols; the last row of a segment has what the segment comes to."""
    kinds = dict(slim.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, place = TaskContext.get().partitionId(), 0, 0
        before, conv, size = None, object(), 0
        runs: list[list[int]] = []
        illegal, opening, closing = 0, None, None
        held: dict | None = None

        def close(row: dict) -> dict:
            made = transition([tuple(r) for r in runs])
            return row | {
                "inner_illegal": illegal, "opening": opening, "closing": closing, "runs": [{"symbol": s, "length": n} for s, n in runs],
                "matrix": [cost for line in made for cost in line]}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None and (row["conv"] != conv or size == SEGMENT):
                    out.append(close(held))
                    segment, place, size, runs, illegal, opening = segment + 1, 0, 0, [], 0, None
                    if row["conv"] != conv:
                        before = None
                elif held is not None:
                    out.append(held)
                key = (row["turn"], row["role"], row["digest"])
                if row["blank"] or before == key or row["repeated"] and row["turn"] != row["first"]:
                    symbol = GONE
                else:
                    symbol = (ROLES.index(row["initial"]) if row["initial"] and row["initial"] in ROLES else 3) + 4 * row["cut"]
                if size:
                    illegal += closing + row["initial"] not in ("su", "ua", "au")
                else:
                    opening = row["initial"]
                if runs and runs[-1][0] == symbol:
                    runs[-1][1] += 1
                else:
                    runs.append([symbol, 1])
                before, conv, closing, size = key, row["conv"], row["initial"], size + 1
                held = {n: row[n] for n in ("conv", "turn", "role", "digest")} | {
                    "part": part, "segment": segment, "place": place, "symbol": symbol, "inner_illegal": None, "opening": None,
                    "closing": None, "runs": None, "matrix": None}
                place += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema_of(batch))
                last = batch
        if held is not None:
            yield pa.RecordBatch.from_pylist([close(held)], schema=schema_of(batch))

    def schema_of(batch: pa.RecordBatch) -> pa.Schema:
        own = batch.schema
        return pa.schema([
            ("conv", own.field("conv").type), ("turn", own.field("turn").type), ("role", pa.string()), ("digest", pa.binary()), ("part", pa.int32()),
            ("segment", pa.int64()), ("place", pa.int32()), ("symbol", pa.int32()), ("inner_illegal", pa.int64()), ("opening", pa.string()),
            ("closing", pa.string()), ("runs", pa.list_(pa.struct([("symbol", pa.int32()), ("length", pa.int32())]))), ("matrix", pa.list_(pa.int64()))])

    order = ["conv", "turn", "role", "digest"]
    ranged = slim.repartitionByRange(shuffle_partitions(slim.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(cut, ORDERED.format(conv=kinds["conv"], turn=kinds["turn"]))


def solved(segments: DataFrame) -> DataFrame:
    """conv, part, segment, runs, behind (costs after the segment), cost and illegal (of the conversation), last, alone."""
    kind = dict(segments.dtypes)["conv"]

    def back(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["segment"]))
        costs, behind = END, []
        for row in reversed(rows):
            behind.append(list(costs))
            flat = row["matrix"]
            costs = applied(tuple(tuple(flat[4 * k:4 * k + 4]) for k in range(4)), costs)
        illegal = sum(r["inner_illegal"] for r in rows)
        illegal += sum(a["closing"] + b["opening"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        count = len(rows)
        return pa.table({
            "conv": pa.array([r["conv"] for r in rows], group["conv"].type), "part": pa.array([r["part"] for r in rows], pa.int32()),
            "segment": pa.array([r["segment"] for r in rows], pa.int64()), "behind": pa.array(behind[::-1], pa.list_(pa.int64())),
            "cost": pa.array([costs[START]] * count, pa.int64()), "illegal": pa.array([illegal] * count, pa.int64()),
            "last": pa.array([k == count - 1 for k in range(count)]), "alone": pa.array([count == 1] * count)})

    counted = segments.withColumn("own", F.count("*").over(Window.partitionBy("conv")))
    slim = counted.where("own > 1").select("conv", "part", "segment", "matrix", "inner_illegal", "opening", "closing")
    several = slim.groupBy("conv").applyInArrow(
        back, f"conv {kind}, part int, segment long, behind array<long>, cost long, illegal long, last boolean, alone boolean")
    # Nearly all conversations are one segment: their cost is read off its transition.
    end = F.array(*(F.lit(cost).cast("long") for cost in END))
    alone = counted.where("own = 1").select(
        "conv", "part", "segment", end.alias("behind"), F.array_min(F.zip_with(F.slice("matrix", 1, 4), end, lambda a, b: a + b)).alias("cost"),
        F.col("inner_illegal").alias("illegal"), F.lit(True).alias("last"), F.lit(True).alias("alone"))
    return segments.select("part", "segment", "runs").join(several.unionByName(alone), ["part", "segment"])


def entered(parts: DataFrame) -> DataFrame:
    """The rows of ``solved`` with the state in which the cheapest way enters each segment."""
    kind = dict(parts.dtypes)["conv"]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits = [
                [unroll([(r["symbol"], r["length"]) for r in runs], state, tuple(behind))[1] for state in range(4)]
                for runs, behind in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(exits, pa.list_(pa.int32()))], ["conv", "part", "segment", "exits"])

    def forward(group: pa.Table) -> pa.Table:
        rows, state, found = sorted(group.to_pylist(), key=lambda r: (r["part"], r["segment"])), START, []
        for row in rows:
            found.append({"part": row["part"], "segment": row["segment"], "entry": state})
            state = row["exits"][state]
        return pa.Table.from_pylist(found, schema=pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("entry", pa.int32())]))

    several = parts.where("not alone")
    exits = several.select("conv", "part", "segment", "runs", "behind").mapInArrow(leave, f"conv {kind}, part int, segment long, exits array<int>")
    states = exits.groupBy("conv").applyInArrow(forward, "part int, segment long, entry int")
    return parts.where("alone").withColumn("entry", F.lit(START)).unionByName(several.join(states, ["part", "segment"]))


def steps(parts: DataFrame) -> DataFrame:
    """conv, part, segment, steps: place (of the turn in the segment, or of the one it stands before), edit and the role it sets."""
    kind = dict(parts.dtypes)["conv"]
    step = pa.struct([("place", pa.int32()), ("edit", pa.string()), ("role", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for runs, behind, state, last in zip(*(batch.column(k).to_pylist() for k in range(3, 7))):
                made, end = unroll([(r["symbol"], r["length"]) for r in runs], state, tuple(behind))
                symbols, own = [r["symbol"] for r in runs for _ in range(r["length"])], []
                place = 0
                for edit in made + (ending(end) if last else ""):
                    if edit == "K" and symbols[place] % 4 == 0:
                        state = SYSTEM
                    elif edit != "D":
                        state = NEXT[state]
                    own.append({"place": place, "edit": edit, "role": ("user" if state == USER else "assistant") if edit in "IR" else None})
                    place += edit != "I"
                found.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(step))], ["conv", "part", "segment", "steps"])

    rows = parts.select("conv", "part", "segment", "runs", "behind", "entry", "last")
    return rows.mapInArrow(walk, f"conv {kind}, part int, segment long, steps array<struct<place:int,edit:string,role:string>>")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repaired conversations, and per conversation what was found and done.

    Rows of a conversation are taken by turn (nulls first), then role, then the text's SHA-256. A row's first fault counts: blank (no
    character but ASCII white space), duplicate (role and text seen earlier), truncated (the last such character is none of ``.!?``).
    Null roles and texts count as one space. Deleting costs 2 and is required for blank and duplicate rows, another role 1, an
    inserted empty turn 5, keeping a truncated one 5 more. Of the cheapest ways the one with the ASCII-least letters (D, I, K, R) is taken.

    First frame: conv, part, segment, step (their order), edit, role, text of every turn that stands afterwards. Second frame:
    conv, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows. Conversations with a null
    id are one conversation; other columns are not read; an empty table gives two.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    slim = stage(marked(plain), "turns")
    lined = stage(ordered(slim), "ordered")
    parts = stage(entered(stage(solved(lined.where("matrix is not null")), "solved")), "entered")
    walked = stage(steps(parts), "steps")

    faults = lined.groupBy("conv").agg(F.count_if(F.col("symbol") == GONE).alias("gone"), F.count_if(F.col("symbol").between(4, 7)).alias("truncated"))
    turns = slim.groupBy("conv").agg(
        F.count_if("blank").alias("blank"),
        F.coalesce(F.expr("try_cast(cast(max(turn) AS decimal(38,0)) - min(turn) + 1 - count(DISTINCT turn) AS long)"), F.lit(0)).cast("long").alias("gaps"))
    audits = walked.join(parts.select("part", "segment", "cost", "illegal"), ["part", "segment"]).groupBy("conv").agg(
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("part", "segment", F.array_join("steps.edit", "").alias("edits")))).alias("edits"))
    summary = matched(matched(turns, faults, ["conv"]), audits, ["conv"]).select(
        "conv", "gaps", "blank", (F.col("gone") - F.col("blank")).alias("duplicate"), "truncated", "illegal", "cost",
        F.array_join(F.col("edits.edits"), "").alias("audit"))

    done = walked.select("part", "segment", "conv", F.posexplode("steps").alias("step", "made")).where("made.edit <> 'D'").select(
        "conv", "part", "segment", "step", F.col("made.place").alias("place"), F.col("made.edit").alias("edit"), F.col("made.role").alias("new_role"))
    # A turn that stands is the only one of its conversation with its role and text.
    standing = done.where("edit <> 'I'").join(lined.select("part", "segment", "place", "turn", "role", "digest"), ["part", "segment", "place"])
    texts = plain.withColumn("digest", F.unhex(F.sha2("text", 256))).dropDuplicates(["conv", "turn", "role", "digest"])
    kept = matched(standing, texts, ["conv", "turn", "role", "digest"]).select(
        "conv", "part", "segment", "step", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    inserted = done.where("edit = 'I'").select("conv", "part", "segment", "step", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(inserted), summary


def digests(turns: DataFrame) -> DataFrame:
    """conv and repaired_sha256: of its turns as ``role:text`` in order, with line breaks between. One task reads a conversation's turns
    one after the other, whatever their number."""
    kind = dict(turns.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made, schema = None, None, None
        for batch in batches:
            out, schema = [], pa.schema([("conv", batch.schema.field(0).type), ("repaired_sha256", pa.string())])
            for own, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if made is not None and own == conv:
                    made.update(b"\n")
                else:
                    if made is not None:
                        out.append({"conv": conv, "repaired_sha256": made.hexdigest()})
                    conv, made = own, hashlib.sha256()
                made.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if made is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": made.hexdigest()}], schema=schema)

    count = shuffle_partitions(turns.sparkSession)
    lined = turns.repartition(count, "conv").sortWithinPartitions("conv", "part", "segment", "step")
    return lined.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every conversation of ``rows`` (null ids are one) after ``damaged``: the figures of ``repair`` and repaired_sha256.

    Conversations all of whose rows were dropped have zeros, an empty audit and the hash of nothing.
    """
    turns, summary = repair(damaged(rows, conv, turn, role, text), conv, turn, role, text)
    made = digests(turns)
    every = rows.select(F.col(conv).alias("conv")).distinct()
    joined = matched(matched(every, summary, ["conv"], "left"), made, ["conv"], "left")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("conv").alias(conv), *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in figures],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
