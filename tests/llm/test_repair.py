"""Conversation repair against a plain search over all ways."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallymark.llm import queries, repair


def plain_damage(rows):
    """Rows per conversation after the damage, in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest())) for c, r in found.items()}


def faults_of(rows):
    seen, found = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def plain_repair(rows):
    """(cost, audit, turns) of the cheapest way: all states kept turn by turn."""
    faults = faults_of(rows)
    best = {"": (0, "", ())}  # by the initials' last and whether anything stands: the shape so far

    def put(into, shape, way):
        if shape not in into or way[:2] < into[shape][:2]:
            into[shape] = way

    def with_insertions(ways):
        out = dict(ways)
        for _ in range(2):
            for shape, (cost, audit, turns) in list(out.items()):
                role = "a" if shape == "u" else "u"
                put(out, role, (cost + 5, audit + "I", turns + (("user" if role == "u" else "assistant") + ":",)))
        return out

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for shape, (cost, audit, turns) in with_insertions(best).items():
            put(after, shape, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            extra, due = 5 * (fault == "truncated"), "a" if shape == "u" else "u"
            if role[:1] == due or role[:1] == "s" and shape == "":
                put(after, role[:1], (cost + extra, audit + "K", turns + (f"{role}:{text}",)))
            put(after, due, (cost + 1 + extra, audit + "R", turns + (("user" if due == "u" else "assistant") + f":{text}",)))
        best = after
    ways = with_insertions(best)
    return min(ways[s] for s in ("", "a") if s in ways)


def plain(rows):
    out = []
    for conv, own in plain_damage(rows).items():
        faults = faults_of(own)
        cost, audit, turns = plain_repair(own) if own else (0, "", ())
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def made_up(chance, convs, most):
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  \t", "Ends. \n", "other words", None, "A", "B.", "C."]
    rows = []
    for conv in convs:
        for turn in range(chance.randint(0, most)):
            rows.append((conv, chance.choice((turn, turn, turn, turn + 3, None)), chance.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)),
                         chance.choice(texts + [f"turn {turn}."] * 6)))
    return rows


def test_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_conversation_repair"](spark, folder)) == plain(rows)


@pytest.mark.parametrize("segment", [1, 3, 1 << 14])
def test_made_up(spark, monkeypatch, segment):
    """Segments of one turn up to whole conversations; null ids and turns, ties, repeated rows, other roles."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = made_up(random.Random(segment), [*range(40), None], 12)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, Audit string")
    assert got(repair.repair_report(frame)) == plain(rows)


def test_runs():
    """Runs crossed by powers cost what the turns cost one by one, and unroll to the same letters."""
    chance = random.Random(1)
    texts = {0: "x{}.", 1: "x{}", 2: " "}
    for _ in range(300):
        rows, runs = [], []
        for k in range(chance.randint(1, 5)):
            role, fault = chance.choice(("system", "user", "assistant", "tool")), chance.choice((0, 0, 1, 2))
            length = chance.choice((1, 1, 2, 3, 7, 20))
            rows += [(len(rows), role, texts[fault].format(f"{k}-{j}")) for j in range(length)]
            runs.append((8 if fault == 2 else "suat".index(role[0]) + 4 * fault, length))
        cost, audit, _ = plain_repair(rows)
        assert repair.applied(repair.transition(runs), repair.END)[repair.START] == cost
        made, state = repair.unroll(runs, repair.START, repair.END)
        assert made + repair.ending(state) == audit


def test_one_long_conversation(spark, monkeypatch):
    """A hot conversation in many segments over several ranges."""
    monkeypatch.setattr(repair, "SEGMENT", 50)
    chance = random.Random(9)
    rows = [(1, t, chance.choice(("user", "assistant")), chance.choice((f"turn {t}.", f"turn {t}.", f"cut {t}", "Yes."))) for t in range(2000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert got(repair.repair_report(frame)) == plain(rows)


def test_empty(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(nothing).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "gone"), (None, None, None, None)]
    assert got(repair.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain(rows)
