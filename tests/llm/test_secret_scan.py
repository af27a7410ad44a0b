"""Secret scans: candidates, features, the forest, and that no Python runs on the way."""

import hashlib
import math
import random
import re

from tallymark.llm import secret_scan as s


def made_findings(seed, count):
    """Documents with one candidate each and whether it is a secret."""
    rng = random.Random(seed)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    out = []
    for k in range(count):
        kind = k % 6
        if kind == 0:
            out.append((k, f'here token = "{hexes(40)}" it is', 1))
        elif kind == 1:
            out.append((k, f"set password={mixed(20)} now", 1))
        elif kind == 2:
            out.append((k, f"the key AKIA{mixed(15).upper()}7 stands", 1))
        elif kind == 3:
            out.append((k, f"sha256 checksum {hexes(64)} of it", 0))
        elif kind == 4:
            out.append((k, f"card {rng.randrange(10**15, 10**16)} paid", 0))
        else:
            out.append((k, f"see /Example-File-Name-{rng.randrange(10)}-of-your-new-page there", 0))
    return out


def test_forest_removes_false_findings(spark):
    rows = made_findings(1, 600)
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "'src/main' AS source")
    truth = spark.createDataFrame([(r[0], float(r[2])) for r in rows], "doc long, label double")
    found = s.candidates(frame)
    labelled = found.join(truth, "doc").where("doc % 3 <> 0 or doc % 2 = 0").where("doc < 400")
    verdicts = {r.doc_id: r for r in s.scan(frame, labelled).collect()}
    wrong = [k for k, _, label in rows if verdicts[k].secret != bool(label)]
    assert len(verdicts) == 600 and len(wrong) <= 6
    own = {r.doc_id: r.secret for r in s.scan(frame).collect()}
    assert sum(own[k] != bool(label) for k, _, label in rows) <= 30


def test_candidates(spark):
    value = "a1" * 10
    rows = [(1, f'x = y token="{value}", next'), (2, None), (3, ""), (4, "w " * 50000 + value), (5, "onlylowercaseletterswithoutend"), (None, value), (1, value), (6, f"{value} {value.upper()}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(NULL AS string) AS source", "1 AS word", "2 AS Value")
    made = s.candidates(frame).collect()
    assert sorted(((r.doc, r.word, r.value) for r in made), key=str) == sorted(
        [(1, 3, value), (4, 50000, value), (None, 0, value), (1, 0, value), (6, 0, value), (6, 1, value.upper())], key=str)
    first = next(r for r in made if r.doc == 1 and r.word == 3)
    assert (first.before, first.prefix, first.suffix, first.after) == ("= y", 'token="', '",', "next")
    out = s.scan(frame).collect()
    assert {r.value_sha256 for r in out} == {hashlib.sha256(v.encode()).hexdigest() for v in (value, value.upper())}


def test_features(spark):
    frame = spark.createDataFrame([(1, "key=Example0000PASSWORD99")], "doc_id long, text string").selectExpr("*", "'tests/x' AS source")
    r = s.with_features(s.candidates(frame)).first()
    assert (r.chars, r.credential_near, r.assigned, r.test_path, r.hex) == (21.0, 1.0, 1.0, 1.0, 0.0)
    assert abs(r.digits - 6 / 21) < 1e-9 and abs(r.dictionary - 11 / 21) < 1e-9 and abs(r.runs - 5 / 21) < 1e-9 and abs(r.transitions - 3 / 21) < 1e-9


def test_no_python_on_the_way(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = s.with_features(s.candidates(docs))
    plan = s.judge(found, s.train(s.certain_findings(found)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert s.scan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_values_of_credentials_of_any_length_and_characters(spark):
    rows = [
        (1, 'x password = "Hunter2!" y'), (2, "set db_password: p@ss,w0rd; then"), (3, "token='a b  c' end"), (4, 'secret="onlylowercaseletterswithoutend"'),
        (5, 'the pwd=x1 and apiKey := `q"z` now'), (6, "no credential = here, Author: Nobody"), (7, 'password = "unclosed! value'), (8, "w " * 5000 + "pass: é!"),
        (9, "password = " + '"' + "a!" * 20000 + '"'), (10, None), (11, 'key2="A1b2C3d4E5f6G7h8" key2=A1b2C3d4E5f6G7h8'),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'src/main' AS source")
    made = {(r.doc, r.word, r.value): r for r in s.candidates(frame).collect()}
    want = {
        (1, 3, "Hunter2!"), (2, 2, "p@ss,w0rd"), (3, 0, "a b  c"), (4, 0, "onlylowercaseletterswithoutend"), (5, 1, "x1"), (5, 5, 'q"z'), (6, 3, "here"),
        (7, 2, "unclosed!"), (8, 5001, "é!"), (9, 2, "a!" * 20000), (11, 0, "A1b2C3d4E5f6G7h8"), (11, 1, "A1b2C3d4E5f6G7h8"),
    }
    assert want - {k for k in made} == set() and {k[0] for k in made} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 11}
    first = made[1, 3, "Hunter2!"]
    assert (first.before, first.prefix, first.suffix, first.after) == ("password =", '"', '"', "y")
    assert {r.value_sha256 for r in s.scan(frame).where("doc_id = 1").collect()} == {hashlib.sha256(b"Hunter2!").hexdigest()}


def plain_long_tokens(rows):
    """Long tokens of whole texts, word by word, with some of their features."""
    value = re.compile(s.VALUE)
    out = []
    for doc, text, path in rows:
        words = re.split(r"\s+", text or "", flags=re.ASCII)
        for i, word in enumerate(words):
            if len(word) < 16:
                continue
            opened = re.sub(r"([A-Za-z_]{2,32})=(?=[A-Za-z0-9+/_-]{16,})", r"\1= ", word)
            for part, v in enumerate(value.findall(opened)):
                if not (re.search("[0-9]", v) or re.search("[a-z]", v) and re.search("[A-Z]", v)):
                    continue
                shares = [v.count(c) / len(v) for c in set(v)]
                out.append((
                    doc, i, part, v, " ".join(words[max(0, i - 2):i]), words[i + 1] if i + 1 < len(words) else "",
                    round(sum(c.isdigit() for c in v) / len(v), 9), round(len(set(v)) / len(v), 9), round(-sum(x * math.log2(x) for x in shares), 6),
                    bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)), bool(re.search(s.TEST_PATH, (path or "").lower()))))
    return sorted(out, key=str)


def test_long_tokens_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = s.with_features(s.candidates(docs)).where("part >= 0")
    got = sorted(((r.doc, r.word, r.part, r.value, r.before, r.after, round(r.digits, 9), round(r.distinct, 9), round(r.entropy, 6), r.hex == 1.0, r.test_path == 1.0)
                  for r in found.collect()), key=str)
    assert got == plain_long_tokens(rows) and got


def test_assigned_values_of_documents(spark, folder):
    """Every value that a plain scan for ``name=value`` and ``name: value`` finds is a candidate, whatever its length."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pattern = re.compile(r"(?i:key|token|secret|password|passwd|pwd|credential)[A-Za-z0-9_-]*\s*[=:]\s*\"([^\"\\\r\n]+)\"")
    want = {(r.doc_id, v) for r in docs.collect() for v in pattern.findall(r.text or "")}
    got = {(r.doc, r.value) for r in s.candidates(docs).collect()}
    assert want <= got


def test_one_label_only(spark):
    """Without findings of both kinds there is no forest: what stands near decides, ties included."""
    rows = [(1, "password = Tr0ub4dor", "a"), (1, "password = Tr0ub4dor", "a"), (2, "nothing here", "a"), (3, None, None)]
    made = s.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [(r.doc_id, r.probability, r.secret) for r in made] == [(1, 1.0, True)] * 2
