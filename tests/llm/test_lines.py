"""Line dedup against a plain version."""

import random

from tallymark.llm import lines


def plain(rows, least):
    sites, first = {}, {}
    for doc, text, site in rows:
        for pos, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r")
            if line:
                sites.setdefault(line, set()).add(site)
                if doc is not None:
                    first[line] = min(first.get(line, (doc, pos)), (doc, pos))
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        parts = text.split("\n")
        gone = [bool(p.strip(" \t\r")) and len(sites[p.strip(" \t\r")] - {None}) >= least and first.get(p.strip(" \t\r")) != (doc, k) for k, p in enumerate(parts)]
        out.append((doc, "\n".join(p for p, g in zip(parts, gone) if not g), len(parts), sum(gone)))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(4)
    common = [f"Shared line {k}" for k in range(12)]
    rows = []
    for k in range(150):
        own = [rng.choice(common) + rng.choice(["", " ", "\r"]) if rng.random() < 0.3 else f"line {k} {j}" for j in range(rng.randrange(0, 9))]
        rows.append((k, "\n".join(own + rng.choice([[], ["", ""]])), f"site{rng.randrange(14)}"))
    rows += [(None, "Shared line 1\nkept", "site1"), (500, None, "site2"), (501, "", "site3"), (502, "Shared line 2", None), (3, rows[3][1], rows[3][2]), (503, "\n".join(["Shared line 3"] * 3000), "site0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS pos", "2 AS h1", "3 AS LINES")
    made = lines.remove_boilerplate(frame, min_sites=6)
    assert made.columns == [*frame.columns, "lines_", "removed_lines"]
    got = sorted(((r.doc_id, r.text, r["lines_"], r.removed_lines) for r in made.collect()), key=str)
    assert got == plain(rows, 6)


def test_sites_near_and_far_from_the_threshold(spark):
    """Lines on 1, 2, ... 60 sites: the decision is that of an exact count for all of them."""
    rows = [(100 * n + s, f"on {n} sites", f"s{s}") for n in range(1, 61) for s in range(n)]
    keyed = lines.keyed_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert lines.boilerplate(keyed, 10).count() == 51


def test_empty_table(spark):
    assert lines.remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_a_very_long_document(spark):
    """All of a hundred thousand footers but the first go, in time that grows with the lines."""
    footer = "the same footer\n"
    rows = [(k, f"s{k}", footer + f"own line {k}") for k in range(12)] + [(50, "s50", footer * 100_000 + "end\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in lines.remove_boilerplate(docs).collect()}
    assert got[50] == ("end\n\n", 100_000) and got[0] == (footer + "own line 0", 0) and got[3] == ("own line 3", 1)
