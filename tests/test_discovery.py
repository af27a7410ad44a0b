"""Column partners and references, by content."""

from tallymark.operators import discovery


def test_pairs_of_odd_tables(spark):
    left = spark.createDataFrame([(1, "a", None, [1]), (2, "b", None, [2]), (3, None, None, [3])], "id int, `a.b` string, gone string, list array<int>")
    right = spark.createDataFrame([(3, "b", "1"), (2, "a", "2"), (9, "a", "3")], "number long, `the text` string, id string")
    got = {(r.source_column, r.destination_column): (r.shared_values, r.overlap) for r in discovery.content_pairs(left, right).collect()}
    assert got == {("id", "number"): (2, 2 / 3), ("id", "id"): (3, 1.0), ("a.b", "the text"): (2, 1.0)}
    assert discovery.content_pairs(left, right.limit(0)).collect() == []


def test_sketches_alone_rule_pairs_out(spark):
    """Only the pairs that the sketches leave are counted, and the estimates are near the truth."""
    left = spark.range(0, 20000).selectExpr("id as a", "id + 15000 as b")
    right = spark.range(10000, 30000).selectExpr("id as c")
    got = {(r.source_column, r.destination_column): (r.in_destination, r.in_source) for r in discovery.estimated_pairs(left, right).collect()}
    assert abs(got["a", "c"][0] - 0.5) < 0.05 and abs(got["b", "c"][1] - 0.75) < 0.05
    assert {(r.source_column, r.shared_values) for r in discovery.content_pairs(left, right, 0.6).collect()} == {("b", 15000)}


def test_inclusions_over_many_columns(spark):
    """More columns than bits in a word; nulls, empty columns and repeated rows."""
    wide = spark.range(0, 40).selectExpr("id", *(f"if(id < {k}, id, null) as x{k}" for k in range(70)), "cast(null as long) as nothing")
    got = {(r.child_column, r.parent_column) for r in discovery.inclusions({"w": wide.union(wide)}).collect()}
    sizes = {"id": 40, **{f"x{k}": min(k, 40) for k in range(1, 70)}}
    assert got == {(a, b) for a in sizes for b in sizes if a != b and sizes[a] <= sizes[b]}


def test_foreign_keys(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "p_id int, p_name string")
    others = spark.createDataFrame([(k, "x") for k in range(1, 9)], "q_id int, q_name string")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, None)], "c_number int, c_id long")
    got = [tuple(r)[:4] for r in discovery.foreign_keys({"p": parents, "q": others, "c": children}).collect()]
    assert ("c", "c_id", "p", "p_id") in got and all(r[:2] != ("c", "c_id") or r[2] == "p" for r in got)
    assert ("q", "q_name", "p", "p_name") in got and ("p", "p_name", "q", "q_name") not in got
    strange = spark.createDataFrame([(10, 4)], "c_number int, c_id long")
    assert discovery.foreign_keys({"p": parents, "c": strange}).collect() == []
    assert discovery.stems(["o_a", "o_b"]) == {"o_a": "a", "o_b": "b"} and discovery.stems(["doc_id", "text"]) == {"doc_id": "doc_id", "text": "text"}
