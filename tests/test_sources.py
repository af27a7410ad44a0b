import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from tallymark.session import scratch_dir
from tallymark.sources import files
from tallymark.sources.append import append_rows, cast_to, read_staged, split_rejected, write_rows
from tallymark.sources.flatten import flatten
from tallymark.sources.typing import settle_types
from tallymark.sources.xml import find_layouts

PEOPLE = [(11, "Wren", "kiln", 7), (12, "Tarn", "loom", 9), (13, "Fell", "kiln", 8)]
FIELDS = ("tag", "maker", "room", "pots")


def put(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted((tuple(r[name] for name in sorted(df.columns)) for r in df.collect()), key=str)


def xml(tmp_path, content, spark, element=None):
    return files.read_table(spark, put(tmp_path / "x.xml", content), record_element=element)


def test_the_same_records_in_every_format(spark, tmp_path):
    objects = [dict(zip(FIELDS, p)) for p in PEOPLE]
    lines = [",".join(map(str, p)) for p in [FIELDS, *PEOPLE]]
    paths = [
        put(tmp_path / "p.csv", "\n".join(lines) + "\n"),
        put(tmp_path / "p.tsv", "\n".join(l.replace(",", "\t") for l in lines)),
        put(tmp_path / "p.txt", "\n".join(l.replace(",", "|") for l in lines)),
        put(tmp_path / "p.json", json.dumps(objects, indent=1)),
        put(tmp_path / "p.ndjson", "\n".join(map(json.dumps, objects))),
        put(tmp_path / "p.jsonl", "\n".join(map(json.dumps, objects))),
        put(tmp_path / "p.xml", "<people>" + "".join(
            "<person>" + "".join(f"<{k}>{v}</{k}>" for k, v in o.items()) + "</person>" for o in objects) + "</people>"),
    ]
    spark.createDataFrame(PEOPLE, "tag bigint, maker string, room string, pots bigint").write.parquet(str(tmp_path / "p.parquet"))
    tables = [files.read_table(spark, p) for p in [*paths, str(tmp_path / "p.parquet")]]
    want_types = {"tag": "bigint", "maker": "string", "room": "string", "pots": "bigint"}
    want = sorted(((m, p, r, t) for t, m, r, p in PEOPLE), key=str)
    for path, df in zip([*paths, "parquet"], tables):
        assert dict(df.dtypes) == want_types, path
        assert rows(df) == want, path


def test_text_tables(spark, tmp_path):
    df = files.read_table(spark, put(tmp_path / "e.csv", "id,name\n"))
    assert df.columns == ["id", "name"] and df.isEmpty()
    df = files.read_table(spark, put(tmp_path / "o.csv", (
        'Order ID;Order Date;ok;n;at;note\nB-1;10-03-2018;true;1.5;2020-01-02 03:04:05;"a;b"\n'
        'B-2;31-12-2018;false;;2020-01-02 03:04:06;"two\nlines, ""quoted"""\n')))
    assert dict(df.dtypes) == {"Order ID": "string", "Order Date": "date", "ok": "boolean", "n": "double", "at": "timestamp_ntz",
                               "note": "string"}
    assert [tuple(r) for r in df.collect()] == [
        ("B-1", date(2018, 3, 10), True, 1.5, datetime(2020, 1, 2, 3, 4, 5), "a;b"),
        ("B-2", date(2018, 12, 31), False, None, datetime(2020, 1, 2, 3, 4, 6), 'two\nlines, "quoted"')]


def test_types_need_every_value_to_fit(spark):
    df = spark.createDataFrame([("1", "13-01-2020", "007", None, "1e3", "x"), ("2", "2020-01-13", "8", "", "2", "1")],
                               "a string, b string, c string, d string, e string, f string")
    assert dict(settle_types(df).dtypes) == {"a": "bigint", "b": "string", "c": "bigint", "d": "string", "e": "double", "f": "string"}


@pytest.mark.parametrize("name, content", [
    ("b.json", '[{"a": 1}, {"a": '), ("b.ndjson", '{"a": 1}\n{"a": \n'), ("b.xml", "<a><b>1</b>"), ("b.csv", "a,b\n1,2,3\n1,2\n"),
    ("b.xlsx", ""),
])
def test_broken_files_fail(spark, tmp_path, name, content):
    with pytest.raises(Exception) as caught:
        files.read_table(spark, put(tmp_path / name, content)).collect()
    if name in ("b.xlsx", "b.xml"):
        assert isinstance(caught.value, files.IngestError) and (name == "b.xlsx" or "b.xml" in str(caught.value))


def test_flatten(spark, tmp_path):
    df = files.read_table(spark, put(tmp_path / "n.json", json.dumps([
        {"id": 1, "customer": {"name": "acme", "address": {"city": "Leeds", "geo": {"lat": 53.8}}}, "tags": ["a", "b"], "on": "2020-01-02"},
        {"id": 2, "customer": {"name": "globex", "address": {"city": "Hull", "geo": {"lat": 53.7}}}, "tags": ["c"], "on": "2020-01-03"}])))
    assert dict(df.dtypes) == {"customer.address.city": "string", "customer.address.geo.lat": "double", "customer.name": "string",
                               "id": "bigint", "on": "date", "tags": "string"}
    assert [r["tags"] for r in df.orderBy("id").collect()] == ['["a","b"]', '["c"]']
    flat = spark.range(2)
    assert flatten(flat) is flat
    odd = spark.sql("SELECT map('k', 1) AS m, named_struct('x', array(named_struct('y', 1))) AS s")
    assert flatten(odd).first().asDict() == {"m": '{"k":1}', "s.x": '[{"y":1}]'}


def test_xml_shapes(spark, tmp_path):
    assert xml(tmp_path, "<root></root>", spark).isEmpty()
    df = xml(tmp_path, "<r><name>x</name><age>5</age></r>", spark)
    assert rows(df) == [(5, "x")]
    one = xml(tmp_path, "<r><item><a>1</a></item></r>", spark)
    two = xml(tmp_path, "<r><item><a>1</a></item><item><a>2</a></item></r>", spark)
    assert one.columns == two.columns == ["a"] and rows(two) == [(1,), (2,)]


def test_xml_fields(spark, tmp_path):
    df = xml(tmp_path, """<o:orders xmlns:o="urn:x">
      <o:order id="7" o:kind="k"><ref> A1 </ref><to><city code="L">Leeds</city></to><tag>x</tag><tag>y</tag></o:order>
      <o:order id="8"><ref>B2</ref><to><city code="H">Hull</city></to><tag>z</tag><empty/></o:order></o:orders>""", spark)
    got = {r["@id"]: r.asDict() for r in df.collect()}
    assert got[7]["ref"] == "A1" and got[7]["to.city"] == "Leeds" and got[7]["to.city.@code"] == "L" and got[7]["@kind"] == "k"
    assert json.loads(got[7]["tag"]) == ["x", "y"] and got[8]["tag"] == "z"


def test_xml_record_element(spark, tmp_path):
    tricky = """<root><note>ignore me</note><note>ignore me too</note><note>and me</note>
        <order><ref>A1</ref><qty>5</qty></order><order><ref>B2</ref><qty>7</qty></order></root>"""
    df = xml(tmp_path, tricky, spark)
    assert {r.note for r in df.collect()} == {"and me", "ignore me", "ignore me too"} and df.columns == ["note"]
    assert rows(xml(tmp_path, tricky, spark, "order")) == [(5, "A1"), (7, "B2")]
    with pytest.raises(files.IngestError, match="children are note, order"):
        xml(tmp_path, tricky, spark, "nope")
    (layout, _), = find_layouts(spark, str(tmp_path / "x.xml"))
    assert (layout.root, layout.candidates, layout.chosen, layout.strays) == ("root", ("note", "order"), "note", False)


def test_xml_same_name_elsewhere(spark, tmp_path):
    df = xml(tmp_path, "<r><order><k>1</k><order><k>9</k></order></order><order><k>2</k></order><meta><order><k>3</k></order></meta></r>", spark)
    assert sorted(r["k"] for r in df.collect()) == [1, 2] and "order.k" in df.columns


def test_xml_folders(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    for n in (1, 2, 3):
        put(folder / f"{n}.xml", f"<person><name>p{n}</name><age>{n}</age></person>")
    assert rows(files.read_table(spark, str(folder), "xml")) == [(1, "p1"), (2, "p2"), (3, "p3")]


def test_table_names():
    assert files.safe_table_name("My Orders (v2).csv") == "my_orders__v2"
    assert files.safe_table_name("2024.csv") == "t_2024"
    assert files.safe_table_name("---.csv") == "t_"
    assert files.safe_table_name("Details.csv", {"details", "details_2"}.__contains__) == "details_3"


def test_ingest_and_reingest(spark, tmp_path):
    path = put(tmp_path / "mixed.xml", "<r><a><x>1</x></a><a><x>2</x></a><b><y>3</y></b></r>")
    first = files.ingest(spark, path)
    second = files.ingest(spark, path)
    assert (first["table"], second["table"], first["row_count"], first["column_count"]) == ("mixed", "mixed_2", 2, 1)
    with pytest.raises(files.IngestError):
        files.reingest_xml(spark, path, "mixed", "nope")
    assert spark.table("mixed").columns == ["x"]
    assert files.reingest_xml(spark, path, "mixed", "b")["row_count"] == 1
    assert spark.table("mixed").columns == ["y"]
    with pytest.raises(Exception):
        files.ingest(spark, put(tmp_path / "bad.json", "{"), "bad_one")
    assert not spark.catalog.tableExists("bad_one")


def test_sampling(spark):
    df = spark.range(1000)
    drawn = files.sample_rows(df, ["id"], 20, seed=1).collect()
    assert files.sample_rows(df.repartition(7), ["id"], 20, seed=1).collect() == drawn
    assert len({r.id for r in drawn}) == 20 and drawn == files.sample_rows(df, ["id"], 20, seed=1).collect()
    assert drawn != files.sample_rows(df, ["id"], 20, seed=2).collect() and len(files.sample_rows(df.limit(5), ["id"], 20).collect()) == 5


def test_typed_append(spark, tmp_path):
    table, staged = str(tmp_path / "t"), str(tmp_path / "staged")
    spark.createDataFrame([(1, Decimal("1.50"), date(2020, 1, 1), True, "007")], "id int, n decimal(8,2), d date, b boolean, code string").write.parquet(table)
    texts = spark.createDataFrame([("2", "2.25", "2020-02-03", "false", "010", "x"), ("3", "", "", "", "", ""), (" ", "", None, "", "", "")],
                                  "id string, n string, d string, b string, code string, other string")
    write_rows(texts, staged)
    frame = read_staged(spark, staged)
    assert frame.count() == 2
    assert append_rows(spark, frame, table) == {"appended": 2, "rejected": 0}
    got = {r.id: tuple(r)[1:] for r in spark.read.parquet(table).collect()}
    assert got[2] == (Decimal("2.25"), date(2020, 2, 3), False, "010") and got[3] == (None, None, None, "")
    bad = frame.withColumn("n", frame["id"]).withColumn("id", frame["d"])
    assert append_rows(spark, bad, table) == {"appended": 0, "rejected": 1} and spark.read.parquet(table).count() == 3
    good, rejected = split_rejected(bad, spark.read.parquet(table).schema)
    assert (good.count(), rejected.count()) == (1, 1)
    assert cast_to(frame.select("id"), spark.read.parquet(table).schema).columns == ["id", "_bad"]


def test_scratch_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(root) and first != second


def test_headers_settle_the_delimiter_or_it_has_to_be_named(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x|y\n" + "1,5|b\n" * 30)
    (folder / "b.csv").write_text('x|y\n2|"two\nlines"\n')
    assert files.read_table(spark, str(folder), "csv").count() == 31
    (folder / "c.csv").write_text("x,y\n1,b\n")
    with pytest.raises(files.IngestError, match="name it"):
        files.read_table(spark, str(folder), "csv")
    (tmp_path / "tie.csv").write_text("a|b,c\n1|x,y\n")
    with pytest.raises(files.IngestError, match="name it"):
        files.read_table(spark, str(tmp_path / "tie.csv"))
    assert files.read_delimited(spark, str(tmp_path / "tie.csv"), sep="|").columns == ["a", "b,c"]


def test_documents_with_different_roots_are_all_read(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    put(folder / "a.xml", "<orders><order><id>1</id></order><order><id>2</id></order></orders>")
    put(folder / "b.xml", "<orders><order><id>3</id></order></orders>")
    put(folder / "c.xml", "<sales><sale><id>8</id><shop>x</shop></sale><sale><id>9</id></sale></sales>")
    found = files.read_table(spark, str(folder), "xml")
    assert rows(found) == [(1, None), (2, None), (3, None), (8, "x"), (9, None)]
    assert rows(files.read_table(spark, str(folder), "xml", record_element="sale")) == [(8, "x"), (9, None)]
    with pytest.raises(files.IngestError, match="no child of a root"):
        files.read_table(spark, str(folder), "xml", record_element="nope")


def test_scratch_folders_go_with_the_process(spark):
    from tallymark import session

    folder = scratch_dir(spark, "gone")
    spark.range(3).write.parquet(folder)
    kept, session._made[:] = session._made[:-1], session._made[-1:]
    session.drop_scratch()
    session._made[:] = kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
