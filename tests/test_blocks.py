"""Files read in many small blocks against the same files read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark.sources import files
from tallymark.sources.blocks import array_records, quoted_records
from tallymark.sources.xml import COUNTS, _count_files, count_tags, tags


@pytest.fixture(params=[40, 97, 1000])
def block(spark, request):
    """Blocks of so many bytes, each a task of its own."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(request.param))
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def put(path, content):
    path.write_bytes(content.encode())
    return str(path)


def chance_text(chance, breaks):
    return "".join(chance.choice(["a", "é", ",", '"', " ", "b c", *breaks]) for _ in range(chance.randint(0, 9)))


def test_quoted_line_breaks(spark, tmp_path, block):
    """Breaks, delimiters and quotes inside cells; records over the ends of blocks and over whole blocks."""
    chance = random.Random(block)
    rows = [(k, chance_text(chance, ["\n", "\r\n", "\n\n"]), "end") for k in range(60)] + [(60, "long\n" * 60, "")]
    quoted = lambda v: '"' + str(v).replace('"', '""') + '"'
    lines = ["id,cell,last\n"] + [f"{k},{quoted(cell)},{quoted(last)}\n" + ("\n" if k % 7 == 0 else "") for k, cell, last in rows]
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.csv", "".join(lines))
    put(folder / "b.csv", "id,cell,last\n" + "".join(f"{k},x,y\n" for k in range(100, 130)))
    got = files.read_delimited_text(spark, str(folder))
    want = [(str(k), cell or None, last or None) for k, cell, last in rows] + [(str(k), "x", "y") for k in range(100, 130)]
    assert sorted(map(tuple, got.collect()), key=lambda r: int(r[0])) == want
    records = quoted_records(spark, [str(folder / "a.csv")])
    assert records.where("first").count() == 1 and records.count() == len(rows) + 1
    if block < 1000:
        assert records.rdd.getNumPartitions() > 5
    typed = files.read_table(spark, str(folder), "csv")
    assert dict(typed.dtypes)["id"] == "bigint" and typed.count() == len(want)


def test_unequal_headers_fail(spark, tmp_path, block):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.csv", 'a,b\n1,"x\ny"\n' + '2,"z\n"\n' * 300)
    put(folder / "b.csv", 'a,c\n1,"x\ny"\n' + '2,"z\n"\n' * 300)
    with pytest.raises(Exception):
        files.read_delimited_text(spark, str(folder), sep=",").collect()


def chance_object(chance, k, depth=0):
    value = {"id": k, "text": "".join(chance.choice(['{', '}', '"', "\\", "[", "]", "é", "\n", "x", ","]) for _ in range(chance.randint(0, 12)))}
    if depth < 2 and chance.random() < 0.5:
        value["in"] = chance_object(chance, k + 1, depth + 1)
        value["list"] = [chance_object(chance, k + 2, 2) for _ in range(chance.randint(0, 3))]
    return value


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, block, indent):
    """Brackets, quotes and backslashes inside strings, nested objects and lists, on one line or on many."""
    chance = random.Random(block)
    objects = [chance_object(chance, k) for k in range(0, 120, 3)]
    path = put(tmp_path / "a.json", " " + json.dumps(objects, indent=indent, ensure_ascii=False) + "\n")
    records, others = array_records(spark, [path])
    assert others == [] and sorted((json.loads(r.value) for r in records.collect()), key=lambda o: o["id"]) == objects
    got = files.read_json(spark, path)
    whole = spark.read.json(path, multiLine=True)
    as_text = lambda df: sorted(r.t for r in df.select(F.to_json(F.struct(*sorted(df.columns))).alias("t")).collect())
    assert as_text(got) == as_text(whole)


def test_json_that_is_no_array_or_is_cut(spark, tmp_path, block):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "one.json", json.dumps({"id": 1, "pad": "x" * 1500}))
    put(folder / "many.json", json.dumps([{"id": k, "pad": "y"} for k in range(200)]))
    assert sorted(r.id for r in files.read_json(spark, str(folder)).collect()) == sorted([1, *range(200)])
    cut = put(tmp_path / "cut.json", json.dumps([{"id": k, "pad": "y"} for k in range(200)])[:-30])
    with pytest.raises(Exception):
        files.read_json(spark, cut).collect()
    assert files.read_json(spark, put(tmp_path / "none.json", "[" + " " * 1500 + "]")).count() == 0


def chance_xml(chance, depth=0):
    name = chance.choice(["order", "item", "ns:note", "meta"])
    held = chance.choice(["", " x='1'", ' y="it\'s"', " z='a\"b'"])
    if depth > 2 or chance.random() < 0.2:
        return chance.choice([f"<{name}{held}/>", f"<{name}{held}>text &gt;</{name}>"])
    return f"<{name}{held}>" + "".join(chance_xml(chance, depth + 1) for _ in range(chance.randint(0, 4))) + f"</{name}>\n"


@pytest.mark.parametrize("odd", ["", "<!-- a > b <x> -->", "<![CDATA[ <order> > ]]>", "<k v='>'/>"])
def test_xml_tags(spark, tmp_path, block, odd):
    """Names under the root and stray ones, from blocks; files where a block can't tell are parsed whole, with the same figures."""
    chance = random.Random(block)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        body = "".join(chance_xml(chance) for _ in range(20))
        put(folder / f"{k}.xml", f'<?xml version="1.0"?>\n<!-- plain -->\n<root{k % 2} xmlns:ns="u">' + body + (odd if k == 1 else "") + f"</root{k % 2}>\n")
    whole = spark.read.format("binaryFile").load(str(folder)).select("path", "content").mapInPandas(_count_files, COUNTS)

    def figures(frame):
        rows = frame.groupBy(F.element_at(F.split("path", "/"), -1).alias("f"), "root", "tag").agg(F.sum("children").alias("c"), F.sum("strays").alias("s"))
        return sorted((r.f, r.root, r.tag, r.c, r.s) for r in rows.where("tag = '' or c > 0 or s > 0").collect())

    assert figures(count_tags(spark, str(folder))) == figures(whole)
    if block < 1000:
        assert tags(spark, str(folder)).rdd.getNumPartitions() > 5
