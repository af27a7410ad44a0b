"""Files in and out, flattening, typed appends, made-up rows, streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators import rules
from tallymark.operators.sides import stack
from tallymark.operators.synth import DUCKDB, cell_sql, fill, non_empty
from tallymark.session import scratch_dir
from tallymark.sources import files
from tallymark.sources.append import append_rows, cast_to, read_staged, split_rejected, write_rows
from tallymark.sources.flatten import flatten
from tallymark.streaming.checks import check_stream, read_results
from tallymark.streaming.uniqueness import left_out, repeated_keys, write_arrivals
from tallymark.streaming.windows import windowed_quality, write_windows
from workload.registry import Tables, query


@query("flatten_events", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "e.props.k", event_type AS "e.kind.name",
       user_id AS "e.user", '["' || event_type || '","x"]' AS "e.tags" FROM events
""")
def flatten_events(t: Tables) -> DataFrame:
    nested = F.struct(
        F.from_json("props", "k bigint").alias("props"), F.struct(F.col("event_type").alias("name")).alias("kind"),
        F.col("user_id").alias("user"), F.array("event_type", F.lit("x")).alias("tags"),
    )
    return flatten(t.events.select("event_id", nested.alias("e")))


@query("select_value", "SELECT l_shipdate AS val FROM lineitem")
def select_value(t: Tables) -> DataFrame:
    return files.select_value(t.lineitem, "l_shipdate")


@query("sample_rows", "SELECT * FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 20")
def sample_rows(t: Tables) -> DataFrame:
    return files.sample_rows(t.orders, ["o_orderkey"], 20, seed=7)


# --- round trips through files --------------------------------------------------------------------

@query("ingest_csv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def ingest_csv(t: Tables) -> DataFrame:
    """Written with semicolons, read back without being told so."""
    folder = scratch_dir(t.spark, "csv")
    t.part.write.csv(folder, header=True, sep=";")
    return files.read_table(t.spark, folder, "csv")


@query("ingest_csv_quoted", "SELECT conv_id, turn, role, text FROM conversations")
def ingest_csv_quoted(t: Tables) -> DataFrame:
    """Texts with commas, quotes and line breaks."""
    folder = scratch_dir(t.spark, "quoted")
    write_rows(t.conversations, folder)
    return files.read_table(t.spark, folder, "csv")


@query("ingest_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS day_first, o_orderstatus = 'F' AS final FROM orders
""")
def ingest_dates(t: Tables) -> DataFrame:
    """Day-first dates and true/false texts take their types."""
    folder = scratch_dir(t.spark, "dates")
    t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("day_first"),
        (F.col("o_orderstatus") == "F").cast("string").alias("final"),
    ).write.csv(folder, header=True, sep="\t")
    return files.read_table(t.spark, folder, "tsv")


@query("ingest_ndjson", """
SELECT c_custkey, c_name AS "c.name", CAST(c_nationkey AS BIGINT) AS "c.place.nation", c_acctbal AS "c.balance",
       '["' || c_mktsegment || '"]' AS tags FROM customer
""")
def ingest_ndjson(t: Tables) -> DataFrame:
    folder = scratch_dir(t.spark, "ndjson")
    nested = F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place"),
        F.col("c_acctbal").alias("balance"),
    )
    t.customer.select("c_custkey", nested.alias("c"), F.array("c_mktsegment").alias("tags")).write.json(folder)
    return files.read_table(t.spark, folder, "ndjson")


@query("ingest_parquet", """
SELECT vec_id, label, CAST(len(embedding) AS INT) AS width, CAST(unnest(range(len(embedding))) AS INT) AS pos, unnest(embedding) AS cell FROM embeddings
""")
def ingest_parquet(t: Tables) -> DataFrame:
    """A list column becomes one text that holds every number of the list; the row count stays."""
    flat = files.read_table(t.spark, f"{t.folder}/embeddings.parquet")
    cells = F.from_json("embedding", "array<float>")
    return flat.select("vec_id", "label", F.size(cells).alias("width"), F.posexplode(cells).alias("pos", "cell"))


def bucket_of(rows: DataFrame, key: str, size: int = 500) -> Column:
    """A column ``bucket``: groups of about ``size`` rows, so that a file is a bounded number of rows however large the table is."""
    return F.pmod(F.xxhash64(key), F.lit(rows.count() // size + 1)).alias("bucket")


@query("ingest_json", """
SELECT c_custkey, c_name AS "c.name", CAST(c_nationkey AS BIGINT) AS "c.nation", c_acctbal AS balance FROM customer
""")
def ingest_json(t: Tables) -> DataFrame:
    """Arrays of objects, one per file; there are as many files as the rows need."""
    folder = scratch_dir(t.spark, "json")
    nested = F.struct("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("c"), F.col("c_acctbal").alias("balance"))
    arrays = t.customer.groupBy(bucket_of(t.customer, "c_custkey")).agg(F.to_json(F.collect_list(nested)).alias("value"))
    arrays.write.partitionBy("bucket").text(folder)
    return files.read_table(t.spark, f"{folder}/*", "json")


@query("ingest_to_table", """
SELECT 'orders_2024' AS stem, CAST((SELECT count(*) FROM supplier) AS BIGINT) AS row_count, CAST(4 AS BIGINT) AS column_count,
       (SELECT count(*) FROM supplier) AS stored
""")
def ingest_to_table(t: Tables) -> DataFrame:
    """A file becomes a table of the catalog under a safe name."""
    folder = scratch_dir(t.spark, "table")
    t.supplier.write.csv(folder, header=True)
    made = files.ingest(t.spark, folder, "Orders 2024.csv", "csv")
    try:
        stored = t.spark.table(made["table"]).count()
    finally:
        t.spark.sql(f"DROP TABLE `{made['table']}`")
    stem = made["table"][:len("orders_2024")]
    return t.spark.createDataFrame([(stem, made["row_count"], made["column_count"], stored)], "stem string, row_count bigint, column_count bigint, stored bigint")


@query("xml_reread", """
SELECT 'note' AS element, count(*) * 2 AS rows, 'note' AS columns FROM supplier
UNION ALL SELECT 'supplier', count(*), '@key,name' FROM supplier
""")
def xml_reread(t: Tables) -> DataFrame:
    """A table of the most frequent element is built again from another one."""
    folder = scratch_dir(t.spark, "reread")
    body = F.concat(*(F.concat(F.lit(f"<note>{n} "), F.col("s_suppkey").cast("string"), F.lit("</note>")) for n in "ab"),
                    F.lit('<supplier key="'), F.col("s_suppkey").cast("string"), F.lit('"><name>'), F.col("s_name"), F.lit("</name></supplier>"))
    documents = t.supplier.groupBy(bucket_of(t.supplier, "s_suppkey")).agg(
        F.concat(F.lit("<all>"), F.array_join(F.collect_list(body), ""), F.lit("</all>")).alias("value"))
    documents.write.partitionBy("bucket").text(folder)
    folder = f"{folder}/*"
    made = files.ingest(t.spark, folder, "notes reread", "xml")
    first = t.spark.table(made["table"])
    rows = [("note", first.count(), ",".join(first.columns))]
    again = files.reingest_xml(t.spark, folder, made["table"], "supplier")
    second = t.spark.table(again["table"])
    rows.append(("supplier", second.count(), ",".join(second.columns)))
    t.spark.sql(f"DROP TABLE `{again['table']}`")
    return t.spark.createDataFrame(rows, "element string, rows bigint, columns string")


@query("ingest_xml", """
SELECT s_suppkey AS "@key", s_name AS name, CAST(s_nationkey AS BIGINT) AS "place.nation", s_acctbal AS "place.balance", CAST(NULL AS BIGINT) AS region FROM supplier
UNION ALL SELECT n_nationkey, n_name, NULL, NULL, n_regionkey FROM nation
""")
def ingest_xml(t: Tables) -> DataFrame:
    """Documents of two kinds in one folder: suppliers, and under another root nations."""
    folder = scratch_dir(t.spark, "xml")
    place = F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    t.supplier.select(
        F.col("s_suppkey").alias("@key"), F.col("s_name").alias("name"), place.alias("place")
    ).write.format("xml").options(rootTag="suppliers", rowTag="supplier", attributePrefix="@").save(folder)
    t.nation.select(F.col("n_nationkey").alias("@key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.mode(
        "append").format("xml").options(rootTag="nations", rowTag="nation", attributePrefix="@").save(folder)
    return files.read_table(t.spark, folder, "xml")


# --- made-up rows and appends ------------------------------------------------------------------------

CONTACT = [
    ("email", "VARCHAR"), ("first_name", "VARCHAR"), ("signup_date", "DATE"), ("last_seen", "TIMESTAMP"), ("event_datetime", "VARCHAR"),
    ("balance", "DECIMAL(10,2)"), ("score", "INTEGER"), ("customer_id", "VARCHAR"), ("token", "UUID"), ("city", "VARCHAR"),
    ("opening_time", "VARCHAR"), ("home_phone", "VARCHAR"), ("website", "VARCHAR"), ("active", "BOOLEAN"), ("anything", "VARCHAR"),
    ("country", "VARCHAR"), ("company", "VARCHAR"), ("remark", "VARCHAR"), ("street", "VARCHAR"), ("zip", "VARCHAR"), ("status", "VARCHAR"),
]


@query("synth_rows", "SELECT " + ", ".join(
    f'{cell_sql(name, kind, 11, DUCKDB)} AS "{name}"' for name, kind in CONTACT) + " FROM (SELECT c_custkey AS id FROM customer)")
def synth_rows(t: Tables) -> DataFrame:
    """A made-up contact for every customer."""
    return fill(t.customer.select(F.col("c_custkey").alias("id")), CONTACT, seed=11)


NAME_RULES = [
    ("contact_email_address", "VARCHAR", "^[a-z]{6}@[a-z]{6}[.]example$"), ("event_datetime", "VARCHAR", "^[0-9-]{10} [0-9:]{8}$"),
    ("birthdate", "VARCHAR", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("seen", "TIMESTAMP WITH TIME ZONE", "^[0-9-]{10} [0-9:]{8}$"),
    ("seen_at", "TIME", "^[0-9:]{8}$"), ("city_id", "VARCHAR", "^[A-Z][a-z]{5}$"), ("order_ref", "VARCHAR", "^[0-9]{3}-[0-9]{3}$"),
    ("whatever", "VARCHAR", "^[A-Z][a-z]{5} [0-9]{2}$"),
]


@query("synth_name_rules", " UNION ALL ".join(
    f"SELECT CAST({k} AS INT) AS position, '{name}' AS column_name, '{shape}' AS shape, count(*) AS rows, count(*) AS fitting FROM customer"
    for k, (name, _, shape) in enumerate(NAME_RULES)))
def synth_name_rules(t: Tables) -> DataFrame:
    """The first rule that fits a column's type or name decides, whatever fits after it."""
    made = fill(t.customer.select(F.col("c_custkey").alias("id")), [(name, kind) for name, kind, _ in NAME_RULES], seed=3)
    return stack([
        made.agg(F.lit(k).alias("position"), F.lit(name).alias("column_name"), F.lit(shape).alias("shape"), F.count("*").alias("rows"),
                 F.count_if(F.col(name).rlike(shape)).alias("fitting"))
        for k, (name, _, shape) in enumerate(NAME_RULES)
    ])


def staged_orders(t: Tables) -> DataFrame:
    """Orders as text, some cells of which are no number or no date."""
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 19 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 23 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"),
        F.lit("left out").alias("not_in_target"),
    )


@query("typed_append", """
SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice, o_orderdate
FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0
""")
def typed_append(t: Tables) -> DataFrame:
    good, _ = split_rejected(staged_orders(t), t.orders.schema)
    return good


@query("typed_append_rejected", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       CAST((o_orderkey % 17 = 0)::INT + (o_orderkey % 23 = 0)::INT AS INT) AS bad
FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 23 = 0
""")
def typed_append_rejected(t: Tables) -> DataFrame:
    staged = staged_orders(t)
    marked = cast_to(staged, t.orders.schema)
    return marked.filter("_bad > 0").select(F.col("o_orderkey").cast("string"), F.col("_bad").alias("bad"))


@query("append_to_table", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_name || ', "new"', NULL, s_acctbal FROM supplier
""")
def append_to_table(t: Tables) -> DataFrame:
    """A staged CSV with quoted names and blank rows, appended to a copy of the suppliers."""
    table, staging = scratch_dir(t.spark, "suppliers"), scratch_dir(t.spark, "staging")
    t.supplier.write.parquet(table)
    blank = F.col("s_suppkey") % 10 == 5
    extra = t.supplier.select(
        F.concat("s_name", F.lit(', "new"')).alias("s_name"), (F.col("s_suppkey") + 1000000).cast("string").alias("s_suppkey"),
        F.lit("").alias("s_nationkey"), F.col("s_acctbal").cast("string").alias("s_acctbal"),
    )
    holes = t.supplier.filter(blank).select(*(F.lit(" ").alias(n) for n in extra.columns))
    write_rows(extra.unionByName(holes), staging)
    outcome = append_rows(t.spark, read_staged(t.spark, staging), table)
    if outcome["rejected"]:
        raise RuntimeError(f"{outcome['rejected']} staged rows did not fit")
    return t.spark.read.parquet(table)


@query("non_empty_rows", "SELECT CAST(c_custkey AS VARCHAR) AS a, c_name AS b FROM customer WHERE c_custkey % 13 <> 0")
def non_empty_rows(t: Tables) -> DataFrame:
    blank = F.col("c_custkey") % 13 == 0
    drafts = t.customer.select(
        F.when(blank, F.lit("")).otherwise(F.col("c_custkey").cast("string")).alias("a"),
        F.when(blank & (F.col("c_custkey") % 2 == 0), F.lit("  ")).when(blank, F.lit(None)).otherwise(F.col("c_name")).alias("b"),
    )
    return non_empty(drafts)


# --- streams --------------------------------------------------------------------------------------------

def event_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{t.folder}/events*.parquet")


def arriving(t: Tables, rows: DataFrame, batch: Column) -> Iterator[DataFrame]:
    """The stream after each of four arrivals; a run over it has the files of one arrival as its batch, however many they are."""
    folder = scratch_dir(t.spark, "arrived")
    for k in range(4):
        rows.where(batch == k).write.mode("append").parquet(folder)
        yield t.spark.readStream.schema(rows.schema).parquet(folder)


@query("stream_checks", """
WITH b AS (SELECT event_id % 4 AS batch, value, event_type, user_id NOT IN (SELECT c_custkey FROM customer) AS stranger FROM events),
n AS (SELECT batch, count(*) AS rows, count(*) FILTER (value < 5) AS low, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other,
             count(*) FILTER (stranger) AS unknown FROM b GROUP BY batch)
SELECT 'value in range' AS rule, CASE WHEN low = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(low AS DOUBLE) AS violations, rows AS total_rows FROM n
UNION ALL SELECT 'event_type allowed', CASE WHEN other = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(other AS DOUBLE), rows FROM n
UNION ALL SELECT 'user_id known', CASE WHEN unknown = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(unknown AS DOUBLE), rows FROM n
""")
def stream_checks(t: Tables) -> DataFrame:
    """Events arrive four times, each time as a batch of its own."""
    target, checkpoint = (scratch_dir(t.spark, p) for p in ("checked", "checkpoint"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    made = [rules.in_range("value", 5, None), rules.allowed_values("event_type", ["click", "view"])]
    for stream in arriving(t, t.events, F.col("event_id") % 4):
        check_stream(stream, made, target, checkpoint, static=users, key="user_id").awaitTermination()
    return read_results(t.spark, target).select("rule", "status", "violations", "total_rows")


@query("stream_windows", """
WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS rows, count(*) FILTER (value < 5) AS violations
           FROM events GROUP BY ALL)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, event_type, rows, violations,
       round((rows - violations) * 100.0 / rows, 2) AS quality_pct
FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_windows(t: Tables) -> DataFrame:
    """Only windows that are closed for good are written."""
    target, checkpoint = scratch_dir(t.spark, "windows"), scratch_dir(t.spark, "checkpoint")
    windows = windowed_quality(event_stream(t), "ts", F.col("value") < 5, by=("event_type",))
    write_windows(windows, target, checkpoint).awaitTermination()
    return t.spark.read.schema(windows.schema).parquet(target)


@query("table_windows", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows, count(*) FILTER (value < 5) AS violations,
       round((count(*) - count(*) FILTER (value < 5)) * 100.0 / count(*), 2) AS quality_pct FROM events GROUP BY 1
""")
def table_windows(t: Tables) -> DataFrame:
    return windowed_quality(t.events, "ts", F.col("value") < 5)


QUARTER = "least(3, (day(ts) - 1) div 8)"


@query("stream_unique", """
WITH r AS (SELECT user_id, event_type, ts FROM events
           UNION ALL SELECT user_id, event_type, ts + INTERVAL 20 MINUTE FROM events WHERE event_id % 37 = 0),
m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM m)
SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS rows, count(*) - 1 AS repeats
FROM g GROUP BY user_id, event_type, nr HAVING count(*) > 1 AND max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM r) - INTERVAL 1 HOUR
""")
def stream_unique(t: Tables) -> DataFrame:
    """The same event of a user within an hour is a repeat, whichever of four arrivals the two are in."""
    target, checkpoint = scratch_dir(t.spark, "repeats"), scratch_dir(t.spark, "checkpoint")
    rows = t.events.select("user_id", "event_type", "ts")
    again = t.events.where("event_id % 37 = 0").select("user_id", "event_type", (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("ts"))
    for stream in arriving(t, rows.unionByName(again), F.expr(QUARTER)):
        found = repeated_keys(stream, ["user_id", "event_type"], "ts", within="1 hour")
        write_windows(found, target, checkpoint, "repeats").awaitTermination()
    return t.spark.read.schema(found.schema).parquet(target)


@query("stream_late", """
WITH q AS (SELECT ts, event_type, CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(3, (day(ts) - 1) // 8) END AS arrival FROM events),
w AS (SELECT max(ts) FILTER (arrival < 3) - INTERVAL 1 HOUR AS third, max(ts) - INTERVAL 1 HOUR AS last FROM q),
d AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS arrived,
             count(*) FILTER (arrival = 3 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT third FROM w)) AS left_out
      FROM q GROUP BY ALL)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, event_type, arrived, arrived - left_out AS counted, left_out
FROM d WHERE window_start + INTERVAL 1 DAY <= (SELECT last FROM w)
""")
def stream_late(t: Tables) -> DataFrame:
    """Every fiftieth event arrives with the last of four arrivals; those whose day was closed by then are named, not lost silently."""
    names = ("windows", "windows-checkpoint", "arrivals", "arrivals-checkpoint")
    target, checkpoint, seen, seen_checkpoint = (scratch_dir(t.spark, n) for n in names)
    delayed = F.when(F.col("event_id") % 50 == 0, F.lit(3)).otherwise(F.expr(QUARTER))
    for stream in arriving(t, t.events, delayed):
        windows = windowed_quality(stream, "ts", F.col("value") < 5, by=("event_type",))
        write_windows(windows, target, checkpoint).awaitTermination()
        write_arrivals(stream, "ts", seen, seen_checkpoint, by=("event_type",)).awaitTermination()
    return left_out(t.spark.read.schema(windows.schema).parquet(target), t.spark.read.parquet(seen), by=("event_type",))
