"""Table lists, harvested schemas and what changed between two of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.sides import stack

COLUMN_TYPE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("data_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()), T.StructField("position", T.IntegerType()),
])
TABLE_TYPE = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("columns", T.ArrayType(COLUMN_TYPE)),
])
ASSET_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("connector_id", T.StringType()),
    T.StructField("connector_type", T.StringType()), T.StructField("connector_name", T.StringType()),
    T.StructField("source_item_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("owner", T.StringType()),
    T.StructField("tables", T.ArrayType(TABLE_TYPE)), T.StructField("harvested_at", T.TimestampType()),
])
JOB_SCHEMA = T.StructType([
    T.StructField("connector_type", T.StringType()), T.StructField("connector_name", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("asset_count", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("error_message", T.StringType()),
    T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()),
])
# What a second harvest of the same item overwrites.
REFRESHED = ("connector_id", "name", "type", "tables", "harvested_at")

Tables = Mapping[str, DataFrame]


# --- counts ---------------------------------------------------------------------------------

def table_counts(frames: Tables) -> DataFrame:
    """``table_name, row_count`` over every table in one job; an empty table counts 0."""
    return stack([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in frames.items()
    ])


def guarded_table_counts(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """As :func:`table_counts`, but a table that cannot be read is listed with a NULL count.

    All tables are counted in one job; only if that fails is each counted on its own. One
    number per table passes through the driver.
    """

    def counted(names: list[str]) -> dict[str, int]:
        return {r.table_name: r.row_count for r in table_counts({n: sources[n]() for n in names}).collect()}

    def alone(name: str) -> dict[str, int | None]:
        try:
            return counted([name])
        except Exception:  # any reason it cannot be read leaves it uncounted
            return {name: None}

    try:
        counts: dict[str, int | None] = counted(list(sources)) if sources else {}
    except Exception:
        with ThreadPoolExecutor(max_workers=4) as pool:
            counts = {name: n for part in pool.map(alone, sources) for name, n in part.items()}
    return spark.createDataFrame([(name, counts[name]) for name in sources], "table_name string, row_count bigint")


def table_totals(counts: DataFrame) -> DataFrame:
    rows = F.col("row_count")
    return counts.agg(
        F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum(rows), F.lit(0)).alias("total_rows"),
        F.count_if(rows == 0).alias("empty_tables"), F.count_if(rows.isNull()).alias("unreadable"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose count moved between two ``table_name, row_count`` snapshots, largest move first."""
    both = before.select("table_name", F.col("row_count").alias("before"), F.lit(None).cast("bigint").alias("after"),
                         F.lit(1).alias("seen")).unionByName(
        after.select("table_name", F.lit(None).cast("bigint").alias("before"), F.col("row_count").alias("after"),
                     F.lit(2).alias("seen"))
    )
    joined = both.groupBy("table_name").agg(
        F.max("before").alias("before"), F.max("after").alias("after"), F.bit_or("seen").alias("seen"),
    )
    moved = (F.col("seen") != 3) | ~F.col("before").eqNullSafe(F.col("after"))
    delta = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    return joined.filter(moved).select(
        "table_name", "before", "after", delta.alias("delta"),
        (F.col("seen") == 2).alias("added"), (F.col("seen") == 1).alias("removed"),
    ).orderBy(F.abs("delta").desc(), "table_name")


# --- filters --------------------------------------------------------------------------------

def name_contains(df: DataFrame, column: str, query: str) -> DataFrame:
    """Case-insensitive substring; a blank query keeps everything."""
    wanted = query.strip().lower()
    return df.filter(F.lower(F.coalesce(F.col(column), F.lit(""))).contains(wanted)) if wanted else df


def harvested_only(tables: DataFrame, harvested: DataFrame | None) -> DataFrame:
    """Live tables the last harvest recorded; none when there was no harvest at all."""
    if harvested is None:
        return tables.limit(0)
    return tables.join(harvested.select("table_name").distinct(), "table_name", "left_semi")


def without_internal(df: DataFrame, prefixes: Sequence[str], column: str = "name") -> DataFrame:
    """Rows whose name begins with none of the prefixes, case aside."""
    name = F.lower(F.trim(F.col(column)))
    internal = F.lit(False)
    for prefix in prefixes:
        internal = internal | name.startswith(prefix.lower())
    return df.filter(~F.coalesce(internal, F.lit(False)))


def gone(selected: DataFrame, live: DataFrame, *names: str) -> DataFrame:
    """Selected tables, or (table, column) pairs, the live schema no longer has."""
    return selected.join(live.select(*names).distinct(), list(names), "left_anti")


# --- harvest --------------------------------------------------------------------------------

def describe(tables: Tables, kind: str = "BASE TABLE") -> list[dict]:
    """The schema of each table as plain rows."""
    return [
        {"table": name, "kind": kind, "columns": [
            {"name": f.name, "data_type": f.dataType.simpleString(), "nullable": f.nullable, "position": i}
            for i, f in enumerate(df.schema.fields)
        ]}
        for name, df in tables.items()
    ]


def harvest(
    spark: SparkSession, items: Sequence[Mapping], load: Callable[[Mapping], Tables], connector_id: str,
    connector_type: str, connector_name: str, at: datetime, mode: str = "incremental",
) -> tuple[DataFrame, DataFrame]:
    """Assets and the job record of one harvest; an item that fails does not stop the others.

    ``items`` carry ``id, name, type``; ``load(item)`` gives the item's tables. Only schemas
    pass through the driver.
    """
    rows, problems = [], []
    for item in items:
        try:
            tables = describe(load(item))
        except Exception as problem:
            problems.append(str(problem))
            continue
        rows.append({
            "id": f"{connector_type}:{item['id']}", "connector_id": connector_id, "connector_type": connector_type,
            "connector_name": connector_name, "source_item_id": str(item["id"]), "name": item["name"],
            "type": item["type"], "owner": item.get("owner"), "tables": tables, "harvested_at": at,
        })
    job = {
        "connector_type": connector_type, "connector_name": connector_name, "mode": mode, "asset_count": len(rows),
        "status": "failed" if problems and not rows else "success",
        "error_message": "; ".join(problems) or None, "started_at": at, "finished_at": at,
    }
    return spark.createDataFrame(rows, ASSET_SCHEMA), spark.createDataFrame([job], JOB_SCHEMA)


def asset_columns(assets: DataFrame) -> DataFrame:
    """One row per asset, table and column."""
    tables = assets.select(F.col("id").alias("asset_id"), F.explode("tables").alias("t"))
    return tables.select(
        "asset_id", F.col("t.table").alias("table_name"), F.col("t.kind").alias("kind"), F.explode("t.columns").alias("c"),
    ).select(
        "asset_id", "table_name", "kind", F.col("c.name").alias("column_name"), "c.data_type", "c.nullable", "c.position",
    )


def upsert_assets(stored: DataFrame, harvested: DataFrame) -> DataFrame:
    """Stored assets with the harvested ones replaced in place or added, by id."""
    old, new = stored.alias("o"), harvested.alias("n")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    fresh = F.col("n.id").isNotNull()
    columns = []
    for name in stored.columns:
        if name in REFRESHED:
            columns.append(F.when(fresh, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
        else:
            kept = F.when(F.col("o.id").isNotNull(), F.col(f"o.{name}")).otherwise(F.col(f"n.{name}"))
            columns.append(kept.alias(name))
    return joined.select(*columns)


def clear_items(assets: DataFrame, connector_type: str, connector_id: str, items: DataFrame) -> DataFrame:
    """What a full refresh keeps: everything but the selected items of that connector."""
    chosen = items.select(F.col("id").cast("string").alias("source_item_id")).distinct().select(
        F.lit(connector_type).alias("connector_type"), F.lit(connector_id).alias("connector_id"), "source_item_id"
    )
    return assets.join(chosen, ["connector_type", "connector_id", "source_item_id"], "left_anti")


def list_assets(
    assets: DataFrame, connector_id: str | None = None, connector_type: str | None = None,
    asset_type: str | None = None, search: str = "",
) -> DataFrame:
    """Assets without their schema, newest first; a connector id overrides a connector type."""
    if connector_id:
        assets = assets.filter(F.col("connector_id") == connector_id)
    elif connector_type:
        assets = assets.filter(F.col("connector_type") == connector_type)
    if asset_type:
        assets = assets.filter(F.col("type") == asset_type)
    return name_contains(assets, "name", search).drop("tables").orderBy(F.col("harvested_at").desc(), "id")


def delete_assets(assets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets left, one row with the number really removed)."""
    chosen = ids.select("id").distinct()
    removed = assets.join(chosen, "id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return assets.join(chosen, "id", "left_anti"), removed


def type_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("type").agg(F.count(F.lit(1)).alias("assets"))


def schema_drift(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Columns added, removed or retyped between two column lists.

    Both carry the key columns (by default ``table_name, column_name``) and ``data_type``.
    """
    names = list(keys or ("table_name", "column_name"))
    none = F.lit(None).cast("string")
    both = before.select(*names, F.col("data_type").alias("before"), none.alias("after"), F.lit(1).alias("seen")).unionByName(
        after.select(*names, none.alias("before"), F.col("data_type").alias("after"), F.lit(2).alias("seen"))
    )
    joined = both.groupBy(*names).agg(
        F.max("before").alias("before"), F.max("after").alias("after"), F.bit_or("seen").alias("seen")
    )
    change = (
        F.when(F.col("seen") == 2, F.lit("added")).when(F.col("seen") == 1, F.lit("removed"))
        .when(~F.col("before").eqNullSafe(F.col("after")), F.lit("retyped"))
    )
    return joined.withColumn("change", change).filter("change is not null").drop("seen")
