"""Two-sided checks. Each gives a lazy one-row verdict; nothing is capped or collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import model
from tallymark.functions.columns import c, columns_for, rename_to_common, shared_columns
from tallymark.functions.text import key_text, literal, normalise_cell, q, text
from tallymark.model import CheckError, ColumnParity
from tallymark.operators.metrics import METRICS, Wanted, distinct_sketches, measure, measure_distinct, merged_distinct, require
from tallymark.operators.sides import FLOATS, INTEGERS, comparable_rows, column_type, stack, tagged_union
from tallymark.operators.verdicts import row_digest, same_value, shown, together, verdict

Frames = Mapping[str, DataFrame]

IN_SOURCE, IN_DESTINATION = 1, 2
KEY_SAMPLES, ROW_SAMPLES, VALUE_SAMPLES = 5, 3, 5
SAMPLE_WIDTH = 120
SKIPPED_SHOWN = 8
#: Texts up to this size are compared as they are; rows of up to so many columns keep their cells apart.
CELL_BYTES, NARROW = 64, 24


# --- row counts -----------------------------------------------------------------------------

def count_side(frames: Frames) -> DataFrame:
    """Rows over every table of a side, added up from one count per table."""
    return stack([df.agg(F.count(F.lit(1)).alias("n")) for df in frames.values()]).agg(F.sum("n").alias("n"))


def row_count_match(source: Frames, destination: Frames) -> DataFrame:
    pair = together(s=count_side(source), d=count_side(destination))
    s, d = F.col("s.n"), F.col("d.n")
    details = F.concat(
        F.lit(f"source tables {list(source)} = "), s.cast("string"),
        F.lit(f" rows | destination tables {list(destination)} = "), d.cast("string"), F.lit(" rows"),
    )
    return pair.select(*verdict(s == d, F.abs(s - d), s, details))


# --- column metrics -------------------------------------------------------------------------

def _figure(metric: str, row: str, schema: T.StructType) -> str:
    kind = METRICS[metric].kind
    if kind == "range":
        low, high = (shown(f"{row}.{name}", schema[name].dataType) for name in ("low", "high"))
        return f"concat('[', {low}, ', ', {high}, ']')"
    value = shown(f"{row}.metric", schema["metric"].dataType)
    if kind == "count2":
        return f"concat({value}, ' rows/', {shown(f'{row}.non_null', T.LongType())}, ' non-null')"
    return value


def _breakdown(metric: str, tables: str, schema: T.StructType) -> str:
    part = f"concat(t.src_table, ': ', {_figure(metric, 't', schema)})"
    return f"if(size({tables}) >= 2, concat(' (', array_join(transform(array_sort({tables}), t -> {part}), ', '), ')'), '')"


def _metric_verdict(metric: str, s: str, d: str, s_type: T.StructType, d_type: T.StructType) -> list[Column]:
    spec = METRICS[metric]
    s_total, d_total = s_type["total"].dataType, d_type["total"].dataType
    names = {"range": ("low", "high"), "count2": ("metric", "non_null")}.get(spec.kind, ("metric",))
    equal = " and ".join(
        same_value(f"{s}.total.{n}", s_total[n].dataType, f"{d}.total.{n}", d_total[n].dataType) for n in names
    )
    violations = f"if({equal}, 0, 1)"
    if spec.kind in ("count", "count2"):
        gaps = [f"abs({s}.total.{n} - {d}.total.{n})" for n in names]
        violations = f"coalesce({gaps[0]}, {violations})" if spec.kind == "count" else " + ".join(
            f"coalesce({gap}, 0)" for gap in gaps
        )
    sides = []
    for side, at, dtype in (("source", s, s_type), ("destination", d, d_type)):
        entry = dtype["tables"].dataType.elementType
        sides.append(f"""concat('{side} {spec.said} = ', {_figure(metric, f'{at}.total', dtype['total'].dataType)},
            {_breakdown(metric, f'{at}.tables', entry)})""")
    return verdict(
        F.expr(equal), F.expr(violations), F.expr(f"coalesce({d}.total.rows, 0)"), F.expr(f"concat_ws(' | ', {', '.join(sides)})")
    )


def uniqueness_verdict(s: Column, d: Column) -> list[Column]:
    """The verdict over two sides' distinct counts, each a struct ``total`` (rows, metric) and ``tables`` (src_table, metric)."""

    def said(side: str, at: Column) -> Column:
        each = F.transform(F.array_sort(at["tables"]), lambda t: F.concat(t["src_table"], F.lit(": "), t["metric"].cast("string")))
        listed = F.when(F.size(at["tables"]) >= 2, F.concat(F.lit(" ("), F.array_join(each, ", "), F.lit(")"))).otherwise(F.lit(""))
        return F.concat(F.lit(f"{side} {METRICS[model.UNIQUENESS].said} = "), at["total"]["metric"].cast("string"), listed)

    gap = F.abs(s["total"]["metric"] - d["total"]["metric"])
    return verdict(gap == 0, gap, d["total"]["rows"], F.concat_ws(" | ", said("source", s), said("destination", d)))


def _wanted(check: ColumnParity, column_map: Sequence[Mapping], source: Frames, destination: Frames):
    if check.validation_type == model.REGEX and not check.pattern:
        raise CheckError(f"{model.REGEX} needs a regex pattern")
    s_cols = columns_for(column_map, "source", source, check.source_column)
    d_cols = columns_for(column_map, "destination", destination, check.destination_column)
    left = Wanted(check.validation_type, s_cols, check.pattern)
    right = Wanted(check.validation_type, d_cols, check.pattern)
    require(source, left)
    require(destination, right)
    return left, right


def column_parity_many(
    source: Frames, destination: Frames, checks: Sequence[ColumnParity], column_map: Sequence[Mapping] = ()
) -> DataFrame:
    """Many column checks over the same tables from one scan per table.

    Gives ``position`` and the verdict columns, one row per check. Distinct counts and
    category sets need a shuffle on the value and are not part of the shared scan.
    """
    wanted = [_wanted(check, column_map, source, destination) for check in checks]
    sides = together(
        s=measure(source, [left for left, _ in wanted]),
        d=measure(destination, [right for _, right in wanted]),
    )
    s_types, d_types = sides.schema["s"].dataType, sides.schema["d"].dataType
    rows = F.array(*(
        F.struct(F.lit(i).alias("position"), *_metric_verdict(
            check.validation_type, f"s.m{i}", f"d.m{i}",
            s_types[f"m{i}"].dataType, d_types[f"m{i}"].dataType,
        ))
        for i, check in enumerate(checks)
    ))
    return sides.select(F.explode(rows).alias("v")).select("v.*")


def shares_a_scan(check: ColumnParity) -> bool:
    return check.validation_type not in (model.UNIQUENESS, model.CATEGORICAL)


def column_parity(
    source: Frames, destination: Frames, check: ColumnParity, column_map: Sequence[Mapping] = ()
) -> DataFrame:
    """One column check: the metric over both sides, compared."""
    if shares_a_scan(check):
        return column_parity_many(source, destination, [check], column_map).drop("position")
    left, right = _wanted(check, column_map, source, destination)
    if check.validation_type == model.CATEGORICAL:
        return categorical_parity(source, destination, left.columns, right.columns)
    if check.approximate:
        return estimated_uniqueness(source, destination, left.columns, right.columns)
    sides = together(
        s=measure_distinct(source, left.columns), d=measure_distinct(destination, right.columns)
    )
    s_types, d_types = sides.schema["s"].dataType, sides.schema["d"].dataType
    return sides.select(*_metric_verdict(
        model.UNIQUENESS, "s.m0", "d.m0", s_types["m0"].dataType, d_types["m0"].dataType
    ))


def estimated_uniqueness(
    source: Frames, destination: Frames, source_columns: Mapping[str, str], destination_columns: Mapping[str, str]
) -> DataFrame:
    """Distinct values of both sides from sketches: one scan a table, nothing shuffled but a sketch each.

    Passes when the two numbers can be the same: violations count what is left between their bounds, which details name.
    """
    sides = together(s=merged_distinct(distinct_sketches(source, source_columns)), d=merged_distinct(distinct_sketches(destination, destination_columns)))
    s, d = F.col("s"), F.col("d")
    gap = F.greatest(s["low"] - d["high"], d["low"] - s["high"], F.lit(0))

    def said(side: str, at: Column) -> Column:
        return F.concat(F.lit(f"{side} about "), at["estimate"].cast("string"), F.lit(" different ("), at["low"].cast("string"), F.lit(" to "),
                        at["high"].cast("string"), F.lit(")"))

    return sides.select(*verdict(gap == 0, gap, d["rows"], F.concat_ws(" | ", said("source", s), said("destination", d))))


# --- value sets -----------------------------------------------------------------------------

def category_sets(
    source: Frames, destination: Frames, source_columns: Mapping[str, str], destination_columns: Mapping[str, str]
) -> DataFrame:
    """One row per distinct value: which sides hold it, which source tables, how many rows."""
    arms = []
    for side, frames, columns in (
        (IN_SOURCE, source, source_columns), (IN_DESTINATION, destination, destination_columns),
    ):
        dtype = column_type(frames, columns)
        union = tagged_union(frames, columns)
        arms.append(union.select(
            F.lit(side).alias("side"), F.expr(text("val", dtype)).alias("val"),
            *(((F.col("src_table") == t) & F.lit(side == IN_SOURCE)).alias(f"in{i}") for i, t in enumerate(source)),
        ))
    return stack(arms).groupBy("val").agg(
        F.bit_or("side").alias("sides"),
        F.sum(F.when(F.col("side") == IN_DESTINATION, F.lit(1)).otherwise(F.lit(0))).alias("destination_rows"),
        *(F.max(f"in{i}").alias(f"in{i}") for i in range(len(source))),
    )


def categorical_parity(
    source: Frames, destination: Frames, source_columns: Mapping[str, str],
    destination_columns: Mapping[str, str], samples: int = VALUE_SAMPLES,
) -> DataFrame:
    """The set of distinct values on each side; NULL is a value like any other."""
    values = category_sets(source, destination, source_columns, destination_columns)
    counts = values.agg(
        F.count_if(F.col("sides") == IN_SOURCE).alias("missing"),
        F.count_if(F.col("sides") == IN_DESTINATION).alias("extra"),
        F.count_if(F.col("sides").bitwiseAND(IN_SOURCE) > 0).alias("source_values"),
        F.coalesce(F.sum("destination_rows"), F.lit(0)).alias("destination_rows"),
        # The examples need every column; asked for here too, all three parts share one shuffle.
        F.max("val").alias("last"), *(F.max(f"in{i}").alias(f"any{i}") for i in range(len(source))),
    )
    quoted = F.when(F.col("val").isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.col("val"), F.lit("'")))
    origin = F.array_join(F.array(*(F.when(F.col(f"in{i}"), F.lit(t)) for i, t in enumerate(source))), ", ")
    named = {"missing": (IN_SOURCE, F.concat(quoted, F.lit(" of "), origin)), "extra": (IN_DESTINATION, quoted)}
    parts = {"counts": counts}
    for name, (side, label) in named.items() if samples else ():
        top = values.filter(F.col("sides") == side).orderBy(F.col("val").asc_nulls_last()).limit(samples)
        parts[name] = _listed(top.select(F.struct(F.col("val").isNull(), F.col("val"), label.alias("label"), origin.alias("origin"), "destination_rows").alias("at")))
    out = together(**parts)
    n = F.col("counts")
    passed = (n["missing"] == 0) & (n["extra"] == 0)
    details = _found("values", n["source_values"] - n["missing"], n["source_values"], n, samples)
    return out.select(*verdict(passed, n["missing"] + n["extra"], n["destination_rows"], details))


def _listed(top: DataFrame) -> DataFrame:
    """The labels of an already limited frame, in order, as one row."""
    return top.agg(F.transform(F.array_sort(F.collect_list("at")), lambda e: e["label"]).alias("labels"))


def _found(what: str, held: Column, of: Column, n: Column, samples: int) -> Column:
    """``9 of 10 keys on both sides; 1 only in source: 7; 2 only in destination: 11, 12``."""
    def only(name: str, side: str) -> Column:
        listed = F.concat(F.lit(": "), F.array_join(F.col(name)["labels"], ", ")) if samples else F.lit("")
        return F.when(n[name] > 0, F.concat(n[name].cast("string"), F.lit(f" only in {side}"), listed))

    both = F.concat(held.cast("string"), F.lit(" of "), of.cast("string"), F.lit(f" {what} on both sides"))
    return F.concat_ws("; ", both, only("missing", "source"), only("extra", "destination"))


# --- key sets -------------------------------------------------------------------------------

def key_sides(
    source: Frames, destination: Frames, source_columns: Mapping[str, str], destination_columns: Mapping[str, str]
) -> DataFrame:
    """One row per key value with the sides that hold it, from one shuffle on the key.

    Whole-number keys on both sides are compared as numbers, anything else as key text.
    """
    s_type, d_type = column_type(source, source_columns), column_type(destination, destination_columns)
    numeric = isinstance(s_type, INTEGERS) and isinstance(d_type, INTEGERS)

    def arm(frames: Frames, columns: Mapping[str, str], dtype: T.DataType, side: int) -> DataFrame:
        key = "cast(val as bigint)" if numeric else key_text("val", dtype)
        return tagged_union(frames, columns).select(F.expr(key).alias("key"), F.lit(side).alias("side"))

    both = arm(source, source_columns, s_type, IN_SOURCE).unionByName(
        arm(destination, destination_columns, d_type, IN_DESTINATION)
    )
    return both.groupBy("key").agg(F.bit_or("side").alias("sides"))


def key_differences(
    source: Frames, destination: Frames, source_columns: Mapping[str, str], destination_columns: Mapping[str, str]
) -> DataFrame:
    """Keys on one side only: ``key, found_in``."""
    keys = key_sides(source, destination, source_columns, destination_columns)
    side = F.when(F.col("sides") == IN_SOURCE, F.lit("source")).otherwise(F.lit("destination"))
    return keys.filter(F.col("sides") != IN_SOURCE + IN_DESTINATION).select("key", side.alias("found_in"))


def key_parity(
    source: Frames, destination: Frames, key: str, column_map: Sequence[Mapping] = (), samples: int = KEY_SAMPLES
) -> DataFrame:
    """Is every key value on both sides? Repeats do not count, NULL is one key value."""
    s_cols = columns_for(column_map, "source", source, key)
    d_cols = columns_for(column_map, "destination", destination, key)
    keys = key_sides(source, destination, s_cols, d_cols)
    counts = keys.agg(
        F.count_if(F.col("sides") == IN_SOURCE).alias("missing"),
        F.count_if(F.col("sides") == IN_DESTINATION).alias("extra"),
        F.count_if(F.col("sides").bitwiseAND(IN_SOURCE) > 0).alias("source_keys"),
    )
    parts = {"counts": counts}
    for name, side in (("missing", IN_SOURCE), ("extra", IN_DESTINATION)) if samples else ():
        top = keys.filter(F.col("sides") == side).orderBy(F.col("key").asc_nulls_last()).limit(samples)
        label = F.coalesce(F.col("key").cast("string"), F.lit("NULL")).alias("label")
        parts[name] = _listed(top.select(F.struct(F.col("key").isNull(), F.col("key"), label).alias("at")))
    out = together(**parts)
    n = F.col("counts")
    passed = (n["missing"] == 0) & (n["extra"] == 0)
    details = _found(f"{key} keys", n["source_keys"] - n["missing"], n["source_keys"], n, samples)
    return out.select(*verdict(passed, n["missing"] + n["extra"], n["source_keys"], details))


# --- whole rows -----------------------------------------------------------------------------

def _lined_up(source: Frames, destination: Frames, column_map: Sequence[Mapping]):
    s = {t: rename_to_common(df, column_map, "source", t) for t, df in source.items()}
    d = {t: rename_to_common(df, column_map, "destination", t) for t, df in destination.items()}
    s_names = {name for df in s.values() for name in df.columns}
    d_names = {name for df in d.values() for name in df.columns}
    shared, skipped = shared_columns(s_names, d_names)
    if not shared:
        raise CheckError("the two sides share no column name; map their columns or compare one key column")
    return s, d, shared, skipped


def _tagged_rows(source: Frames, destination: Frames, shared: Sequence[str]) -> DataFrame:
    s_arms, d_arms = comparable_rows(source, destination, shared)
    return stack([
        *(df.select("*", F.lit(True).alias("__source")) for df in s_arms),
        *(df.select("*", F.lit(False).alias("__source")) for df in d_arms),
    ])


def row_balance(
    source: Frames, destination: Frames, column_map: Sequence[Mapping] = ()
) -> tuple[DataFrame, list[str], list[str]]:
    """Distinct rows with their number of copies on each side.

    One shuffle: copies collapse to two counts on the map side, so a row that makes up a third
    of a table travels once per task.
    """
    s, d, shared, skipped = _lined_up(source, destination, column_map)
    return _copies(_tagged_rows(s, d, shared), [c(n) for n in shared]), shared, skipped


def _copies(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_if("__source").alias("source_copies"),
        F.count_if(~F.col("__source")).alias("destination_copies"),
    )


def _cut_cells(rows: DataFrame, shared: Sequence[str]) -> DataFrame:
    """The rows with long texts cut to what an example shows of them and their SHA-256, so that a row stays narrow and stays itself."""
    cells = []
    for name in shared:
        own = q(name)
        if isinstance(rows.schema[name].dataType, T.StringType):
            own = f"if(octet_length({own}) <= {CELL_BYTES}, {own}, concat(left({own}, {SAMPLE_WIDTH}), '#', sha2({own}, 256)))"
        cells.append(f"{own} as {q(name)}")
    return rows.selectExpr(*cells, "__source")


def _wide(rows: DataFrame, shared: Sequence[str]) -> DataFrame:
    """The rows as one example text and the SHA-256 of all cells; -0.0 is 0.0, as it is when rows are grouped."""
    level = rows.select(*(
        (c(n) + F.lit(0.0)).alias(n) if isinstance(rows.schema[n].dataType, FLOATS) else c(n) for n in shared
    ), "__source")
    return level.select(_row_text(rows, shared).alias("__shown"), row_digest(shared).alias("__digest"), "__source")


def row_differences(source: Frames, destination: Frames, column_map: Sequence[Mapping] = ()) -> DataFrame:
    """Rows whose number of copies differs: shared columns, ``found_in`` and ``copies``."""
    balance, shared, _ = row_balance(source, destination, column_map)
    net = F.col("source_copies") - F.col("destination_copies")
    side = F.when(net > 0, F.lit("source")).otherwise(F.lit("destination"))
    return balance.filter(net != 0).select(*(c(n) for n in shared), side.alias("found_in"), F.abs(net).alias("copies"))


def _row_text(df: DataFrame, shared: Sequence[str]) -> Column:
    """A row as ``(name=cell, ...)``; text cells are in their normal form already."""
    cells = []
    for name in shared:
        dtype = df.schema[name].dataType
        cell = q(name) if isinstance(dtype, T.StringType) else normalise_cell(q(name), dtype)
        cells.append(f"concat({literal(name + '=')}, nullif({cell}, ''))")
    return F.expr(f"concat('(', left(concat_ws(', ', {', '.join(cells)}), {SAMPLE_WIDTH}), ')')")


def row_parity(
    source: Frames, destination: Frames, column_map: Sequence[Mapping] = (), samples: int = ROW_SAMPLES,
) -> DataFrame:
    """Does every row exist on both sides, with the same number of copies?

    Each table is read once. What is shuffled of a distinct row is bounded: its cells, long texts cut and hashed, or for tables of many
    columns one hash and the text an example shows. Either way the rows shown as examples, the smallest ones, can be
    read off the groups.
    """
    s, d, shared, skipped = _lined_up(source, destination, column_map)
    rows = _tagged_rows(s, d, shared)
    if len(shared) <= NARROW:
        rows, keys = _cut_cells(rows, shared), list(shared)
        label = _row_text(rows, shared)
    else:
        rows, keys = _wide(rows, shared), ["__digest", "__shown"]
        label = F.col("__shown")
    balance = _copies(rows, [c(n) for n in keys])
    net = F.col("source_copies") - F.col("destination_copies")
    counts = balance.agg(
        F.coalesce(F.sum(F.greatest(net, F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-net, F.lit(0))), F.lit(0)).alias("extra"),
        F.coalesce(F.sum("source_copies"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("destination_copies"), F.lit(0)).alias("destination_rows"),
    )
    parts = {"counts": counts}
    for name, side in (("missing", net > 0), ("extra", net < 0)) if samples else ():
        top = balance.filter(side).orderBy(*(c(n) for n in keys)).limit(samples)
        parts[name] = _listed(top.select(F.struct(F.struct(*(c(n) for n in keys)).alias("key"), label.alias("label")).alias("at")))
    out = together(**parts)
    n = F.col("counts")
    passed = (n["missing"] == 0) & (n["extra"] == 0)
    details = _found("rows", n["source_rows"] - n["missing"], n["source_rows"], n, samples)
    scope = f"; compared on {len(shared)} columns"
    if skipped:
        scope += f", {len(skipped)} are on one side only: {', '.join(skipped[:SKIPPED_SHOWN])}"
    return out.select(*verdict(passed, n["missing"] + n["extra"], n["source_rows"], F.concat(details, F.lit(scope))))
