"""Set checks over the same tables, answered by one grouping.

Keys, value sets and distinct counts all ask which tables hold a value. Every table is read once; a row gives one value for each check, a value
and a check become a bit for each table that holds it, and what a check reports is counted from those bits. Hot values are one row
per task before the shuffle, whichever check they belong to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import model
from tallymark.functions.columns import columns_for
from tallymark.functions.text import key_text, text
from tallymark.model import ALL_COLUMNS, Check, ColumnParity, KeyParity
from tallymark.operators.parity import KEY_SAMPLES, uniqueness_verdict
from tallymark.operators.sides import INTEGERS, as_type, column_type, stack
from tallymark.operators.verdicts import together, verdict

#: Tables of both sides that have a bit.
MOST_TABLES = 62

Frames = Mapping[str, DataFrame]


def shares_a_grouping(check: Check) -> bool:
    if isinstance(check, ColumnParity):
        return check.validation_type in (model.UNIQUENESS, model.CATEGORICAL) and not check.approximate
    return isinstance(check, KeyParity) and check.key != ALL_COLUMNS


def _cells(check: Check, source: Frames, destination: Frames, column_map: Sequence[Mapping]) -> tuple[dict[str, str], dict[str, str], bool]:
    """The check's value in each table of both sides, in SQL, and whether the values are whole numbers."""
    names = (check.key, check.key) if isinstance(check, KeyParity) else (check.source_column, check.destination_column)
    sides = [(f, columns_for(column_map, side, f, name)) for side, f, name in zip(("source", "destination"), (source, destination), names)]
    types = [column_type(frames, columns) for frames, columns in sides]
    whole = isinstance(check, KeyParity) and all(isinstance(t, INTEGERS) for t in types)
    form = key_text if isinstance(check, KeyParity) and not whole else text
    made = [{t: form(f"({as_type(df, columns[t], dtype)})", dtype) for t, df in frames.items()} for (frames, columns), dtype in zip(sides, types)]
    return made[0], made[1], whole


def held_values(source: Frames, destination: Frames, checks: Sequence[Check], column_map: Sequence[Mapping] = ()) -> DataFrame:
    """at (the check), value, bits (of the tables, source first), source_rows and destination_rows: a row per distinct value and check."""
    cells = [_cells(check, source, destination, column_map) for check in checks]
    arms = []
    for side, frames in enumerate((source, destination)):
        for k, (table, df) in enumerate(frames.items()):
            entries = ", ".join(f"named_struct('at', {i}, 'value', {cell[side][table]})" for i, cell in enumerate(cells))
            arms.append(df.selectExpr(f"inline(array({entries}))", f"{1 << (k + side * len(source))}L as bit", f"{1 - side}L as s", f"{side}L as d"))
    return stack(arms).groupBy("at", "value").agg(F.bit_or("bit").alias("bits"), F.sum("s").alias("source_rows"), F.sum("d").alias("destination_rows"))


def set_parity_many(
    source: Frames, destination: Frames, checks: Sequence[Check], column_map: Sequence[Mapping] = (), samples: int = KEY_SAMPLES
) -> DataFrame:
    """``position`` and the verdict columns of key, value-set and uniqueness checks, as each gives on its own."""
    values = held_values(source, destination, checks, column_map)
    whole = [i for i, c in enumerate(checks) if _cells(c, source, destination, column_map)[2]]
    ours = (1 << len(source)) - 1
    theirs = ((1 << len(destination)) - 1) << len(source)

    def held(mask: int, bits: Column = F.col("bits")) -> Column:
        return bits.bitwiseAND(F.lit(mask).cast("bigint")) != 0

    missing, extra, known = held(ours) & ~held(theirs), ~held(ours), F.col("value").isNotNull()
    tables = [(t, 1 << k) for k, t in enumerate((*source, *destination))]
    figures = values.groupBy("at").agg(
        F.count_if(missing).alias("missing"), F.count_if(extra).alias("extra"), F.count_if(held(ours)).alias("source_values"),
        F.sum("source_rows").alias("source_rows"), F.sum("destination_rows").alias("destination_rows"),
        F.count_if(held(ours) & known).alias("source_distinct"), F.count_if(held(theirs) & known).alias("destination_distinct"),
        *(F.count_if(held(bit) & known).alias(f"t{k}") for k, (_, bit) in enumerate(tables)),
        *(F.max(held(bit)).alias(f"has{k}") for k, (_, bit) in enumerate(tables)),
        # The examples need the values, and ask for the rows because this does: all parts then share one shuffle.
        F.max("value").alias("last"),
    )
    parts = {"figures": figures.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("*")))).alias("by"))}
    listed = [i for i, c in enumerate(checks) if not (isinstance(c, ColumnParity) and c.validation_type == model.UNIQUENESS)]
    number = F.when(F.col("at").isin(whole), F.expr("try_cast(value as bigint)")) if whole else F.lit(None).cast("bigint")
    order = [F.col("value").isNull(), number, F.col("value")]
    categories = F.col("at").isin([i for i in listed if isinstance(checks[i], ColumnParity)])
    quoted = F.when(known, F.concat(F.lit("'"), F.col("value"), F.lit("'"))).otherwise(F.lit("NULL"))
    origin = F.array_join(F.array(*(F.when(held(1 << k), F.lit(t)) for k, t in enumerate(source))), ", ")
    # A condition on the check alone would be moved below the grouping, which would then be another one.
    bits = F.col("bits") * F.col("at").isin(listed).cast("bigint")
    sides = {"missing": held(ours, bits) & ~held(theirs, bits), "extra": held(theirs, bits) & ~held(ours, bits)}
    for name, side in sides.items() if samples and listed else ():
        labels = F.when(categories, F.concat(quoted, F.lit(" of "), origin) if name == "missing" else quoted).otherwise(F.coalesce("value", F.lit("NULL")))
        ranked = values.where(side).withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(*order)))
        top = ranked.where(F.col("place") <= samples).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("place", labels.alias("label"), "source_rows", "destination_rows"))).alias("top"))
        parts[name] = top.agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("top.label")))).alias("by"))
    row = together(**parts)
    return row.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("position"), *_verdict(check, i, tables, len(source), samples)) for i, check in enumerate(checks)))).alias("v")).select("v.*")


def _verdict(check: Check, i: int, tables: Sequence[tuple[str, int]], sources: int, samples: int) -> list[Column]:
    n = F.col("figures.by")[i]
    count = lambda name: F.coalesce(n[name], F.lit(0))  # noqa: E731 - a check over empty tables has no values
    if isinstance(check, ColumnParity) and check.validation_type == model.UNIQUENESS:
        def side(name: str, own: range) -> Column:
            shown = F.filter(F.array(*(F.when(n[f"has{k}"], F.struct(F.lit(tables[k][0]).alias("src_table"), n[f"t{k}"].alias("metric"))) for k in own)), lambda e: e.isNotNull())
            return F.struct(F.struct(count(f"{name}_rows").alias("rows"), count(f"{name}_distinct").alias("metric")).alias("total"), shown.alias("tables"))

        return uniqueness_verdict(side("source", range(sources)), side("destination", range(sources, len(tables))))
    key = isinstance(check, KeyParity)
    what, of = (f"{check.key} keys", count("source_values")) if key else ("values", count("source_values"))

    def only(name: str, where: str) -> Column:
        found = F.concat(F.lit(": "), F.array_join(F.col(f"{name}.by")[i], ", ")) if samples else F.lit("")
        return F.when(count(name) > 0, F.concat(count(name).cast("string"), F.lit(f" only in {where}"), found))

    both = F.concat((of - count("missing")).cast("string"), F.lit(" of "), of.cast("string"), F.lit(f" {what} on both sides"))
    details = F.concat_ws("; ", both, only("missing", "source"), only("extra", "destination"))
    gaps = count("missing") + count("extra")
    return verdict(gaps == 0, gaps, of if key else count("destination_rows"), details)
