"""One-sided rules over a table: which rows break the rule, out of how many.

Rules that judge a row on its own are predicates, so any number of them share one scan
(:func:`check_rows`). Uniqueness and referential integrity need one shuffle on the key,
with copies of a key collapsed before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import model
from tallymark.functions.columns import c
from tallymark.functions.text import java_pattern, q, text
from tallymark.model import CheckError
from tallymark.operators.verdicts import row_digest, verdict


@dataclass(frozen=True)
class Rule:
    """``failed`` and ``note`` are aggregates over the whole table."""

    name: str
    kind: str
    violations: Column
    note: Column


def _row_rule(name: str, kind: str, bad: Column, what: str) -> Rule:
    violations = F.count_if(bad)
    return Rule(name, kind, violations, F.concat(violations.cast("string"), F.lit(f" {what}")))


def not_null(column: str) -> Rule:
    return _row_rule(f"{column} is filled", model.NULLS, c(column).isNull(), f"null {column} value(s)")


def in_range(column: str, low: object = None, high: object = None) -> Rule:
    if low is None and high is None:
        raise CheckError("a range rule needs a lower or an upper bound")
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c(column) < F.lit(low))
    if high is not None:
        bad = bad | (c(column) > F.lit(high))
    return _row_rule(f"{column} in range", model.RANGE, bad, f"{column} value(s) outside [{low}, {high}]")


def matches(df: DataFrame, column: str, pattern: str) -> Rule:
    if not pattern:
        raise CheckError(f"{model.REGEX} needs a regex pattern")
    value = F.expr(text(q(column), df.schema[column].dataType))
    bad = value.isNotNull() & ~F.regexp_like(value, F.lit(java_pattern(pattern)))
    return _row_rule(f"{column} matches", model.REGEX, bad, f"{column} value(s) not matching the pattern")


def length_between(df: DataFrame, column: str, low: int = 0, high: int | None = None) -> Rule:
    size = F.length(F.expr(text(q(column), df.schema[column].dataType)))
    bad = size < low if high is None else ~size.between(low, high)
    return _row_rule(f"{column} length", model.LENGTH, bad, f"{column} value(s) with a length outside [{low}, {high}]")


def allowed_values(column: str, allowed: Sequence[object]) -> Rule:
    bad = c(column).isNotNull() & ~c(column).isin(list(allowed))
    return _row_rule(f"{column} allowed", model.CATEGORICAL, bad, f"{column} value(s) not on the list")


def expression(sql: str, name: str = "") -> Rule:
    """Rows for which the SQL condition is false or unknown break the rule."""
    bad = ~F.coalesce(F.expr(sql), F.lit(False))
    return _row_rule(name or sql, model.CUSTOM, bad, f"row(s) failing {sql}")


def fresh(column: str, as_of: datetime, max_age: timedelta) -> Rule:
    """The newest value is at most ``max_age`` older than ``as_of``; no value at all is stale."""
    newest = F.max(c(column)).cast("timestamp_ntz")
    stale = F.coalesce(newest < F.lit(as_of - max_age).cast("timestamp_ntz"), F.lit(True))
    note = F.concat(F.lit(f"newest {column} is "), F.coalesce(newest.cast("string"), F.lit("missing")))
    return Rule(f"{column} is fresh", model.FRESHNESS, stale.cast("bigint"), note)


def volume_between(low: int | None = None, high: int | None = None) -> Rule:
    """Violations are the rows too few or too many."""
    rows = F.count(F.lit(1))
    short = F.greatest(F.lit(low) - rows, F.lit(0)) if low is not None else F.lit(0)
    over = F.greatest(rows - F.lit(high), F.lit(0)) if high is not None else F.lit(0)
    note = F.concat(rows.cast("string"), F.lit(f" rows, expected [{low}, {high}]"))
    return Rule("row volume", model.VOLUME, short + over, note)


def check_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All rules in one scan: ``position, rule, validation_type`` and the verdict columns."""
    measured = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *(rule.violations.alias(f"v{i}") for i, rule in enumerate(rules)),
        *(rule.note.alias(f"n{i}") for i, rule in enumerate(rules)),
    )
    rows = F.array(*(
        F.struct(
            F.lit(i).alias("position"), F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("validation_type"),
            *verdict(F.col(f"v{i}") == 0, F.col(f"v{i}"), F.col("total_rows"), F.col(f"n{i}")),
        )
        for i, rule in enumerate(rules)
    ))
    return measured.select(F.explode(rows).alias("r")).select("r.*")


def check_rule(df: DataFrame, rule: Rule) -> DataFrame:
    return check_rows(df, [rule]).drop("position", "rule", "validation_type")


def unique(df: DataFrame, columns: Sequence[str], digest: bool = False) -> DataFrame:
    """Violations are the key values that occur more than once; NULL keys are left out.

    With ``digest`` the shuffle carries the SHA-256 of the key, for keys that are long texts.
    """
    filled = F.lit(True)
    for name in columns:
        filled = filled & c(name).isNotNull()
    keys = [row_digest(columns).alias("k")] if digest else [c(name).alias(f"k{i}") for i, name in enumerate(columns)]
    copies = df.groupBy(*keys, filled.alias("filled")).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("filled") & (F.col("n") > 1)
    measured = copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_if(repeated).alias("violations"),
        F.coalesce(F.sum(F.when(repeated, F.col("n") - 1)), F.lit(0)).alias("surplus"),
    )
    details = F.concat(
        F.col("violations").cast("string"), F.lit(f" repeated ({', '.join(columns)}) value(s), "),
        F.col("surplus").cast("string"), F.lit(" surplus row(s)"),
    )
    return measured.select(*verdict(F.col("violations") == 0, F.col("violations"), F.col("total_rows"), details))


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """``key, n``: child key values without a parent and the rows that carry them.

    Both tables shrink to one row per key before the shuffle and meet in a grouping, so a
    hot key costs no join and no side is broadcast.
    """
    both = child.select(c(child_key).alias("key"), F.lit(1).alias("n"), F.lit(False).alias("known")).unionByName(
        parent.select(c(parent_key).alias("key"), F.lit(0).alias("n"), F.lit(True).alias("known"))
    )
    return both.groupBy("key").agg(F.sum("n").alias("n"), F.max("known").alias("known"))


def referential(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, nulls_fail: bool = False
) -> DataFrame:
    """Violations are the child rows whose key no parent row carries."""
    keys = orphan_keys(child, child_key, parent, parent_key)
    orphan = F.when(F.col("key").isNull(), F.lit(nulls_fail)).otherwise(~F.col("known"))
    measured = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("violations"),
        F.count_if(orphan & (F.col("n") > 0)).alias("keys"),
    )
    details = F.concat(
        F.col("violations").cast("string"), F.lit(" row(s) with "), F.col("keys").cast("string"),
        F.lit(f" {child_key} value(s) that have no parent"),
    )
    return measured.select(*verdict(F.col("violations") == 0, F.col("violations"), F.col("total_rows"), details))
