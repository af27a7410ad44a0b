"""Mappings, checks and the schemas of stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymark.functions.columns import clean_column_map

ALL_COLUMNS = "*"
TWO_SIDED = "source_to_destination"
SOURCE_ONLY = "source_only"

# The names of the validation types.
NULLS = "Null Value Constraint"
RANGE = "Boundary Range Constraint"
REGEX = "Regex Pattern Check"
UNIQUENESS = "Uniqueness Constraint"
LENGTH = "Length Constraint"
CATEGORICAL = "Categorical Constraint"
REFERENTIAL = "Referential Integrity"
FRESHNESS = "Data Freshness"
VOLUME = "Record Volume Integrity"
CUSTOM = "Custom"
VALIDATION_TYPES = (
    NULLS, RANGE, REGEX, UNIQUENESS, LENGTH, CATEGORICAL, REFERENTIAL, FRESHNESS, VOLUME, CUSTOM,
)
PARITY_TYPES = (NULLS, UNIQUENESS, RANGE, VOLUME, LENGTH, REGEX, FRESHNESS, CATEGORICAL)

RESULT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("test_case_id", T.StringType()),
    T.StructField("test_label", T.StringType()),
    T.StructField("test_name", T.StringType()),
    T.StructField("rule_target", T.StringType()),
    T.StructField("validation_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("evaluated_query", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("violations", T.DoubleType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("executed_at", T.TimestampType()),
])
RUN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("mapping_id", T.StringType()),
    T.StructField("suite_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_checkpoints", T.IntegerType()),
    T.StructField("pass_count", T.IntegerType()),
    T.StructField("fail_count", T.IntegerType()),
    T.StructField("compute_time_seconds", T.DoubleType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
])


class CheckError(ValueError):
    """The check itself is wrong, so it ends as ERROR and not as FAIL."""


@dataclass(frozen=True)
class Mapping:
    """Source tables paired with destination tables, and how their columns line up."""

    name: str
    source: dict[str, DataFrame]
    destination: dict[str, DataFrame] = field(default_factory=dict)
    column_map: Sequence[dict] = ()
    kind: str = TWO_SIDED
    id: str = ""

    def __post_init__(self) -> None:
        if self.kind not in (TWO_SIDED, SOURCE_ONLY):
            raise ValueError(f"unknown mapping kind {self.kind!r}")
        if not self.source:
            raise ValueError("a mapping needs at least one source table")
        if self.kind == TWO_SIDED and not self.destination:
            raise ValueError("a two-sided mapping needs at least one destination table")
        cleaned = clean_column_map(self.column_map, self.source, self.destination)
        object.__setattr__(self, "column_map", cleaned)
        object.__setattr__(self, "id", self.id or self.name)

    def side(self, side: str, tables: Sequence[str] = ()) -> dict[str, DataFrame]:
        """The named tables of one side, all of them when none is named."""
        frames = self.source if side == "source" else self.destination
        unknown = [t for t in tables if t not in frames]
        if unknown:
            raise CheckError(f"not among this mapping's {side} tables: {', '.join(unknown)}")
        return {t: frames[t] for t in (tables or frames)}

    def every_table(self) -> dict[str, DataFrame]:
        return {**self.destination, **self.source}


@dataclass(frozen=True, kw_only=True)
class Check:
    """What every check carries. Severity, origin and description never change a verdict."""

    name: str
    id: str = ""
    validation_type: str = CUSTOM
    severity: str = "error"
    origin: str = "manual"
    description: str = ""
    active: bool = True

    two_sided = True

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a check needs a name")
        if self.validation_type not in VALIDATION_TYPES:
            raise ValueError(f"unknown validation type {self.validation_type!r}")
        if not self.id:
            object.__setattr__(self, "id", self.name)

    def target(self, mapping: Mapping) -> str:
        raise NotImplementedError


@dataclass(frozen=True, kw_only=True)
class SideBySide(Check):
    """A check that names tables on both sides; empty means all of that side."""

    source_tables: Sequence[str] = ()
    destination_tables: Sequence[str] = ()

    def frames(self, mapping: Mapping) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        return mapping.side("source", self.source_tables), mapping.side("destination", self.destination_tables)

    def target(self, mapping: Mapping) -> str:
        left = ", ".join(self.source_tables or mapping.source)
        right = ", ".join(self.destination_tables or mapping.destination)
        return f"{left} -> {right}"


@dataclass(frozen=True, kw_only=True)
class RowCountMatch(SideBySide):
    validation_type: str = VOLUME


@dataclass(frozen=True, kw_only=True)
class ColumnParity(SideBySide):
    source_column: str
    destination_column: str
    pattern: str | None = None
    #: Uniqueness only: compare sketches of the values instead of the values.
    approximate: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.approximate and self.validation_type != UNIQUENESS:
            raise ValueError(f"only {UNIQUENESS} can be approximate")
        if self.validation_type not in PARITY_TYPES:
            raise ValueError(f"column parity supports only: {', '.join(PARITY_TYPES)}")
        if not self.source_column or not self.destination_column:
            raise ValueError("column parity needs a column on each side")

    def target(self, mapping: Mapping) -> str:
        left = ", ".join(self.source_tables or mapping.source)
        right = ", ".join(self.destination_tables or mapping.destination)
        return f"{left}.{self.source_column} -> {right}.{self.destination_column}"


@dataclass(frozen=True, kw_only=True)
class KeyParity(SideBySide):
    """Key sets on both sides; the key ``*`` compares whole rows."""

    key: str = ALL_COLUMNS

    def target(self, mapping: Mapping) -> str:
        suffix = "all columns" if self.key == ALL_COLUMNS else f"key: {self.key}"
        return f"{super().target(mapping)} ({suffix})"


Script = str | Callable[..., Any]


@dataclass(frozen=True, kw_only=True)
class ScriptCheck(Check):
    """One SELECT, or a callable ``(spark, read_table) -> dict or DataFrame``."""

    script: Script
    side: str = "source"
    tables: Sequence[str] = ()
    two_sided = False

    def target(self, mapping: Mapping) -> str:
        frames = mapping.source if self.side == "source" else mapping.destination
        return ", ".join(self.tables or frames)


@dataclass(frozen=True, kw_only=True)
class DualScriptCheck(Check):
    """One script per side, each giving one value to compare."""

    source_script: Script
    destination_script: Script

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.source_script or not self.destination_script:
            raise ValueError("both a source and a destination script are required")

    def target(self, mapping: Mapping) -> str:
        return f"{', '.join(mapping.source)} -> {', '.join(mapping.destination)}"


@dataclass(frozen=True, kw_only=True)
class RuleCheck(Check):
    """A one-sided rule over one table, or over the rows of all tables of the side when none is named.

    ``rule`` is a Rule, or takes the rows and gives a Rule or a one-row verdict.
    """

    rule: Callable[[DataFrame], DataFrame]
    side: str = "source"
    table: str = ""
    two_sided = False

    def target(self, mapping: Mapping) -> str:
        frames = mapping.source if self.side == "source" else mapping.destination
        return self.table or ", ".join(frames)


def admit(check: Check, mapping: Mapping) -> None:
    """Refuse a check the mapping cannot run; the message says why."""
    if mapping.kind == SOURCE_ONLY:
        if check.two_sided:
            raise CheckError("this mapping has no destination, so it runs one-sided checks only")
        if getattr(check, "side", "source") != "source":
            raise CheckError("this mapping has no destination, so a check has to target the source")
    if isinstance(check, SideBySide):
        check.frames(mapping)
    if isinstance(check, (ScriptCheck, RuleCheck)) and check.side not in ("source", "destination"):
        raise CheckError("a check targets 'source' or 'destination'")
    if isinstance(check, ScriptCheck):
        unknown = [t for t in check.tables if t not in mapping.every_table()]
        if unknown:
            raise CheckError(f"not among this mapping's tables: {', '.join(unknown)}")
    if isinstance(check, ColumnParity) and check.validation_type == REGEX and not check.pattern:
        raise CheckError(f"{REGEX} needs a regex pattern")
