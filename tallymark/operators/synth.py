"""Made-up rows for a schema: any number of them, the same ones for the same seed.

A recipe says what a cell looks like; its slots are drawn from an MD5 of (row, seed, column, slot),
so rows are made in parallel, a lost task makes the same rows again, and another engine can
make them too. Cells are text, as they are when typed in by hand; the typed append casts them to
the target's types.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.text import literal

SYLLABLES = "bakelimorutasovi"
# Short names of ISO 3166-1 countries and of their parts, and the words that the other slots choose from.
CHOICES = {
    "land": ("AO", "BT", "CL", "DK", "EE", "FJ", "GA", "IS"),
    "part": ("CL-03", "DK-82", "EE-37", "IS-05"),
    "step": ("draft", "open", "paid", "void"),
    "unit": ("archive", "kitchen", "garage", "library"),
    "flag": ("false", "true"),
    "tail": ("cooperative", "foundation", "workshop"),
}
# Names under "example" are reserved for documentation (RFC 2606); no country answers to +999 (E.164).
RECIPES = {
    "email": "<word>@<word>.example", "first_name": "<Word>", "last_name": "<Word>", "full_name": "<Word> <Word>",
    "timestamp": "<date> <time>", "date": "<date>", "time": "<time>", "phone": "+999<8>", "street": "<Word> road <2>",
    "city": "<Word>", "zip": "<6>", "country": "<land>", "state": "<part>", "status": "<step>", "url": "https://<word>.example/",
    "department": "<unit>", "company": "<Word> <tail>", "remark": "<word> <word> <word>", "code": "<3>-<3>",
    "boolean": "<flag>", "fraction": "<2>.<2>", "integer": "<2>", "uuid": "<uuid>", "": "<Word> <2>",
}
FIRST_DAY, DAYS = "2001-01-01", 9000

# What a column's name says about its content, the first match wins.
NAME_KINDS = (
    ("email", r"email"),
    ("first_name", r"first.?name|given.?name"),
    ("last_name", r"last.?name|surname|family.?name"),
    ("full_name", r"full.?name|^name$|customer.?name|employee.?name|staff.?name|contact.?name|student.?name"),
    ("timestamp", r"datetime|timestamp"),
    ("date", r"date|_dob$|^dob$|birthdate|anniversary"),
    ("time", r"(^|_)time$"),
    ("phone", r"phone|mobile|telephone"),
    ("street", r"street|address.?line"),
    ("city", r"city|district|town"),
    ("zip", r"zip|postal|pin.?code"),
    ("country", r"country"),
    ("state", r"state|province"),
    ("status", r"status"),
    ("url", r"url|website|link|site"),
    ("department", r"department|^dept$"),
    ("company", r"company|organi[sz]ation|employer"),
    ("remark", r"description|note|comment|remark"),
    ("code", r"(^id$|.?_id$|code|reference|ref)$"),
)
# Type names by family; the timestamp comes before the time.
TYPE_KINDS = (
    ("boolean", r"bool(ean)?"),
    ("decimal", r"decimal.*"),
    ("fraction", r"float|double|real"),
    ("integer", r"tinyint|smallint|int|integer|bigint|hugeint|utinyint|usmallint|uinteger|ubigint"),
    ("uuid", r"uuid"),
    ("date", r"date"),
    ("timestamp", r"timestamp.*"),
    ("time", r"time.*"),
)



class Dialect:
    """How an engine says the few things that engines say differently."""

    def __init__(self, text: str, number: str, day: str) -> None:
        self.text, self.number, self.day = text, number, day


SPARK = Dialect("string", "cast(conv({0}, 16, 10) as bigint)", "date_add(date'{1}', cast({0} as int))")
DUCKDB = Dialect("varchar", "cast('0x' || {0} as bigint)", "(date '{1}' + cast({0} as int))")


class _Draws:
    """The slots of one column's recipe, each from a hash of its own."""

    def __init__(self, seed: int, column: str, dialect: Dialect) -> None:
        self.seed, self.column, self.dialect, self.drawn = seed, column, dialect, 0

    def hex(self) -> str:
        self.drawn += 1
        key = literal(f":{self.seed}:{self.column}:{self.drawn}")
        return f"md5(concat(cast(id as {self.dialect.text}), {key}))"

    def below(self, count: int) -> str:
        return f"({self.dialect.number.format(f'substr({self.hex()}, 1, 8)')} % {count})"

    def digits(self, width: int) -> str:
        return f"lpad(cast({self.below(10**width)} as {self.dialect.text}), {width}, '0')"

    def of(self, slot: str) -> str:
        if slot.isdigit():
            return self.digits(int(slot))
        if slot in CHOICES:
            words = CHOICES[slot]
            arms = " ".join(f"when {k} then {literal(w)}" for k, w in enumerate(words))
            return f"case {self.below(len(words))} {arms} end"
        if slot == "word":
            return "concat(" + ", ".join(f"substr('{SYLLABLES}', cast(1 + 2 * {self.below(len(SYLLABLES) // 2)} as int), 2)" for _ in range(3)) + ")"
        if slot == "Word":
            made = self.of("word")
            return f"concat(upper(substr({made}, 1, 1)), substr({made}, 2))"
        if slot == "date":
            return f"cast({self.dialect.day.format(self.below(DAYS), FIRST_DAY)} as {self.dialect.text})"
        if slot == "time":
            parts = [f"lpad(cast({self.below(n)} as {self.dialect.text}), 2, '0')" for n in (24, 60, 60)]
            return f"concat_ws(':', {', '.join(parts)})"
        if slot == "uuid":  # version 4, variant 8
            made = self.hex()
            return f"concat_ws('-', substr({made}, 1, 8), substr({made}, 9, 4), concat('4', substr({made}, 14, 3)), concat('8', substr({made}, 18, 3)), substr({made}, 21, 12))"
        raise KeyError(slot)


def recipe_of(column: str, data_type: str) -> str:
    """A typed column's recipe follows from its type, a text column's from its name, else it is a word and a number."""
    wanted = data_type.lower().replace("timestamp_ntz", "timestamp")
    kind = next((kind for kind, pattern in TYPE_KINDS if re.fullmatch(pattern, wanted)), None)
    if kind == "decimal":
        found = re.match(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", wanted)
        precision, scale = (int(n) for n in found.groups()) if found else (18, 2)
        whole = f"<{min(2, precision - scale)}>" if precision > scale else "0"
        return f"{whole}.<{scale}>" if scale else whole
    if kind is None:
        kind = next((kind for kind, pattern in NAME_KINDS if re.search(pattern, column.lower())), "")
    return RECIPES[kind]


def cell_sql(column: str, data_type: str, seed: int, dialect: Dialect = SPARK) -> str:
    """The column's value for the row ``id``, in SQL."""
    draws = _Draws(seed, column, dialect)
    pieces = re.split(r"<(\w+)>", recipe_of(column, data_type))
    parts = [draws.of(piece) if k % 2 else literal(piece) for k, piece in enumerate(pieces) if piece]
    return f"concat({', '.join(parts)})"


def cell(column: str, data_type: str, seed: int) -> Column:
    return F.expr(cell_sql(column, data_type, seed))


def columns_of(schema: T.StructType | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    if isinstance(schema, T.StructType):
        return [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return list(schema)


def fill(ids: DataFrame, schema: T.StructType | Sequence[tuple[str, str]], seed: int = 0) -> DataFrame:
    """One made-up row per row of ``ids``, whose column ``id`` is a whole number."""
    return ids.select(*(cell(name, kind, seed).alias(name) for name, kind in columns_of(schema)))


def synthetic_rows(
    spark: SparkSession, schema: T.StructType | Sequence[tuple[str, str]], n: int, seed: int = 0
) -> DataFrame:
    """n made-up rows; there is no upper limit."""
    return fill(spark.range(n), schema, seed)


def non_empty(df: DataFrame) -> DataFrame:
    """Rows with at least one cell that is not blank."""
    filled = [F.when(F.trim(F.col(f"`{name}`").cast("string")) != "", F.lit(1)) for name in df.columns]
    return df.filter(F.coalesce(*filled).isNotNull())
