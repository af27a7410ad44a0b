"""Text forms of values: the rules that decide whether two cells are the same.

Each function takes and gives a piece of Spark SQL, so a form is analysed in one go however
wide the table is, and stays inside generated code. ``F.expr`` turns it into a Column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as blank around a cell.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
# What may be a date, and where two-digit years turn over.
DATE_LIKE = "^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$"
YEAR_PIVOT = 69

TIME = "([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?"
KEY_DAY = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"

NESTED = (T.StructType, T.ArrayType, T.MapType)


def q(name: str) -> str:
    """A column by its exact name, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(x: str) -> str:
    """The text without blanks around it; text that starts and ends in plain ASCII is left alone."""
    plain = f"ascii({x}) between 33 and 126 and ascii(substring({x}, -1, 1)) between 33 and 126"
    return f"if({plain}, {x}, btrim({x}, {literal(BLANKS)}))"


def double_text(x: str) -> str:
    """A double in plain digits between 1e-4 and 1e16, with an ``e`` form outside."""
    raw = f"cast({x} as string)"
    sign = f"if(startswith({raw}, '-'), '-', '')"
    mantissa = f"regexp_extract({raw}, '^-?([0-9]+[.][0-9]+)E', 1)"
    exponent = f"try_cast(regexp_extract({raw}, 'E(-?[0-9]+)$', 1) as int)"
    digits = f"regexp_replace(replace({mantissa}, '.', ''), '(?<=[0-9])0+$', '')"
    whole = f"rpad(substring({digits}, 1, {exponent} + 1), {exponent} + 1, '0')"
    rest = f"coalesce(nullif(substring({digits}, {exponent} + 2, 40), ''), '0')"
    power = f"concat(if({exponent} < 0, 'e-', 'e+'), if(abs({exponent}) < 10, '0', ''), cast(abs({exponent}) as string))"
    return f"""case when not contains({raw}, 'E') then {raw}
        when {exponent} between 7 and 15 then concat({sign}, {whole}, '.', {rest})
        when {exponent} = -4 then concat({sign}, '0.000', {digits})
        else concat({sign}, regexp_replace({mantissa}, '[.]0$', ''), {power}) end"""


def text(x: str, dtype: T.DataType) -> str:
    """The value as text, one form per type, NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return x
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return double_text(f"cast({x} as double)")
    if isinstance(dtype, NESTED):
        return f"to_json({x})"
    if isinstance(dtype, T.BinaryType):
        return f"hex({x})"
    return f"cast({x} as string)"


def date_parts(cell: str) -> str:
    """The three numbers of a cell that may be a date, NULL for any other cell."""
    return f"""case when length({cell}) between 5 and 12 and {cell} rlike '{DATE_LIKE}'
        and not (contains({cell}, '-') and contains({cell}, '/')) then split({cell}, '[-/]') end"""


def date_of(cell: str, parts: str) -> str:
    """ISO text of a date written in one of nine day/month/year layouts, else NULL.

    Four-digit years win over two-digit ones and day-first wins over month-first:
    Y-m-d, Y/m/d, d-m-Y, d/m/Y, m-d-Y, m/d/Y, y-m-d, d-m-y, d/m/y.
    """
    first, middle, last = (f"get({parts}, {i})" for i in range(3))

    def day(year: str, month: str, number: str) -> str:
        return f"if({year} = '0000', null, try_cast(concat_ws('-', {year}, {month}, {number}) as date))"

    def long(short: str) -> str:
        return f"cast(int({short}) + if(int({short}) >= {YEAR_PIVOT}, 1900, 2000) as string)"

    return f"""cast(case
        when length({first}) = 4 and length({last}) <= 2 then {day(first, middle, last)}
        when length({last}) = 4 and length({first}) <= 2
          then coalesce({day(last, middle, first)}, {day(last, first, middle)})
        when length({first}) <= 2 and length({last}) <= 2 then coalesce(
          if(contains({cell}, '-') and length({first}) = 2, {day(long(first), middle, last)}, null),
          if(length({last}) = 2, {day(long(last), middle, first)}, null))
        end as string)"""


def iso_date(x: str) -> str:
    return date_of(x, date_parts(x))


def settled(cell: str, parts: str) -> str:
    """A stripped cell in its one form: midnight as a date, 5.0 as 5, dates as ISO, NULL as blank.

    Dates are read inside a lambda. That keeps their long code out of the fused stage, which
    would otherwise outgrow what the JVM compiles once a table has a few text columns.
    """
    return f"""case when {cell} is null then ''
        when length({cell}) = 19 and substring({cell}, 5, 1) = '-' and endswith({cell}, '00:00:00')
          then substring({cell}, 1, 10)
        when endswith({cell}, '.0') and {cell} rlike '^-*[0-9]+[.]0$' then substring({cell}, 1, length({cell}) - 2)
        when {parts} is null then {cell}
        else coalesce(get(transform(array({parts}), p -> {date_of(cell, 'p')}), 0), {cell}) end"""


def normalise_text(x: str) -> str:
    """One form per cell, in one expression; whole tables take :func:`normalise_columns`."""
    return settled(strip(x), date_parts(strip(x)))


def normalise_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named text columns in their one form.

    Three projections, so that each cell is stripped and split once however often the rules
    look at it.
    """
    if not names:
        return df
    chosen = set(names)
    parts = {name: q(f"{name}\u0001parts") for name in names}
    stripped = df.selectExpr(*(f"{strip(q(n))} as {q(n)}" if n in chosen else q(n) for n in df.columns))
    split = stripped.selectExpr("*", *(f"{date_parts(q(n))} as {parts[n]}" for n in names))
    return split.selectExpr(*(f"{settled(q(n), parts[n])} as {q(n)}" if n in chosen else q(n) for n in df.columns))


def plain_cell(x: str, dtype: T.DataType) -> str | None:
    """A cell whose type settles its form, as text; NULL is blank. None for types that arrive as text."""
    if isinstance(dtype, T.BooleanType):
        return f"case when {x} is null then '' when {x} then 'True' else 'False' end"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)):
        return f"coalesce(cast({x} as string), '')"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        wide = f"cast({x} as double)"
        return f"""case when {x} is null then ''
            when abs({wide}) < 1e15 and {wide} = floor({wide}) then cast(cast({wide} as bigint) as string)
            else regexp_replace({double_text(wide)}, '[.]0$', '') end"""
    if isinstance(dtype, T.DecimalType):
        return f"coalesce(regexp_replace(cast({x} as string), '^(-?[0-9]+)[.]0$', '$1'), '')"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"""case when {x} is null then ''
            when date_trunc('day', {x}) = {x} then cast(cast({x} as date) as string)
            when date_trunc('second', {x}) = {x} then date_format({x}, 'yyyy-MM-dd HH:mm:ss')
            else date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') end"""
    return None


def normalise_cell(x: str, dtype: T.DataType) -> str:
    """The cell as whole-row comparison sees it when the two sides' types differ."""
    return plain_cell(x, dtype) or normalise_text(text(x, dtype))


def key_text(x: str, dtype: T.DataType) -> str:
    """A key as text: timestamps and date-like text collapse to their date."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"cast(cast({x} as date) as string)"
    if isinstance(dtype, T.StringType):
        cell = f"trim({x})"
        day = f"replace(regexp_extract({cell}, '^({KEY_DAY})', 1), '/', '-')"
        return f"""case when {cell} rlike '^({KEY_DAY}){TIME}$'
            then coalesce(cast(try_cast({day} as date) as string), {x}) else {x} end"""
    return text(x, dtype)


def java_pattern(pattern: str) -> str:
    """The pattern with a closing ``$`` that only matches the very end of the text."""
    slashes = len(pattern[:-1]) - len(pattern[:-1].rstrip("\\"))
    if pattern.endswith("$") and slashes % 2 == 0:
        return pattern[:-1] + r"\z"
    return pattern


def pass_pct(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, NULL when there is nothing to divide by."""
    return F.round(F.try_divide(part * F.lit(100.0), F.nullif(whole, F.lit(0))), 2)
