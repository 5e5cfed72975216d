"""Cleaning and casting of feed and CSV values. Every function maps Column to Column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as Python's ``str.strip`` sees it: Unicode White_Space plus four
# control characters.
SPACE = r"[\s\x1c-\x1f]"
STRIP = rf"(?U)^{SPACE}+|{SPACE}+$"

# Spellings that a default pandas CSV read takes as missing.
DEFAULT_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.regexp_replace(_col(value), STRIP, "")


def _starts_visibly(text: Column) -> Column:
    """A quick test that spares most values the pattern: a visible ASCII first character."""
    return F.ascii(text).between(33, 126)


def strip_plain(name: str | Column) -> Column:
    """``strip`` of a text column itself; only values with odd ends meet the pattern."""
    text = F.col(f"`{name}`") if isinstance(name, str) else name
    clean_ends = _starts_visibly(text) & _starts_visibly(F.right(text, F.lit(1)))
    return F.when(clean_ends, text).otherwise(strip(text))


def safe_int(value: Column | str) -> Column:
    """Integer or NULL. Text must be a whole number; a float is truncated."""
    return _col(value).try_cast("int")


def safe_float(value: Column | str, dtype: T.DataType | None = None) -> Column:
    """4-byte float or NULL; NaN stays NaN.

    Java reads a trailing ``d``/``f`` type letter and hexadecimal floats as numbers;
    neither is one here. Pass ``dtype`` of a non-text source to skip that test.
    """
    column = _col(value)
    parsed = column.try_cast("float")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return parsed
    text = F.lower(F.trim(column.cast("string")))
    suffixed = F.right(text, F.lit(1)).isin("d", "f") & ~text.endswith("inf")
    return F.when(suffixed | text.contains("x"), None).otherwise(parsed).cast("float")


def height_to_inches(value: Column | str) -> Column:
    """``'6-5'`` to 77; parts after the second are ignored; anything else is NULL."""
    parts = F.split(_col(value).cast("string"), "-")
    feet = F.get(parts, F.lit(0)).try_cast("int")
    inches = F.get(parts, F.lit(1)).try_cast("int")
    return (feet * 12 + inches).cast("int")


def season_to_int(value: Column | str) -> Column:
    """``'2023-24'`` to 22023; an unreadable or missing label gives 0."""
    start = F.get(F.split(_col(value).cast("string"), "-"), F.lit(0)).try_cast("int")
    return F.coalesce((start.cast("bigint") + 20000).try_cast("int"), F.lit(0))


def season_from_end_year(year: Column | str | int) -> Column:
    """The season that ends in ``year``: 2023 is season 22022."""
    column = F.lit(year) if isinstance(year, int) else _col(year)
    return (column + 19999).cast("int")


def blank_to_null(value: Column | str, dtype: T.DataType | None = None) -> Column:
    """NaN and whitespace-only text become NULL."""
    column = _col(value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return F.when(_starts_visibly(column), column).when(
        ~column.rlike(rf"(?U)^{SPACE}*$"), column
    )


def na_to_null(value: Column | str, tokens: Iterable[str] = DEFAULT_NA) -> Column:
    """Missing-value spellings become NULL."""
    column = _col(value)
    return F.when(~column.isin(list(tokens)), column)


def real_overflows(value: Column | str) -> Column:
    """Whether a number fits a double but not a 4-byte float, which would be infinite."""
    column, infinite = _col(value), F.lit(float("inf"))
    narrow, wide = F.abs(column.try_cast("float")), F.abs(column.try_cast("double"))
    return (narrow == infinite) & (wide < infinite)


def truncated_int(value: Column | str) -> Column:
    """Number text to integer, dropping the fraction; NULL if it is no number."""
    return _col(value).try_cast("double").try_cast("int")


def stringify(
    value: Column | str, py_quirk: bool = False, dtype: T.DataType | None = None
) -> Column:
    """Text form, empty text as NULL.

    With ``py_quirk`` a missing value turns into the text ``None`` and a NaN into
    ``nan``, as ``str()`` of the raw value would.
    """
    column = _col(value)
    text = F.nullif(column.cast("string"), F.lit(""))
    if not py_quirk:
        return text
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = F.when(F.isnan(column), F.lit("nan")).otherwise(text)
    return F.when(column.isNull(), F.lit("None")).otherwise(text)
