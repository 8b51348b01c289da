"""Cleaning and casting expressions. All of them stay inside Catalyst."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Space separators (Unicode category Zs), the characters a trim removes.
SPACES = " \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"

_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NOT_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
_DATE = r"^\s*\d{1,7}([-/ ])\d{1,2}\1\d{1,2}([ T].*)?$"
_LIMITS = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31, "bigint": 2**63}


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def clean_text(column: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(trimmed(column), F.lit(""))


def to_integer(column: Column, sql_type: str = "int") -> Column:
    """Integer of a padded text. `1.0` and `1e2` count as integers, halves round away from zero,
    anything else or out of range is NULL.

    A failing cast raises and catches an exception inside Spark, which costs more than all the rest of a
    row, so a pattern decides first which cast to use and only values out of range ever fail.
    """
    text = trimmed(column)
    parsed = text.try_cast("double")
    number = F.signum(parsed) * F.floor(F.abs(parsed) + 0.5)
    limit = float(_LIMITS[sql_type])
    rounded = F.when((number >= -limit) & (number < limit), number.cast(sql_type))
    return F.when(text.rlike(_INTEGER), text.try_cast(sql_type)).when(text.rlike(_NUMBER), rounded)


def to_double(column: Column) -> Column:
    """Double of a padded text; Java's type suffixes (`1d`, `2f`) are not numbers."""
    text = trimmed(column)
    return F.when(text.rlike(_NUMBER) | text.rlike(_NOT_FINITE), text.try_cast("double"))


def to_date(column: Column) -> Column:
    """Date of a padded text with year, month and day; a year or a month alone is NULL."""
    text = trimmed(column)
    dashed = F.regexp_replace(text, r"^(\d+)[/ ](\d+)[/ ](\d+)", "$1-$2-$3")
    return F.when(text.rlike(_DATE), dashed.try_cast("date"))


def yes_flag(column: Column, yes: str) -> Column:
    """TRUE for the yes letter, FALSE for other text, NULL for NULL."""
    return trimmed(column) == F.lit(yes)


def normal_code(column: Column, allowed: tuple[str, ...]) -> Column:
    """Upper-case code without a trailing `.0`; NULL when it is not an allowed one."""
    code = F.regexp_replace(F.upper(trimmed(column)), r"\.0$", "")
    return F.when(code.isin(*allowed), code)


def months_between_labels(earlier: Column, later: Column) -> Column:
    """Calendar-month boundaries crossed, so 31 January to 1 February is 1."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def row_sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def row_any(columns: list[Column]) -> Column:
    return reduce(or_, columns)


def row_min(columns: list[Column]) -> Column:
    """Smallest non-NULL value of a row."""
    return F.least(*columns) if len(columns) > 1 else columns[0]


def row_max(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def ratio(part: Column, whole: Column) -> Column:
    """Double ratio, NULL for an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
