"""Dynamic typing of displayed text, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an integer and as a decimal number in displayed text.
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
DECIMAL = r"^\s*[+-]?(\d+(_\d+)*\.(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def is_decimal(text: Column) -> Column:
    return F.coalesce(text.rlike(DECIMAL), F.lit(False))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(INTEGER) | text.rlike(DECIMAL), F.lit(False))


def number(text: Column) -> Column:
    """The number a displayed text stands for, null where it is only text: percentages, dates, `1,234`, `1e5`, `nan`."""
    return F.when(is_number(text), F.regexp_replace(F.trim(text), "[_\\s]", "").try_cast("double"))


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once and stands once in the plan, however often ``body`` speaks of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decimal_text(value: Column) -> Column:
    """A double as its shortest decimal text: `10000000.0`, `0.0001`, `1e-05`, `1e+16`."""
    return named(value, _decimal_text)


def _decimal_text(value: Column) -> Column:
    short = value.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.split_part(short, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(short, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    size = F.abs(value)
    return F.when((size != 0) & ((size < 1e-4) | (size >= 1e16)) & short.contains("E"), scientific).when(short.contains("E"), plain).otherwise(short)


def value_text(text: Column) -> Column:
    """Displayed text after typing: integers lose signs, zeros and separators that don't count, decimals take their shortest form."""
    whole = F.regexp_replace(F.trim(text), "[_\\s]", "")
    return F.when(is_decimal(text), decimal_text(number(text))).when(text.rlike(INTEGER), F.coalesce(whole.try_cast("decimal(38,0)").cast("string"), whole)).otherwise(text)


def same_number(text: Column) -> Column:
    """One text for all spellings of a number, whole or decimal (`7`, `007`, `7.0`), null for other text: what groups are made by."""
    amount = number(text)
    whole = (amount == F.floor(amount)) & (F.abs(amount) < 1e15)
    return F.when(is_decimal(text), F.when(whole, amount.try_cast("decimal(38,0)").cast("string")).otherwise(decimal_text(amount))).when(is_number(text), value_text(text))
