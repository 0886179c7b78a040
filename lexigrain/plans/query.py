"""The declarative query: where, group and aggregate, select, order, limit over displayed text.

A query is built into one DataFrame plan. Every logical column is typed once: a
text that is a number counts as that number, in conditions, groups, aggregates,
order and output alike. Columns that Spark has typed already are compared as they
are, so that conditions on them reach the scan. Nothing is collected.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

from lexigrain.functions.values import decimal_text, is_decimal, is_number, number, same_number, value_text

OPERATORS = ("eq", "contains", "gt", "lt")
AGGREGATES = ("sum", "count", "avg", "min", "max")


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Aggregate:
    op: str
    column: str
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias or f"{self.op}_{self.column}"


@dataclass(frozen=True)
class Query:
    """``where`` conditions all hold. Grouping happens only with both ``group_by`` and ``aggregates``. ``order_by``: (column, descending)."""

    where: Sequence[Condition] = ()
    group_by: Sequence[str] = ()
    aggregates: Sequence[Aggregate] = ()
    select: Sequence[str] = ()
    order_by: Sequence[tuple[str, bool]] = ()
    limit: int | None = None

    def validate(self, columns: Sequence[str]) -> None:
        for c in self.where:
            if c.op not in OPERATORS:
                raise ValueError(f"unknown operator {c.op!r}; there are {', '.join(OPERATORS)}")
        for a in self.aggregates:
            if a.op not in AGGREGATES:
                raise ValueError(f"unknown aggregate {a.op!r}; there are {', '.join(AGGREGATES)}")
        for c in [*(x.column for x in self.where), *self.group_by, *(a.column for a in self.aggregates if a.column != "*")]:
            resolve(columns, c)


def resolve(columns: Sequence[str], name: str) -> str:
    """A column by its name, else by letter (``C``) or position (``Col3``); ValueError naming the columns there are."""
    if name in columns:
        return name
    place = None
    if m := re.fullmatch(r"[Cc]ol(\d+)", name):
        place = int(m[1])
    elif re.fullmatch(r"[A-Za-z]{1,3}", name):
        place = 0
        for letter in name.upper():
            place = 26 * place + ord(letter) - 64
    if place and 1 <= place <= len(columns):
        return columns[place - 1]
    raise ValueError(f"no column {name!r}; there are {', '.join(columns)}")


def header_keys(labels: Sequence[str]) -> list[str]:
    """Column keys of a header row: labels trimmed, blank ones ``__col{n}``, repeated ones numbered from 2."""
    seen: dict[str, int] = {}
    out = []
    for place, label in enumerate(labels, 1):
        key = (label or "").strip() or f"__col{place}"
        seen[key] = seen.get(key, 0) + 1
        out.append(key if seen[key] == 1 else f"{key}_{seen[key]}")
    return out


_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_REAL = (FloatType, DoubleType)


class Typed:
    """A column with the number and the text that its values stand for, each built when it is asked for.

    ``made``: parts that a frame has worked out already.
    """

    def __init__(self, column: Column | None, kind: DataType, made: dict[str, Column] | None = None):
        self.column, self.kind = column, kind
        self.whole = isinstance(kind, _WHOLE) or isinstance(kind, DecimalType) and not kind.scale
        self.real = isinstance(kind, _REAL)
        self.native = (self.whole or self.real) and made is None
        for name, part in (made or {}).items():
            self.__dict__[name] = part

    @functools.cached_property
    def text(self) -> Column:
        return self.column.cast("string") if self.whole else decimal_text(self.column.cast("double")) if self.real else value_text(self.column.cast("string"))

    @functools.cached_property
    def number(self) -> Column:
        return self.column if self.whole else self.column.cast("double") if self.real else number(self.column.cast("string"))

    @functools.cached_property
    def decimal(self) -> Column:
        return F.lit(False) if self.whole else self.column.isNotNull() if self.real else is_decimal(self.column.cast("string"))

    @functools.cached_property
    def numeric(self) -> Column:
        return self.column.isNotNull() if self.native else is_number(self.column.cast("string"))

    @functools.cached_property
    def group(self) -> Column:
        return self.text if self.native else F.coalesce(same_number(self.column.cast("string")), self.column.cast("string"))

    @functools.cached_property
    def exact(self) -> Column:
        if self.native:
            return self.column.cast("decimal(38,0)") if self.whole else F.lit(None).cast("decimal(38,0)")
        text = self.column.cast("string")
        return F.when(is_number(text) & ~is_decimal(text), value_text(text).try_cast("decimal(38,0)"))

    def equals(self, value: object) -> Column:
        """As their texts are equal; an absent value's is ``None``."""
        wanted = str(value)
        if wanted == "None":
            return self.column.isNull() | (self.text == wanted)
        if self.native:
            try:
                if isinstance(self.kind, _REAL):
                    return self.column == F.lit(float(wanted)) if repr(float(wanted)) == wanted else F.lit(False)
                return self.column == F.lit(int(wanted)) if str(int(wanted)) == wanted and abs(int(wanted)) < 1 << 63 else F.lit(False)
            except ValueError:
                return F.lit(False)
        # a text that is no number is itself, so the scan can compare it
        if isinstance(self.kind, StringType) and not re.fullmatch(r"[\s+\-_.\deE]*", wanted):
            return self.column == wanted
        return self.text == wanted


def condition(typed: Typed, c: Condition) -> Column:
    if c.op == "eq":
        return typed.equals(c.value)
    if c.op == "contains":
        return F.lower(F.coalesce(typed.text, F.lit("None"))).contains(str(c.value).lower())
    try:
        bound = float(str(c.value))
    except ValueError:
        return F.lit(False)
    if typed.native and typed.whole and abs(bound) < 1 << 62:  # a whole bound, so that the scan can compare it
        return typed.column > math.floor(bound) if c.op == "gt" else typed.column < math.ceil(bound)
    return typed.number > bound if c.op == "gt" else typed.number < bound


def _aggregate(a: Aggregate, typed: Typed | None) -> Column:
    if a.op == "count" or typed is None:
        return F.count(F.lit(1)).cast("string")
    amount = typed.number.cast("double")
    if a.op == "avg":
        return F.coalesce(decimal_text(F.round(F.avg(amount), 4)), F.lit("0"))
    if a.op == "sum":
        return F.when(F.max(typed.decimal.cast("int")) == 1, decimal_text(F.sum(amount))).otherwise(F.try_sum(typed.exact).cast("string"))
    if typed.native:
        found = (F.min if a.op == "min" else F.max)(typed.number)
        return decimal_text(found.cast("double")) if typed.real else found.cast("string")
    # the least or largest value as it is typed itself; of equal ones the first
    place = F.when(typed.numeric, F.struct(amount, F.coalesce(typed.exact, amount.try_cast("decimal(38,0)")), F.col("__row") if a.op == "min" else -F.col("__row")))
    return F.min_by(typed.text, place) if a.op == "min" else F.max_by(typed.text, place)


#: What each aggregate asks of a text column.
_PARTS = {"count": set(), "avg": {"number"}, "sum": {"number", "decimal", "exact"}, "min": {"number", "numeric", "exact", "text"}, "max": {"number", "numeric", "exact", "text"}}


def order_keys(typed: Typed, descending: bool) -> list[Column]:
    """Numbers before text, numbers by size, text by code point; absent counts as empty text."""
    keys = [typed.number.isNull().cast("int"), typed.number, F.when(typed.number.isNull(), F.coalesce(typed.text, F.lit("")))]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def run(df: DataFrame, query: Query, row: str | None = None) -> DataFrame:
    """The query over ``df``'s columns, all results as text.

    ``row`` names the column that gives source order: ties and groups come in
    it; without it rows count in the order in which Spark reads them, which is
    the source's only where one task reads a file from its beginning. Absent
    stays null, but a group's absent key is empty. Spellings of one number are one
    group, shown as in its first row. ValueError for unknown operators and columns.
    """
    columns = [c for c in df.columns if c != row]
    query.validate(columns)
    at = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    source = df.select(*columns, at.alias("__row"))
    kinds = {f.name: f.dataType for f in source.schema.fields}
    typed = lambda frame, name: Typed(frame[name], kinds[name])
    for c in query.where:
        source = source.where(condition(typed(source, resolve(columns, c.column)), c))
    if query.group_by and query.aggregates:
        keys = list(dict.fromkeys(resolve(columns, g) for g in query.group_by))
        needed: dict[str, set[str]] = {k: {"text", "group"} for k in keys}
        for a in query.aggregates:
            if a.column != "*":
                needed.setdefault(resolve(columns, a.column), set()).update(_PARTS[a.op])
        held = {c: typed(source, c) for c in needed}
        ready = source.select(*(c for c in needed if held[c].native), *(getattr(held[c], p).alias(f"{c}.{p}") for c in needed if not held[c].native for p in sorted(needed[c])), "__row")
        plain = typed
        made = {c: Typed(ready[c], kinds[c]) if held[c].native else Typed(None, kinds[c], {p: ready[f"`{c}.{p}`"] for p in needed[c]}) for c in needed}
        source, typed = ready, lambda _, name: made[name]
        grouped = source.groupBy(*(F.coalesce(typed(source, k).group, F.lit("")).alias(f"__g{n}") for n, k in enumerate(keys)))
        shown = [F.coalesce(F.min_by(typed(source, k).text, F.col("__row")), F.lit("")).alias(k) for k in keys]
        totals = [_aggregate(a, typed(source, resolve(columns, a.column)) if a.column != "*" else None).alias(a.name) for a in query.aggregates]
        found = grouped.agg(*shown, *totals, F.min("__row").alias("__row"))
        columns = [*keys, *(a.name for a in query.aggregates)]
        kinds = dict.fromkeys(columns, StringType())
        source, typed = found.select(*columns, "__row"), plain
    chosen = [resolve(columns, s) for s in query.select] or columns
    orders = [k for name, down in query.order_by for k in order_keys(typed(source, resolve(columns, name)), down)]
    if query.order_by or query.limit and query.limit > 0:
        source = source.orderBy(*orders, "__row")
    if query.limit and query.limit > 0:
        source = source.limit(query.limit)
    return source.select(*(typed(source, c).text.alias(c) for c in dict.fromkeys(chosen)))
