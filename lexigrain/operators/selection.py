"""Selections by place: rows, slides, previews, and what they leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_spec(spec: str) -> tuple[int, int]:
    """(first, last) of `a-b` or `a`, counted from 1; ValueError for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", spec)
    first, last = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
    if not 1 <= first <= last:
        raise ValueError(f"{spec!r} is no span of rows like 2-5")
    return first, last


def slide_span(numbers: DataFrame, keys: list[str], number: str, start: int, span: int = 1) -> DataFrame:
    """Rows of ``span`` slides from ``start`` on; -1 is each deck's last. Nothing where the deck is shorter."""
    if start != -1 and start < 1 or span < 1:
        raise ValueError("slides count from 1, or -1 for the last")
    if start > 0:
        return numbers.where(F.col(number).between(start, start + span - 1))
    last = numbers.groupBy(*keys).agg(F.max(number).alias("__last"))
    return numbers.join(last, keys).where(F.col(number) == F.col("__last")).drop("__last")


def truncated(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Each group's first ``most`` rows with the group's size as ``total``."""
    w = Window.partitionBy(*keys)
    return df.withColumn("total", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def split_at_breaks(df: DataFrame, text: str, page: str) -> DataFrame:
    """Rows whose text holds form feeds as one row a page; fragments without text are dropped, ``fragment`` counts them from 0."""
    parts = df.select("*", F.posexplode(F.split(F.col(text), "\f", -1)).alias("__at", "__part"))
    kept = parts.where(F.trim("__part") != "")
    return kept.withColumn(page, (F.col(page) + F.col("__at")).cast("long")).withColumn(text, F.col("__part")).withColumnRenamed("__at", "fragment").drop("__part")


def toggled(*layers: Column) -> Column:
    """A toggle property over style layers: on where an odd number of them switch it on; null layers say nothing."""
    total = F.lit(0)
    for layer in layers:
        total = total + F.when(layer, 1).otherwise(0)
    return total % 2 == 1


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key once, where it comes first: warnings and names are told once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def frequent_styles(cells: DataFrame, style: str, least: int = 6) -> DataFrame:
    """Styles that cover at least ``least`` cells, with their number and extent."""
    return cells.groupBy(style).agg(F.count("*").alias("n"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right")).where(F.col("n") >= least)


def rows_slice(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` in order, counted from 1; only ``last`` rows are brought together."""
    few = df.orderBy(*order).limit(last)
    return few.withColumn("__n", F.row_number().over(Window.orderBy(*order))).where(F.col("__n").between(first, last)).drop("__n")


def extent(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The least rectangle around the cells of each group."""
    return cells.groupBy(*(keys or [])).agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has, one row a table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def band_index(place: Column, headers: int = 0, size: int = 1) -> Column:
    """0 or 1: which of two bands a row (from 0) is in, behind ``headers`` rows."""
    return (F.floor((place - headers) / size) % 2).cast("long")
