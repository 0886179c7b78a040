"""Order-dependent operators: pages, islands, previews within a budget, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def assign_pages(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """``page`` from 1: one more for every break at or before the row."""
    return df.withColumn("page", (F.sum(F.when(breaks, 1).otherwise(0)).over(running(keys, order)) + 1).cast("long"))


def page_index(paged: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """First and last ordinal of every page."""
    return paged.groupBy(*keys, "page").agg(F.min(ord_).alias("first_ord"), F.max(ord_).alias("last_ord"), F.count("*").alias("n"))


def page_window(numbers: DataFrame, keys: list[str], number: str, start: int, span: int) -> DataFrame:
    """Rows numbered ``start`` and on, ``span`` at most, up to the first missing number; none where ``start`` is missing."""
    near = numbers.where((F.col(number) >= start) & (F.col(number) < start + span))
    order = Window.partitionBy(*keys).orderBy(number)
    # in an unbroken run the number and its place differ by a constant
    return near.withColumn("__gap", F.col(number) - F.dense_rank().over(order)).where(F.col("__gap") == start - 1).drop("__gap")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: keys, ``island`` (from 1), value, first and last order value, count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True))
    marked = df.withColumn("__new", F.when(changed, 1).otherwise(0)).withColumn("island", F.sum("__new").over(running(keys, order)).cast("long"))
    return marked.groupBy(*keys, "island", value).agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("n"))


def spans(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Distinct numbers as spans of consecutive ones: keys, ``start``, ``end``."""
    w = Window.partitionBy(*keys).orderBy(number)
    some = df.select(*keys, number).distinct().withColumn("__g", F.col(number) - F.row_number().over(w))
    return some.groupBy(*keys, "__g").agg(F.min(number).alias("start"), F.max(number).alias("end")).drop("__g")


def rectangles(spans_: DataFrame, row: str) -> DataFrame:
    """Equal spans on consecutive rows as rectangles: ``top``, ``bottom``, ``start``, ``end``."""
    w = Window.partitionBy("start", "end").orderBy(row)
    some = spans_.withColumn("__g", F.col(row) - F.row_number().over(w))
    return some.groupBy("start", "end", "__g").agg(F.min(row).alias("top"), F.max(row).alias("bottom")).drop("__g")


def budget_preview(sizes: DataFrame, order: list[str], size: str, budget: int, keys: list[str] | None = None) -> DataFrame:
    """Whole rows in order for as long as the sizes of the rows before them stay under the budget.

    Without ``keys`` only the first ``budget`` rows of a size are brought together
    for the running sum: each counts 1 at least, so no later one can be shown.
    """
    w = Window.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        return sizes.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("before") < budget)
    # every row counts 1 at least, so the first ``budget`` rows are enough
    few = sizes.where(F.col(size) > 0).orderBy(*order).limit(budget)
    return few.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("before") < budget)


def list_labels(df: DataFrame, keys: list[str], order: list[str], level: str) -> DataFrame:
    """Counters of a two-level list: ``n0`` counts rows of level 0, ``n1`` those of level 1 since the last of level 0."""
    top = F.sum(F.when(F.col(level) == 0, 1).otherwise(0)).over(running(keys, order))
    out = df.withColumn("n0", top.cast("long"))
    below = F.sum(F.when(F.col(level) == 1, 1).otherwise(0)).over(running([*keys, "n0"], order))
    out = out.withColumn("n1", below.cast("long"))
    return out.withColumn("label", F.when(F.col(level) == 0, F.concat(F.col("n0").cast("string"), F.lit("."))).otherwise(F.concat_ws(".", F.col("n0").cast("string"), F.col("n1").cast("string"))))


def fill_down(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null at or before each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(running(keys, order)))
