"""Streams: office files as they arrive, text search, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from lexigrain.operators.search import find_text
from lexigrain.sources.office import parse_files

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def office_stream(spark: SparkSession, path: str, entity: str, files_per_trigger: int = 100) -> DataFrame:
    """An entity's rows of every office file that arrives at the path."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parse_files(files, entity)


def search_stream(units: DataFrame, query: str, ignore_case: bool = False, context: int = 80) -> DataFrame:
    """Arriving text units that hold the query, with place and excerpt; nothing is kept between batches."""
    return find_text(units, query, ignore_case, context)


def counts_by_window(events: DataFrame, time: str, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and keys; rows later than ``late`` are dropped and closed windows leave the state."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end when nothing has come for ``gap``: the idle expiry of a stateful reader."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("expired"), "n")


def merged_by_row(rows: DataFrame, notes: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """Two tables in row order as one: what stands beside a row joins it, what stands alone has a row of its own. Neither has to be in order."""
    return rows.join(notes, [*keys, row], "full").orderBy(*keys, row)


def first_rows(df: DataFrame, order: list[str], wanted: int) -> list:
    """The first rows in order: as soon as they are there nothing more is asked of the source."""
    return df.orderBy(*order).limit(wanted).collect()


def pieces(df: DataFrame, order: list[str], column: str):
    """A text column's values in order, one partition at a time; closing the generator stops the reading."""
    for r in df.select(*order, column).orderBy(*order).toLocalIterator(prefetchPartitions=False):
        yield r[column]
