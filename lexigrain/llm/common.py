"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch are handed on in slices of about so many bytes of text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (any store it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set and all runs in one process (tests).

    RuntimeError on a cluster that names none: a folder of the driver's own would lose data there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexigrain-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that was written that one task goes on with, at least.
ROWS_A_TASK = 100_000


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` for tables that may be far smaller than their partitions are many: ROWS_A_TASK rows to a task go on."""
    out = cut(df)
    return out.coalesce(out.count() // ROWS_A_TASK + 1)


#: Bytes of a batch handed to Python: JVM and worker hold several of them at once, for every task.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches BATCH_BYTES long where they may be longer; long texts come in batches of few rows."""
    if int(re.match(r"\d+", spark.conf.get(_BATCH_CONF))[0]) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The column as a string, null as empty, to be mapped in bounded batches."""
    bound_batches(df.sparkSession)
    return F.coalesce(df[name].cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive slices holding about SLICE_BYTES of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    total = col.nbytes
    if total <= SLICE_BYTES:
        yield batch
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)
