"""Links between rows: parents, closures, inheritance."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, lineage cut; a folder of our own only where none is set and all runs in one process."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigrain-"))
    return df.checkpoint(eager=True)


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) of the forest given by (id, parent).

    Parents that are null, unknown or the node itself are none. Members of a
    cycle have no root: root and depth are null. Pointers double every round, so
    rounds grow with the logarithm of the depth; lineage is cut in each.
    """
    known = nodes.select(F.col("id").alias("parent")).distinct()
    linked = nodes.join(known.withColumn("__known", F.lit(True)), "parent", "left")
    up = F.when(F.col("__known") & (F.col("parent") != F.col("id")), F.col("parent"))
    state = cut(linked.select("id", up.alias("up"), F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.coalesce(up, F.col("id")).alias("root")))
    total = state.count()
    reach = 1
    while reach <= 2 * total and state.where("up is not null").limit(1).count():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        state = cut(state.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")))
        reach *= 2
    lost = F.col("up").isNotNull()
    return state.select("id", F.when(~lost, F.col("root")).alias("root"), F.when(~lost, F.col("depth")).alias("depth"))


def overlay(base: DataFrame, *layers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column from the last layer that has a value for it, else from ``base``."""
    out = base
    for n, layer in enumerate(layers):
        own = layer.select(key, *(F.col(c).alias(f"__{n}_{c}") for c in columns))
        out = out.join(own, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(*(F.col(f"__{n}_{c}") for n in range(len(layers) - 1, -1, -1)), F.col(c)))
    return out.select(*base.columns)


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows whose spans [start, end] overlap, by equality of buckets of ``width``.

    A pair is kept in the first bucket that both spans have.
    """
    ls, le = left_span
    rs, re_ = right_span
    a = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col(ls) / width), F.floor(F.col(le) / width))))
    b = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(rs) / width), F.floor(F.col(re_) / width))))
    joined = a.join(b, "__b").where((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)))
    return joined.where(F.col("__b") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width)).drop("__b")
