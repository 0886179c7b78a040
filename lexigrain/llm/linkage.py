"""Connected components of a link table, and joins that check sizes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_A_TASK, cut, cut_small

#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Links of a node from which on they aren't brought together.
MANY_LINKS = 2_000
#: Pieces that a hot key is dealt in where its table is too large to broadcast.
SALTS = 32


def semi(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (one column of that name), or with left_anti isn't.

    ``ids`` should be cut off from its lineage: it is counted first, and
    broadcast only where it has BROADCAST_IDS rows at most.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, column, how)


def attach(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``df`` joined with a ``table`` that has one row for each ``column``, rows of ``df`` left where they are if ``table`` is small.

    For tables of hot keys, which are few: no task takes all rows of a key.
    ``table`` should be cut off from its lineage; it is counted, and where it has
    more than BROADCAST_IDS rows both sides are dealt by salted keys.
    """
    if table.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return df.join(F.broadcast(table), column)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [column, "__salt"]).drop("__salt")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in a link (a, b) the smallest id reachable from it.

    Labels fall to the smallest neighbour's and then to their own label's label,
    until none changes; a star needs two rounds, a chain a number that grows with
    the logarithm of its length. Lineage is cut after every round. Tasks are as
    many as ROWS_A_TASK links each ask for: rounds over few links are small jobs.
    ``links`` is counted first and should be cut off from its lineage.
    """
    tasks = 2 * links.count() // ROWS_A_TASK + 1
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.where("a <> b").distinct().coalesce(tasks))
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")).coalesce(tasks))
    met_by_all = labels.count() <= BROADCAST_IDS  # as many labels in every round
    # a node that many links lead to doesn't bring them to one task
    hot = None if met_by_all else cut_small(edges.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= MANY_LINKS).select("b"))
    while True:
        known = labels.select(F.col("id").alias("b"), "component")
        if met_by_all:
            told = edges.join(F.broadcast(known), "b")
        else:
            rest = semi(edges, hot, "b", "left_anti").join(known, "b").select("a", "b", "component")
            told = attach(edges, cut_small(semi(known, hot, "b")), "b").select("a", "b", "component").union(rest)
        near = told.select("a", "component").coalesce(tasks).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("before"), F.least("component", "near").alias("c"))
        met = cut(met.coalesce(tasks))
        jump = met.select(F.col("id").alias("c"), F.col("c").alias("further"))
        nearer = cut(met.join(jump, "c").select("id", "before", F.least("c", "further").alias("component")).coalesce(tasks))
        labels = nearer.select("id", "component")
        if not nearer.where("before <> component").limit(1).count():
            return labels
