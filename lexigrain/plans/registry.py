"""All queries over the reference tables and their SQL.

Modules register theirs by importing ``query`` from here; ``load`` is done at
the end of this file so that importing the registry is enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function of (spark, sf_dir) and, where SQL can say it, its DuckDB SQL."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from lexigrain.plans import queries_functions, queries_office, queries_relational, queries_selection, queries_stories, queries_text, queries_windows  # noqa: E402, F401
