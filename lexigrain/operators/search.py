"""Literal text search with bounded excerpts and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: stands for text left out of an excerpt.
CUT = "…"


def _literal(text: str) -> str:
    """A pattern that matches the text as it is."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c for c in text)


def excerpt(text: Column, at: Column, size: int, context: int) -> Column:
    """``context`` characters on either side of a match of ``size`` at ``at`` (from 1), the sides marked where cut."""
    begin = F.greatest(at - context, F.lit(1))
    end = F.least(at + size - 1 + context, F.length(text))
    return F.concat(F.when(begin > 1, CUT).otherwise(""), F.substring(text, begin, end - begin + 1), F.when(end < F.length(text), CUT).otherwise(""))


def find_text(units: DataFrame, query: str, ignore_case: bool = False, context: int = 80, group: str | None = None, order: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Units (rows with ``text``) that hold the query, with ``match_at`` (from 1) and ``excerpt``.

    The first occurrence in a unit counts. With ``group`` the first unit of each
    group by ``order`` counts. With a ``limit`` rows ``offset`` and on come in
    order, and ``has_more`` says whether another follows. The query has 1 to
    4,000 characters and the context at most 4,000; ValueError otherwise. Null
    texts hold nothing.
    """
    if not 1 <= len(query) <= 4000:
        raise ValueError("a query has 1 to 4,000 characters")
    if not 0 <= context <= 4000 or offset < 0 or limit is not None and not 1 <= limit <= 200:
        raise ValueError("context is 0 to 4,000, offset not negative, limit 1 to 200")
    if ignore_case:
        # places are counted in the text itself: lower case can be longer
        same = ("(?iu)" if not query.isascii() else "(?i)") + _literal(query)
        at = F.when(F.col("text").rlike(same), F.length(F.regexp_extract("text", f"(?s)^(.*?){same}", 1)) + 1).otherwise(0)
    else:
        at = F.instr("text", query)
    found = units.withColumn("match_at", at).where("match_at > 0")
    found = found.withColumn("excerpt", excerpt(F.col("text"), F.col("match_at"), len(query), context))
    if group:
        first = Window.partitionBy(group).orderBy(*(order or ["match_at"]))
        found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if limit is not None:
        page = found.orderBy(*(order or ["match_at"])).offset(offset).limit(limit + 1)
        numbered = page.withColumn("__n", F.row_number().over(Window.orderBy(*(order or ["match_at"]))))  # limit + 1 rows
        return numbered.withColumn("has_more", F.max("__n").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("__n") <= limit).drop("__n")
    return found


def line_units(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One unit for each line of a text: the key, ``ord`` (from 0) and ``text``."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("ord", "text"))


def field_search(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows that hold the query in one of the fields: the first such field as ``kind``, its text as ``text``. An empty query finds nothing."""
    if not query:
        return rows.limit(0).withColumn("kind", F.lit("")).withColumn("found", F.lit(""))
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in reversed(fields):
        hit = F.coalesce(F.col(f).contains(query), F.lit(False))
        kind, text = F.when(hit, f).otherwise(kind), F.when(hit, F.col(f)).otherwise(text)
    return rows.withColumn("kind", kind).withColumn("found", text).where("kind is not null")
