"""Text search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.operators import search
from lexigrain.plans.registry import query, table

_LINES = "select doc_id, i - 1 as ord, l[i] as text from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))"


def _excerpt(text: str, at: str, size: int, context: int = 80) -> str:
    begin, end = f"greatest({at} - {context}, 1)", f"least({at} + {size - 1 + context}, length({text}))"
    return f"(case when {begin} > 1 then '…' else '' end || substr({text}, {begin}, {end} - {begin} + 1) || case when {end} < length({text}) then '…' else '' end)"


@query("q_find_text_documents", f"with u as ({_LINES}) select doc_id, cast(ord as integer) as ord, cast(instr(text, 'tion') as integer) as match_at, {_excerpt('text', chr(105) + 'nstr(text, ' + chr(39) + 'tion' + chr(39) + ')', 4)} as excerpt from u where instr(text, 'tion') > 0")
def q_find_text_documents(spark, sf_dir):
    units = search.line_units(table(spark, sf_dir, "documents"), "doc_id")
    return search.find_text(units, "tion").select("doc_id", "ord", F.col("match_at").cast("int").alias("match_at"), "excerpt")


@query("q_find_text_first_per_group", f"with u as ({_LINES}) select doc_id, cast(min(ord) as integer) as ord from u where instr(text, 'the') > 0 group by doc_id")
def q_find_text_first_per_group(spark, sf_dir):
    units = search.line_units(table(spark, sf_dir, "documents"), "doc_id")
    return search.find_text(units, "the", group="doc_id", order=["ord"]).select("doc_id", "ord")


@query("q_find_text_case_insensitive", f"select conv_id, turn, cast(instr(lower(text), 'the') as integer) as match_at, {_excerpt('text', 'instr(lower(text), ' + chr(39) + 'the' + chr(39) + ')', 3, 20)} as excerpt from conversations where instr(lower(text), 'the') > 0")
def q_find_text_case_insensitive(spark, sf_dir):
    found = search.find_text(table(spark, sf_dir, "conversations"), "THE", ignore_case=True, context=20)
    return found.select("conv_id", "turn", F.col("match_at").cast("int").alias("match_at"), "excerpt")


@query("q_find_text_paged", """
with f as (select conv_id, turn from conversations where instr(text, 'en') > 0 order by conv_id, turn limit 21 offset 10),
n as (select conv_id, turn, row_number() over (order by conv_id, turn) as n, count(*) over () as m from f)
select conv_id, turn, m > 20 as has_more from n where n <= 20""")
def q_find_text_paged(spark, sf_dir):
    found = search.find_text(table(spark, sf_dir, "conversations"), "en", order=["conv_id", "turn"], offset=10, limit=20)
    return found.select("conv_id", "turn", "has_more")


@query("q_field_priority_search", "select page_id, case when contains(url, 'com') then 'url' else 'html' end as kind from pages where contains(url, 'com') or contains(html, 'com')")
def q_field_priority_search(spark, sf_dir):
    return search.field_search(table(spark, sf_dir, "pages"), "com", ["url", "html"]).select("page_id", "kind")


@query("q_text_units_union", """
select 'document' as source, doc_id as id, 0::bigint as ord, length(text)::bigint as n from documents
union all select 'conversation', conv_id, turn, length(text) from conversations
union all select 'page', page_id, 0, length(html) from pages""")
def q_text_units_union(spark, sf_dir):
    size = lambda c: F.length(c).cast("long").alias("n")
    zero = F.lit(0).cast("long").alias("ord")
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), zero, size("text"))
    c = table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("source"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("ord"), size("text"))
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), zero, size("html"))
    return d.unionByName(c).unionByName(p)


@query("q_dtp_render", "select conv_id, string_agg('<turn=' || turn || '>' || chr(10) || role || ': ' || text, chr(10) order by turn) as rendered from conversations group by conv_id")
def q_dtp_render(spark, sf_dir):
    part = F.concat(F.lit("<turn="), F.col("turn").cast("string"), F.lit(">\n"), "role", F.lit(": "), "text")
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("rendered"))
