"""Queries of selections by place and of rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.operators import rendering, selection
from lexigrain.plans.query import Condition, Query, run
from lexigrain.plans.registry import query, table


@query("q_slide_selection", "select conv_id, max(turn) as last_turn, arg_max(role, turn) as role from conversations group by conv_id")
def q_slide_selection(spark, sf_dir):
    found = selection.slide_span(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", -1)
    return found.select("conv_id", F.col("turn").alias("last_turn"), "role")


@query("q_table_truncation", """
with n as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as total from orders)
select o_custkey, o_orderkey, total from n where n <= 10""")
def q_table_truncation(spark, sf_dir):
    return selection.truncated(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 10)


@query("q_split_at_breaks", """
with l as (select doc_id, string_split(text, chr(10)) as p from documents),
e as (select doc_id, unnest(range(1, len(p) + 1)) as k, p from l)
select doc_id, (k - 1)::integer as fragment, k as page, length(p[k])::integer as n from e where trim(p[k]) <> ''""")
def q_split_at_breaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"), F.lit(1).alias("page"))
    return selection.split_at_breaks(docs, "text", "page").select("doc_id", "fragment", "page", F.length("text").alias("n"))


@query("q_toggle_cascade", "select c_custkey, (c_acctbal > 0) <> ((c_nationkey % 2 = 0) <> (c_mktsegment = 'BUILDING')) as bold from customer")
def q_toggle_cascade(spark, sf_dir):
    bold = selection.toggled(F.col("c_acctbal") > 0, F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment") == "BUILDING")
    return table(spark, sf_dir, "customer").select("c_custkey", bold.alias("bold"))


@query("q_first_of_each", "select event_type, user_id, min(event_id) as event_id from events group by event_type, user_id")
def q_first_of_each(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return selection.first_of_each(events, ["event_type", "user_id"], ["event_id"])


@query("q_frequent_styles", 'select event_type as style, count(*) as n, min(user_id) as top, max(user_id) as bottom, min(day(ts)) as "left", max(day(ts)) as "right" from events group by event_type having count(*) >= 6')
def q_frequent_styles(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select(F.col("event_type").alias("style"), F.col("user_id").alias("row"), F.dayofmonth("ts").cast("long").alias("col"))
    return selection.frequent_styles(cells, "style")


@query("q_distinct_in_order", "select o_custkey, string_agg(s, ',' order by k) as statuses from (select o_custkey, o_orderstatus as s, min(o_orderkey) as k from orders group by all) group by o_custkey")
def q_distinct_in_order(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("s")).agg(F.min("o_orderkey").alias("k"))
    return rendering.joined(first, ["o_custkey"], ["k"], F.col("s"), ",", "statuses")


@query("q_marked_pages", """
with t as (select conv_id, turn // 2 + 1 as page, turn, text from conversations),
p as (select conv_id, page, string_agg(text, chr(10) order by turn) as body from t group by conv_id, page)
select conv_id, 'density=plain format=dtp' || chr(10) || string_agg('<page=' || page || '>' || chr(10) || body, chr(10) order by page) as rendered from p group by conv_id""")
def q_marked_pages(spark, sf_dir):
    paged = table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 2).cast("long") + 1)
    return rendering.marked_pages(paged, ["conv_id"], "page", ["turn"], "text", {"format": F.lit("dtp"), "density": F.lit("plain")})


@query("q_xml_elements", """
select event_id, '<event id="' || event_id || '" is-error="' || case when event_type = 'error' then 'true' else 'false' end || '">' || replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</event>' as rendered from events""")
def q_xml_elements(spark, sf_dir):
    made = rendering.element("event", {"is_error": F.col("event_type") == "error", "id": F.col("event_id"), "note": F.lit(None).cast("string")}, rendering.xml_text(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", made.alias("rendered"))


@query("q_query_sink", """
with n as (select n_nationkey, n_name from nation where contains(lower(n_name), '1'))
select '<workbook><query><table><tr><th>n_nationkey</th><th>n_name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' order by n_nationkey) || '</table></query></workbook>' as rendered from n""")
def q_query_sink(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("at", F.col("n_nationkey"))
    found = run(nation, Query(where=[Condition("n_name", "contains", "1")], select=["n_nationkey", "n_name"]), row="at")
    return rendering.query_result(found.withColumn("at", F.col("n_nationkey").cast("int")), ["n_nationkey", "n_name"], "at")
