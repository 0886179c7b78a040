"""Queries over order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrain.operators import selection, windows
from lexigrain.plans.registry import query, table


@query("q_page_assign", """
with p as (select conv_id, turn, 1 + sum(case when role = 'user' and turn > 0 then 1 else 0 end) over (partition by conv_id order by turn) as page from conversations)
select conv_id, page::bigint as page, min(turn) as first_ord, max(turn) as last_ord, count(*) as n from p group by conv_id, page""")
def q_page_assign(spark, sf_dir):
    paged = windows.assign_pages(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], (F.col("role") == "user") & (F.col("turn") > 0))
    return windows.page_index(paged, ["conv_id"], "turn")


@query("q_page_window_hole", """
with d as (select distinct user_id, day(ts)::bigint as day from events),
w as (select user_id, day, day - row_number() over (partition by user_id order by day) as g from d where day >= 3 and day < 10)
select user_id, day from w where g = 2""")
def q_page_window_hole(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("day")).distinct()
    return windows.page_window(days, ["user_id"], "day", 3, 7)


@query("q_run_islands", """
with c as (select user_id, event_id, event_type, case when event_type is distinct from lag(event_type) over w or lag(event_id) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by event_id)),
i as (select *, sum(new) over (partition by user_id order by event_id) as island from c)
select user_id, island::bigint as island, event_type, min(event_id) as first_at, max(event_id) as last_at, count(*) as n from i group by user_id, island, event_type""")
def q_run_islands(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@query("q_rectangles", """
with d as (select distinct day(ts)::bigint as day, user_id from events where event_type = 'purchase'),
s as (select day, min(user_id) as start, max(user_id) as "end" from (select day, user_id, user_id - row_number() over (partition by day order by user_id) as g from d) group by day, g),
r as (select *, day - row_number() over (partition by start, "end" order by day) as h from s)
select min(day) as top, max(day) as bottom, start, "end" from r group by start, "end", h""")
def q_rectangles(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    cells = events.select(F.dayofmonth("ts").cast("long").alias("day"), "user_id")
    return windows.rectangles(windows.spans(cells, ["day"], "user_id"), "day").select("top", "bottom", "start", "end")


@query("q_budget_preview", """
with s as (select l_orderkey, count(*) as n from lineitem group by l_orderkey),
b as (select l_orderkey, n, coalesce(sum(n) over (order by l_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as before from s)
select l_orderkey, n, before from b where before < 500""")
def q_budget_preview(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return windows.budget_preview(sizes, ["l_orderkey"], "n", 500).select("l_orderkey", "n", "before")


@query("q_text_budget", """
with b as (select source, doc_id, n_chars, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from documents)
select source, doc_id, least(n_chars, 12000 - before)::bigint as shown from b where before < 12000""")
def q_text_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    kept = windows.budget_preview(docs, ["doc_id"], "n_chars", 12000, ["source"])
    return kept.select("source", "doc_id", F.least("n_chars", F.lit(12000) - F.col("before")).cast("long").alias("shown"))


@query("q_list_counters", """
with l as (select conv_id, turn, case when role = 'user' then 0 else 1 end as level from conversations),
t as (select *, sum(case when level = 0 then 1 else 0 end) over (partition by conv_id order by turn)::bigint as n0 from l),
u as (select *, sum(case when level = 1 then 1 else 0 end) over (partition by conv_id, n0 order by turn)::bigint as n1 from t)
select conv_id, turn, case when level = 0 then n0 || '.' else n0 || '.' || n1 end as label from u""")
def q_list_counters(spark, sf_dir):
    leveled = table(spark, sf_dir, "conversations").withColumn("level", F.when(F.col("role") == "user", 0).otherwise(1))
    return windows.list_labels(leveled, ["conv_id"], ["turn"], "level").select("conv_id", "turn", "label")


@query("q_vmerge_propagation", """
with m as (select o_custkey, o_orderkey, last_value(case when o_orderstatus <> 'O' then o_orderkey end ignore nulls) over (partition by o_custkey order by o_orderkey) as anchor from orders)
select o_orderkey, anchor from m""")
def q_vmerge_propagation(spark, sf_dir):
    anchor = F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey"))
    return windows.fill_down(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], anchor, "anchor").select("o_orderkey", "anchor")


@query("q_session_window", """
with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as started, count(*) as n from s group by user_id, k""")
def q_session_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n")


@query("q_band_index", "select c_custkey, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) // 2 % 2)::bigint as band from customer")
def q_band_index(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return table(spark, sf_dir, "customer").select("c_custkey", selection.band_index(place, 0, 2).alias("band"))
