"""Queries of the declarative builder, and joins and aggregates on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrain.operators import documents, graphs, ocr, selection, sheets
from lexigrain.plans.query import Aggregate, Condition, Query, header_keys, run
from lexigrain.plans.registry import query, table


@query("q_group_first_occurrence", """
with g as (select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as a, min(o_orderkey) as r
  from orders where contains(lower(o_orderpriority), 'high') group by o_orderstatus)
select o_orderstatus, cast(n as varchar) as orders, a as mean_price, row_number() over (order by r) as place from g""")
def q_group_first_occurrence(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    spec = Query(where=[Condition("o_orderpriority", "contains", "high")], group_by=["o_orderstatus"], aggregates=[Aggregate("count", "*", "orders"), Aggregate("avg", "o_totalprice", "mean_price"), Aggregate("min", "o_orderkey", "first_key")])
    found = run(orders, spec)
    place = F.row_number().over(Window.orderBy(F.col("first_key").cast("long"))).cast("long")  # a row a group
    return found.select("o_orderstatus", "orders", F.col("mean_price").cast("double").alias("mean_price"), place.alias("place"))


@query("q_where_eq_contains", "select c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING' and contains(lower(c_name), '7')")
def q_where_eq_contains(spark, sf_dir):
    found = run(table(spark, sf_dir, "customer"), Query(where=[Condition("c_mktsegment", "eq", "BUILDING"), Condition("c_name", "contains", "7")], select=["c_custkey", "c_name", "c_mktsegment"]))
    return found.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("q_where_gt_lt_numeric", "select p_partkey, cast(p_size as integer) as p_size from part where p_size > 15 and p_size < 35")
def q_where_gt_lt_numeric(spark, sf_dir):
    found = run(table(spark, sf_dir, "part"), Query(where=[Condition("p_size", "gt", 15), Condition("p_size", "lt", "35")], select=["p_partkey", "p_size"]))
    return found.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))


@query("q_group_all_aggs", """
select o_orderpriority, cast(count(*) as varchar) as n, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 1) as total,
  round(avg(o_totalprice), 2) as mean, min(o_totalprice) as least, max(o_totalprice) as most from orders group by o_orderpriority""")
def q_group_all_aggs(spark, sf_dir):
    aggregates = [Aggregate(op, "o_totalprice", name) for op, name in (("count", "n"), ("sum", "total"), ("avg", "mean"), ("min", "least"), ("max", "most"))]
    found = run(table(spark, sf_dir, "orders"), Query(group_by=["o_orderpriority"], aggregates=aggregates))
    number = lambda c, places: F.round(F.col(c).cast("double"), places).alias(c)
    return found.select("o_orderpriority", "n", number("total", 1), number("mean", 2), F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"))


@query("q_group_ignored_without_aggs", "select n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def q_group_ignored_without_aggs(spark, sf_dir):
    return run(table(spark, sf_dir, "nation"), Query(group_by=["n_regionkey"], select=["n_name", "n_regionkey"]))


@query("q_typed_coercion", """
with v as (select event_id, json_extract_string(props, '$.k') as t from events),
m as (select event_id, t, case when regexp_matches(t, '^\\s*[+-]?\\d+(_\\d+)*\\s*$') then 'integer'
  when regexp_matches(t, '^\\s*[+-]?(\\d+(_\\d+)*\\.(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+(_\\d+)*)?\\s*$') then 'decimal' else 'text' end as kind from v)
select kind, count(*) as n, coalesce(sum(try_cast(t as bigint)), 0)::bigint as total from m group by kind""")
def q_typed_coercion(spark, sf_dir):
    from lexigrain.functions.values import is_decimal, is_number, number

    v = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("t"))
    kind = F.when(is_decimal(F.col("t")), "decimal").when(is_number(F.col("t")), "integer").otherwise("text")
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(number(F.col("t"))), F.lit(0.0)).cast("long").alias("total"))


@query("q_type_aware_order_limit", "select p_partkey, p_size, row_number() over (order by p_size desc, p_partkey) as place from part order by p_size desc, p_partkey limit 50")
def q_type_aware_order_limit(spark, sf_dir):
    found = run(table(spark, sf_dir, "part").withColumn("__at", F.col("p_partkey")), Query(select=["p_partkey", "p_size"], order_by=[("p_size", True)], limit=50), row="__at")
    found = found.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_size"), "p_partkey")).cast("long"))  # 50 rows


@query("q_header_dedup", """
with l as (select n_nationkey, left(trim(n_name), 1) as label from nation),
k as (select n_nationkey, label, row_number() over (partition by label order by n_nationkey) as n from l)
select n_nationkey, case when n = 1 then label else label || '_' || n end as key from k""")
def q_header_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.substring(F.trim("n_name"), 1, 1).alias("label")).orderBy("n_nationkey").collect()  # a header row
    keys = header_keys([r["label"] for r in rows])
    return spark.createDataFrame([(r["n_nationkey"], k) for r, k in zip(rows, keys)], "n_nationkey int, key string")


@query("q_table_column_aggregate", """
select count(*) as n, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 1) as total, min(o_totalprice) as least, max(o_totalprice) as most, round(avg(o_totalprice), 2) as mean from orders where o_orderkey > (select min(o_orderkey) from orders)""")
def q_table_column_aggregate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    header = orders.agg(F.min("o_orderkey")).first()[0]
    rows = orders.where(F.col("o_orderkey") > F.lit(header).cast("long"))
    price = F.col("o_totalprice")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(price.cast("decimal(18,2)")).cast("double"), 1).alias("total"), F.min(price).alias("least"), F.max(price).alias("most"), F.round(F.avg(price), 2).alias("mean"))


@query("q_rows_slice_aggregate", """
with r as (select s_acctbal, row_number() over (order by s_suppkey) as n from supplier)
select count(*) as n, cast(sum(cast(s_acctbal as decimal(18,2))) as double) as total, min(s_acctbal) as least, max(s_acctbal) as most from r where n between 3 and 8""")
def q_rows_slice_aggregate(spark, sf_dir):
    first, last = selection.rows_spec("3-8")
    rows = selection.rows_slice(table(spark, sf_dir, "supplier"), ["s_suppkey"], first, last)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("total"), F.min("s_acctbal").alias("least"), F.max("s_acctbal").alias("most"))


@query("q_lookup_left_join", """
select o.o_orderkey, coalesce(c.c_name, '') as customer, coalesce(n.n_name, '') as nation
from orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey""")
def q_lookup_left_join(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    return joined.select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("customer"), F.coalesce("n_name", F.lit("")).alias("nation"))


@query("q_missing_reference_warnings", "select doc_id, 'missing label' as warning from documents where doc_id not in (select doc_id from labels)")
def q_missing_reference_warnings(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", F.lit("missing label").alias("warning"))


@query("q_full_outer_attach", "select coalesce(d.doc_id, l.doc_id) as doc_id, d.n_chars, l.quality, l.toxic from documents d full outer join labels l on d.doc_id = l.doc_id")
def q_full_outer_attach(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "full").select("doc_id", "n_chars", "quality", "toxic")


@query("q_parent_links", """
with recursive t as (select conv_id, turn, turn as root, 0::bigint as depth from conversations where turn = 0
  union all select c.conv_id, c.turn, t.root, t.depth + 1 from conversations c join t on c.conv_id = t.conv_id and c.turn = t.turn + 1)
select conv_id * 1000 + turn as id, conv_id * 1000 + root as root, depth from t""")
def q_parent_links(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return graphs.roots(c)


@query("q_thread_closure", """
with hit as (select distinct conv_id from conversations where role = 'system')
select c.conv_id, c.turn, c.role from conversations c join hit using (conv_id)""")
def q_thread_closure(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nodes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    roots = graphs.roots(nodes).select("id", "root")
    keyed = c.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).join(roots, "id")
    wanted = keyed.where("role = 'system'").select("root").distinct()
    return keyed.join(wanted, "root", "left_semi").select("conv_id", "turn", "role")


@query("q_inheritance_overlay", """
select c_custkey, coalesce(case when c_mktsegment = 'BUILDING' then c_name end, case when n_nationkey % 2 = 0 then n_name end, r_name) as label
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def q_inheritance_overlay(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    base = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 nations, 5 regions
    own, above = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return base.select("c_custkey", F.coalesce(own, above, "r_name").alias("label"))


@query("q_range_join_merge", """
with a as (select p_partkey as a_key, p_size + 60 * p_partkey as a_start, p_size + 60 * p_partkey + 2 as a_end from part),
b as (select s_suppkey as b_key, 1000 * s_suppkey as b_start, 1000 * s_suppkey + 300 as b_end from supplier)
select a_key, b_key, (b_start < a_start or b_end > a_end) as crosses from a join b on a_start <= b_end and b_start <= a_end""")
def q_range_join_merge(spark, sf_dir):
    start = F.col("p_size") + 60 * F.col("p_partkey")
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a_key"), start.alias("a_start"), (start + 2).alias("a_end"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b_key"), (F.col("s_suppkey") * 1000).alias("b_start"), (F.col("s_suppkey") * 1000 + 300).alias("b_end"))
    joined = graphs.overlapping(a, b, ("a_start", "a_end"), ("b_start", "b_end"), 256)
    return joined.select("a_key", "b_key", ((F.col("b_start") < F.col("a_start")) | (F.col("b_end") > F.col("a_end"))).alias("crosses"))


@query("q_dedup_join_back", """
with h as (select doc_id, sha256(text) as digest from documents), u as (select digest, min(doc_id) as first_id, count(*) as n from h group by digest)
select doc_id, first_id, n from h join u using (digest)""")
def q_dedup_join_back(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return h.join(h.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "digest").select("doc_id", "first_id", "n")


def _reader():
    """Stands for an image reader: what it says is the first letters of the bytes."""
    return lambda data: ocr.OcrResult("ok", data[:7].decode("utf-8", "ignore"), (("x", 0.5),)) if data[:1] != b"T" else ocr.OcrResult("empty")


@query("q_ocr_fan_out", """
select doc_id, case when starts_with(text, 'T') then 'empty' else 'ok' end as status, case when starts_with(text, 'T') then '' else left(text, 5) end as said, case when starts_with(text, 'T') then null else 0.5::double end as confidence
from documents where regexp_full_match(left(text, 7), '[\\x00-\\x7F]*') and length(text) > 6""")
def q_ocr_fan_out(spark, sf_dir):
    images = table(spark, sf_dir, "documents").where(F.substring("text", 1, 7).rlike(r"^[\x00-\x7F]*$") & (F.length("text") > 6)).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return ocr.recognise(images, _reader).select("doc_id", F.col("ocr_status").alias("status"), F.substring("ocr_text", 1, 5).alias("said"), F.col("ocr_confidence").alias("confidence"))


@query("q_weighted_mean", """
select lang, round(sum(quality * length(regexp_replace(text, '\\s', '', 'g')))::double / sum(length(regexp_replace(text, '\\s', '', 'g'))), 4) as mean_quality, count(*) as n
from documents join labels using (doc_id) group by lang""")
def q_weighted_mean(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").groupBy("lang").agg(F.round(ocr.weighted_mean(F.col("quality"), F.col("text")), 4).alias("mean_quality"), F.count("*").alias("n"))


@query("q_extent", "select min(p_size) as least, max(p_size) as most, min(p_partkey) as first_key, max(p_partkey) as last_key from part")
def q_extent(spark, sf_dir):
    found = selection.extent(table(spark, sf_dir, "part").select(F.col("p_size").alias("row"), F.col("p_partkey").alias("col")))
    return found.select(F.col("top").alias("least"), F.col("bottom").alias("most"), F.col("left").alias("first_key"), F.col("right").alias("last_key"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("q_manifest", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _TABLES))
def q_manifest(spark, sf_dir):
    return selection.manifest({t: table(spark, sf_dir, t) for t in _TABLES})


@query("q_referenced_semi", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def q_referenced_semi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return documents.referenced(table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_name")


@query("q_zip_points", "select label, i - 1 as place, round(avg(embedding[i]), 5) as mean, count(*) as n from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by label, i")
def q_zip_points(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "v"))
    return points.groupBy("label", F.col("place").cast("long").alias("place")).agg(F.round(F.avg("v"), 5).alias("mean"), F.count("*").alias("n"))


@query("q_map_describe", "select event_id, 'event_type=' || event_type || ';k=' || coalesce(json_extract_string(props, '$.k'), '') as described from events")
def q_map_describe(spark, sf_dir):
    props = documents.over(F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_type"), "event_type"))
    filled = F.transform_values(props, lambda _, v: F.coalesce(v, F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", documents.described_change(filled, filled)[0].alias("described"))


@query("q_union_intersect_except", """
select 'both' as side, k from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
union all select 'customer', k from (select c_nationkey as k from customer except select s_nationkey from supplier)""")
def q_union_intersect_except(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("side"), "k").union(c.subtract(s).select(F.lit("customer").alias("side"), "k"))


@query("q_rollup_cube", "select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def q_rollup_cube(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    return found.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("q_asof_range_join", """
with e as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts, value from events where event_type = 'view')
select e.event_id, max(v.ts) as last_view from e left join v on v.user_id = e.user_id and v.ts <= e.ts group by e.event_id""")
def q_asof_range_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    last = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("last_view", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(last))
    return marked.where("event_type = 'purchase'").select("event_id", "last_view")


@query("q_residual_trim", """
with m as (select user_id, max(case when event_type <> 'error' then event_id end) as last_id from events group by user_id)
select event_id, e.user_id, event_type from events e join m using (user_id) where event_id <= last_id""")
def q_residual_trim(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit("s").alias("sheet"), F.col("event_id").alias("row"), F.lit(1).alias("col"), "event_type")
    kept = sheets.reading_cells(cells, F.col("event_type") == "error")
    return kept.select(F.col("row").alias("event_id"), F.col("doc_id").alias("user_id"), "event_type")


@query("q_rank_windows", "select c_custkey, rank() over w as place, dense_rank() over w as dense, ntile(4) over (partition by c_nationkey order by c_acctbal desc, c_custkey) as quarter from customer window w as (partition by c_nationkey order by c_acctbal desc)")
def q_rank_windows(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    tie = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("place"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(tie).cast("long").alias("quarter"))
