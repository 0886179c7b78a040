"""Queries over office files: packages are made from the tables by the tasks, read again, and worked on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.operators import documents, sheets
from lexigrain.plans.query import Aggregate, Condition, Query, run
from lexigrain.plans.registry import query, table
from lexigrain.plans.samples import NATIONS, atlas_of_region, ledger, nations, region_of
from lexigrain.sources import making
from lexigrain.sources.office import parse_files


# ---------------------------------------------------------------- workbooks


def _ledger_files(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.lit(1).alias("one"), F.col("s_suppkey").cast("int").alias("k"), F.col("s_nationkey").cast("int").alias("nation"))
    return making.make_files(rows, ["one"], ["k"], ledger, "ledger-{one}.xlsx")


def _ledger_query(spark, sf_dir, spec: Query, **source) -> DataFrame:
    files = _ledger_files(spark, sf_dir)
    return sheets.query_workbook(parse_files(files, "xlsx_cells"), spec, parse_files(files, "xlsx_tables"), parse_files(files, "xlsx_sheets"), **source)


@query("q_workbook_typed_groups", """
select arg_min(case when s_suppkey % 4 = 1 then (s_suppkey % 5) || '.0' else (s_suppkey % 5)::varchar end, s_suppkey) as code,
  count(*)::varchar as n, sum(s_nationkey)::bigint::varchar as nations, min(s_suppkey)::bigint::varchar as first_key from supplier group by s_suppkey % 5""")
def q_workbook_typed_groups(spark, sf_dir):
    made = [Aggregate("count", "key", "n"), Aggregate("sum", "nation", "nations"), Aggregate("min", "key", "first_key")]
    return _ledger_query(spark, sf_dir, Query(group_by=["code"], aggregates=made), table_id="table-0")


@query("q_workbook_range_query", """
with r as (select s_suppkey as k, s_nationkey as n, row_number() over (order by s_suppkey) + 1 as pos from supplier)
select k::varchar as key, n::varchar as nation, ((k % 7) || '.5') as amount from r where pos <= 61 and k % 7 > 2 and k % 5 = 3 and n > 4 order by n desc, k limit 10""")
def q_workbook_range_query(spark, sf_dir):
    spec = Query(where=[Condition("amount", "gt", "2.5"), Condition("B", "contains", "3"), Condition("nation", "gt", 4)], select=["key", "nation", "amount"], order_by=[("nation", True)], limit=10)
    return _ledger_query(spark, sf_dir, spec, sheet="Data", range_spec="A1:E61", header_row=1)


@query("q_workbook_select_blank", "select '' as __col3, s_suppkey::varchar as key from supplier where s_suppkey % 5 = 2 and s_nationkey = 7")
def q_workbook_select_blank(spark, sf_dir):
    return _ledger_query(spark, sf_dir, Query(where=[Condition("Col4", "eq", 7), Condition("code", "lt", 3), Condition("code", "gt", "1.5")], select=["C", "key"]), table_id="table-0")


@query("q_integer_sums", "select o_orderstatus, (sum(o_orderkey::hugeint) + count(*) * 9007199254740993::hugeint)::varchar as total from orders group by o_orderstatus")
def q_integer_sums(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey").cast("decimal(38,0)") + F.lit("9007199254740993").cast("decimal(38,0)")).cast("string").alias("v"))
    return run(orders, Query(group_by=["o_orderstatus"], aggregates=[Aggregate("sum", "v", "total")]))


@query("q_typed_contains", "select p_partkey::varchar as p_partkey, (p_size || '.5') as v from part where contains(p_size || '.5', '2.5')")
def q_typed_contains(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".50")).alias("v"))
    return run(parts, Query(where=[Condition("v", "contains", "2.5")]))


def _atlases(spark, sf_dir) -> DataFrame:
    return making.make_files(nations(spark, sf_dir).withColumn("r", F.col("region")), ["region"], ["k"], atlas_of_region, "atlas-{region}.xlsx")


def _entity(spark, sf_dir, name: str) -> DataFrame:
    return parse_files(_atlases(spark, sf_dir), name)


@query("q_xlsx_cells", f"""
with {NATIONS}
select region, pos::integer + 1 as row, 1 as col, name as text, null as formula from n union all select region, pos::integer + 1, 2, k::varchar, null from n
union all select region, pos::integer + 1, 3, (2 * k)::varchar, 'B' || (pos + 1) || '*2' from n""")
def q_xlsx_cells(spark, sf_dir):
    cells = _entity(spark, sf_dir, "xlsx_cells").withColumn("region", region_of())
    sizes = cells.where("formula_type = 'array'").select("region", F.col("row").alias("last"))
    return cells.join(sizes, "region").where("row > 1 and row < last and col < 4").select("region", "row", "col", "text", "formula")


@query("q_xlsx_merges", f"""
with {NATIONS}, r as (select distinct region from n)
select region, 'A1' as ref, 2 as colspan, false as shadow from r union all select region, 'B1', 1, true from r union all select region, 'C1', 1, false from r union all select region, 'D1', 1, false from r""")
def q_xlsx_merges(spark, sf_dir):
    cells = _entity(spark, sf_dir, "xlsx_cells").drop("rowspan", "colspan", "shadow")
    merged = sheets.with_merges(cells, _entity(spark, sf_dir, "xlsx_ranges"))
    return merged.where("row = 1").select(region_of().alias("region"), "ref", "colspan", "shadow")


@query("q_xlsx_spills_and_tables", f"""
with {NATIONS}, r as (select distinct region, size from n)
select region, 'A' || (size + 2) as ref, 'A' || (size + 2) || ':A' || (size + 4) as spill_range, null as spill_from, null as table_formula from r
union all select region, 'A' || (size + 2 + i), null, 'A' || (size + 2), null from r, (values (1), (2)) v(i)
union all select region, c || (size + 2 + i), null, null, 'TABLE(C2,B2)' from r, (values ('B', 0), ('C', 0), ('B', 1), ('C', 1)) v(c, i)""")
def q_xlsx_spills_and_tables(spark, sf_dir):
    done = sheets.post_process(_entity(spark, sf_dir, "xlsx_cells"), _entity(spark, sf_dir, "xlsx_ranges"))
    return done.where("spill_range is not null or spill_from is not null or table_formula is not null").select(region_of().alias("region"), "ref", "spill_range", "spill_from", "table_formula")


@query("q_xlsx_rules", f"""
with {NATIONS}, r as (select distinct region from n)
select region, kind, ranges, formulas, said from r, (values ('conditional', 'B2:B9', '10', 'dataBar'), ('conditional', 'B2:B9', 'A1=1', 'expression'), ('validation', 'B2:B9', '1|99', 'whole'), ('validation', 'A2 A3', '"a,b"', 'list'), ('filter', 'A1:C9', '3', 'custom'), ('filter', 'A1:C9', '20', 'custom'), ('filter', 'A1:C9', 'x', 'values')) v(kind, ranges, formulas, said)""")
def q_xlsx_rules(spark, sf_dir):
    rules = _entity(spark, sf_dir, "xlsx_rules")
    merged = sheets.merged_rules(rules).withColumn("kind", F.lit("conditional"))
    plain = rules.where("kind <> 'conditional'")
    both = plain.select("doc_id", "kind", "ranges", "formulas", "attrs").union(merged.select("doc_id", "kind", "ranges", "formulas", "attrs"))
    return both.select(region_of().alias("region"), "kind", F.array_join("ranges", " ").alias("ranges"), F.array_join("formulas", "|").alias("formulas"), F.col("attrs")["type"].alias("said"))


@query("q_xlsx_pivots", f"with {NATIONS} select region, 'P' || region as name, 'name' as row_fields, 'Sum of key=key' as data, 'Atlas!A1:C9' as source, count(*) as records from n group by region")
def q_xlsx_pivots(spark, sf_dir):
    caches = _entity(spark, sf_dir, "xlsx_pivot_caches")
    found = sheets.pivot_fields(_entity(spark, sf_dir, "xlsx_pivots"), caches).join(caches.where("not ambiguous").select("doc_id", "records"), "doc_id")
    return found.select(region_of().alias("region"), "name", F.array_join("rows", ",").alias("row_fields"), F.array_join(F.transform("data", lambda d: F.concat(d["name"], F.lit("="), d["field"])), ",").alias("data"), F.concat("source_sheet", F.lit("!"), "source_ref").alias("source"), "records")


@query("q_xlsx_threads", f"""
with {NATIONS}
select region, 'thread-B' || (2 + (pos - 1) // 2) || '-' || ((pos - 1) % 2 + 1) as id, case when pos % 2 = 0 then 'thread-B' || (2 + (pos - 1) // 2) || '-1' end as parent_id, pos = 3 as parent_invalid,
  'Ann' as author, case when pos % 2 = 0 then 'resolved' else 'active' end as status, name as text from n""")
def q_xlsx_threads(spark, sf_dir):
    return sheets.conversations(_entity(spark, sf_dir, "xlsx_threads")).select(region_of().alias("region"), "id", "parent_id", "parent_invalid", "author", "status", "text")


@query("q_xlsx_names", f"with {NATIONS}, r as (select distinct region from n) select region, name, step from r, (values ('Total', 0), ('Tax', 1), ('Base', 1), ('Rate', 2)) v(name, step)")
def q_xlsx_names(spark, sf_dir):
    names = _entity(spark, sf_dir, "xlsx_names").withColumn("region", region_of())
    one = names.where(F.col("region") == 0).select("name", "refers_to")
    used = sheets.names_used(one, ["Total"]).select("name", F.col("step").cast("int").alias("step"))
    return names.select("region", "name").distinct().join(F.broadcast(used), "name").select("region", "name", "step")  # the workbooks' names are the same ones


@query("q_xlsx_drawings", f"with {NATIONS}, r as (select distinct region from n) select region, object_id, kind, said from r, (values ('10', 'group', null), ('11', 'shape', 'boxed'), ('12', 'connector', null), ('13', 'shape', null)) v(object_id, kind, said)")
def q_xlsx_drawings(spark, sf_dir):
    drawn = _entity(spark, sf_dir, "xlsx_drawings")
    chosen = sheets.relevant(drawn, "F1:H3")
    return sheets.drawings_used(drawn, chosen).select(region_of().alias("region"), "object_id", "kind", F.col("text").alias("said"))


@query("q_xlsx_styles", f"""
with {NATIONS}, r as (select distinct region from n)
select region, style, code, look, locked from r, (values (0, 'General', '', true), (1, '0.0', 'bold color=#FF0000 fill=#A2B8E2', false), (2, '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', '', true)) v(style, code, look, locked)""")
def q_xlsx_styles(spark, sf_dir):
    return _entity(spark, sf_dir, "xlsx_styles").select(region_of().alias("region"), "style", "code", sheets.look_text(F.col("look")).alias("look"), "locked")


@query("q_xlsx_plain", f"""
with {NATIONS}, b as (select region, size, string_agg(name || chr(9) || k || chr(9) || (2 * k) || chr(9) || case when pos = 1 then '[comment status=unknown] see ' || name else '' end || chr(10), '' order by pos) as body from n group by region, size)
select region, 'density=plain format=xlsx' || chr(10) || '<sheet name=Atlas>' || chr(10) || 'name' || chr(9) || 'key' || chr(9) || 'twice' || chr(9) || 'note' || chr(10) || body
  || '1' || chr(9) || '5' || chr(9) || '6' || chr(10) || '2' || chr(9) || '7' || chr(9) || '8' || chr(10) || '3' || chr(10) as rendered from b""")
def q_xlsx_plain(spark, sf_dir):
    done = sheets.plain_workbook(_entity(spark, sf_dir, "xlsx_cells"), _entity(spark, sf_dir, "xlsx_sheets"), _entity(spark, sf_dir, "xlsx_ranges"))
    return done.select(region_of().alias("region"), "rendered")


@query("q_xlsx_xml", f"""
with {NATIONS}, b as (select region, size, string_agg('<tr number="' || (pos + 1) || '"><cell>' || case when pos = 1 then '<a href="http://a.example/#top">' || name || '</a>' else name end || '</cell><cell>' || k || '</cell><cell formula="B' || (pos + 1) || '*2">' || (2 * k) || '</cell></tr>', '' order by pos) as body from n where pos <= 3 group by region, size)
select region, '<workbook density="structural" format="xlsx"><sheet name="Atlas"><grid ref="A2:C4">' || body || '</grid></sheet></workbook>' as rendered from b""")
def q_xlsx_xml(spark, sf_dir):
    cells = sheets.in_range(_entity(spark, sf_dir, "xlsx_cells"), "A2:C4")
    return sheets.xml_workbook(cells, _entity(spark, sf_dir, "xlsx_sheets"), 1 << 40).select(region_of().alias("region"), "rendered")


@query("q_xlsx_units", f"with {NATIONS} select region, 'A' || (pos + 1) as cell, name as excerpt from n where contains(name, 'AN')")
def q_xlsx_units(spark, sf_dir):
    from lexigrain.operators.search import find_text

    units = documents.locator(documents.sheet_units(_entity(spark, sf_dir, "xlsx_cells"), _entity(spark, sf_dir, "xlsx_sheets")))
    return find_text(units, "AN").where("col = 1 and row > 1").select(region_of().alias("region"), F.col("locator")["cell"].alias("cell"), "excerpt")


@query("q_xlsx_crossing", f"with {NATIONS}, r as (select distinct region from n) select region, 'A1:B1' as ref, true as anchor_inside from r")
def q_xlsx_crossing(spark, sf_dir):
    return sheets.crossing(_entity(spark, sf_dir, "xlsx_ranges"), "merge", "A1:A9").select(region_of().alias("region"), "ref", "anchor_inside")


@query("q_package_parts", f"""
with {NATIONS}, r as (select distinct region from n)
select region, name, t as content_type from r, (values ('xl/workbook.xml', 'application/xml'), ('xl/styles.xml', 'application/xml'), ('_rels/.rels', 'application/vnd.openxmlformats-package.relationships+xml')) v(name, t)""")
def q_package_parts(spark, sf_dir):
    return _entity(spark, sf_dir, "content_types").where("name in ('xl/workbook.xml', 'xl/styles.xml', '_rels/.rels')").select(region_of().alias("region"), "name", "content_type")


@query("q_package_links", f"with {NATIONS}, r as (select distinct region from n) select region, id, resolved_target, external from r, (values ('c1', 'xl/comments1.xml', false), ('h1', 'http://a.example/', true), ('p1', 'xl/pivotTables/pivot1.xml', false)) v(id, resolved_target, external)")
def q_package_links(spark, sf_dir):
    return _entity(spark, sf_dir, "relationships").where("source_part = 'xl/worksheets/sheet1.xml' and id in ('c1', 'h1', 'p1')").select(region_of().alias("region"), "id", "resolved_target", "external")


@query("q_broken_packages", "select r_regionkey::integer as region, r_regionkey % 2 = 1 as told from region")
def q_broken_packages(spark, sf_dir):
    whole = _atlases(spark, sf_dir)
    half = F.expr("substring(content, 1, cast(length(content) / 2 as int))")
    files = whole.withColumn("content", F.when(region_of("path") % 2 == 1, half).otherwise(F.col("content")))
    told = parse_files(files, "warnings").select(region_of().alias("region")).distinct().withColumn("told", F.lit(True))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("region"))
    return regions.join(told, "region", "left").select("region", F.coalesce("told", F.lit(False)).alias("told"))
