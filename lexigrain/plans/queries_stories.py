"""Queries over word documents and decks made from the tables, and over the functions that they use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import colors, number_format, numbering, text_marks
from lexigrain.functions.references import string_udf
from lexigrain.operators import documents, graphs
from lexigrain.operators.search import find_text
from lexigrain.plans.registry import query, table
from lexigrain.plans.samples import NATIONS, nations, region_of, report, talk
from lexigrain.sources import making
from lexigrain.sources.office import parse_files

# ---------------------------------------------------------------- word documents


def _reports(spark, sf_dir, name: str) -> DataFrame:
    files = making.make_files(nations(spark, sf_dir).withColumn("r", F.col("region")), ["region"], ["k"], report, "report-{region}.docx")
    return parse_files(files, name)


@query("q_docx_blocks", f"""
with {NATIONS}, r as (select distinct region, size from n)
select region, 0 as ord, 'heading' as type, 2 as level, 'Region ' || region as text, 1 as page from r
union all select region, pos::integer, 'paragraph', null, name || '[fn' || pos || ']' || case when pos <= 2 then '[en1]' else '' end, pos::integer from n
union all select region, (size + i)::integer, 'paragraph', null, t, size::integer from r, (values (1, 'first of two'), (2, 'second of two'), (3, 'around kept'), (4, 'see there')) v(i, t)""")
def q_docx_blocks(spark, sf_dir):
    return _reports(spark, sf_dir, "docx_blocks").where("type <> 'table'").select(region_of().alias("region"), "ord", "type", "level", "text", "page")


@query("q_docx_plain", f"""
with {NATIONS}, b as (select region, max(size) as size, string_agg(case when pos > 1 then '<page=' || pos || '>' || chr(10) || chr(10) else '' end || name || ' [fn' || pos || ': key ' || k || ']', chr(10) || chr(10) order by pos) as body, string_agg(chr(10) || name || chr(9) || k, '' order by pos) as cells from n group by region)
select region, 'density=plain format=docx pagination=hints revision_view=final' || chr(10) || '<page=1>' || chr(10) || chr(10) || 'Region ' || region || chr(10) || chr(10) || body || chr(10) || chr(10) || 'first of two' || chr(10) || chr(10) || 'second of two' || chr(10) || chr(10) || 'around kept' || chr(10) || chr(10) || 'see there' || chr(10) || chr(10)
  || 'nation' || chr(9) || 'key' || cells || chr(10) || chr(10) || '[Endnotes]' || chr(10) || '[ed1: the end]' || chr(10) || chr(10) || '[Comments]' || chr(10) || '[comment status=unknown] well said' as rendered from b""")
def q_docx_plain(spark, sf_dir):
    done = documents.plain_documents(_reports(spark, sf_dir, "docx_blocks"), _reports(spark, sf_dir, "docx_notes"))
    return done.select(region_of().alias("region"), "rendered")


@query("q_docx_xml", f"""
with {NATIONS}, b as (select region, string_agg('<tr><td>' || name || '</td><td>' || k || '</td></tr>', '' order by pos) as cells, max(pos) as last from n group by region)
select region, '<document density="structural" format="docx"><heading level="2">Region ' || region || '</heading><table id="table-0" page="' || last || '"><tr><th>nation</th><th>key</th></tr>' || cells || '</table></document>' as rendered from b""")
def q_docx_xml(spark, sf_dir):
    blocks = _reports(spark, sf_dir, "docx_blocks").where("type <> 'paragraph'")
    return documents.xml_documents(blocks, _reports(spark, sf_dir, "docx_table_cells")).select(region_of().alias("region"), "rendered")


@query("q_docx_units", f"""
with {NATIONS}
select region, 'body' as source, null as grp, name || '[fn' || pos || ']' || case when pos <= 2 then '[en1]' else '' end as text from n where contains(name, 'A') union all select region, 'body', 'table-0:' || pos || ':0', name from n where contains(name, 'A')
union all select distinct region, 'comment', null, 'well sAid' from n where false""")
def q_docx_units(spark, sf_dir):
    units = documents.word_units(*(_reports(spark, sf_dir, e) for e in ("docx_blocks", "docx_table_cells", "docx_notes", "docx_objects")))
    return find_text(units, "A", context=200).select(region_of().alias("region"), "source", "grp", F.col("excerpt").alias("text"))


@query("q_docx_boxes_and_controls", f"""
with {NATIONS}, r as (select distinct region from n)
select region, kind, label, text from r, (values ('rich_text', 'Notes', 'first of two' || chr(10) || 'second of two'), ('textbox', 'a box', 'boxed')) v(kind, label, text)""")
def q_docx_boxes_and_controls(spark, sf_dir):
    held = _reports(spark, sf_dir, "docx_controls").select(region_of().alias("region"), "kind", "label", "text")
    drawn = documents.shown_names(_reports(spark, sf_dir, "docx_objects")).where("name is null").select(region_of().alias("region"), "kind", F.col("alt").alias("label"), "text")
    return held.union(drawn)


@query("q_docx_fields", f"with {NATIONS}, r as (select distinct region from n) select region, 'see there' as text, 'true' as bold, '#4472C4' as color, 'here' as anchor from r")
def q_docx_fields(spark, sf_dir):
    runs = _reports(spark, sf_dir, "docx_runs").where("link is not null")
    marks = documents.referenced(_reports(spark, sf_dir, "docx_bookmarks"), runs.select("doc_id", F.col("link")["anchor"].alias("name")), ["doc_id", "name"])
    return runs.join(marks.select("doc_id", F.col("name").alias("anchor")), "doc_id").select(region_of().alias("region"), "text", F.col("format")["bold"].alias("bold"), F.col("format")["color"].alias("color"), "anchor")


@query("q_docx_styles", f"with {NATIONS}, r as (select distinct region from n) select region, style_id, look, cyclic from r, (values ('H1', 'bold=true;color=#112233', false), ('H2', 'bold=true;color=#445566;italic=true', false), ('C1', 'normal', true), ('C2', 'normal', true), ('T', 'italic=true', false)) v(style_id, look, cyclic)")
def q_docx_styles(spark, sf_dir):
    done = documents.resolved_styles(_reports(spark, sf_dir, "docx_styles"))
    return done.select(region_of().alias("region"), "style_id", documents.described_change(F.col("format"), F.col("format"))[0].alias("look"), "cyclic")


@query("q_docx_table_regions", f"""
with {NATIONS}, c as (select region, pos as row from n union all select distinct region, 0 from n), d as (select region, row, max(row) over (partition by region) as last from c)
select region, row::integer as row, col, case when row = 0 then 'bold=true;italic=true' when (row - 1) % 2 = 1 then 'italic=false' else 'italic=true' end as look from d, (values (0), (1)) v(col)""")
def q_docx_table_regions(spark, sf_dir):
    placed = documents.table_regions(_reports(spark, sf_dir, "docx_table_cells"))
    found = documents.region_format(placed, _reports(spark, sf_dir, "docx_styles"), "T")
    return found.select(region_of().alias("region"), "row", "col", documents.described_change(F.col("format"), F.col("format"))[0].alias("look"))


# ---------------------------------------------------------------- decks


def _talks(spark, sf_dir, name: str) -> DataFrame:
    files = making.make_files(nations(spark, sf_dir).withColumn("r", F.col("region")), ["region"], ["k"], talk, "talk-{region}.pptx")
    return parse_files(files, name)


@query("q_pptx_plain", f"""
with {NATIONS}, s as (select region, string_agg(case when pos > 1 then chr(10) else '' end || '=== Slide ' || pos || case when pos <= 2 then ' (Section: Opening)' else '' end || ' ===' || chr(10) || name || chr(10) || chr(10) || 'I. key' || chr(10) || 'II. ' || k || chr(10) || chr(10) || 'wide' || chr(9) || chr(10) || k || chr(9) || 'x' || chr(10) || chr(10) || 'inside' || chr(10) || chr(10) || '[Connector]' || case when pos = 1 then chr(10) || chr(10) || '[Notes: about ' || name || ']' else '' end, '' order by pos) as body,
  string_agg('[comment status=unknown] on ' || name, chr(10) order by pos) as said from n group by region)
select region, 'density=plain format=pptx' || chr(10) || body || chr(10) || chr(10) || '[Comments]' || chr(10) || said as rendered from s""")
def q_pptx_plain(spark, sf_dir):
    done = documents.plain_decks(*(_talks(spark, sf_dir, e) for e in ("pptx_slides", "pptx_shapes", "pptx_sections", "pptx_comments")))
    return done.select(region_of().alias("region"), "rendered")


@query("q_pptx_xml", f"""
with {NATIONS}, s as (select region, string_agg('<slide n="' || pos || '"><text><p>' || name || '</p></text><text><p label="I.">key</p><p label="II.">' || k || '</p></text><table><tr><td colspan="2">wide</td></tr><tr><td>' || k || '</td><td>x</td></tr></table><text><p>inside</p></text>' || case when pos = 1 then '<notes>about ' || name || '</notes>' else '' end || '</slide>', '' order by pos) as body from n group by region)
select region, '<presentation density="structural" format="pptx">' || body || '</presentation>' as rendered from s""")
def q_pptx_xml(spark, sf_dir):
    done = documents.xml_decks(*(_talks(spark, sf_dir, e) for e in ("pptx_slides", "pptx_paragraphs", "pptx_table_cells")))
    return done.select(region_of().alias("region"), "rendered")


@query("q_pptx_units", f"""
with {NATIONS}
select region, pos::integer as slide, 'body' as source, name as text from n where contains(lower(name), 'an') union all select region, pos::integer, 'comment', 'on ' || name from n where contains(lower(name), 'an')
union all select region, 1, 'notes', 'about ' || name from n where pos = 1 and contains(lower(name), 'an')""")
def q_pptx_units(spark, sf_dir):
    units = documents.deck_units(*(_talks(spark, sf_dir, e) for e in ("pptx_paragraphs", "pptx_table_cells", "pptx_slides", "pptx_comments")))
    return find_text(units, "an", True, 200).select(region_of().alias("region"), "slide", "source", F.col("excerpt").alias("text"))


@query("q_pptx_navigation", f"with {NATIONS} select region, pos::integer as n, '#slide' || case when pos = 1 then size else least(pos + 1, size) end as resolved from n")
def q_pptx_navigation(spark, sf_dir):
    return documents.navigation(_talks(spark, sf_dir, "pptx_links"), _talks(spark, sf_dir, "pptx_slides")).select(region_of().alias("region"), "n", "resolved")


@query("q_pptx_geometry", f"with {NATIONS} select region, pos::integer as n, shape_id, x, y, w, h, reading from n, (values ('6', 1020, 140, 60, 80, 2), ('3', 100, 500, 40, 10, 3), ('5', 1000, 100, 200, 200, 1)) v(shape_id, x, y, w, h, reading)")
def q_pptx_geometry(spark, sf_dir):
    ordered = documents.reading_order(documents.placed(_talks(spark, sf_dir, "pptx_objects"))).where("x is not null")
    return ordered.select(region_of().alias("region"), "n", "shape_id", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")), "reading")


@query("q_pptx_placeholders", f"with {NATIONS} select region, pos::integer as n, 'title' as placeholder, 7 as x, 8 as y, 9 as w, 10 as h from n")
def q_pptx_placeholders(spark, sf_dir):
    found = documents.inherited_places(_talks(spark, sf_dir, "pptx_objects"), _talks(spark, sf_dir, "pptx_placeholders"))
    return found.select(region_of().alias("region"), "n", "placeholder", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")))


@query("q_pptx_connectors", f"with {NATIONS} select region, pos::integer as n, '3' as from_id, 1 as from_ord, '99' as to_id, null::integer as to_ord from n")
def q_pptx_connectors(spark, sf_dir):
    return documents.connectors(_talks(spark, sf_dir, "pptx_objects")).select(region_of().alias("region"), "n", "from_id", "from_ord", "to_id", "to_ord")


@query("q_pptx_comments", f"with {NATIONS} select region, pos::integer as n, 'Bo' as author, 'on ' || name as text, 'ppt/slides/slide' || pos || '.xml' as part from n")
def q_pptx_comments(spark, sf_dir):
    placed = documents.comment_places(*(_talks(spark, sf_dir, e) for e in ("pptx_comments", "pptx_slides", "pptx_objects")))
    return placed.select(region_of().alias("region"), "n", "author", "text", "part")


@query("q_pptx_spans", f"with {NATIONS} select region, pos::integer as n, row, col, col_span, text from n, (values (0, 0, 2, 'wide'), (1, 0, 1, null), (1, 1, 1, 'x')) v(row, col, col_span, t), lateral (select coalesce(t, k::varchar) as text)")
def q_pptx_spans(spark, sf_dir):
    return documents.normal_spans(_talks(spark, sf_dir, "pptx_table_cells")).select(region_of().alias("region"), "n", "row", "col", "col_span", "text")


@query("q_pptx_meaningful", f"with {NATIONS} select region, pos::integer as n, shape_id, number from n, (values ('2', 1), ('3', 2), ('4', 3), ('6', 4), ('7', 5)) v(shape_id, number)")
def q_pptx_meaningful(spark, sf_dir):
    shapes = _talks(spark, sf_dir, "pptx_shapes").select("doc_id", "n", "shape_id", "text")
    return documents.meaningful(_talks(spark, sf_dir, "pptx_objects"), shapes).select(region_of().alias("region"), "n", "shape_id", "number")


@query("q_pptx_themes", f"with {NATIONS} select distinct region, 1 as n, 'accent2' as slot, '#ED7D31' as color from n")
def q_pptx_themes(spark, sf_dir):
    return _talks(spark, sf_dir, "pptx_themes").where("slot = 'accent2' and n = 1").select(region_of().alias("region"), "n", "slot", "color")


@query("q_resource_envelopes", f"""
with {NATIONS}
select region, 'docx' as format, 'application/xml' as media_type, 0 as resources, count(*) > 0 as has_text from n group by region""")
def q_resource_envelopes(spark, sf_dir):
    rendered = documents.xml_documents(_reports(spark, sf_dir, "docx_blocks"), _reports(spark, sf_dir, "docx_table_cells"))
    held = documents.resource_catalog(_reports(spark, sf_dir, "docx_objects"), None, _reports(spark, sf_dir, "charts"))
    made = documents.envelope(rendered, "docx", "structural", held, _reports(spark, sf_dir, "warnings"))
    told = F.from_json("json", "format string, media_type string, text string, resources array<struct<kind:string>>")
    return made.select(region_of().alias("region"), told.alias("t")).select("region", "t.format", "t.media_type", F.size("t.resources").alias("resources"), (F.length("t.text") > 0).alias("has_text"))


# ---------------------------------------------------------------- further operators and functions


@query("q_table_segments", """
with s as (select o_custkey % 3 as t, o_orderkey as k, row_number() over (partition by o_custkey % 3, o_orderstatus order by o_orderkey) - 1 as r, o_orderstatus as part from orders),
z as (select t, part, max(r) + 1 as n from s group by t, part), b as (select t, part, coalesce(sum(n) over (partition by t order by part rows between unbounded preceding and 1 preceding), 0) as before from z)
select k, (r + before)::integer as row from s join b using (t, part)""")
def q_table_segments(spark, sf_dir):
    from pyspark.sql import Window

    name = F.concat(F.col("t").cast("string"), F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").withColumn("t", F.col("o_custkey") % 3)
    rows = (F.row_number().over(Window.partitionBy("t", "o_orderstatus").orderBy("o_orderkey")) - 1).alias("row")
    cells = o.select(F.lit("d").alias("doc_id"), name.alias("table_id"), rows, F.col("o_orderkey").alias("k"))
    segments = o.select(F.lit("d").alias("doc_id"), F.col("t").cast("string").alias("table_id"), F.col("o_orderstatus").alias("segment"), name.alias("segment_table")).distinct()
    return documents.table_segments(cells, segments).select("k", "row")


@query("q_section_pages", "select conv_id, turn, sum(case when role = 'assistant' and turn > 0 then 1 else 0 end) over (partition by conv_id order by turn)::bigint as back from conversations")
def q_section_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sections = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("section"), F.when(F.col("role") == "assistant", "continuous").otherwise("nextPage").alias("type"))
    return documents.section_pages(sections).select(F.col("doc_id").alias("conv_id"), (F.col("section") - 1).alias("turn"), "back")


@query("q_stories_regrouped", """
with e as (select user_id, event_id, event_type, day(ts) as page, case when event_type is distinct from lag(event_type) over (partition by user_id order by event_id) then 1 else 0 end as new from events),
g as (select *, sum(new) over (partition by user_id order by event_id) as story, lag(page) over (partition by user_id order by event_id) as earlier from e)
select user_id, min(event_id) as ord, string_agg(case when new = 0 and page > earlier then chr(12) else '' end || event_id, '' order by event_id) as text from g group by user_id, story""")
def q_stories_regrouped(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.lit("p").alias("part"), F.col("event_type").alias("id"), F.dayofmonth("ts").alias("page"), F.col("event_id").cast("string").alias("text"))
    return documents.regrouped(e).select(F.col("doc_id").alias("user_id"), "ord", "text")


@query("q_search_goes_on", "select conv_id, turn from conversations where contains(text, 'e') and (conv_id > 3 or conv_id = 3 and turn > 1) order by conv_id, turn limit 15")
def q_search_goes_on(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("doc_id"), F.lit(0).alias("rank"), F.col("turn").alias("ord"), "text", "conv_id", "turn")
    return documents.page_after(find_text(c, "e"), ("3".zfill(12), 0, 1), 15).select("conv_id", "turn")


@query("q_property_overlay", "select c_custkey, 'bold=' || (c_custkey % 3 = 0)::varchar || case when c_custkey % 2 = 0 then ';color=red' when c_custkey % 5 = 0 then ';color=blue' else '' end as described from customer")
def q_property_overlay(spark, sf_dir):
    k = F.col("c_custkey")
    base = F.when(k % 5 == 0, F.create_map(F.lit("color"), F.lit("blue"), F.lit("bold"), F.lit("x"))).otherwise(F.create_map(F.lit("bold"), F.lit("x")))
    later = F.when(k % 2 == 0, F.create_map(F.lit("color"), F.lit("red"), F.lit("bold"), (k % 3 == 0).cast("string"))).otherwise(F.create_map(F.lit("bold"), (k % 3 == 0).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", documents.described_change(documents.over(base, later), base)[0].alias("described"))


@query("q_overlay_layers", "select n_nationkey, coalesce(case when n_nationkey % 3 = 0 then 'own' end, case when n_nationkey % 2 = 0 then 'layout' end, r_name) as label from nation join region on n_regionkey = r_regionkey")
def q_overlay_layers(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    base = n.join(F.broadcast(table(spark, sf_dir, "region")), n.n_regionkey == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("label"))  # 5 regions
    layer = lambda every, name: n.where(f"n_nationkey % {every} = 0").select("n_nationkey", F.lit(name).alias("label"))
    return graphs.overlay(base, layer(2, "layout"), layer(3, "own"), key="n_nationkey", columns=["label"])


@query("q_chinese_numbers", """
with d as (select p_partkey, p_size, ['○','一','二','三','四','五','六','七','八','九'] as g from part)
select p_partkey, case when p_size >= 10 then g[(p_size // 10 + 1)::integer] || '十' || case when p_size % 10 > 0 then g[(p_size % 10 + 1)::integer] else '' end else g[(p_size + 1)::integer] end as shown from d""")
def q_chinese_numbers(spark, sf_dir):
    shown = string_udf(lambda v: number_format.chinese_value(v, 1), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"))


@query("q_formula_bar", "select o_orderkey, case when o_totalprice = floor(o_totalprice) then floor(o_totalprice)::bigint::varchar else regexp_replace(o_totalprice::decimal(18,2)::varchar, '0+$', '') end as shown from orders")
def q_formula_bar(spark, sf_dir):
    raw = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", string_udf(lambda v: number_format.formula_bar(v, "#,##0.00"), raw).alias("shown"))


@query("q_numbers_of_words", """
with n as (select n_nationkey + 1 as k from nation)
select k, format, case format when 'hebrew2' then chr(8207) || substr('אבגדהוזחטיכלמנסעפצקרשת', ((k - 1) % 22 + 1)::integer, 1) || repeat('ת', ((k - 1) // 22)::integer)
  when 'arabicAlpha' then repeat(substr('أبتثجحخدذرزسشصضطظعغفقكلمنهوي', ((k - 1) % 28 + 1)::integer, 1), ((k - 1) // 28 + 1)::integer) || chr(8204) when 'koreanDigital2' then translate(k::varchar, '0123456789', '零一二三四五六七八九')
  when 'ideographZodiacTraditional' then substr('甲乙丙丁戊己庚辛壬癸', ((k - 1) % 10 + 1)::integer, 1) || substr('子丑寅卯辰巳午未申酉戌亥', ((k - 1) % 12 + 1)::integer, 1)
  when 'japaneseCounting' then case when k >= 20 then '二' else '' end || case when k >= 10 then '十' else '' end || case when k % 10 > 0 then substr('一二三四五六七八九', (k % 10)::integer, 1) else '' end
  when 'ideographEnclosedCircle' then case when k <= 10 then '(' || chr((12831 + k)::integer) || ')' else k::varchar end else k::varchar end as label
from n, (values ('hebrew2'), ('arabicAlpha'), ('koreanDigital2'), ('ideographZodiacTraditional'), ('japaneseCounting'), ('ideographEnclosedCircle'), ('no such format')) f(format)""")
def q_numbers_of_words(spark, sf_dir):
    names = ["hebrew2", "arabicAlpha", "koreanDigital2", "ideographZodiacTraditional", "japaneseCounting", "ideographEnclosedCircle", "no such format"]
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"), F.explode(F.array(*map(F.lit, names))).alias("format"))
    return n.withColumn("label", string_udf(lambda k, f: numbering.format_number(int(k), f), F.col("k").cast("string"), F.col("format")))


@query("q_custom_numbers", "with n as (select n_nationkey + 1 as k from nation) select k, '(' || lpad(k::varchar, 3, '0') || ')' as padded, 'Art. ' || chr((64 + k)::integer) as letter from n")
def q_custom_numbers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    own = lambda pattern: string_udf(lambda k: numbering.custom_number(int(k), pattern), F.col("k").cast("string"))
    return n.select("k", own("(001)").alias("padded"), own("Art. A").alias("letter"))


@query("q_word_colors", "select r_regionkey, '#' || ['000000', 'FFFFFF', '44546A', 'E7E6E6', '4472C4'][(r_regionkey + 1)::integer] as color, '#' || upper(lpad(to_hex((r_regionkey * 17)::integer), 6, '0')) as plain from region")
def q_word_colors(spark, sf_dir):
    slots = ["text1", "background1", "text2", "background2", "accent1"]
    r = table(spark, sf_dir, "region").withColumn("v", F.lpad(F.hex(F.col("r_regionkey") * 17), 6, "0"))
    themed = string_udf(lambda k: colors.word_color("auto", slots[int(k)]), F.col("r_regionkey").cast("string"))
    return r.select("r_regionkey", themed.alias("color"), string_udf(lambda v: colors.word_color(v.lower()), F.col("v")).alias("plain"))


@query("q_field_targets", "select s_suppkey, 'http://a.example/' || s_suppkey as href, 'part' || (s_suppkey % 3) as anchor from supplier")
def q_field_targets(spark, sf_dir):
    said = F.concat(F.lit(' HYPERLINK "http://a.example/'), F.col("s_suppkey").cast("string"), F.lit('" \\l part'), (F.col("s_suppkey") % 3).cast("string"), F.lit(" \\n"))
    part = lambda name: string_udf(lambda t: (text_marks.field(t) or {}).get(name), said).alias(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", part("href"), part("anchor"))


@query("q_symbols", "select r_regionkey, ['α', 'β', '✓', '•', 'x'][(r_regionkey + 1)::integer] as shown from region")
def q_symbols(spark, sf_dir):
    codes = [("Symbol", 0xF061), ("Symbol", 0x62), ("Wingdings", 0xF0FC), ("Wingdings", 0xF001), ("Arial", 0x78)]
    return table(spark, sf_dir, "region").select("r_regionkey", string_udf(lambda k: text_marks.symbol(*codes[int(k)]), F.col("r_regionkey").cast("string")).alias("shown"))


@query("q_markers", """
select doc_id, '[Image ' || lang || ']' as image, '[Chart chart1: ' || source || ' (bar, 2 series); ' || lang || ', ' || source || ']' as chart, case when doc_id % 3 = 0 then '[OCR failed]' when doc_id % 3 = 1 then '[OCR]' || chr(10) || lang || chr(10) || '[/OCR]' else '' end as ocr,
  case when doc_id % 2 = 0 then '[Checkbox true]' else '[Box: ' || lang || ']' end as control, '[Unparsed shape: ' || lang || ']' as lost from documents""")
def q_markers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 3 == 0, "error").when(F.col("doc_id") % 3 == 1, "success").otherwise("none")
    even = F.col("doc_id") % 2 == 0
    return d.select("doc_id", text_marks.image_marker(F.col("lang")).alias("image"), text_marks.chart_marker(F.lit("chart1"), F.col("source"), F.lit("bar"), F.lit(2), F.array("lang", "source")).alias("chart"), text_marks.ocr_marker(status, F.col("lang"), F.lit(False)).alias("ocr"), text_marks.control_marker(F.when(even, "checkbox").otherwise("text"), F.lit("Box"), F.when(even, F.lit(True)), F.col("lang")).alias("control"), text_marks.unsupported_marker(F.lit("shape"), F.col("lang")).alias("lost"))
