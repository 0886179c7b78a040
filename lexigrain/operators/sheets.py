"""Operators over the cells and catalogs of workbooks: sources of queries, rectangles, rules, closures, plain and XML reading."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.references import LAST_COLUMN, LAST_ROW, column_letters, number_of
from lexigrain.operators import rendering, windows
from lexigrain.operators.graphs import cut, roots
from lexigrain.plans.query import Query, header_keys, resolve, run

#: Fixed value: cells of a default reading of a sheet.
CELL_BUDGET = 500
SHEET = ["doc_id", "sheet"]


# ---------------------------------------------------------------- sources of queries


def area(spec: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of `A1:H20`, whole rows `10:20` or one cell; ValueError where ends aren't ordered on the grid."""
    if m := re.fullmatch(r"([1-9]\d*):([1-9]\d*)", spec):
        found = int(m[1]), 1, int(m[2]), LAST_COLUMN
    elif m := re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([1-9]\d*)(?::\$?([A-Za-z]{1,3})\$?([1-9]\d*))?", spec):
        found = int(m[2]), number_of(m[1].upper()), int(m[4] or m[2]), number_of((m[3] or m[1]).upper())
    else:
        raise ValueError(f"{spec!r} is no range like A1:H20, 10:20 or A1")
    if not (1 <= found[0] <= found[2] <= LAST_ROW and 1 <= found[1] <= found[3] <= LAST_COLUMN):
        raise ValueError(f"{spec!r} isn't ordered within A1:XFD1048576")
    return found


def in_range(cells: DataFrame, spec: str) -> DataFrame:
    """Cells inside a rectangle; the bounds are plain comparisons of row and col."""
    top, left, bottom, right = area(spec)
    return cells.where(F.col("row").between(top, bottom) & F.col("col").between(left, right))


def in_sheet(cells: DataFrame, sheets: DataFrame, name: str) -> DataFrame:
    """Cells of the sheet with exactly this name; ValueError where no workbook has it."""
    if not sheets.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"no sheet {name!r}")
    return cells.where(F.col("sheet") == name)


def query_source(cells: DataFrame, tables: DataFrame | None = None, sheets: DataFrame | None = None, *, table_id: str | None = None, sheet: str | None = None, range_spec: str | None = None, header_row: int | None = None) -> tuple[DataFrame, list[str], int]:
    """(cells below the header, column keys, first column) of a table by id, or of a sheet's range with a header row.

    The table wins where both are given. Labels are the table's own, or the texts
    of the header row. The cells are those of one workbook.
    """
    if table_id is not None:
        found = tables.where(F.col("id") == table_id).limit(1).collect()
        if not found:
            raise ValueError(f"no table {table_id!r}")
        name, (top, left, bottom, right), labels = found[0]["sheet"], area(found[0]["ref"]), list(found[0]["columns"])
        labels += [""] * (right - left + 1 - len(labels))
        header = top
        own = cells.where(F.col("sheet") == name)
    elif sheet is not None and range_spec is not None and header_row is not None:
        top, left, bottom, right = area(range_spec)
        header, own = header_row, in_sheet(cells, sheets, sheet)
        heads = own.where((F.col("row") == header) & F.col("col").between(left, right)).select("col", "text").collect()  # a header row
        last = max([h["col"] for h in heads], default=left - 1)
        labels = [""] * (min(right, max(last, left)) - left + 1)
        for h in heads:
            labels[h["col"] - left] = h["text"] or ""
    else:
        raise ValueError("a table's id, or a sheet with a range and a header row, is needed")
    keys = [k if not k.startswith("__col") else f"__col{left + n}" for n, k in enumerate(header_keys(labels[: right - left + 1]))]
    rows = own.where((F.col("row") > header) & F.col("row").between(top, bottom) & F.col("col").between(left, right))
    return rows, keys, left


def materialize(cells: DataFrame, keys: Sequence[str], first: int, needed: Sequence[str] | None = None) -> DataFrame:
    """One row for each row of cells: ``__row`` and a text column for each key that is needed; null where a cell isn't there."""
    wanted = [k for k in keys if needed is None or k in needed]
    place = {k: first + n for n, k in enumerate(keys)}
    columns = [F.max(F.when(F.col("col") == place[k], F.coalesce("text", F.lit("")))).alias(k) for k in wanted]
    return cells.groupBy("row").agg(F.count(F.lit(1)).alias("__cells"), *columns).select(F.col("row").cast("long").alias("__row"), *(F.col(f"`{k}`") for k in wanted))


def needed_columns(query: Query, keys: Sequence[str]) -> list[str] | None:
    """The keys that a query reads; null for all."""
    if query.group_by and query.aggregates:
        names = [*query.group_by, *(a.column for a in query.aggregates if a.column != "*")]
    elif query.select:
        names = list(query.select)
    else:
        return None
    names += [c.column for c in query.where] + ([] if query.aggregates else [c for c, _ in query.order_by])
    return list(dict.fromkeys(resolve(keys, n) for n in names if n in keys or not query.aggregates or n not in [a.name for a in query.aggregates]))


def query_workbook(cells: DataFrame, query: Query, tables: DataFrame | None = None, sheets: DataFrame | None = None, **source) -> DataFrame:
    """The query over a table or a range of one workbook's cells, source order by row. Arguments of ``query_source`` name the source."""
    rows, keys, first = query_source(cells, tables, sheets, **source)
    return run(materialize(rows, keys, first, needed_columns(query, keys)), query, "__row")


# ---------------------------------------------------------------- rectangles


def covering(cells: DataFrame, rectangles: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Cells joined with the rectangles (top, left, bottom, right) that hold them.

    A rectangle lies in two buckets at most of rows as high as itself (a power of
    two), and a cell asks one bucket for each height that there is, 21 at most:
    the work grows with cells and matches, not with their product. ``how``:
    inner, left_semi or left_anti.
    """
    height = F.ceil(F.log2(F.col("bottom") - F.col("top") + F.lit(1.0))).cast("int")
    known = rectangles.where("top is not null").withColumn("__height", height)
    heights = sorted(r[0] for r in known.select("__height").distinct().collect())  # 21 at most
    size = F.pow(F.lit(2.0), F.col("__height"))
    spread = known.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("top") / size), F.floor(F.col("bottom") / size))))
    asked = cells.withColumn("__height", F.explode(F.array(*map(F.lit, heights)) if heights else F.array().cast("array<int>"))).withColumn("__bucket", F.floor(F.col("row") / F.pow(F.lit(2.0), F.col("__height"))))
    inside = (F.col("row") >= F.col("top")) & (F.col("row") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") <= F.col("right"))
    if how == "inner":
        return asked.join(spread, [*keys, "__height", "__bucket"]).where(inside).drop("__height", "__bucket")
    place = [*keys, "row", "col"]
    hit = asked.select(*place, "__height", "__bucket").join(spread.select(*keys, "top", "left", "bottom", "right", "__height", "__bucket"), [*keys, "__height", "__bucket"]).where(inside).select(*place).distinct()
    return cells.join(hit, place, how)


def without_hidden(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells outside their sheet's hidden columns; a sheet's hidden spans are few and travel as one array."""
    hidden = ranges.where("kind = 'hidden_columns'").groupBy(*SHEET).agg(F.collect_list(F.struct("left", "right")).alias("__hidden"))
    joined = cells.join(hidden, SHEET, "left")
    return joined.where(~F.coalesce(F.exists("__hidden", lambda h: (F.col("col") >= h["left"]) & (F.col("col") <= h["right"])), F.lit(False))).drop("__hidden")


def without_shadows(cells: DataFrame) -> DataFrame:
    """Without cells that a merge covers."""
    return cells.where(~F.coalesce("shadow", F.lit(False)))


def reading_cells(cells: DataFrame, residual: Column | None = None) -> DataFrame:
    """Blank cells inside the extent of meaningful ones stay, those beyond it go."""
    gone = F.coalesce(residual if residual is not None else F.col("blank") & F.col("hyperlink").isNull() & F.col("comment").isNull() & (F.col("rowspan") == 1) & (F.col("colspan") == 1) & ~F.col("shadow"), F.lit(False))
    marked = cells.withColumn("__gone", gone)
    edge = marked.where("not __gone").groupBy(*SHEET).agg(F.max("row").alias("__row"), F.max("col").alias("__col"))
    return marked.join(edge, SHEET, "left").where(~F.col("__gone") | (F.col("row") <= F.col("__row")) & (F.col("col") <= F.col("__col"))).drop("__gone", "__row", "__col")


def keep_blanks(cells: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Cells inside any of the rectangles are no longer blank to be left out: formulas and rules speak of them."""
    place = [*SHEET, "row", "col"]
    meant = covering(cells.where("blank").select(*place), rectangles.select(*SHEET, "top", "left", "bottom", "right"), SHEET).select(*place).distinct().withColumn("__meant", F.lit(True))
    return cells.join(meant, place, "left").withColumn("blank", F.col("blank") & F.col("__meant").isNull()).drop("__meant")


def with_merges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans on the first cell of each merge, ``shadow`` on the others."""
    merges = ranges.where("kind = 'merge'").select(*SHEET, "top", "left", "bottom", "right")
    plain = cells.drop("rowspan", "colspan", "shadow")
    place = [*SHEET, "row", "col"]
    held = covering(plain.select(*place), merges, SHEET).groupBy(*place).agg(F.min(F.struct("top", "left", "bottom", "right")).alias("m"))
    first = (F.col("m.top") == F.col("row")) & (F.col("m.left") == F.col("col"))
    joined = plain.join(held, place, "left")
    span = lambda a, b: F.when(first, F.col(b) - F.col(a) + 1).otherwise(1)
    return joined.withColumn("rowspan", span("m.top", "m.bottom")).withColumn("colspan", span("m.left", "m.right")).withColumn("shadow", F.col("m").isNotNull() & ~F.coalesce(first, F.lit(False))).drop("m")


def with_spills(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """``spill_range`` on the anchor of a dynamic array, ``spill_from`` on the other cells that are there."""
    return _from_ranges(cells, ranges, "spill", lambda held: {"spill_range": F.when(held["own"], held["ref"]), "spill_from": F.when(~held["own"], held["anchor"])})


def with_data_tables(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """The TABLE formula on every cell of a what-if table; where tables overlap none is, and ``table_conflict`` says so."""
    return _from_ranges(cells, ranges, "data_table", lambda held: {"table_formula": F.when(held["n"] == 1, held["formula"]), "table_conflict": F.coalesce(held["n"] > 1, F.lit(False))})


def _from_ranges(cells: DataFrame, ranges: DataFrame, kind: str, columns) -> DataFrame:
    own = ranges.where(F.col("kind") == kind).select(*SHEET, "ref", "top", "left", "bottom", "right", F.col("attrs")["anchor"].alias("anchor"), F.col("attrs")["formula"].alias("formula"))
    place = [*SHEET, "row", "col"]
    met = covering(cells.select(*place), own, SHEET)
    held = met.groupBy(*place).agg(F.count("*").alias("n"), F.min(F.struct("top", "left", "ref", "anchor", "formula")).alias("held"))
    joined = cells.join(held, place, "left")
    first = (F.col("held.top") == F.col("row")) & (F.col("held.left") == F.col("col"))
    parts = {"own": first, "n": F.col("n"), **{c: F.col(f"held.{c}") for c in ("ref", "anchor", "formula")}}
    made = columns(parts)
    return joined.select(*cells.columns, *(c.alias(n) for n, c in made.items()))


def crossing(ranges: DataFrame, kind: str, spec: str) -> DataFrame:
    """Ranges of a kind that reach into a window and out of it, and whether their first cell is in it."""
    top, left, bottom, right = area(spec)
    meets = (F.col("left") <= right) & (F.col("right") >= left) & (F.col("top") <= bottom) & (F.col("bottom") >= top)
    within = (F.col("left") >= left) & (F.col("right") <= right) & (F.col("top") >= top) & (F.col("bottom") <= bottom)
    return ranges.where((F.col("kind") == kind) & meets & ~within).withColumn("anchor_inside", F.col("left").between(left, right) & F.col("top").between(top, bottom))


def relevant(ranges: DataFrame, spec: str) -> DataFrame:
    """Ranges of any kind that meet a window."""
    top, left, bottom, right = area(spec)
    return ranges.where((F.col("left") <= right) & (F.col("right") >= left) & (F.col("top") <= bottom) & (F.col("bottom") >= top))


def post_process(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """The fixed order of what is attached to cells: data tables, merges, spills, then blanks that formulas and rules speak of; rows and columns in order come last."""
    out = with_spills(with_merges(with_data_tables(cells, ranges), ranges), ranges)
    return keep_blanks(out, ranges.where("kind in ('spill', 'data_table', 'table')")).orderBy(*SHEET, "row", "col")


# ---------------------------------------------------------------- catalogs


def merged_rules(rules: DataFrame) -> DataFrame:
    """Conditional formats of the core with their extensions by id: what the extension says wins; extensions without a core rule come last."""
    own = rules.where("kind = 'conditional'")
    core, ext = own.where("source = 'core'"), own.where("source = 'x14'")
    names = ["doc_id", "sheet", "ord", "ext_id", "ranges", "formulas", "unparsed", "attrs"]
    c, e = core.select(*(F.col(n).alias("c_" + n) for n in names)), ext.select(*(F.col(n).alias("e_" + n) for n in names))
    both = c.join(e, F.expr("c_doc_id = e_doc_id and c_sheet = e_sheet and c_ext_id = e_ext_id"), "full")
    over = lambda n: F.when(F.size("e_" + n) > 0, F.col("e_" + n)).otherwise(F.col("c_" + n))
    attrs = F.map_concat(F.map_filter(F.coalesce("c_attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.coalesce(F.map_keys("e_attrs"), F.array().cast("array<string>")), k)), F.coalesce("e_attrs", F.create_map().cast("map<string,string>")))
    return both.select(F.coalesce("c_doc_id", "e_doc_id").alias("doc_id"), F.coalesce("c_sheet", "e_sheet").alias("sheet"), F.coalesce("c_ord", F.col("e_ord") + 1_000_000).alias("ord"), F.coalesce("c_ext_id", "e_ext_id").alias("ext_id"), F.coalesce(over("ranges"), F.col("c_ranges")).alias("ranges"), F.coalesce(over("formulas"), F.col("c_formulas")).alias("formulas"), attrs.alias("attrs"))


def pivot_fields(pivots: DataFrame, caches: DataFrame) -> DataFrame:
    """Pivot tables with the names of their axes' fields; an ambiguous cache id joins nothing, and field numbers outside the cache are null."""
    known = caches.where("not ambiguous").select("doc_id", "cache_id", F.col("id").alias("cache"), "fields", "source_sheet", "source_ref")
    joined = pivots.join(known, ["doc_id", "cache_id"], "left")
    names = lambda c: F.transform(F.filter(c, lambda i: i >= 0), lambda i: F.get(F.col("fields"), i)).alias(c)
    data = F.transform("data", lambda d: F.struct(d["name"].alias("name"), F.get(F.col("fields"), d["field"]).alias("field"), d["function"].alias("function"))).alias("data")
    return joined.select("doc_id", "id", "sheet", "name", "ref", "cache", "source_sheet", "source_ref", names("rows"), names("columns"), names("pages"), data)


def cell_kinds(cells: DataFrame, styles: DataFrame, rich: DataFrame | None = None) -> DataFrame:
    """Cells with the control of their style (and whether it is checked) and the rich value that they name."""
    looks = styles.where("kind = 'cell'").select("doc_id", "style", "control", "locked", F.col("look").alias("look"))
    out = cells.join(looks, ["doc_id", "style"], "left")
    out = out.withColumn("checked", F.when((F.col("control") == "checkbox") & (F.col("type") == "boolean"), F.col("raw") == "1"))
    if rich is None:
        return out
    values = rich.select("doc_id", "vm", F.struct("kind", "display", "alt", "fallback", "image_part", "image_url").alias("rich"))
    return out.join(values, ["doc_id", "vm"], "left")


def conversations(threads: DataFrame) -> DataFrame:
    """Comments of conversations with ids by cell (`thread-B2-1`) and parents; parents that are unknown, itself or in a circle are dropped and told."""
    cell = Window.partitionBy(*SHEET, "ref").orderBy("ord")
    named = threads.withColumn("id", F.concat(F.lit("thread-"), "ref", F.lit("-"), F.row_number().over(cell).cast("string")))
    key = F.concat_ws("|", "doc_id", "sheet", F.coalesce("raw_id", "id"))
    keyed = cut(named.withColumn("__id", key).withColumn("__parent", F.concat_ws("|", "doc_id", "sheet", "parent_raw_id")).withColumn("__parent", F.when(F.col("parent_raw_id").isNotNull(), F.col("__parent"))))
    tops = roots(keyed.select(F.col("__id").alias("id"), F.col("__parent").alias("parent"))).select(F.col("id").alias("__id"), "root")
    ids = keyed.select(F.col("__id").alias("__parent"), F.col("id").alias("parent_id"))
    joined = keyed.join(tops, "__id", "left").join(ids, "__parent", "left")
    fine = F.col("root").isNotNull() & F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("id"))
    return joined.select(*SHEET, "ord", "ref", "id", F.when(fine, F.col("parent_id")).alias("parent_id"), (F.col("__parent").isNotNull() & ~F.coalesce(fine, F.lit(False))).alias("parent_invalid"), "author", "date", "status", "mentions", "text")


def names_used(names: DataFrame, start: Sequence[str], rounds: int = 64) -> DataFrame:
    """The defined names that some names speak of, directly or through others, with the step they are met at.

    ``names``: name and refers_to of one workbook. A worklist: each round asks the
    names met last; it ends when none is new.
    """
    words = F.regexp_extract_all(F.regexp_replace("refers_to", "\"[^\"]*\"|'[^']*'", " "), F.lit(r"([A-Za-z_\\][A-Za-z0-9_.\\]*)"), F.lit(1))
    edges = cut(names.select(F.lower("name").alias("name"), F.explode(F.transform(words, F.lower)).alias("uses")).join(names.select(F.lower("name").alias("uses")), "uses", "left_semi").distinct())
    known = names.select(F.lower("name").alias("name")).where(F.col("name").isin([s.lower() for s in start])).distinct().withColumn("step", F.lit(0))
    last = known = cut(known)
    for step in range(1, rounds + 1):
        met = last.join(edges, "name").select(F.col("uses").alias("name")).distinct()
        last = cut(met.join(known, "name", "left_anti").withColumn("step", F.lit(step)))
        if not last.limit(1).count():
            break
        known = cut(known.union(last))
    return names.withColumn("__key", F.lower("name")).join(known.withColumnRenamed("name", "__key"), "__key").drop("__key")


def drawings_used(drawings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Drawing objects with all that belongs to the chosen ones (doc_id, sheet, object_id): their groups, the groups' members, connectors at them and what connectors lead to."""
    own = drawings.select(*SHEET, "object_id", "group_id", "from_id", "to_id").where("object_id is not null")
    pairs = [own.select(*SHEET, F.col("object_id").alias("a"), F.col(c).alias("b")).where("b is not null") for c in ("group_id", "from_id", "to_id")]
    edges = pairs[0].union(pairs[1]).union(pairs[2])
    edges = cut(edges.union(edges.select(*SHEET, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = last = cut(chosen.select(*SHEET, F.col("object_id").alias("a")).distinct())
    while last.limit(1).count():
        met = last.join(edges, [*SHEET, "a"]).select(*SHEET, F.col("b").alias("a")).distinct()
        last = cut(met.join(known, [*SHEET, "a"], "left_anti"))
        known = cut(known.union(last))
    return drawings.join(known.withColumnRenamed("a", "object_id"), [*SHEET, "object_id"], "left_semi")


def look_text(look: Column) -> Column:
    """A style's look as sorted `key=value` words."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(look)), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), " ")


def style_ranges(cells: DataFrame, least: int = 6) -> DataFrame:
    """Looks (``look_text``) that cover ``least`` cells of a sheet, as rectangles: spans of columns, equal on consecutive rows."""
    often = cells.groupBy(*SHEET, "look_text").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("look_text") != ""))
    some = cells.join(often, [*SHEET, "look_text"], "left_semi")
    keys = [*SHEET, "look_text"]
    spans = windows.spans(some, [*keys, "row"], "col")
    w = Window.partitionBy(*keys, "start", "end").orderBy("row")
    boxes = spans.withColumn("__g", F.col("row") - F.row_number().over(w)).groupBy(*keys, "start", "end", "__g").agg(F.min("row").alias("top"), F.max("row").alias("bottom"))
    return boxes.select(*keys, reference("top", "start", "bottom", "end").alias("ref"))


def reference(top: str, left: str, bottom: str, right: str) -> Column:
    first = F.concat(column_letters(F.col(left)), F.col(top).cast("string"))
    last = F.concat(column_letters(F.col(right)), F.col(bottom).cast("string"))
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(":"), last))


# ---------------------------------------------------------------- reading


def preview(cells: DataFrame, counted: Column | None = None, budget: int = CELL_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(cells of each sheet's rows until the budget is met, (doc_id, sheet, next_row) of sheets with more). A row is never split."""
    sizes = cells.groupBy(*SHEET, "row").agg(F.sum(F.when(counted if counted is not None else F.lit(True), 1).otherwise(0)).alias("n"))
    w = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    told = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return cells.join(told.where(F.col("before") < budget).select(*SHEET, "row"), [*SHEET, "row"], "left_semi"), told.where(F.col("before") >= budget).groupBy(*SHEET).agg(F.min("row").alias("next_row"))


def cell_text(control: Column | None = None, checked: Column | None = None) -> Column:
    """A cell's plain text: its control or its value, then its comment."""
    value = F.coalesce("text", F.lit(""))
    if control is not None:
        box = F.when(checked.isNotNull(), F.concat(F.lit("[Checkbox "), checked.cast("string"), F.lit("]"))).otherwise(F.rtrim(F.concat(F.lit("[Checkbox] "), value)))
        value = F.when(control == "checkbox", box).otherwise(value)
    note = F.when(F.col("comment").isNotNull(), F.rtrim(F.concat(F.lit("[comment status=unknown] "), "comment")))
    return F.concat(value, F.when((value != "") & note.isNotNull(), " ").otherwise(""), F.coalesce(note, F.lit("")))


def plain_sheets(cells: DataFrame, sheets: DataFrame, ranges: DataFrame, budget: int = CELL_BUDGET) -> DataFrame:
    """doc_id, sheet, ord, rendered: each sheet's tab-separated rows without hidden columns, a line for its name, one for each table and, where the budget cut it, one for the next row."""
    shown, more = preview(reading_cells(cells), budget=budget)
    visible = without_hidden(shown, ranges)
    rows = rendering.joined(visible.withColumn("__text", cell_text()), [*SHEET, "row"], ["col"], F.col("__text"), "\t", "line")
    body = rendering.joined(rows, SHEET, ["row"], F.concat("line", F.lit("\n")), "", "body")
    tables = rendering.joined(ranges.where("kind = 'table'"), SHEET, ["top", "left"], F.concat(F.lit("[Table "), F.col("attrs")["name"], F.lit(" "), "ref", F.lit("]\n")), "", "tables")
    state = F.when(F.col("state") == "visible", "").otherwise(F.concat(F.lit(" "), "state"))
    head = F.concat(F.when(F.col("kind") == "chartsheet", "<chartsheet name=").otherwise("<sheet name="), rendering.xml_text(F.col("name"), True), state, F.lit(">\n"))
    named = sheets.where("kind in ('worksheet', 'chartsheet')").select("doc_id", F.col("name").alias("sheet"), "ord", head.alias("head"))
    out = named.join(body, SHEET, "left").join(tables, SHEET, "left").join(more, SHEET, "left")
    cut_line = F.when(F.col("next_row").isNotNull(), F.concat(F.lit("[Truncated: next row "), F.col("next_row").cast("string"), F.lit("]\n"))).otherwise("")
    return out.select("doc_id", "sheet", "ord", F.concat("head", F.coalesce("tables", F.lit("")), F.coalesce("body", F.lit("")), cut_line).alias("rendered"))


def plain_workbook(cells: DataFrame, sheets: DataFrame, ranges: DataFrame, budget: int = CELL_BUDGET) -> DataFrame:
    """doc_id, rendered: the header line and all sheets in order."""
    parts = rendering.joined(plain_sheets(cells, sheets, ranges, budget), ["doc_id"], ["ord"], F.col("rendered"), "", "body")
    return parts.select("doc_id", F.concat(F.lit("density=plain format=xlsx\n"), "body").alias("rendered"))


def xml_workbook(cells: DataFrame, sheets: DataFrame, budget: int = CELL_BUDGET, density: str = "structural") -> DataFrame:
    """doc_id, rendered: sheets, their grids, rows and cells as XML with what isn't default as attributes; merged-away cells are left out."""
    shown, more = preview(reading_cells(cells), ~F.col("shadow"), budget)
    seen = without_shadows(shown)
    w = Window.partitionBy(*SHEET, "row").orderBy("col")
    edge = shown.groupBy(*SHEET).agg(F.min("row").alias("__t"), F.min("col").alias("__l"), F.max("row").alias("__b"), F.max("col").alias("__r"))
    placed = seen.join(edge.select(*SHEET, "__l"), SHEET).withColumn("__next", F.coalesce(F.lag(F.col("col") + F.col("colspan")).over(w), F.col("__l")))
    plain = F.coalesce("text", F.lit(""))
    attributes = {"column": F.when(F.col("col") != F.col("__next"), column_letters(F.col("col"))), "raw": F.when(F.col("raw").isNotNull() & (F.col("raw") != plain) & (F.col("type") != "string"), F.col("raw")), "colspan": F.when(F.col("colspan") > 1, F.col("colspan")), "rowspan": F.when(F.col("rowspan") > 1, F.col("rowspan")), "formula": F.col("formula"), "formula_type": F.col("formula_type"), "formula_range": F.col("formula_range")}
    inside = F.when(F.col("hyperlink").isNotNull(), rendering.element("a", {"href": F.col("hyperlink")}, rendering.xml_text(plain))).otherwise(rendering.xml_text(plain))
    made = placed.withColumn("__cell", rendering.element("cell", attributes, inside))
    rows = rendering.joined(made, [*SHEET, "row"], ["col"], F.col("__cell"), "", "cells")
    lines = rendering.joined(rows, SHEET, ["row"], rendering.element("tr", {"number": F.col("row")}, F.col("cells")), "", "rows")
    grids = lines.join(edge, SHEET).join(more, SHEET, "left")
    grid = rendering.element("grid", {"ref": reference("__t", "__l", "__b", "__r"), "truncated": F.when(F.col("next_row").isNotNull(), F.lit(True)), "next_row": F.col("next_row")}, F.col("rows"))
    named = sheets.where("kind in ('worksheet', 'chartsheet')").select("doc_id", F.col("name").alias("sheet"), "ord", "state").join(grids.select(*SHEET, grid.alias("grid")), SHEET, "left")
    one = rendering.element("sheet", {"name": F.col("sheet"), "visibility": F.when(F.col("state") != "visible", F.col("state"))}, F.coalesce("grid", F.lit("")))
    body = rendering.joined(named, ["doc_id"], ["ord"], one, "", "body")
    return body.select("doc_id", rendering.element("workbook", {"density": F.lit(density), "format": F.lit("xlsx")}, F.col("body")).alias("rendered"))
