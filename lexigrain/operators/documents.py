"""Operators over the entities of word documents and decks: text units, notes, sections, comments, geometry, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.text_marks import own_name, readable
from lexigrain.operators import rendering
from lexigrain.operators.graphs import cut

#: Rows of a table that plain reading shows in full, and names that programs give shapes.
PLAIN_ROWS, XML_ROWS = 10, 30
DEFAULT_NAMES = ["Picture", "Image", "Rectangle", "Oval", "TextBox", "Text Box", "Title", "Content Placeholder", "Straight Connector", "Chart", "Table", "Group", "Diagram"]
UNIT = "doc_id string, source string, rank int, ord long, item_id string, page int, slide int, sheet string, cell string, table_id string, row int, col int, paragraph int, grp string, text string"


def _unit(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows as text units: what isn't given is null."""
    kinds = {name: kind for name, kind in (x.split(" ") for x in UNIT.split(", "))}
    return df.select(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def _lines(df: DataFrame, column: str = "text") -> DataFrame:
    return df.select("*", F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n", -1)).alias("__line", "__text"))


# ---------------------------------------------------------------- text units


def word_units(blocks: DataFrame, cells: DataFrame, notes: DataFrame, objects: DataFrame | None = None, headers: bool = False) -> DataFrame:
    """Text units of word documents: body, table cells (one group each), footnotes, endnotes, comments, text boxes, on request headers and footers."""
    body = blocks.where("type <> 'table'")
    out = _unit(body, doc_id=F.col("doc_id"), source=F.lit("body"), rank=F.lit(0), ord=F.col("ord") * 1_000_000, page=F.col("page"), item_id=F.concat(F.lit("block"), F.col("ord").cast("string")), text=F.col("text"))
    places = blocks.where("type = 'table'").select("doc_id", "table_id", F.col("ord").alias("__ord"), F.col("page").alias("__page"))
    told = _lines(cells.join(places, ["doc_id", "table_id"]))
    group = F.concat_ws(":", "table_id", F.col("row").cast("string"), F.col("col").cast("string"))
    out = out.union(_unit(told, doc_id=F.col("doc_id"), source=F.lit("body"), rank=F.lit(0), ord=F.col("__ord") * 1_000_000 + F.col("row") * 1000 + F.col("col"), page=F.col("__page"), table_id=F.col("table_id"), row=F.col("row") + 1, col=F.col("col") + 1, paragraph=F.col("__line") + 1, grp=group, text=F.col("__text")))
    kinds = ["footnote", "endnote", "comment"] + ["header", "footer"] * headers
    for rank, kind in enumerate(kinds, 1):
        own = _lines(notes.where(F.col("kind") == kind))
        out = out.union(_unit(own, doc_id=F.col("doc_id"), source=F.lit(kind), rank=F.lit(rank), ord=F.coalesce(F.col("id").try_cast("long"), F.lit(0)) * 1000 + F.col("__line"), item_id=F.col("id"), paragraph=F.col("__line") + 1, text=F.col("__text")))
    if objects is not None:
        boxes = _lines(objects.where("kind = 'textbox'"))
        out = out.union(_unit(boxes, doc_id=F.col("doc_id"), source=F.lit("textbox"), rank=F.lit(9), ord=F.col("ord") * 1000 + F.col("__line"), paragraph=F.col("__line") + 1, item_id=F.concat(F.lit("textbox"), F.col("ord").cast("string")), text=F.col("__text")))
    return out


def deck_units(paragraphs: DataFrame, cells: DataFrame, slides: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Text units of decks: paragraphs without the labels of their lists, table cells that no merge continues, notes, comments."""
    out = _unit(paragraphs, doc_id=F.col("doc_id"), source=F.lit("body"), rank=F.lit(0), slide=F.col("n"), ord=F.col("n").cast("long") * 10_000_000 + F.col("shape") * 10_000 + F.col("ord"), item_id=F.concat(F.lit("shape"), F.col("shape").cast("string")), paragraph=F.col("ord") + 1, text=F.col("text"))
    told = _lines(cells.where("not h_merge and not v_merge"))
    group = F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "shape", "row", "col")))
    out = out.union(_unit(told, doc_id=F.col("doc_id"), source=F.lit("body"), rank=F.lit(0), slide=F.col("n"), ord=F.col("n").cast("long") * 10_000_000 + F.col("shape") * 10_000 + F.col("row") * 100 + F.col("col"), item_id=F.concat(F.lit("shape"), F.col("shape").cast("string")), row=F.col("row") + 1, col=F.col("col") + 1, grp=group, text=F.col("__text")))
    notes = _lines(slides.where("notes is not null"), "notes")
    out = out.union(_unit(notes, doc_id=F.col("doc_id"), source=F.lit("notes"), rank=F.lit(1), slide=F.col("n"), ord=F.col("n") * 1000 + F.col("__line"), paragraph=F.col("__line") + 1, text=F.col("__text")))
    if comments is not None:
        said = _lines(comments)
        out = out.union(_unit(said, doc_id=F.col("doc_id"), source=F.lit("comment"), rank=F.lit(2), slide=F.col("n"), ord=F.col("ord") * 1000 + F.col("__line"), item_id=F.col("id"), paragraph=F.col("__line") + 1, text=F.col("__text")))
    return out


def sheet_units(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Text units of workbooks: displayed cells in sheet, row and column order, merged-away ones left out."""
    order = sheets.select("doc_id", F.col("name").alias("sheet"), F.col("ord").alias("__sheet"))
    shown = cells.where("not shadow and text is not null and text <> ''").join(order, ["doc_id", "sheet"])
    return _unit(shown, doc_id=F.col("doc_id"), source=F.lit("cell"), rank=F.col("__sheet"), ord=F.col("row").cast("long") * 16_384 + F.col("col"), sheet=F.col("sheet"), cell=F.col("ref"), row=F.col("row"), col=F.col("col"), text=F.col("text"))


def locator(units: DataFrame) -> DataFrame:
    """Units with ``locator``: what is known of the place, as a map."""
    names = ["source", "item_id", "page", "slide", "sheet", "cell", "table_id", "row", "col", "paragraph"]
    pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("string") for n in names)))
    return units.withColumn("locator", F.map_filter(pairs, lambda _, v: v.isNotNull()))


#: What each kind of search has to read.
SEARCH_ENTITIES = {"xlsx": ["xlsx_cells", "xlsx_sheets"], "docx": ["docx_blocks", "docx_table_cells", "docx_notes", "docx_objects"], "pptx": ["pptx_paragraphs", "pptx_table_cells", "pptx_slides", "pptx_comments"]}


def page_after(units: DataFrame, after: tuple[str, int, int] | None, limit: int) -> DataFrame:
    """The next ``limit`` matched units behind a place (doc_id, rank, ord), without going through those before: a search that goes on."""
    if after is not None:
        doc, rank, ord_ = after
        units = units.where((F.col("doc_id") > doc) | (F.col("doc_id") == doc) & ((F.col("rank") > rank) | (F.col("rank") == rank) & (F.col("ord") > ord_)))
    return units.orderBy("doc_id", "rank", "ord").limit(limit)


# ---------------------------------------------------------------- joins


def inline_notes(blocks: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with the footnotes they refer to behind their text, endnotes once each in the order in which they are first referred to)."""
    refs = lambda mark: F.regexp_extract_all("text", F.lit(rf"\[{mark}(\d+)\]"), F.lit(1))
    asked = blocks.select("doc_id", "ord", F.posexplode(refs("fn")).alias("k", "id"))
    told = asked.join(notes.where("kind = 'footnote'").select("doc_id", "id", F.col("text").alias("note")), ["doc_id", "id"]).where("note <> ''")
    said = rendering.joined(told, ["doc_id", "ord"], ["k"], F.concat(F.lit(" [fn"), "id", F.lit(": "), "note", F.lit("]")), "", "__notes")
    out = blocks.join(said, ["doc_id", "ord"], "left").withColumn("text", F.concat(F.regexp_replace("text", r"\[fn\d+\]|\[en\d+\]", ""), F.coalesce("__notes", F.lit("")))).drop("__notes")
    ends = blocks.select("doc_id", "ord", F.posexplode(refs("en")).alias("k", "id")).groupBy("doc_id", "id").agg(F.min(F.struct("ord", "k")).alias("first"))
    return out, ends.join(notes.where("kind = 'endnote'").select("doc_id", "id", "text"), ["doc_id", "id"])


def with_sections(slides: DataFrame, sections: DataFrame) -> DataFrame:
    """Slides with the name of the section they are in."""
    named = sections.where("n is not null").groupBy("doc_id", "n").agg(F.min_by("name", "ord").alias("section"))
    return slides.join(named, ["doc_id", "n"], "left")


def navigation(links: DataFrame, slides: DataFrame) -> DataFrame:
    """Links with ``resolved``: `#slideN` for parts of the deck and for jumps, which stop at its ends; anything else as it stands."""
    parts = slides.select("doc_id", F.col("part").alias("target"), F.col("n").alias("__to"))
    ends = slides.groupBy("doc_id").agg(F.max("n").alias("__last"))
    joined = links.join(parts, ["doc_id", "target"], "left").join(ends, "doc_id", "left")
    jump = F.regexp_extract("action", r"jump=(\w+)", 1)
    to = F.when(jump == "firstslide", 1).when(jump == "lastslide", F.col("__last")).when(jump == "nextslide", F.least(F.col("n") + 1, F.col("__last"))).when(jump == "previousslide", F.greatest(F.col("n") - 1, F.lit(1)))
    number = F.coalesce("__to", to)
    return joined.select("doc_id", "n", "shape_id", "action", "target", F.when(number.isNotNull(), F.concat(F.lit("#slide"), number.cast("string"))).otherwise(F.col("target")).alias("resolved"))


def connectors(objects: DataFrame) -> DataFrame:
    """Connectors with the ordinals of the shapes they lead from and to; ends that aren't there are null."""
    ids = objects.where("kind <> 'connector'").groupBy("doc_id", "n", "shape_id").agg(F.min("ord").alias("__at"))
    end = lambda c, name: ids.select("doc_id", "n", F.col("shape_id").alias(c), F.col("__at").alias(name))
    return objects.where("kind = 'connector'").join(end("from_id", "from_ord"), ["doc_id", "n", "from_id"], "left").join(end("to_id", "to_ord"), ["doc_id", "n", "to_id"], "left").select("doc_id", "n", "ord", "from_id", "to_id", "from_ord", "to_ord")


def comment_places(comments: DataFrame, slides: DataFrame, objects: DataFrame) -> DataFrame:
    """Comments with their slide's part and the ordinal of the shape they are anchored at, where it is on that slide."""
    at = objects.groupBy("doc_id", "n", "shape_id").agg(F.min("ord").alias("shape_ord"))
    return comments.join(slides.select("doc_id", "n", "part"), ["doc_id", "n"], "left").join(at, ["doc_id", "n", "shape_id"], "left")


def with_assets(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """Objects with the size and digest of the part they show; ``missing`` where a target isn't there."""
    held = parts.select("doc_id", F.col("name").alias("target"), "size", "sha256")
    return objects.join(held, ["doc_id", "target"], "left").withColumn("missing", F.col("target").isNotNull() & F.col("sha256").isNull())


def referenced(items: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """Items that something refers to: bookmarks that a link goes to, assets that a window shows."""
    return items.join(uses.select(*keys).distinct(), keys, "left_semi")


def meaningful(objects: DataFrame, texts: DataFrame) -> DataFrame:
    """Shapes that say or show something, numbered anew in drawing order: decoration without text, description, link or connection goes."""
    said = texts.where(F.trim("text") != "").select("doc_id", "n", "shape_id").distinct().withColumn("__said", F.lit(True))
    kept = objects.join(said, ["doc_id", "n", "shape_id"], "left").where(F.col("__said") | readable(F.col("alt")).isNotNull() | ~F.col("kind").isin("text", "group"))
    return kept.drop("__said").withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "n").orderBy("ord")))


def shown_names(objects: DataFrame, name: str = "name") -> DataFrame:
    """Without names that programs give by themselves."""
    return objects.withColumn(name, own_name(F.col(name), DEFAULT_NAMES))


# ---------------------------------------------------------------- geometry and tables


def placed(objects: DataFrame) -> DataFrame:
    """Shapes in slide coordinates: each group around one, from the inside out, moves and scales what it holds."""
    def step(at: Column, g: Column) -> Column:
        sx = F.when(F.coalesce(g["cw"], F.lit(0)) > 0, g["w"] / g["cw"]).otherwise(F.lit(1.0))
        sy = F.when(F.coalesce(g["ch"], F.lit(0)) > 0, g["h"] / g["ch"]).otherwise(F.lit(1.0))
        known = g["x"].isNotNull() & g["cx"].isNotNull()
        moved = F.struct((g["x"] + (at["x"] - g["cx"]) * sx).alias("x"), (g["y"] + (at["y"] - g["cy"]) * sy).alias("y"), (at["w"] * sx).alias("w"), (at["h"] * sy).alias("h"))
        return F.when(known, moved).otherwise(at)

    start = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")))
    folded = F.aggregate(F.reverse("group_path"), start, step)
    return objects.withColumn("__at", folded).select(*(c for c in objects.columns if c not in ("x", "y", "w", "h")), *(F.round(F.col(f"__at.{c}")).cast("long").alias(c) for c in ("x", "y", "w", "h")))


def reading_order(objects: DataFrame) -> DataFrame:
    """Shapes with their place in reading order: from the top, then from the left; shapes without a place come last."""
    w = Window.partitionBy("doc_id", "n").orderBy(F.col("y").asc_nulls_last(), F.col("x").asc_nulls_last(), "ord")
    return objects.withColumn("reading", F.row_number().over(w))


def inherited_places(objects: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Placeholders without a place of their own have that of the layout's, else of the master's of their kind."""
    own = ["x", "y", "w", "h"]
    layer = lambda name, keys: placeholders.where(F.col("layer") == name).groupBy("doc_id", "n", *keys).agg(*(F.first(c, True).alias(f"__{name}_{c}") for c in own))
    held = objects.where("placeholder is not null").withColumn("type", F.col("placeholder")).withColumn("idx", F.coalesce("placeholder_idx", F.lit("0")))
    by_idx = layer("layout", ["idx"])
    out = held.join(by_idx.withColumn("idx", F.coalesce("idx", F.lit("0"))), ["doc_id", "n", "idx"], "left").join(layer("master", ["type"]), ["doc_id", "n", "type"], "left")
    return out.select("doc_id", "n", "ord", "placeholder", *(F.coalesce(F.col(c), F.col(f"__layout_{c}"), F.col(f"__master_{c}")).alias(c) for c in own))


def normal_spans(cells: DataFrame) -> DataFrame:
    """Table cells that start a merge with their spans, counted by the cells that continue it; continued ones are left out."""
    keys = ["doc_id", "n", "shape"]
    across = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    anchored = cells.withColumn("__col", F.last(F.when(~F.col("h_merge"), F.col("col")), True).over(across)).withColumn("__row", F.last(F.when(~F.col("v_merge"), F.col("row")), True).over(down))
    wide = anchored.where("h_merge and not v_merge").groupBy(*keys, "row", F.col("__col").alias("col")).agg(F.count("*").alias("__wide"))
    high = anchored.where("v_merge and not h_merge").groupBy(*keys, F.col("__row").alias("row"), "col").agg(F.count("*").alias("__high"))
    first = cells.where("not h_merge and not v_merge")
    out = first.join(wide, [*keys, "row", "col"], "left").join(high, [*keys, "row", "col"], "left")
    span = lambda declared, met: F.greatest(F.coalesce(F.col(declared), F.lit(1)), F.coalesce(F.col(met), F.lit(0)) + 1).cast("int")
    return out.withColumn("col_span", span("col_span", "__wide")).withColumn("row_span", span("row_span", "__high")).drop("__wide", "__high", "h_merge", "v_merge")


def section_pages(sections: DataFrame) -> DataFrame:
    """Sections with how many pages their numbers go back: sections that go on on the same page, up to each one."""
    w = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("back", F.sum(F.when((F.col("type") == "continuous") & (F.col("section") > 1), 1).otherwise(0)).over(w))


def table_segments(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """Cells of tables that pages cut, as one table: rows are numbered on through the segments in order (doc_id, table_id, segment, segment_table)."""
    sizes = cells.groupBy("doc_id", F.col("table_id").alias("segment_table")).agg((F.max("row") + 1).alias("__n"))
    w = Window.partitionBy("doc_id", "table_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed_ = segments.join(sizes, ["doc_id", "segment_table"], "left").withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    own = cells.withColumnRenamed("table_id", "segment_table").join(placed_, ["doc_id", "segment_table"])
    return own.withColumn("row", (F.col("row") + F.col("__before")).cast("int")).drop("__n", "__before", "segment", "segment_table")


def table_regions(cells: DataFrame, headers: int = 1, band: int = 1) -> DataFrame:
    """Cells with the regions of a table style that hold them, the most particular last: whole, bands, columns, rows, corners."""
    size = cells.groupBy("doc_id", "table_id").agg(F.max("row").alias("__rows"), F.max("col").alias("__cols"))
    c = cells.join(size, ["doc_id", "table_id"])
    top, bottom, left, right = F.col("row") == 0, F.col("row") == F.col("__rows"), F.col("col") == 0, F.col("col") == F.col("__cols")
    row_band = F.pmod(F.floor((F.col("row") - headers) / band), F.lit(2))
    col_band = F.pmod(F.floor(F.col("col") / band), F.lit(2))
    inner = ~top & (F.col("row") >= headers)
    named = [(F.lit(True), "wholeTable"), (inner & (col_band == 0), "band1Vert"), (inner & (col_band == 1), "band2Vert"), (inner & (row_band == 0), "band1Horz"), (inner & (row_band == 1), "band2Horz"), (right, "lastCol"), (left, "firstCol"), (bottom, "lastRow"), (top, "firstRow"), (bottom & right, "seCell"), (bottom & left, "swCell"), (top & right, "neCell"), (top & left, "nwCell")]
    regions = F.filter(F.array(*(F.when(when, name) for when, name in named)), lambda x: x.isNotNull())
    return c.withColumn("regions", regions).drop("__rows", "__cols")


def region_format(cells: DataFrame, styles: DataFrame, style: str) -> DataFrame:
    """The run format of each cell under a table style: its regions' formats over one another."""
    own = styles.where((F.col("style_id") == style) & F.col("type").startswith("table")).select("doc_id", F.when(F.col("type") == "table", "wholeTable").otherwise(F.substring("type", 7, 40)).alias("region"), "format")
    keys = ["doc_id", "table_id", "row", "col"]
    asked = cells.select(*keys, F.posexplode("regions").alias("__at", "region")).join(own, ["doc_id", "region"])
    values = asked.select(*keys, "__at", F.explode("format").alias("k", "v")).groupBy(*keys, "k").agg(F.max_by("v", "__at").alias("v"))
    return values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("format"))


def resolved_styles(styles: DataFrame, rounds: int = 32) -> DataFrame:
    """Styles with the format of their bases under their own; a base of another type, an unknown one or a circle ends the chain, ``cyclic`` tells circles."""
    own = cut(styles.where("not startswith(type, 'table:')").select("doc_id", "style_id", "type", "base", "format"))
    state = own.select("doc_id", "style_id", "type", "format", F.col("base").alias("next"), F.array("style_id").alias("seen"), F.lit(False).alias("cyclic"))
    above = own.select("doc_id", F.col("style_id").alias("next"), "type", F.col("format").alias("__format"), F.col("base").alias("__base"))
    for _ in range(rounds):
        joined = state.join(above, ["doc_id", "next", "type"], "left")
        loop = F.array_contains("seen", F.col("next"))
        found = F.col("__format").isNotNull() & ~F.coalesce(loop, F.lit(False))
        merged = F.when(found, over(F.col("__format"), F.col("format"))).otherwise(F.col("format"))
        state = cut(joined.select("doc_id", "style_id", "type", merged.alias("format"), F.when(found, F.col("__base")).alias("__next"), F.when(found, F.concat("seen", F.array("next"))).otherwise(F.col("seen")).alias("seen"), (F.col("cyclic") | F.coalesce(loop, F.lit(False))).alias("cyclic")).withColumnRenamed("__next", "next"))
        if not state.where("next is not null").limit(1).count():
            break
    return state.select("doc_id", "style_id", "type", "format", F.slice("seen", 2, 1 << 20).alias("bases"), "cyclic")


def over(base: Column, later: Column) -> Column:
    """Two maps as one, the later's values where both have a key."""
    empty = F.create_map().cast("map<string,string>")
    base, later = F.coalesce(base, empty), F.coalesce(later, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(later), k)), later)


def visible_format(look: Column) -> Column:
    """Without what is off, and without the usual look of links (blue, underlined)."""
    shown = F.map_filter(look, lambda _, v: ~v.isin("false", ""))
    link = (F.element_at(shown, "color") == "#0563C1") & F.map_contains_key(shown, "underline")
    return F.when(F.coalesce(link, F.lit(False)), F.map_filter(shown, lambda k, _: ~k.isin("color", "underline"))).otherwise(shown)


def described_change(before: Column, after: Column) -> tuple[Column, Column]:
    """What a property change was and is, as sorted `k=v;k=v`, `normal` for nothing."""
    told = lambda m: F.when(F.size(m) > 0, F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")).otherwise("normal")
    return told(before), told(after)


def regrouped(stories: DataFrame) -> DataFrame:
    """Consecutive fragments of one anchored story (part, id) as one text again, a form feed at each change of page."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    same = (F.col("part") == F.lag("part").over(w)) & (F.col("id") == F.lag("id").over(w))
    marked = stories.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__break", F.when(F.coalesce(same, F.lit(False)) & (F.col("page") > F.lag("page").over(w)), "\f").otherwise(""))
    marked = marked.withColumn("__story", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = marked.groupBy("doc_id", "__story").agg(F.min("ord").alias("ord"), F.min("page").alias("page"), F.first("part").alias("part"), F.first("id").alias("id"))
    text = rendering.joined(marked.withColumnRenamed("ord", "__ord"), ["doc_id", "__story"], ["__ord"], F.concat("__break", "text"), "", "text")
    return first.join(text, ["doc_id", "__story"]).drop("__story")


# ---------------------------------------------------------------- reading


def cut_tables(blocks: DataFrame, most: int = PLAIN_ROWS) -> DataFrame:
    """Tables of more rows than ``most`` as their first row and a line that says how large they are."""
    rows = F.split("text", "\n", -1)
    columns = F.array_max(F.transform(rows, lambda r: F.size(F.split(r, "\t", -1))))
    short = F.concat(F.element_at(rows, 1), F.lit("\n[Table truncated: "), F.size(rows).cast("string"), F.lit(" rows, "), columns.cast("string"), F.lit(" cols]"))
    return blocks.withColumn("text", F.when((F.col("type") == "table") & (F.size(rows) > most), short).otherwise(F.col("text")))


def plain_documents(blocks: DataFrame, notes: DataFrame, view: str = "final") -> DataFrame:
    """doc_id, rendered: pages behind their marks, footnotes behind their paragraphs, endnotes and comments at the end."""
    told, ends = inline_notes(cut_tables(blocks), notes)
    labelled = told.withColumn("text", F.when(F.col("label").isNotNull() & (F.col("label") != ""), F.concat("label", F.lit(" "), "text")).otherwise(F.col("text")))
    safe = F.regexp_replace("text", r"(?m)^(\\*<page=\d+>)$", r"\\$1")
    pages = rendering.joined(labelled, ["doc_id", "page"], ["ord"], safe, "\n\n", "body")
    last = blocks.groupBy("doc_id").agg(F.max(F.greatest("page", "page_end")).alias("last"), F.min("page").alias("first"))
    every = last.select("doc_id", F.explode(F.sequence("first", "last")).alias("page")).join(pages, ["doc_id", "page"], "left")
    body = rendering.joined(every, ["doc_id"], ["page"], F.concat_ws("\n\n", F.concat(F.lit("<page="), F.col("page").cast("string"), F.lit(">")), "body"), "\n\n", "body")
    ended = rendering.joined(ends.where("text <> ''"), ["doc_id"], ["first"], F.concat(F.lit("\n[ed"), "id", F.lit(": "), "text", F.lit("]")), "", "ends")
    said = notes.where("kind = 'comment'").withColumn("__k", F.coalesce(F.col("id").try_cast("long"), F.lit(0)))
    spoken = rendering.joined(said, ["doc_id"], ["__k", "id"], F.concat(F.lit("\n"), F.rtrim(F.concat(F.lit("[comment status=unknown] "), "text"))), "", "said")
    out = body.join(ended, "doc_id", "left").join(spoken, "doc_id", "left")
    head = F.lit(f"density=plain format=docx pagination=hints revision_view={view}\n")
    return out.select("doc_id", F.concat(head, "body", F.coalesce(F.concat(F.lit("\n\n[Endnotes]"), "ends"), F.lit("")), F.coalesce(F.concat(F.lit("\n\n[Comments]"), "said"), F.lit(""))).alias("rendered"))


def xml_documents(blocks: DataFrame, cells: DataFrame, density: str = "structural") -> DataFrame:
    """doc_id, rendered: headings, paragraphs and tables in order as XML, with page, style and label as attributes; long tables are cut."""
    size = cells.groupBy("doc_id", "table_id").agg((F.max("row") + 1).alias("rows"))
    shown = cells.join(size, ["doc_id", "table_id"]).where((F.col("rows") <= XML_ROWS) | (F.col("row") == 0))
    attributes = {"colspan": F.when(F.col("col_span") > 1, F.col("col_span")), "rowspan": F.when(F.col("row_span") > 1, F.col("row_span"))}
    text = rendering.xml_text(F.col("text"))
    made = shown.withColumn("__cell", F.when(F.col("is_header"), rendering.element("th", attributes, text)).otherwise(rendering.element("td", attributes, text)))
    rows = rendering.joined(made, ["doc_id", "table_id", "row"], ["col"], F.col("__cell"), "", "cells")
    tables = rendering.joined(rows, ["doc_id", "table_id"], ["row"], rendering.element("tr", {}, F.col("cells")), "", "__rows").join(size, ["doc_id", "table_id"])
    joined = blocks.join(tables, ["doc_id", "table_id"], "left")
    page = {"page": F.when(F.col("page") > 1, F.col("page")), "style": F.col("style_id") if density == "semantic" else F.lit(None).cast("string"), "label": F.col("label")}
    one = F.when(F.col("type") == "heading", rendering.element("heading", {**page, "level": F.col("level")}, text)).when(F.col("type") == "table", rendering.element("table", {"id": F.col("table_id"), "page": page["page"], "rows": F.when(F.col("rows") > XML_ROWS, F.col("rows")), "truncated": F.when(F.col("rows") > XML_ROWS, F.lit(True))}, F.coalesce("__rows", F.lit("")))).otherwise(rendering.element("p", page, text))
    body = rendering.joined(joined.withColumn("__one", one), ["doc_id"], ["ord"], F.col("__one"), "", "body")
    return body.select("doc_id", rendering.element("document", {"density": F.lit(density), "format": F.lit("docx")}, F.col("body")).alias("rendered"))


def plain_decks(slides: DataFrame, shapes: DataFrame, sections: DataFrame | None = None, comments: DataFrame | None = None) -> DataFrame:
    """doc_id, rendered: slides under their numbers, shapes with text parted by blank lines, notes behind them, comments at the end."""
    named = with_sections(slides, sections) if sections is not None else slides.withColumn("section", F.lit(None).cast("string"))
    rows = F.split("text", "\n", -1)
    cut_rows = F.concat(F.array_join(F.slice(rows, 1, PLAIN_ROWS), "\n"), F.lit("\n[Table truncated: "), F.size(rows).cast("string"), F.lit(" rows, "), F.array_max(F.transform(rows, lambda r: F.size(F.split(r, "\t", -1)))).cast("string"), F.lit(" cols]"))
    text = F.when(F.col("type") == "picture", "[Image]").when((F.col("type") == "table") & (F.size(rows) > PLAIN_ROWS), cut_rows).when(F.col("type") == "connector", "[Connector]").otherwise(F.col("text"))
    said = rendering.joined(shapes.withColumn("__text", text).where("__text <> ''"), ["doc_id", "n"], ["ord"], F.col("__text"), "\n\n", "body")
    joined = named.join(said, ["doc_id", "n"], "left")
    note = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("[Notes: "), "notes", F.lit("]")))
    one = F.concat(F.when(F.col("n") > 1, "\n").otherwise(""), F.lit("=== Slide "), F.col("n").cast("string"), F.coalesce(F.concat(F.lit(" (Section: "), "section", F.lit(")")), F.lit("")), F.lit(" ===\n"), F.concat_ws("\n\n", "body", note))
    body = rendering.joined(joined, ["doc_id"], ["n"], one, "", "body")
    if comments is None:
        return body.select("doc_id", F.concat(F.lit("density=plain format=pptx\n"), "body").alias("rendered"))
    told = rendering.joined(comments, ["doc_id"], ["ord"], F.rtrim(F.concat(F.lit("[comment status="), "status", F.lit("] "), "text")), "\n", "said")
    return body.join(told, "doc_id", "left").select("doc_id", F.concat(F.lit("density=plain format=pptx\n"), "body", F.coalesce(F.concat(F.lit("\n\n[Comments]\n"), "said"), F.lit(""))).alias("rendered"))


def xml_decks(slides: DataFrame, paragraphs: DataFrame, cells: DataFrame, density: str = "structural") -> DataFrame:
    """doc_id, rendered: slides with their text shapes and tables in drawing order as XML."""
    attributes = {"level": F.when(F.col("level") > 0, F.col("level")), "label": F.col("label")}
    lines = rendering.joined(paragraphs.where("text <> ''"), ["doc_id", "n", "shape"], ["ord"], rendering.element("p", attributes, rendering.xml_text(F.col("text"))), "", "inside")
    text = lines.select("doc_id", "n", "shape", rendering.element("text", {}, F.col("inside")).alias("one"))
    span = {"colspan": F.when(F.col("col_span") > 1, F.col("col_span")), "rowspan": F.when(F.col("row_span") > 1, F.col("row_span"))}
    rows = rendering.joined(normal_spans(cells), ["doc_id", "n", "shape", "row"], ["col"], rendering.element("td", span, rendering.xml_text(F.col("text"))), "", "cells")
    tables = rendering.joined(rows, ["doc_id", "n", "shape"], ["row"], rendering.element("tr", {}, F.col("cells")), "", "inside").select("doc_id", "n", "shape", rendering.element("table", {}, F.col("inside")).alias("one"))
    shapes = rendering.joined(text.union(tables), ["doc_id", "n"], ["shape"], F.col("one"), "", "shapes")
    joined = slides.join(shapes, ["doc_id", "n"], "left")
    note = F.coalesce(rendering.element("notes", {}, rendering.xml_text(F.col("notes"))), F.lit(""))
    one = rendering.element("slide", {"n": F.col("n"), "hidden": F.when(F.col("hidden"), F.lit(True))}, F.concat(F.coalesce("shapes", F.lit("")), F.when(F.col("notes").isNotNull(), note).otherwise("")))
    body = rendering.joined(joined, ["doc_id"], ["n"], one, "", "body")
    return body.select("doc_id", rendering.element("presentation", {"density": F.lit(density), "format": F.lit("pptx")}, F.col("body")).alias("rendered"))


def envelope(rendered: DataFrame, form: str, density: str, resources: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One row for each document: its text with density, format, media type, syntax version, resources and warnings, and all of it as JSON."""
    out = rendered.select("doc_id", F.col("rendered").alias("text"))
    if resources is not None:
        held = resources.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "id", "label"))).alias("resources"))
        out = out.join(held, "doc_id", "left")
    else:
        out = out.withColumn("resources", F.array().cast("array<struct<kind:string,id:string,label:string>>"))
    if warnings is not None:
        out = out.join(warnings.groupBy("doc_id").agg(F.sort_array(F.collect_set("message")).alias("warnings")), "doc_id", "left")
    else:
        out = out.withColumn("warnings", F.array().cast("array<string>"))
    media = "text/plain" if density == "plain" else "application/xml"
    told = F.struct("text", F.lit(density).alias("density"), F.lit(form).alias("format"), F.lit(media).alias("media_type"), F.lit("1").alias("syntax_version"), F.coalesce("resources", F.array().cast("array<struct<kind:string,id:string,label:string>>")).alias("resources"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    return out.select("doc_id", told.alias("result"), F.to_json(told).alias("json"))


def resource_catalog(objects: DataFrame | None = None, tables: DataFrame | None = None, charts: DataFrame | None = None, pivots: DataFrame | None = None) -> DataFrame:
    """All resources of documents in one table: kind, id (numbered in order for each kind), label, target."""
    parts = []
    if objects is not None:
        w = Window.partitionBy("doc_id", "kind").orderBy("ord")
        shown = objects.where("kind in ('image', 'picture', 'chart', 'diagram', 'media', 'embedded')").withColumn("__n", F.row_number().over(w))
        parts.append(shown.select("doc_id", "kind", F.concat("kind", F.col("__n").cast("string")).alias("id"), F.col("alt").alias("label"), "target"))
    if tables is not None:
        parts.append(tables.select("doc_id", F.lit("table").alias("kind"), "id", F.col("name").alias("label"), F.col("ref").alias("target")))
    if charts is not None:
        parts.append(charts.groupBy("doc_id", "part").agg(F.first("title").alias("label")).select("doc_id", F.lit("chart").alias("kind"), F.regexp_extract("part", r"(chart\d+)\.xml$", 1).alias("id"), "label", F.col("part").alias("target")))
    if pivots is not None:
        parts.append(pivots.select("doc_id", F.lit("pivot").alias("kind"), "id", F.col("name").alias("label"), F.col("ref").alias("target")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chart_points(charts: DataFrame) -> DataFrame:
    """Points of charts' series by place: category, value, x, y and size where the series has them."""
    longest = F.greatest(*(F.size(c) for c in ("categories", "values", "x", "y", "size")))
    spread = charts.where(longest > 0).select("doc_id", "part", "series", "name", F.explode(F.sequence(F.lit(0), longest - 1)).alias("place"), "categories", "values", "x", "y", "size")
    return spread.select("doc_id", "part", "series", "name", "place", *(F.get(F.col(c), F.col("place")).alias(n) for c, n in (("categories", "category"), ("values", "value"), ("x", "x"), ("y", "y"), ("size", "size"))))


def diagram_text(nodes: DataFrame, links: DataFrame, most_nodes: int = 12, most_chars: int = 1200) -> DataFrame:
    """doc_id, part, rendered: a diagram's labels in order, twelve nodes and 1,200 characters at most, and whether more are left out."""
    w = Window.partitionBy("doc_id", "part").orderBy("node")
    counted = nodes.withColumn("__k", F.row_number().over(w)).withColumn("__before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = F.lit(most_chars) - F.col("__before")
    text = F.when(F.length("text") > room, F.concat(F.expr(f"substring(text, 1, greatest(0, {most_chars - 1} - cast(__before as int)))"), F.lit("…"))).otherwise(F.col("text"))
    kept = counted.where((F.col("__k") <= most_nodes) & ((room > 0) | (F.length("text") == 0))).withColumn("__text", text)
    body = rendering.joined(kept.where(F.trim("__text") != ""), ["doc_id", "part"], ["node"], F.col("__text"), "; ", "body")
    sizes = counted.groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    out = sizes.join(body, ["doc_id", "part"], "left").join(links.groupBy("doc_id", "part").agg(F.count("*").alias("links")), ["doc_id", "part"], "left")
    more = (F.col("n") > most_nodes) | (F.col("chars") > most_chars) | (F.coalesce("links", F.lit(0)) > 24)
    return out.select("doc_id", "part", F.concat(F.lit("[SmartArt"), F.when(more, " truncated").otherwise(""), F.coalesce(F.concat(F.lit(": "), F.col("body")), F.lit("")), F.lit("]")).alias("rendered"))
