"""Office files as entity tables: one row per cell, block, shape, part or relationship.

Files are read as binary rows by Spark, from any store it can open, and parsed
by the tasks that read them; a file that can't be parsed gives a row of the
``warnings`` entity and none of the others.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexigrain.sources import catalogs, deck_parts, emf, figures, word_parts
from lexigrain.sources.legacy import BinaryWorkbook
from lexigrain.sources.package import Package, PackageError
from lexigrain.sources.workbooks import Workbook
from lexigrain.sources.writings import Deck, Writing

#: From a package, or the bytes of a binary workbook.
Rows = Callable[..., Iterator[dict]]


def _entries(p: Package) -> Iterator[dict]:
    return ({"name": e.filename, "compressed": e.compress_size, "uncompressed": e.file_size, "crc": e.CRC} for e in p.entries)


def _links(p: Package) -> Iterator[dict]:
    return ({"source_part": r.source_part, "id": r.id, "type": r.type, "target": r.target, "external": r.external, "resolved_target": r.resolved} for r in p.all_links())


def _parts(p: Package) -> Iterator[dict]:
    for e in p.entries:
        data = p.read(e.filename)
        yield {"name": e.filename, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "content": data}


def _cells(p: Package) -> Iterator[dict]:
    book = Workbook(p)
    for sheet in book.sheets:
        if sheet["kind"] == "worksheet":
            yield from book.cells(sheet)


#: What a damaged file can make a parser raise; it is told as a warning and never ends a job.
UNREADABLE = (PackageError, ValueError, AttributeError, struct.error, LookupError, TypeError, OverflowError, RecursionError, ArithmeticError, zlib.error, EOFError)

#: Each entity's suffix (empty: any package), columns after doc_id, and rows.
ENTITIES: dict[str, tuple[str, str, Rows]] = {
    "package_entries": ("", "name string, compressed long, uncompressed long, crc long", _entries),
    "relationships": ("", "source_part string, id string, type string, target string, external boolean, resolved_target string", _links),
    "charts": ("", "part string, title string, type string, series int, name string, plot string, axes map<string,string>, categories array<string>, values array<string>, x array<string>, y array<string>, size array<string>", figures.charts),
    "diagram_nodes": ("", "part string, node int, kind string, text string", figures.diagram_nodes),
    "diagram_links": ("", "part string, kind string, from_node int, to_node int", figures.diagram_links),
    "xlsx_sheets": ("xlsx", "ord int, name string, state string, part string, kind string", lambda p: iter(Workbook(p).sheets)),
    "xlsx_cells": ("xlsx", "sheet string, row int, col int, ref string, text string, raw string, type string, formula string, formula_type string, formula_range string, style int, rowspan int, colspan int, shadow boolean, hyperlink string, comment string, comment_author string, cm int, vm int, blank boolean, row_hidden boolean, outline int", _cells),
    "xlsx_tables": ("xlsx", "id string, sheet string, name string, ref string, columns array<string>", lambda p: Workbook(p).tables()),
    "content_types": ("", "name string, content_type string, declared string", catalogs.content_types),
    "emf_texts": ("", "part string, ord int, text string", emf.texts),
    "parts": ("", "name string, size long, sha256 string, content binary", _parts),
    "xlsx_ranges": ("xlsx", "sheet string, kind string, ref string, top int, left int, bottom int, right int, attrs map<string,string>", catalogs.ranges),
    "xlsx_rules": ("xlsx", "ord int, sheet string, kind string, source string, ext_id string, ranges array<string>, formulas array<string>, unparsed boolean, attrs map<string,string>", catalogs.rules),
    "xlsx_styles": ("xlsx", "kind string, style int, code string, look map<string,string>, locked boolean, hidden boolean, control string", catalogs.styles),
    "xlsx_pivot_caches": ("xlsx", "id string, cache_id string, ambiguous boolean, missing boolean, source_sheet string, source_ref string, fields array<string>, records long", catalogs.pivot_caches),
    "xlsx_pivots": ("xlsx", "id string, sheet string, name string, cache_id string, ref string, rows array<int>, columns array<int>, pages array<int>, data array<struct<name:string,field:int,function:string>>", catalogs.pivots),
    "xlsx_slicers": ("xlsx", "kind string, name string, source string, cache_id string, tables array<string>", catalogs.slicers),
    "xlsx_drawings": ("xlsx", "sheet string, ord int, kind string, object_id string, name string, alt string, text string, target string, group_id string, from_id string, to_id string, top int, left int, bottom int, right int", catalogs.drawings),
    "xlsx_threads": ("xlsx", "sheet string, ord int, ref string, raw_id string, parent_raw_id string, person_id string, author string, date string, status string, mentions array<string>, text string", catalogs.threads),
    "xlsx_rich_values": ("xlsx", "vm int, kind string, display string, alt string, fallback string, image_part string, image_url string, fields map<string,string>", catalogs.rich_values),
    "xlsx_external_links": ("xlsx", "n int, part string, target string, sheets array<string>", catalogs.external_links),
    "xlsx_names": ("xlsx", "name string, refers_to string, scope string", lambda p: (dict(zip(("name", "refers_to", "scope"), n)) for n in Workbook(p).names)),
    "xls_sheets": ("xls", "ord int, name string, state string, kind string", lambda d: ({k: s[k] for k in ("ord", "name", "state", "kind")} for s in BinaryWorkbook(d).sheets)),
    "xls_cells": ("xls", "sheet string, row int, col int, ref string, text string, raw string, type string", lambda d: BinaryWorkbook(d).cells()),
    "docx_blocks": ("docx", "ord int, type string, level int, style_id string, text string, label string, list_level int, page int, page_end int, table_id string, section int", lambda p: Writing(p).blocks()),
    "docx_table_cells": ("docx", "table_id string, row int, col int, row_span int, col_span int, v_merge string, is_header boolean, text string", lambda p: Writing(p).table_cells()),
    "docx_notes": ("docx", "kind string, id string, text string, author string, date string", lambda p: Writing(p).notes()),
    "docx_runs": ("docx", "paragraph int, ord int, text string, format map<string,string>, link map<string,string>, ruby string, revision string, author string", word_parts.runs),
    "docx_styles": ("docx", "style_id string, type string, name string, base string, default boolean, outline int, num_id string, format map<string,string>", word_parts.styles),
    "docx_controls": ("docx", "ord int, kind string, label string, lock string, options array<string>, checked boolean, text string", word_parts.controls),
    "docx_bookmarks": ("docx", "paragraph int, id string, name string", word_parts.bookmarks),
    "docx_objects": ("docx", "paragraph int, ord int, kind string, rel_id string, target string, external string, name string, alt string, floating boolean, program string, text string", word_parts.objects),
    "docx_sections": ("docx", "section int, type string, width int, height int", word_parts.sections),
    "pptx_paragraphs": ("pptx", "n int, shape int, ord int, level int, text string, label string", deck_parts.paragraphs),
    "pptx_runs": ("pptx", "n int, shape int, paragraph int, ord int, text string, format map<string,string>, href string", deck_parts.runs),
    "pptx_table_cells": ("pptx", "n int, shape int, row int, col int, text string, row_span int, col_span int, h_merge boolean, v_merge boolean", deck_parts.table_cells),
    "pptx_comments": ("pptx", "ord int, n int, id string, parent_id string, author string, date string, status string, shape_id string, text string", deck_parts.comments),
    "pptx_sections": ("pptx", "ord int, name string, slide_id string, n int", deck_parts.sections),
    "pptx_links": ("pptx", "n int, shape_id string, action string, target string, external boolean", deck_parts.links),
    "pptx_objects": ("pptx", "n int, ord int, shape_id string, kind string, group_path array<struct<x:long,y:long,w:long,h:long,cx:long,cy:long,cw:long,ch:long>>, x long, y long, w long, h long, placeholder string, placeholder_idx string, alt string, target string, from_id string, to_id string", deck_parts.objects),
    "pptx_placeholders": ("pptx", "n int, layer string, type string, idx string, x long, y long, w long, h long", deck_parts.placeholders),
    "pptx_themes": ("pptx", "n int, slot string, color string", deck_parts.themes),
    "pptx_slides": ("pptx", "n int, hidden boolean, part string, notes string", lambda p: Deck(p).slides()),
    "pptx_shapes": ("pptx", "n int, ord int, shape_id string, name string, type string, text string, x long, y long, w long, h long", lambda p: Deck(p).shapes()),
}


def parse_files(files: DataFrame, entity: str) -> DataFrame:
    """Rows of an entity from rows of (path, content); doc_id is the path. ValueError for an entity that isn't known."""
    if entity not in (*ENTITIES, "warnings"):
        raise ValueError(f"no entity {entity!r}; there are {', '.join([*ENTITIES, 'warnings'])}")
    suffix, columns, rows = ENTITIES.get(entity, ("", "message string", lambda p: iter(())))
    schema = StructType.fromDDL("doc_id string, " + columns)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if suffix and not path.lower().endswith("." + suffix):
                    continue
                lost = None
                try:
                    if path.lower().endswith(".xls"):
                        content = data or b""
                        if entity == "warnings":
                            BinaryWorkbook(content)
                        elif suffix != "xls":
                            continue
                    else:
                        content = Package(data or b"")
                        if entity == "warnings":
                            content.main_part()
                    made = ({"doc_id": path, **r} for r in rows(content))
                    while some := list(itertools.islice(made, 5000)):
                        yield pa.RecordBatch.from_pylist(some, schema=arrow)
                except UNREADABLE as e:
                    lost = str(e)
                if lost is not None and entity == "warnings":
                    yield pa.RecordBatch.from_pylist([{"doc_id": path, "message": lost}], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_office(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """An entity of all files at the path."""
    suffix = ENTITIES.get(entity, ("",))[0]
    reader = spark.read.format("binaryFile")
    return parse_files((reader.option("pathGlobFilter", f"*.{suffix}") if suffix else reader).load(path), entity)
