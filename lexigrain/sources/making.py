"""Small office packages written from rows: what readers are tried on, and a sink for tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.references import letters_of

# Namespaces of the formats.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{OFFICE}"'
WORD = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="{OFFICE}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
SLIDE = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{OFFICE}"'
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"


def links(*items: tuple) -> str:
    """A relationship part of (id, kind, target) or (id, kind, target, True) for targets outside."""
    inner = "".join(f'<Relationship Id="{i[0]}" Type="{OFFICE}/{i[1]}" Target={quoteattr(i[2])}' + (' TargetMode="External"' if len(i) > 3 and i[3] else "") + "/>" for i in items)
    return f'<Relationships xmlns="{LINKS}">{inner}</Relationships>'


def package(parts: dict[str, str | bytes], overrides: dict[str, str] | None = None) -> bytes:
    """The bytes of a package; parts are stored in the given order."""
    own = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in (overrides or {}).items())
    types = f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{own}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {"[Content_Types].xml": types, **parts}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def cell(row: int, column: int, value: str | int | float | None, more: str = "") -> str:
    """A cell element: numbers as numbers, text inline, null as an empty cell."""
    ref = f'r="{letters_of(column)}{row}"{more}'
    if value is None:
        return f"<c {ref}/>"
    if isinstance(value, (int, float)):
        return f"<c {ref}><v>{value}</v></c>"
    return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def workbook(sheets: list[tuple[str, list[list]]], tails: dict[int, str] | None = None, sheet_links: dict[int, list[tuple]] | None = None, parts: dict[str, str | bytes] | None = None, book: str = "", book_links: list[tuple] | None = None) -> bytes:
    """A workbook of (name, rows of values); ``tails``: elements behind a sheet's rows; ``parts``: whatever else it holds."""
    out: dict[str, str | bytes] = {"_rels/.rels": links(("r1", "officeDocument", "xl/workbook.xml"))}
    entries = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="s{k}"/>' for k, (n, _) in enumerate(sheets, 1))
    out["xl/workbook.xml"] = f"<workbook {SHEET}><sheets>{entries}</sheets>{book}</workbook>"
    out["xl/_rels/workbook.xml.rels"] = links(*((f"s{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)), *(book_links or []))
    for k, (_, rows) in enumerate(sheets, 1):
        body = "".join(f'<row r="{r}">' + "".join(v if isinstance(v, str) and v.startswith("<c ") else cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        out[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {SHEET}><sheetData>{body}</sheetData>{(tails or {}).get(k, '')}</worksheet>"
        if own := (sheet_links or {}).get(k):
            out[f"xl/worksheets/_rels/sheet{k}.xml.rels"] = links(*own)
    return package({**out, **(parts or {})})


def paragraph(text: str, props: str = "", run: str = "") -> str:
    return f'<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def grid(rows: list[list[str]]) -> str:
    """A table of a word document; its first row is a header."""
    lines = []
    for n, row in enumerate(rows):
        lines.append("<w:tr>" + ("<w:trPr><w:tblHeader/></w:trPr>" if not n else "") + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>")
    return f"<w:tbl>{''.join(lines)}</w:tbl>"


def document(body: str, parts: dict[str, str | bytes] | None = None, own_links: list[tuple] | None = None) -> bytes:
    """A word document of body elements; ``parts`` and the links to them by name."""
    out = {"_rels/.rels": links(("r1", "officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"}
    if own_links:
        out["word/_rels/document.xml.rels"] = links(*own_links)
    return package({**out, **(parts or {})})


def text_shape(number: int, name: str, paragraphs: list[str], place: tuple[int, int, int, int] | None = None, more: str = "") -> str:
    at = f'<a:xfrm><a:off x="{place[0]}" y="{place[1]}"/><a:ext cx="{place[2]}" cy="{place[3]}"/></a:xfrm>' if place else ""
    lines = "".join(p if p.startswith("<a:p") else f"<a:p><a:r><a:t>{escape(p)}</a:t></a:r></a:p>" for p in paragraphs)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name={quoteattr(name)}/><p:cNvSpPr/><p:nvPr>{more}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>'


def table_shape(number: int, rows: list[list[str]]) -> str:
    body = "".join("<a:tr>" + "".join(c if c.startswith("<a:tc") else f"<a:tc><a:txBody><a:p><a:r><a:t>{escape(c)}</a:t></a:r></a:p></a:txBody></a:tc>" for c in row) + "</a:tr>" for row in rows)
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{number}" name="Table {number}"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def deck(slides: list[str], notes: dict[int, str] | None = None, parts: dict[str, str | bytes] | None = None, slide_links: dict[int, list[tuple]] | None = None, more: str = "", own_links: list[tuple] | None = None) -> bytes:
    """A presentation of shape trees in order, with the text of some slides' notes."""
    out: dict[str, str | bytes] = {"_rels/.rels": links(("r1", "officeDocument", "ppt/presentation.xml"))}
    ids = "".join(f'<p:sldId id="{255 + n}" r:id="s{n}"/>' for n in range(1, len(slides) + 1))
    out["ppt/presentation.xml"] = f"<p:presentation {SLIDE}><p:sldIdLst>{ids}</p:sldIdLst>{more}</p:presentation>"
    out["ppt/_rels/presentation.xml.rels"] = links(*((f"s{n}", "slide", f"slides/slide{n}.xml") for n in range(1, len(slides) + 1)), *(own_links or []))
    for n, tree in enumerate(slides, 1):
        out[f"ppt/slides/slide{n}.xml"] = f"<p:sld {SLIDE}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        own = list((slide_links or {}).get(n, []))
        if notes and n in notes:
            own.append(("n1", "notesSlide", f"../notesSlides/notesSlide{n}.xml"))
            body = text_shape(2, "Notes", notes[n].split("\n"), more='<p:ph type="body"/>')
            out[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {SLIDE}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:notes>"
        if own:
            out[f"ppt/slides/_rels/slide{n}.xml.rels"] = links(*own)
    return package({**out, **(parts or {})})


def make_files(rows: DataFrame, keys: list[str], order: list[str], build: Callable[[list[dict]], bytes], name: str) -> DataFrame:
    """(path, content): one file for each group of rows, built by the task that has them, in their order.

    ``name`` is a pattern of the keys (``book-{k}.xlsx``). A group is one file's
    rows and has to fit in a task, as the file itself has.
    """
    others = [c for c in rows.columns if c not in order]
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                path = name.format(**{k: row[k] for k in keys})
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([build(row["held"])], pa.binary())], names=["path", "content"])

    return grouped.mapInArrow(run, "path string, content binary")
