"""Workbooks: sheets, cells with displayed text, tables."""

from __future__ import annotations

import bisect
import functools
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lexigrain.functions.number_format import built_in_code, format_value
from lexigrain.functions.references import letters_of, number_of, parse_range, shift_formula
from lexigrain.sources.package import Package, R

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def escaped(text: str) -> str:
    """`_x000D_` and its like as the characters they stand for; half a pair stands for the replacement character."""
    if "_x" not in text:
        return text
    out = re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def lenient_number(text: str | None, default: int | None) -> int | None:
    """A whole number, or the default where the text is none."""
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def lenient_flag(text: str | None, default: bool = False) -> bool:
    """A boolean as the formats spell it, or the default."""
    return default if text is None else {"1": True, "true": True, "on": True, "0": False, "false": False, "off": False}.get(text.strip().lower(), default)


def plain_text(node: ET.Element) -> str:
    """Text of a string item; phonetic readings are left out."""
    out = ""
    for child in node:
        if child.tag == S + "t":
            out += child.text or ""
        elif child.tag == S + "r":
            out += "".join(t.text or "" for t in child.findall(S + "t"))
    return escaped(out)


def theme_colors(root: ET.Element) -> dict[str, str]:
    """RRGGBB of each slot of a theme part."""
    out = {}
    for scheme in root.iter(DRAWING + "clrScheme"):
        for slot in scheme:
            for color in slot:
                out[slot.tag.removeprefix(DRAWING)] = (color.get("lastClr") or color.get("val") or "").upper()
    return {k: v for k, v in out.items() if len(v) == 6}


def _range(ref: str) -> tuple[int, int, int, int] | None:
    try:
        return parse_range(ref)
    except ValueError:
        return None


class Merges:
    """Rectangles by the rows they cover: a cell asks only those that begin at or above it."""

    def __init__(self, spans):
        self.spans = sorted(spans)
        self.anchors = {(m[0], m[1]): m for m in self.spans}
        self.open: list[tuple[int, int, int, int]] = []
        self.next, self.row = 0, 0

    def covers(self, row: int, column: int) -> bool:
        if row < self.row:  # rows out of order: from the start again
            self.open, self.next = [], 0
        if row != self.row:
            self.row = row
            end = bisect.bisect_right(self.spans, (row, 1 << 30, 0, 0))
            self.open = [m for m in self.open + self.spans[self.next : end] if m[2] >= row]
            self.next = max(self.next, end)
        return any(left <= column <= right for _, left, _, right in self.open)


class Workbook:
    """One workbook's parts that cells refer to. ``locale``: whose built-in formats are shown."""

    def __init__(self, package: Package, locale: str = "en-US"):
        self.package, self.part, self.locale = package, package.main_part(), locale
        root = package.xml(self.part)
        date = root.find(S + "workbookPr")
        self.date_1904 = date is not None and lenient_flag(date.get("date1904"))
        self.sheets = []
        for n, e in enumerate(root.iterfind(f"{S}sheets/{S}sheet")):
            link = package.link(self.part, e.get(R + "id"))
            kind = "missing" if link is None or link.resolved not in package.names else link.kind
            self.sheets.append({"ord": n, "name": e.get("name", ""), "state": e.get("state", "visible"), "part": link.resolved if link else None, "kind": kind})
        self.names = [(e.get("name", ""), e.text or "", e.get("localSheetId")) for e in root.iterfind(f"{S}definedNames/{S}definedName")]

    def worksheets(self) -> list[dict]:
        return [s for s in self.sheets if s["kind"] == "worksheet"]

    @functools.cached_property
    def strings(self) -> list[str]:
        """Shared strings, read one item at a time."""
        out = []
        for r in self.package.linked(self.part, "sharedStrings"):
            for event, e in self.package.events(r.resolved):
                if event == "end" and e.tag == S + "si":
                    out.append(plain_text(e))
                    e.clear()
        return out

    @functools.cached_property
    def codes(self) -> list[str]:
        return self._codes()

    def theme(self) -> dict[str, str]:
        """Colors of the theme's slots."""
        for r in self.package.linked(self.part, "theme"):
            root = self.package.xml(r.resolved)
            if root is not None:
                return theme_colors(root)
        return {}

    def _codes(self) -> list[str]:
        """The format code of each style number."""
        found = [self.package.xml(r.resolved) for r in self.package.linked(self.part, "styles")]
        if not found or found[0] is None:
            return ["General"]
        own = {int(e.get("numFmtId", 0)): e.get("formatCode", "General") for e in found[0].iterfind(f"{S}numFmts/{S}numFmt")}
        ids = [int(e.get("numFmtId", 0)) for e in found[0].iterfind(f"{S}cellXfs/{S}xf")]
        return [own.get(i) or built_in_code(i, self.locale) for i in ids] or ["General"]

    def tail(self, sheet: dict) -> ET.Element:
        """What a sheet holds beside its rows, in one element; rows are let go as they are read."""
        out, depth = ET.Element("tail"), 0
        for event, e in self.package.events(sheet["part"] or ""):
            if event == "start":
                depth += 1
                continue
            depth -= 1
            if e.tag in (S + "row", S + "c"):
                e.clear()
            elif depth == 1 and e.tag != S + "sheetData":
                out.append(e)
        return out

    def rows(self, sheet: dict) -> Iterator[ET.Element]:
        """The sheet's rows, one at a time."""
        for event, e in self.package.events(sheet["part"] or ""):
            if event == "end" and e.tag == S + "row":
                yield e
                e.clear()

    def places(self, sheet: dict) -> Iterator[tuple[ET.Element, ET.Element, int, int]]:
        """(row, cell, row number, column): addresses that aren't given follow the ones before."""
        number = 0
        for row in self.rows(sheet):
            number, column = lenient_number(row.get("r"), number + 1), 0
            for c in row.findall(S + "c"):
                m = re.match(r"([A-Z]+)(\d+)$", c.get("r", ""))
                column = number_of(m[1]) if m else column + 1
                yield row, c, number, column

    def formulas(self, sheet: dict) -> Iterator[tuple[str, ET.Element, str | None]]:
        """(cell, its formula element, its cell metadata index)."""
        for _, c, number, column in self.places(sheet):
            f = c.find(S + "f")
            if f is not None:
                yield f"{letters_of(column)}{number}", f, c.get("cm")

    def cells(self, sheet: dict) -> Iterator[dict]:
        """The sheet's cells in the order of the file, with merges, links, comments and shared formulas resolved.

        Rows are read one at a time. Of a merge the first cell has the span, the
        others are ``shadow``. Comments and links make a cell where there is none.
        """
        if not sheet["part"]:
            return
        tail = self.tail(sheet)
        merges = Merges(m for e in tail.iterfind(f"{S}mergeCells/{S}mergeCell") if (m := _range(e.get("ref", ""))))
        links = {}
        for e in tail.iterfind(f"{S}hyperlinks/{S}hyperlink"):
            target = self.package.link(sheet["part"], e.get(R + "id"))
            links[e.get("ref", "").split(":")[0]] = (target.target if target else "") + ("#" + e.get("location") if e.get("location") else "")
        notes = self._notes(sheet["part"])
        column_style = {}
        for e in tail.iterfind(f"{S}cols/{S}col"):
            for c in range(lenient_number(e.get("min"), 1), min(lenient_number(e.get("max"), 1), 16_384) + 1):
                column_style[c] = lenient_number(e.get("style"), 0)
        shared: dict[str, tuple[str, int, int]] = {}
        seen = set()
        for row, c, number, column in self.places(sheet):
            ref = f"{letters_of(column)}{number}"
            given = c.get("s") or (row.get("s") if row.get("customFormat") in ("1", "true") else None)
            style = lenient_number(given, column_style.get(column, 0)) or 0
            text, raw, kind = self._value(c, style)
            formula = self._formula(c, shared, number, column)
            f = c.find(S + "f")
            span = merges.anchors.get((number, column))
            if ref in links or ref in notes:
                seen.add(ref)
            author, note = notes.get(ref, (None, None))
            yield {
                "sheet": sheet["name"], "row": number, "col": column, "ref": ref, "text": text, "raw": raw, "type": kind, "formula": formula,
                "formula_type": f.get("t") if f is not None else None, "formula_range": f.get("ref") if f is not None else None, "style": style,
                "rowspan": span[2] - span[0] + 1 if span else 1, "colspan": span[3] - span[1] + 1 if span else 1, "shadow": span is None and merges.covers(number, column),
                "hyperlink": links.get(ref), "comment": note, "comment_author": author, "cm": lenient_number(c.get("cm"), None), "vm": lenient_number(c.get("vm"), None),
                "blank": kind == "blank" and formula is None, "row_hidden": lenient_flag(row.get("hidden")), "outline": lenient_number(row.get("outlineLevel"), None),
            }
        for ref in sorted((links.keys() | notes.keys()) - seen):
            at = _range(ref)
            if at:
                author, note = notes.get(ref, (None, None))
                blank = dict.fromkeys(("text", "raw", "formula", "formula_type", "formula_range", "cm", "vm", "outline"))
                yield {**blank, "sheet": sheet["name"], "row": at[0], "col": at[1], "ref": ref, "type": "blank", "style": 0, "rowspan": 1, "colspan": 1, "shadow": merges.covers(at[0], at[1]) and (at[0], at[1]) not in merges.anchors, "hyperlink": links.get(ref), "comment": note, "comment_author": author, "blank": False, "row_hidden": False}

    def _value(self, c: ET.Element, style: int) -> tuple[str | None, str | None, str]:
        kind, node = c.get("t", "n"), c.find(S + "v")
        raw = None if node is None else node.text or ""
        if kind == "inlineStr":
            inline = c.find(S + "is")
            return (plain_text(inline) if inline is not None else ""), None, "string"
        if raw is None:
            return None, None, "blank"
        if kind == "s":
            at = int(raw) if raw.isdigit() else -1
            return (self.strings[at] if 0 <= at < len(self.strings) else ""), raw, "string"
        if kind == "str":
            return escaped(raw), raw, "string"
        if kind == "b":
            return ("TRUE" if raw == "1" else "FALSE"), raw, "boolean"
        if kind == "e":
            return raw, raw, "error"
        code = self.codes[style] if style < len(self.codes) else "General"
        return format_value(raw, code, self.date_1904), raw, "number"

    @staticmethod
    def _formula(c: ET.Element, shared: dict, row: int, column: int) -> str | None:
        f = c.find(S + "f")
        if f is None:
            return None
        if f.get("t") == "shared":
            if f.text:
                shared[f.get("si", "")] = (f.text, row, column)
            elif f.get("si", "") in shared:
                text, r, k = shared[f.get("si", "")]
                return shift_formula(text, row - r, column - k)
        return f.text

    def _notes(self, part: str) -> dict[str, tuple[str | None, str]]:
        """(author, text) of the comments by cell."""
        out = {}
        for r in self.package.linked(part, "comments"):
            root = self.package.xml(r.resolved)
            authors = [a.text or "" for a in root.iterfind(f"{S}authors/{S}author")] if root is not None else []
            for e in root.iterfind(f"{S}commentList/{S}comment") if root is not None else ():
                node, at = e.find(S + "text"), lenient_number(e.get("authorId"), -1)
                out[e.get("ref", "")] = (authors[at] if 0 <= at < len(authors) else None, plain_text(node) if node is not None else "")
        return out

    def tables(self) -> Iterator[dict]:
        n = 0
        for sheet in self.sheets:
            for r in self.package.linked(sheet["part"], "table") if sheet["part"] else ():
                root = self.package.xml(r.resolved)
                if root is not None:
                    yield {"id": f"table-{n}", "sheet": sheet["name"], "name": root.get("displayName", ""), "ref": root.get("ref", ""), "columns": [e.get("name", "") for e in root.iterfind(f"{S}tableColumns/{S}tableColumn")]}
                    n += 1
