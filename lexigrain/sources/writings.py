"""Word documents and presentations: blocks, table cells, notes, slides, shapes."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lexigrain.functions.equations import MATH, to_latex
from lexigrain.functions.numbering import auto_number, fill_template
from lexigrain.functions.text_marks import symbol
from lexigrain.sources.package import Package, R

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


# Prefixes of extensions whose content is read, so that their branch of a compatibility block counts.
KNOWN_PREFIXES = frozenset("wps wpg wpc wpi w14 w15 w16 w16se a14 p14 p15 x14 x15 cx cx1 m a p w r v".split())
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"


def branch(node: ET.Element) -> ET.Element | None:
    """Of a compatibility block the first choice whose requirements are all known, else the fallback."""
    for choice in node.findall(MC + "Choice"):
        needs = choice.get("Requires", "").split()
        if needs and all(n in KNOWN_PREFIXES for n in needs):
            return choice
    return node.find(MC + "Fallback")


def below(node: ET.Element) -> Iterator[ET.Element]:
    """All nodes below one, the branches of compatibility blocks chosen."""
    for child in node:
        if child.tag == MC + "AlternateContent":
            chosen = branch(child)
            if chosen is not None:
                yield from below(chosen)
            continue
        yield child
        yield from below(child)


def _val(node: ET.Element | None, path: str, default: str | None = None) -> str | None:
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return default if found is None else found.get(W + "val", default)


class Writing:
    """A word document. ``view``: of its revisions, final (without deletions) or original (without insertions)."""

    def __init__(self, package: Package, view: str = "final"):
        self.package, self.part = package, package.main_part()
        self.dropped = {"final": {W + "del", W + "moveFrom"}, "original": {W + "ins", W + "moveTo"}, "review": set()}[view]
        self.styles = self._styles()
        self.levels = self._levels()
        self.counters: dict[str, list[int]] = {}

    def _part(self, kind: str) -> ET.Element | None:
        found = self.package.linked(self.part, kind)
        return self.package.xml(found[0].resolved) if found else None

    def _styles(self) -> dict[str, dict]:
        """Each style's outline level and numbering, its own or the next base style's."""
        root = self._part("styles")
        own = {}
        for e in root.findall(W + "style") if root is not None else ():
            props = e.find(W + "pPr")
            own[e.get(W + "styleId", "")] = {"base": _val(e, "basedOn"), "outline": _val(props, "outlineLvl"), "num": _val(props, "numPr/numId"), "level": _val(props, "numPr/ilvl")}
        out = {}
        for name in own:
            got, at, seen = {"outline": None, "num": None, "level": None}, name, set()
            while at in own and at not in seen:
                seen.add(at)
                got = {k: v if v is not None else own[at][k] for k, v in got.items()}
                at = own[at]["base"]
            out[name] = got
        return out

    def _levels(self) -> dict[str, dict[int, tuple[str, str, int]]]:
        """For each list its levels: format, template, start."""
        root = self._part("numbering")
        if root is None:
            return {}
        abstract = {}
        for e in root.findall(W + "abstractNum"):
            abstract[e.get(W + "abstractNumId")] = {int(l.get(W + "ilvl", 0)): (_val(l, "numFmt", "decimal"), _val(l, "lvlText", ""), int(_val(l, "start", "1"))) for l in e.findall(W + "lvl")}
        out = {}
        for e in root.findall(W + "num"):
            levels = dict(abstract.get(_val(e, "abstractNumId"), {}))
            for o in e.findall(W + "lvlOverride"):
                k = int(o.get(W + "ilvl", 0))
                if (start := _val(o, "startOverride")) is not None and k in levels:
                    levels[k] = (*levels[k][:2], int(start))
            out[e.get(W + "numId")] = levels
        return out

    def text(self, node: ET.Element) -> Iterator[str]:
        """Pieces of text below a node in the chosen view; a form feed is a page break."""
        for child in node:
            if child.tag in self.dropped:
                continue
            if child.tag == MC + "AlternateContent":
                if (chosen := branch(child)) is not None:
                    yield from self.text(chosen)
            elif child.tag in (W + "t", W + "delText"):
                yield child.text or ""
            elif child.tag == W + "tab":
                yield "\t"
            elif child.tag in (W + "br", W + "cr"):
                yield "\f" if child.get(W + "type") == "page" else "\n"
            elif child.tag == W + "lastRenderedPageBreak":
                yield "\f"
            elif child.tag == W + "noBreakHyphen":
                yield "-"
            elif child.tag == W + "sym":
                yield symbol(child.get(W + "font", ""), int(child.get(W + "char", "0"), 16))
            elif child.tag == W + "ruby":
                base = child.find(W + "rubyBase")
                yield from self.text(base) if base is not None else ()
            elif child.tag == MATH + "oMath":
                yield f"${to_latex(ET.tostring(child, 'unicode'))}$"
            elif child.tag == W + "footnoteReference":
                yield f"[fn{child.get(W + 'id')}]"
            elif child.tag == W + "endnoteReference":
                yield f"[en{child.get(W + 'id')}]"
            elif child.tag not in (W + "pPr", W + "rPr", W + "instrText", W + "tbl", W + "txbxContent", W + "sdtPr"):
                yield from self.text(child)

    def flow(self, node: ET.Element) -> Iterator[ET.Element]:
        """Paragraphs and tables below a story, through content controls, custom markup, revisions and compatibility blocks."""
        for child in node:
            if child.tag in self.dropped:
                continue
            if child.tag in (W + "p", W + "tbl"):
                yield child
            elif child.tag == MC + "AlternateContent":
                if (chosen := branch(child)) is not None:
                    yield from self.flow(chosen)
            elif child.tag in (W + "sdt", W + "sdtContent", W + "customXml", W + "smartTag", W + "ins", W + "moveTo", W + "del", W + "moveFrom"):
                yield from self.flow(child)

    def story(self, node: ET.Element) -> str:
        """The text of a container's paragraphs and tables, nested ones too, a line for each paragraph or row."""
        lines = []
        for block in self.flow(node):
            if block.tag == W + "p":
                lines.append("".join(self.text(block)).replace("\f", ""))
            else:
                lines += ["\t".join(c["text"] for c in row) for row in self._rows(block)]
        return "\n".join(lines)

    def tables(self) -> Iterator[ET.Element]:
        body = self.package.xml(self.part).find(W + "body")
        yield from (b for b in self.flow(body) if b.tag == W + "tbl") if body is not None else ()

    def _label(self, num: str, level: int) -> str:
        levels = self.levels.get(num, {})
        if level not in levels:
            return ""
        counts = self.counters.setdefault(num, [])
        while len(counts) <= level:
            counts.append(levels.get(len(counts), ("decimal", "", 1))[2] - 1)
        counts[level] += 1
        del counts[level + 1 :]
        shown = [max(n, levels.get(k, ("", "", 1))[2]) for k, n in enumerate(counts)]
        return "•" if levels[level][0] == "bullet" else fill_template(levels[level][1], shown, [levels.get(k, ("decimal",))[0] for k in range(level + 1)])

    def paragraph(self, node: ET.Element) -> dict:
        props = node.find(W + "pPr")
        style = _val(props, "pStyle") or ""
        inherited = self.styles.get(style, {})
        outline = _val(props, "outlineLvl") or inherited.get("outline")
        num, level = _val(props, "numPr/numId") or inherited.get("num"), int(_val(props, "numPr/ilvl") or inherited.get("level") or 0)
        heading = outline is not None and outline.isdigit() and int(outline) <= 8
        return {"type": "heading" if heading else "paragraph", "level": int(outline) + 1 if heading else None, "style_id": style or None, "text": "".join(self.text(node)), "label": self._label(num, level) if num and num != "0" else None, "list_level": level if num and num != "0" else None}

    def blocks(self) -> Iterator[dict]:
        """Paragraphs, headings and tables of the body in order, with the page that each starts and ends on."""
        body, page, n, table = self.package.xml(self.part).find(W + "body"), 1, 0, 0
        section = 1
        for node in self.flow(body) if body is not None else ():
            if node.tag == W + "p":
                block = self.paragraph(node)
                if (before := node.find(f"{W}pPr/{W}pageBreakBefore")) is not None and before.get(W + "val", "1") not in ("0", "false"):
                    page += 1
                lead = len(block["text"]) - len(block["text"].lstrip("\f"))
                start = page + lead
                page += block["text"].count("\f")
                block["text"] = block["text"].replace("\f", "")
                if block["text"].strip():
                    yield {"ord": n, **block, "page": start, "page_end": page, "table_id": None, "section": section}
                    n += 1
                if (mark := node.find(f"{W}pPr/{W}sectPr")) is not None:
                    section += 1
                    # a section that goes on on the same page breaks none
                    page += _val(mark, "type", "nextPage") != "continuous"
            elif node.tag == W + "tbl":
                rows = ["\t".join(c["text"] for c in row) for row in self._rows(node)]
                yield {"ord": n, "type": "table", "level": None, "style_id": None, "text": "\n".join(rows), "label": None, "list_level": None, "page": page, "page_end": page, "table_id": f"table-{table}", "section": section}
                table, n = table + 1, n + 1

    def _rows(self, table: ET.Element) -> Iterator[list[dict]]:
        found = [x for x in below(table) if x.tag == W + "tr"] if table.find(W + "sdt") is not None else table.findall(W + "tr")
        for r, row in enumerate(found):
            header = row.find(f"{W}trPr/{W}tblHeader") is not None
            column, cells = int(_val(row.find(W + "trPr"), "gridBefore", "0")), []
            for c in [x for e in row for x in ([e] if e.tag == W + "tc" else e.findall(f"{W}sdtContent/{W}tc"))]:
                props = c.find(W + "tcPr")
                merge = props.find(W + "vMerge") if props is not None else None
                span = int(_val(props, "gridSpan", "1"))
                text = self.story(c)
                cells.append({"row": r, "col": column, "col_span": span, "row_span": 1, "v_merge": None if merge is None else merge.get(W + "val", "continue"), "is_header": header, "text": text})
                column += span
            yield cells

    def table_cells(self) -> Iterator[dict]:
        """Cells of the body's tables on their grid; cells merged downwards once, with how many rows they span."""
        for t, table in enumerate(self.tables()):
            open_: dict[int, dict] = {}
            out = []
            for cells in self._rows(table):
                for c in cells:
                    if c["v_merge"] == "continue" and c["col"] in open_:
                        open_[c["col"]]["row_span"] += 1
                        continue
                    open_.pop(c["col"], None)
                    if c["v_merge"] == "restart":
                        open_[c["col"]] = c
                    out.append(c)
            yield from ({"table_id": f"table-{t}", **c} for c in out)

    def notes(self) -> Iterator[dict]:
        """Footnotes, endnotes and comments, headers and footers."""
        for kind, tag in (("footnotes", "footnote"), ("endnotes", "endnote"), ("comments", "comment"), ("header", None), ("footer", None)):
            for r in self.package.linked(self.part, kind):
                root = self.package.xml(r.resolved)
                if root is None:
                    continue
                for e in root.findall(W + tag) if tag else [root]:
                    if e.get(W + "type") in ("separator", "continuationSeparator"):
                        continue
                    text = self.story(e)
                    yield {"kind": tag or kind, "id": e.get(W + "id") or r.id, "text": text, "author": e.get(W + "author"), "date": e.get(W + "date")}


class Deck:
    """A presentation: its slides in the order of the deck."""

    def __init__(self, package: Package):
        self.package, self.part = package, package.main_part()
        root = package.xml(self.part)
        found = [package.link(self.part, e.get(R + "id")) for e in root.iterfind(f"{P}sldIdLst/{P}sldId")]
        self.parts = [r.resolved for r in found if r is not None and r.resolved in package.names]

    @staticmethod
    def _text(body: ET.Element | None) -> str:
        counts: dict[tuple[str, int], int] = {}
        lines = []
        for p in body.findall(A + "p") if body is not None else ():
            props = p.find(A + "pPr")
            level = int(props.get("lvl", 0)) if props is not None else 0
            auto = props.find(A + "buAutoNum") if props is not None else None
            text = "".join("\n" if e.tag == A + "br" else e.findtext(A + "t") or "" for e in p if e.tag in (A + "r", A + "br", A + "fld"))
            if auto is not None and text:
                key = (auto.get("type", "arabicPeriod"), level)
                counts[key] = counts.get(key, int(auto.get("startAt", 1)) - 1) + 1
                text = f"{auto_number(counts[key], key[0])} {text}"
            counts = {k: n for k, n in counts.items() if k[1] <= level}
            lines.append(text)
        return "\n".join(lines).strip("\n")

    def slides(self) -> Iterator[dict]:
        for n, part in enumerate(self.parts, 1):
            root = self.package.xml(part)
            notes = []
            for r in self.package.linked(part, "notesSlide"):
                page = self.package.xml(r.resolved)
                for shape in page.iter(P + "sp") if page is not None else ():
                    holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    if holder is not None and holder.get("type") == "body":
                        notes.append(self._text(shape.find(P + "txBody")))
            yield {"n": n, "hidden": root.get("show", "1") in ("0", "false"), "part": part, "notes": "\n".join(notes) or None}

    def shapes(self) -> Iterator[dict]:
        """Shapes with text, tables (tab-separated) and pictures, in drawing order."""
        for n, part in enumerate(self.parts, 1):
            at = 0
            for e in self.package.xml(part).iter():
                kind = {P + "sp": "text", P + "pic": "picture", P + "graphicFrame": "frame", P + "cxnSp": "connector"}.get(e.tag)
                if not kind:
                    continue
                text = self._text(e.find(P + "txBody"))
                table = next(e.iter(A + "tbl"), None)
                if table is not None:
                    kind, text = "table", "\n".join("\t".join(self._text(c.find(A + "txBody")) for c in r.findall(A + "tc")) for r in table.findall(A + "tr"))
                about, place = next(e.iter(P + "cNvPr"), None), next((x for x in e.iter() if x.tag in (A + "xfrm", P + "xfrm")), None)
                offset, size = (place.find(A + "off"), place.find(A + "ext")) if place is not None else (None, None)
                number = lambda node, name: int(node.get(name)) if node is not None and re.fullmatch(r"-?\d+", node.get(name, "")) else None
                yield {"n": n, "ord": at, "shape_id": about.get("id") if about is not None else None, "name": about.get("name") if about is not None else None, "type": kind, "text": text, "x": number(offset, "x"), "y": number(offset, "y"), "w": number(size, "cx"), "h": number(size, "cy")}
                at += 1
