"""Parts of a word document beside its blocks: runs, styles, controls, bookmarks, drawings, assets, sections."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lexigrain.functions.colors import word_color
from lexigrain.functions.text_marks import field
from lexigrain.sources.package import Package, R
from lexigrain.sources.workbooks import lenient_flag, lenient_number, theme_colors
from lexigrain.sources.writings import MC, A, W, Writing, _val, below, branch

# Toggles of run formats, and kinds of content controls.
TOGGLES = {"b": "bold", "i": "italic", "strike": "strike", "dstrike": "double_strike", "caps": "caps", "smallCaps": "small_caps", "vanish": "hidden"}
CONTROL_KINDS = {"checkbox": "checkbox", "dropDownList": "dropdown", "comboBox": "combobox", "date": "date", "picture": "picture", "text": "text", "richText": "rich_text", "group": "group", "docPartList": "gallery", "docPartObj": "gallery", "equation": "equation", "citation": "citation", "bibliography": "bibliography"}
V = "{urn:schemas-microsoft-com:vml}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"


def local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def run_format(props: ET.Element | None, theme: dict[str, str]) -> dict[str, str]:
    """The properties that a run states itself, `false` ones too."""
    out: dict[str, str] = {}
    for e in props if props is not None else ():
        name = local(e)
        if name in TOGGLES:
            out[TOGGLES[name]] = str(lenient_flag(e.get(W + "val"), True)).lower()
        elif name == "u":
            out["underline"] = str(e.get(W + "val", "single") != "none").lower()
        elif name == "vertAlign" and e.get(W + "val") in ("superscript", "subscript"):
            out[e.get(W + "val")] = "true"
        elif name == "color":
            if found := word_color(e.get(W + "val"), e.get(W + "themeColor"), e.get(W + "themeTint"), e.get(W + "themeShade"), theme):
                out["color"] = found
        elif name == "highlight" and e.get(W + "val", "none") != "none":
            out["highlight"] = e.get(W + "val", "")
        elif name == "shd" and (found := word_color(e.get(W + "fill"), e.get(W + "themeFill"), e.get(W + "themeFillTint"), e.get(W + "themeFillShade"), theme)):
            out["shading"] = found
        elif name == "rStyle":
            out["style"] = e.get(W + "val", "")
    return out


def theme(package: Package, part: str) -> dict[str, str]:
    for r in package.linked(part, "theme"):
        root = package.xml(r.resolved)
        if root is not None:
            return theme_colors(root)
    return {}


def runs(package: Package) -> Iterator[dict]:
    """Runs of the body's paragraphs in order, with their own formats, links, fields, rubies and revisions.

    ``block`` counts paragraphs with text as ``docx_blocks`` does for those outside
    tables; ``paragraph`` counts all.
    """
    doc = Writing(package, "review")
    scheme = theme(package, doc.part)
    body = package.xml(doc.part).find(W + "body")
    for number, p in enumerate(x for x in doc.flow(body) if x.tag == W + "p") if body is not None else ():
        state = {"stack": [], "n": 0}
        yield from _runs(doc, p, number, scheme, {}, state)


def _runs(doc: Writing, node: ET.Element, paragraph: int, scheme: dict, given: dict, state: dict) -> Iterator[dict]:
    for e in node:
        if e.tag == MC + "AlternateContent":
            chosen = branch(e)
            if chosen is not None:
                yield from _runs(doc, chosen, paragraph, scheme, given, state)
        elif e.tag == W + "hyperlink":
            link = doc.package.link(doc.part, e.get(R + "id"))
            own = {"kind": "hyperlink", "href": link.target if link else "", "anchor": e.get(W + "anchor", "")}
            yield from _runs(doc, e, paragraph, scheme, {**given, "link": {k: v for k, v in own.items() if v}}, state)
        elif e.tag == W + "fldSimple":
            yield from _runs(doc, e, paragraph, scheme, {**given, "link": _field(e.get(W + "instr", ""))}, state)
        elif e.tag in (W + "ins", W + "del", W + "moveTo", W + "moveFrom"):
            kind = "insertion" if e.tag in (W + "ins", W + "moveTo") else "deletion"
            yield from _runs(doc, e, paragraph, scheme, {**given, "revision": kind, "author": e.get(W + "author")}, state)
        elif e.tag == W + "r":
            for part in e:
                if part.tag == W + "fldChar":
                    kind = part.get(W + "fldCharType")
                    if kind == "begin":
                        state["stack"].append({"text": "", "link": None, "shown": False})
                    elif state["stack"] and kind == "separate":
                        state["stack"][-1] |= {"shown": True, "link": _field(state["stack"][-1]["text"])}
                    elif state["stack"] and kind == "end":
                        state["stack"].pop()
                elif part.tag == W + "instrText" and state["stack"]:
                    state["stack"][-1]["text"] += part.text or ""
            ruby = next((x for x in e if x.tag == W + "ruby"), None)
            text = "".join(doc.text(e)).replace("\f", "")
            if text and not (state["stack"] and not state["stack"][-1]["shown"]):
                top = next((f["link"] for f in reversed(state["stack"]) if f["link"]), None)
                note = "".join(doc.text(ruby.find(W + "rt"))) if ruby is not None and ruby.find(W + "rt") is not None else None
                link = given.get("link") or top
                yield {"paragraph": paragraph, "ord": state["n"], "text": text, "format": sorted(run_format(e.find(W + "rPr"), scheme).items()), "link": sorted(link.items()) if link else None, "ruby": note, "revision": given.get("revision"), "author": given.get("author")}
                state["n"] += 1
        elif e.tag in (W + "sdt", W + "sdtContent", W + "smartTag", W + "customXml"):
            yield from _runs(doc, e, paragraph, scheme, given, state)


def _field(instruction: str) -> dict[str, str] | None:
    try:
        return field(instruction)
    except ValueError:
        return None


def styles(package: Package) -> Iterator[dict]:
    """Styles as they are declared: type, base, own run format, outline, list."""
    doc = Writing(package)
    scheme, root = theme(package, doc.part), doc._part("styles")
    for e in root.findall(W + "style") if root is not None else ():
        yield {"style_id": e.get(W + "styleId", ""), "type": e.get(W + "type", "paragraph"), "name": _val(e, "name"), "base": _val(e, "basedOn"), "default": lenient_flag(e.get(W + "default")), "outline": lenient_number(_val(e.find(W + "pPr"), "outlineLvl"), None), "num_id": _val(e.find(W + "pPr"), "numPr/numId"), "format": sorted(run_format(e.find(W + "rPr"), scheme).items())}
        for region in e.findall(W + "tblStylePr"):
            yield {"style_id": e.get(W + "styleId", ""), "type": "table:" + region.get(W + "type", ""), "name": None, "base": None, "default": False, "outline": None, "num_id": None, "format": sorted(run_format(region.find(W + "rPr"), scheme).items())}


def controls(package: Package) -> Iterator[dict]:
    """Content controls in document order: kind, label, lock, options, whether checked, text."""
    doc = Writing(package)
    root = package.xml(doc.part)
    for n, e in enumerate(x for x in below(root) if x.tag == W + "sdt"):
        props, inside = e.find(W + "sdtPr"), e.find(W + "sdtContent")
        kind = next((CONTROL_KINDS[local(x)] for x in props if local(x) in CONTROL_KINDS), "rich_text") if props is not None else "rich_text"
        box = next((x for x in props if local(x) == "checkbox"), None) if props is not None else None
        state = next((x for x in box if local(x) == "checked"), None) if box is not None else None
        items = [x.get(W + "displayText") or x.get(W + "value", "") for x in props.iter(W + "listItem")] if props is not None else []
        text = "".join(doc.text(inside)) if inside is not None else ""
        if inside is not None and inside.find(W + "p") is not None:
            text = doc.story(inside)
        checked = None if box is None else next((lenient_flag(v) for k, v in (state.attrib.items() if state is not None else ()) if k.endswith("}val")), False)
        yield {"ord": n, "kind": kind, "label": _val(props, "alias") or _val(props, "tag"), "lock": _val(props, "lock"), "options": items, "checked": checked, "text": text}


def bookmarks(package: Package) -> Iterator[dict]:
    """Bookmarks by the paragraph that they begin in."""
    doc = Writing(package)
    body = package.xml(doc.part).find(W + "body")
    for number, p in enumerate(x for x in doc.flow(body) if x.tag == W + "p") if body is not None else ():
        for e in p.iter(W + "bookmarkStart"):
            yield {"paragraph": number, "id": e.get(W + "id"), "name": e.get(W + "name", "")}


def objects(package: Package) -> Iterator[dict]:
    """Drawings, charts, diagrams, text boxes, embedded objects and pictures of the older markup, by paragraph, with the parts they show."""
    doc, n = Writing(package), 0
    body = package.xml(doc.part).find(W + "body")
    for number, p in enumerate(x for x in doc.flow(body) if x.tag == W + "p") if body is not None else ():
        for e in below(p):
            if e.tag not in (W + "drawing", W + "pict", W + "object"):
                continue
            about = next((x for x in e.iter() if x.tag == WP + "docPr"), None)
            floating = e.find(WP + "anchor") is not None
            chart = next((x.get(R + "id") for x in e.iter(C + "chart")), None)
            diagram = next((x.get(R + "dm") for x in e.iter(D + "relIds")), None)
            image = next((x.get(R + "embed") or x.get(R + "link") for x in e.iter(A + "blip")), None) or next((x.get(R + "id") for x in e.iter(V + "imagedata")), None)
            story = next(e.iter(W + "txbxContent"), None)
            embedded = next((x.get("ProgID") for x in e.iter() if local(x) == "OLEObject"), None)
            kind, rel = ("chart", chart) if chart else ("diagram", diagram) if diagram else ("embedded", image) if embedded else ("textbox", None) if story is not None else ("image", image) if image else ("shape", None)
            link = package.link(doc.part, rel) if rel else None
            yield {"paragraph": number, "ord": n, "kind": kind, "rel_id": rel, "target": link.resolved if link and not link.external else None, "external": link.target if link and link.external else None, "name": about.get("name") if about is not None else None, "alt": about.get("descr") if about is not None else None, "floating": floating, "program": embedded, "text": doc.story(story) if story is not None else None}
            n += 1


def sections(package: Package) -> Iterator[dict]:
    """Sections in order: how each begins, and its page size."""
    doc = Writing(package)
    body = package.xml(doc.part).find(W + "body")
    found = [x for x in body.iter(W + "sectPr")] if body is not None else []
    for n, e in enumerate(found, 1):
        size = e.find(W + "pgSz")
        yield {"section": n, "type": _val(e, "type", "nextPage"), "width": lenient_number(size.get(W + "w"), None) if size is not None else None, "height": lenient_number(size.get(W + "h"), None) if size is not None else None}
