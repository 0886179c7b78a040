"""Parts of a presentation beside its shapes' texts: runs, table cells, comments, sections, links, geometry, inheritance, themes."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lexigrain.functions.colors import THEME, resolve
from lexigrain.functions.numbering import auto_number
from lexigrain.functions.text_marks import symbol
from lexigrain.sources.package import Package, R
from lexigrain.sources.workbooks import lenient_flag, lenient_number, theme_colors
from lexigrain.sources.writings import MC, A, Deck, P, branch

C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
KINDS = {P + "sp": "text", P + "pic": "picture", P + "graphicFrame": "frame", P + "cxnSp": "connector", P + "grpSp": "group"}


def local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def shapes(tree: ET.Element | None, path: tuple = ()) -> Iterator[tuple[ET.Element, tuple]]:
    """(shape, the groups around it, outermost first) in drawing order, compatibility branches chosen."""
    for e in tree if tree is not None else ():
        if e.tag == MC + "AlternateContent":
            chosen = branch(e)
            if chosen is not None:
                yield from shapes(chosen, path)
        elif e.tag in KINDS:
            yield e, path
            if e.tag == P + "grpSp":
                yield from shapes(e, (*path, e))


def _tree(root: ET.Element | None) -> ET.Element | None:
    return root.find(f"{P}cSld/{P}spTree") if root is not None else None


def _slides(package: Package) -> Iterator[tuple[int, str, ET.Element]]:
    for n, part in enumerate(Deck(package).parts, 1):
        yield n, part, package.xml(part)


def _numbered(package: Package) -> Iterator[tuple[int, str, int, ET.Element]]:
    """(slide, its part, number of the shape as ``pptx_shapes`` counts, shape), groups aside."""
    for n, part, root in _slides(package):
        at = 0
        for e, _ in shapes(_tree(root)):
            if e.tag != P + "grpSp":
                yield n, part, at, e
                at += 1


def paragraphs(package: Package) -> Iterator[dict]:
    """Paragraphs of text shapes with the label of their list; numbers go on while level and scheme stay."""
    for n, _, at, shape in _numbered(package):
        counts: dict[tuple[str, int], int] = {}
        for k, p in enumerate(shape.findall(f"{P}txBody/{A}p")):
            props = p.find(A + "pPr")
            level = lenient_number(props.get("lvl"), 0) if props is not None else 0
            auto, bullet = (props.find(A + "buAutoNum"), props.find(A + "buChar")) if props is not None else (None, None)
            text = "".join("\n" if e.tag == A + "br" else e.findtext(A + "t") or "" for e in p if e.tag in (A + "r", A + "br", A + "fld"))
            label = None
            if auto is not None and text:
                key = (auto.get("type", "arabicPeriod"), level)
                counts[key] = counts.get(key, lenient_number(auto.get("startAt"), 1) - 1) + 1
                label = auto_number(counts[key], key[0])
            elif bullet is not None and text:
                font = props.find(A + "buFont")
                char = bullet.get("char", "•")
                label = symbol(font.get("typeface", ""), ord(char)) if font is not None and len(char) == 1 and font.get("typeface", "").lower().startswith(("symbol", "wingdings")) else char
            counts = {x: c for x, c in counts.items() if x[1] <= level}
            yield {"n": n, "shape": at, "ord": k, "level": level, "text": text, "label": label}


def run_format(props: ET.Element | None, scheme: dict[str, str]) -> dict[str, str]:
    """What a run says of itself: resets (`false`) are kept."""
    out: dict[str, str] = {}
    if props is None:
        return out
    for name, key in (("b", "bold"), ("i", "italic")):
        if props.get(name) is not None:
            out[key] = str(lenient_flag(props.get(name))).lower()
    if props.get("u") is not None:
        out["underline"] = str(props.get("u") != "none").lower()
    if props.get("strike") is not None:
        out["strike"] = str(props.get("strike") != "noStrike").lower()
    if (base := lenient_number(props.get("baseline"), 0)) != 0:
        out["superscript" if base > 0 else "subscript"] = "true"
    for tag, key in ((A + "solidFill", "color"), (A + "highlight", "highlight")):
        box = props.find(tag)
        if box is not None and len(box) and (found := drawing_color(box[0], scheme)):
            out[key] = found
    return out


def drawing_color(e: ET.Element, scheme: dict[str, str]) -> str | None:
    """`#RRGGBB` of a color element with its adjustments."""
    steps = [(local(x), (lenient_number(x.get("val"), 0) or 0) / (21_600_000 if local(x).startswith("hue") and local(x) != "hueMod" else 100_000)) for x in e]
    kind = local(e).removesuffix("Clr")
    value = {"srgb": e.get("val"), "scheme": e.get("val"), "prst": e.get("val"), "sys": e.get("lastClr")}.get(kind)
    return resolve("preset" if kind == "prst" else kind, value or "", steps, scheme)


def _theme(package: Package, part: str) -> dict[str, str]:
    """The color slots of a slide, by its layout and master; the usual ones where there is no theme."""
    at = part
    for kind in ("slideLayout", "slideMaster", "theme"):
        found = package.linked(at, kind)
        if not found:
            return dict(THEME)
        at = found[0].resolved
    root = package.xml(at)
    return {**THEME, **theme_colors(root)} if root is not None else dict(THEME)


def themes(package: Package) -> Iterator[dict]:
    for n, part, _ in _slides(package):
        yield from ({"n": n, "slot": k, "color": "#" + v} for k, v in sorted(_theme(package, part).items()))


def runs(package: Package) -> Iterator[dict]:
    """Runs of text shapes with their own format and link."""
    for n, part, at, shape in _numbered(package):
        scheme = _theme(package, part)
        for k, p in enumerate(shape.findall(f"{P}txBody/{A}p")):
            for j, e in enumerate(x for x in p if x.tag in (A + "r", A + "fld")):
                props = e.find(A + "rPr")
                click = props.find(A + "hlinkClick") if props is not None else None
                link = package.link(part, click.get(R + "id")) if click is not None else None
                yield {"n": n, "shape": at, "paragraph": k, "ord": j, "text": e.findtext(A + "t") or "", "format": sorted(run_format(props, scheme).items()), "href": (link.target if link.external else link.resolved) if link else None}


def table_cells(package: Package) -> Iterator[dict]:
    """Cells as the file has them, continued ones marked."""
    for n, _, at, shape in _numbered(package):
        for table in shape.iter(A + "tbl"):
            for r, row in enumerate(table.findall(A + "tr")):
                for c, cell in enumerate(row.findall(A + "tc")):
                    yield {"n": n, "shape": at, "row": r, "col": c, "text": Deck._text(cell.find(A + "txBody")), "row_span": lenient_number(cell.get("rowSpan"), 1), "col_span": lenient_number(cell.get("gridSpan"), 1), "h_merge": lenient_flag(cell.get("hMerge")), "v_merge": lenient_flag(cell.get("vMerge"))}


def comments(package: Package) -> Iterator[dict]:
    """Classic and modern comments by slide, replies after what they answer."""
    authors = {}
    for name in sorted(x for x in package.names if x.rsplit("/", 1)[-1] in ("commentAuthors.xml", "authors.xml")):
        root = package.xml(name)
        authors |= {e.get("id"): e.get("name") for e in root.iter() if e.get("id") and e.get("name")}
    n_all = 0
    for n, part, _ in _slides(package):
        for r in package.linked(part, "comments"):
            root = package.xml(r.resolved)
            for e in root.iter() if root is not None else ():
                if local(e) not in ("cm", "reply"):
                    continue
                body = next((x for x in e if local(x) in ("text", "txBody")), None)
                text = (body.text or "") if body is not None and local(body) == "text" else "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in body.iter(A + "p")) if body is not None else ""
                parent = next((x.get("id") for x in root.iter() if local(x) == "cm" and any(y is e for y in x.iter() if local(y) == "reply")), None) if local(e) == "reply" else next((x.get("parentCmId") or x.get("parentIdx") for x in e.iter() if local(x) == "parentCm" or x.get("parentIdx")), None)
                place = next((x.get("id") for x in e.iter() if local(x) in ("spMk", "deMkLst") and x.get("id")), None)
                status = {"resolved": "resolved", "active": "active", "closed": "resolved"}.get(e.get("status", ""), "unknown")
                yield {"ord": n_all, "n": n, "id": e.get("id") or f"{e.get('authorId', '')}-{e.get('idx', n_all)}", "parent_id": parent, "author": authors.get(e.get("authorId")), "date": e.get("dt") or e.get("created"), "status": status, "shape_id": place, "text": text}
                n_all += 1


def sections(package: Package) -> Iterator[dict]:
    """Sections of the deck with their slides, in order."""
    deck = Deck(package)
    root = package.xml(deck.part)
    numbers = {}
    for e in root.iterfind(f"{P}sldIdLst/{P}sldId"):
        link = package.link(deck.part, e.get(R + "id"))
        if link is not None and link.resolved in deck.parts:
            numbers[e.get("id")] = deck.parts.index(link.resolved) + 1
    at = 0
    for e in root.iter():
        if local(e) == "section":
            for x in e.iter():
                if local(x) == "sldId":
                    yield {"ord": at, "name": e.get("name", ""), "slide_id": x.get("id"), "n": numbers.get(x.get("id"))}
                    at += 1


def links(package: Package) -> Iterator[dict]:
    """What shapes and runs lead to, as it stands in the file."""
    for n, part, root in _slides(package):
        for e, _ in shapes(_tree(root)):
            if e.tag == P + "grpSp":
                continue
            about = next((x for x in e.iter(P + "cNvPr")), None)
            for click in e.iter(A + "hlinkClick"):
                link = package.link(part, click.get(R + "id"))
                yield {"n": n, "shape_id": about.get("id") if about is not None else None, "action": click.get("action"), "target": (link.target if link.external else link.resolved) if link else None, "external": link.external if link else False}


def _place(node: ET.Element | None) -> dict:
    spot = node.find(A + "off") if node is not None else None
    size = node.find(A + "ext") if node is not None else None
    got = lambda e, k: lenient_number(e.get(k), None) if e is not None else None
    return {"x": got(spot, "x"), "y": got(spot, "y"), "w": got(size, "cx"), "h": got(size, "cy")}


def _frame(e: ET.Element) -> ET.Element | None:
    return next((x for box in e for x in ([box] if box.tag == P + "xfrm" else box.findall(A + "xfrm")) if local(box) in ("spPr", "grpSpPr", "xfrm")), None)


def objects(package: Package) -> Iterator[dict]:
    """All shapes with their own place, the groups around them, placeholder, part shown and ends of connectors."""
    for n, part, root in _slides(package):
        for at, (e, path) in enumerate(shapes(_tree(root))):
            about = next(e.iter(P + "cNvPr"), None)
            holder = next(e.iter(P + "ph"), None)
            chart = next((x.get(R + "id") for x in e.iter(C + "chart")), None)
            diagram = next((x.get(R + "dm") for x in e.iter(D + "relIds")), None)
            image = next((x.get(R + "embed") for x in e.iter(A + "blip")), None)
            kind = KINDS[e.tag]
            if kind == "frame":
                kind = "chart" if chart else "diagram" if diagram else "table" if next(e.iter(A + "tbl"), None) is not None else "embedded"
            if kind == "picture" and any(local(x) in ("videoFile", "audioFile", "media") for x in e.iter()):
                kind = "media"
            link = package.link(part, chart or diagram or image) if kind not in ("group", "connector") and (chart or diagram or image) else None
            groups = []
            for g in path:
                frame = g.find(f"{P}grpSpPr/{A}xfrm")
                inner = {k: None for k in ("cx", "cy", "cw", "ch")}
                if frame is not None and frame.find(A + "chOff") is not None and frame.find(A + "chExt") is not None:
                    inner = {"cx": lenient_number(frame.find(A + "chOff").get("x"), 0), "cy": lenient_number(frame.find(A + "chOff").get("y"), 0), "cw": lenient_number(frame.find(A + "chExt").get("cx"), 0), "ch": lenient_number(frame.find(A + "chExt").get("cy"), 0)}
                groups.append({**_place(frame), **inner})
            ends = [next((x.get("id") for x in e.iter(A + tag)), None) for tag in ("stCxn", "endCxn")]
            yield {"n": n, "ord": at, "shape_id": about.get("id") if about is not None else None, "kind": kind, "group_path": groups, **_place(_frame(e)), "placeholder": (holder.get("type", "obj") if holder is not None and kind != "group" else None), "placeholder_idx": holder.get("idx") if holder is not None and kind != "group" else None, "alt": about.get("descr") if about is not None else None, "target": link.resolved if link else None, "from_id": ends[0], "to_id": ends[1]}


def placeholders(package: Package) -> Iterator[dict]:
    """Places of placeholders in the layout and the master of each slide."""
    for n, part, _ in _slides(package):
        at = part
        for layer in ("slideLayout", "slideMaster"):
            found = package.linked(at, layer)
            if not found:
                break
            at = found[0].resolved
            for e, _ in shapes(_tree(package.xml(at))):
                holder = next(e.iter(P + "ph"), None) if e.tag != P + "grpSp" else None
                if holder is not None:
                    yield {"n": n, "layer": "layout" if layer == "slideLayout" else "master", "type": holder.get("type", "obj"), "idx": holder.get("idx"), **_place(_frame(e))}
