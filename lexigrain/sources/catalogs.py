"""What a workbook declares beside its cells: ranges, rules, styles, pivots, drawings, threads, rich values."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lexigrain.functions.colors import spreadsheet_color
from lexigrain.functions.number_format import built_in_code
from lexigrain.functions.references import parse_range
from lexigrain.sources.package import Package, R
from lexigrain.sources.workbooks import S, Workbook, escaped, lenient_flag, lenient_number, plain_text

# Namespaces of extensions, and the kinds of rules that there are.
X14 = "{http://schemas.microsoft.com/office/spreadsheetml/2009/9/main}"
XM = "{http://schemas.microsoft.com/office/excel/2006/main}"
XDR = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
VALIDATIONS = frozenset("none whole decimal list date time textLength custom".split())
CONDITIONS = frozenset("expression cellIs colorScale dataBar iconSet top10 uniqueValues duplicateValues containsText notContainsText beginsWith endsWith containsBlanks notContainsBlanks containsErrors notContainsErrors timePeriod aboveAverage".split())
BETWEEN = ("between", "notBetween")


def local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def told(values: dict) -> list[tuple[str, str]]:
    """Attributes as sorted pairs; what isn't there is left out, booleans are lower case."""
    return sorted((k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items() if v is not None and v != "")


def _span(ref: str) -> dict:
    try:
        top, left, bottom, right = parse_range(ref)
    except ValueError:
        return {"top": None, "left": None, "bottom": None, "right": None}
    return {"top": top, "left": left, "bottom": bottom, "right": right}


def data_table_formula(f: ET.Element, master: str) -> str:
    """The TABLE text of a what-if table, which files don't hold; ValueError where its inputs or its range are unusable."""
    ref = f.get("ref", "")
    first, last = (ref.split(":") + [ref])[:2] if ref else ("", "")
    if first.replace("$", "") != master:
        raise ValueError(f"the range {ref!r} doesn't begin at {master}")
    parse_range(f"{first}:{last}")

    def given(name: str, gone: str) -> str:
        if lenient_flag(f.get(gone)):
            return "#REF!"
        if not re.fullmatch(r"\$?[A-Za-z]{1,3}\$?[1-9]\d*", f.get(name, "")):
            raise ValueError(f"no usable input {name}")
        return f.get(name, "")

    one = given("r1", "del1")
    if lenient_flag(f.get("dt2D")):
        return f"TABLE({given('r2', 'del2')},{one})"
    return f"TABLE({one},)" if lenient_flag(f.get("dtr")) else f"TABLE(,{one})"


def dynamic_arrays(package: Package, book: Workbook) -> list[bool]:
    """For each cell metadata index from 1 whether it declares a dynamic array."""
    for r in package.linked(book.part, "sheetMetadata"):
        root = package.xml(r.resolved)
        if root is None:
            continue
        types = [e.get("name") for e in root.iterfind(f"{S}metadataTypes/{S}metadataType")]
        future = [any(local(x) == "dynamicArrayProperties" and lenient_flag(x.get("fDynamic")) for x in bk.iter()) for f in root.findall(S + "futureMetadata") if f.get("name") == "XLDAPR" for bk in f.findall(S + "bk")]
        out = []
        for bk in root.iterfind(f"{S}cellMetadata/{S}bk"):
            hit = False
            for rc in bk.findall(S + "rc"):
                t, v = lenient_number(rc.get("t"), 0), lenient_number(rc.get("v"), -1)
                hit = hit or 0 < t <= len(types) and types[t - 1] == "XLDAPR" and 0 <= v < len(future) and future[v]
            out.append(hit)
        return out
    return []


def ranges(package: Package) -> Iterator[dict]:
    """Rectangles of every worksheet with what they mean: merge, spill, data_table, hyperlink, hidden_columns, column_style, protection, tables by reference."""
    book = Workbook(package)
    dynamic = dynamic_arrays(package, book)
    for sheet in book.worksheets():
        row = lambda kind, ref, **more: {"sheet": sheet["name"], "kind": kind, "ref": ref, **_span(ref), "attrs": told(more)}  # noqa: E731, B023
        tail = book.tail(sheet)
        for e in tail.iterfind(f"{S}mergeCells/{S}mergeCell"):
            yield row("merge", e.get("ref", ""))
        for e in tail.iterfind(f"{S}cols/{S}col"):
            low, high = lenient_number(e.get("min"), 1), min(lenient_number(e.get("max"), 1), 16_384)
            span = {"sheet": sheet["name"], "ref": f"{low}:{high}", "top": 1, "left": low, "bottom": 1_048_576, "right": high}
            if lenient_flag(e.get("hidden")):
                yield {**span, "kind": "hidden_columns", "attrs": []}
            if e.get("style"):
                yield {**span, "kind": "column_style", "attrs": told({"style": e.get("style")})}
        for e in tail.iterfind(f"{S}hyperlinks/{S}hyperlink"):
            link = package.link(sheet["part"], e.get(R + "id"))
            target = (link.target if link else "") + ("#" + e.get("location") if e.get("location") else "")
            yield row("hyperlink", e.get("ref", ""), target=target, tooltip=e.get("tooltip"))
        for e in tail.findall(S + "sheetProtection"):
            if lenient_flag(e.get("sheet")):
                yield {"sheet": sheet["name"], "kind": "protection", "ref": "", **_span(""), "attrs": told({k: lenient_flag(v) for k, v in e.attrib.items() if k not in ("password", "hashValue", "saltValue", "algorithmName", "spinCount")})}
        for ref, f, cm in book.formulas(sheet):
            if f.get("t") == "array" and 0 < lenient_number(cm, 0) <= len(dynamic) and dynamic[lenient_number(cm, 0) - 1]:
                yield row("spill", f.get("ref", ref), anchor=ref)
            elif f.get("t") == "dataTable":
                try:
                    yield row("data_table", f.get("ref", ref), anchor=ref, formula=data_table_formula(f, ref))
                except ValueError as problem:
                    yield row("data_table", f.get("ref", ref), anchor=ref, problem=str(problem))
    for t in book.tables():
        yield {"sheet": t["sheet"], "kind": "table", "ref": t["ref"], **_span(t["ref"]), "attrs": told({"id": t["id"], "name": t["name"]})}


# ---------------------------------------------------------------- rules


def _rule(sheet: str, kind: str, source: str, place: str, attrs: dict, ext_id: str | None = None, formulas: list[str] | None = None, unparsed: bool = False) -> dict:
    return {"sheet": sheet, "kind": kind, "source": source, "ext_id": ext_id, "ranges": place.split(), "formulas": formulas or [], "unparsed": unparsed, "attrs": told(attrs)}


def _validations(sheet: str, box: ET.Element, space: str) -> Iterator[dict]:
    source = "x14" if space == X14 else "core"
    for e in box:
        if e.tag == space + "extLst":
            continue
        if e.tag != space + "dataValidation":
            yield _rule(sheet, "validation", source, "", {}, unparsed=True)
            continue
        place = e.findtext(XM + "sqref", "") if space == X14 else e.get("sqref", "")
        kind = e.get("type", "none")
        operator = e.get("operator", "between") if kind in ("whole", "decimal", "date", "time", "textLength") else None
        formulas = []
        for name in ("formula1", "formula2"):
            node = e.find(space + name)
            formulas.append(None if node is None else node.findtext(XM + "f", "") if space == X14 else node.text or "")
        lost = kind not in VALIDATIONS or not place.strip() or kind != "none" and not formulas[0] or operator in BETWEEN and not formulas[1]
        attrs = {"type": kind, "operator": operator, **{k: lenient_flag(e.get(k)) for k in ("allowBlank", "showInputMessage", "showErrorMessage")}}
        if lenient_flag(box.get("disablePrompts")):
            attrs["showInputMessage"] = False
        attrs |= {k: escaped(e.get(k, "")) or None for k in ("promptTitle", "prompt", "errorTitle", "error")}
        attrs["errorStyle"] = None if e.get("errorStyle", "stop") == "stop" else e.get("errorStyle")
        yield _rule(sheet, "validation", source, place, attrs, None, [f for f in formulas if f is not None], lost)


def _conditions(sheet: str, box: ET.Element, space: str) -> Iterator[dict]:
    source = "x14" if space == X14 else "core"
    place = box.findtext(XM + "sqref", "") if space == X14 else box.get("sqref", "")
    for e in box:
        if e.tag in (XM + "sqref", space + "extLst"):
            continue
        if e.tag != space + "cfRule":
            yield _rule(sheet, "conditional", source, place, {}, unparsed=True)
            continue
        formulas = [f.text or "" for f in e.findall(XM + "f" if space == X14 else S + "formula")]
        ext_id = e.get("id") if space == X14 else e.findtext(f"{S}extLst/{S}ext/{X14}id")
        attrs = {k: e.get(k) for k in ("type", "priority", "dxfId", "operator", "text", "timePeriod", "rank", "stdDev")}
        attrs |= {k: lenient_flag(e.get(k), k == "aboveAverage") for k in ("stopIfTrue", "percent", "bottom", "aboveAverage", "equalAverage") if e.get(k) is not None}
        for shape in e:
            if local(shape) in ("colorScale", "dataBar", "iconSet"):
                attrs["visual"] = local(shape)
                attrs["icons"] = shape.get("iconSet")
                stops = [v.get("type", "") + ("=" + (v.get("val") or v.findtext(XM + "f", "")) if v.get("val") or v.findtext(XM + "f") else "") for v in shape if local(v) == "cfvo"]
                attrs["stops"] = ",".join(stops)
        yield _rule(sheet, "conditional", source, place, attrs, ext_id.casefold() if ext_id else None, formulas, e.get("type") is not None and e.get("type") not in CONDITIONS)


def _filters(sheet: str, box: ET.Element) -> Iterator[dict]:
    """Every form of filter, one rule each; none is evaluated."""
    place = box.get("ref", "")
    for column in box.findall(S + "filterColumn"):
        number = {"column": lenient_number(column.get("colId"), 0)}
        dates = [e for e in column.iter(S + "dateGroupItem")]
        for e in column:
            kind = local(e)
            if kind == "filters":
                values = [x.get("val") for x in e.findall(S + "filter") if x.get("val")]
                calendar = e.get("calendarType") if e.get("calendarType") != "none" else None
                if values or lenient_flag(e.get("blank")) or calendar:
                    yield _rule(sheet, "filter", "core", place, {**number, "type": "values", "blank": lenient_flag(e.get("blank")) or None, "calendarType": calendar}, None, values)
            elif kind == "customFilters":
                for n, x in enumerate(e.findall(S + "customFilter")):
                    yield _rule(sheet, "filter", "core", place, {**number, "type": "custom", "operator": x.get("operator", "equal"), "and": True if not n and lenient_flag(e.get("and")) else None}, None, [x.get("val", "")])
            elif kind == "dynamicFilter":
                yield _rule(sheet, "filter", "core", place, {**number, "type": "dynamic", "operator": e.get("type"), "value": e.get("val"), "value2": e.get("maxVal")})
            elif kind == "top10":
                yield _rule(sheet, "filter", "core", place, {**number, "type": "top10", "top": lenient_flag(e.get("top"), True), "percent": lenient_flag(e.get("percent")), "rank": e.get("val"), "filterValue": e.get("filterVal")})
            elif kind == "colorFilter":
                yield _rule(sheet, "filter", "core", place, {**number, "type": "color", "cellColor": lenient_flag(e.get("cellColor"), True), "dxfId": e.get("dxfId")})
            elif kind == "iconFilter":
                yield _rule(sheet, "filter", "core", place, {**number, "type": "icon", "iconSet": e.get("iconSet"), "iconId": e.get("iconId")})
        if dates:
            yield _rule(sheet, "filter", "core", place, {**number, "type": "dateGroup"}, None, ["-".join(d.get(k, "") for k in ("year", "month", "day") if d.get(k)) for d in dates])


def rules(package: Package) -> Iterator[dict]:
    """Validations, conditional formats and filters of every worksheet, those of the core format and of its extension."""
    book = Workbook(package)
    for sheet in book.worksheets():
        tail, n = book.tail(sheet), 0
        found = [*(x for box in tail.findall(S + "dataValidations") for x in _validations(sheet["name"], box, S)), *(x for box in tail.iter(X14 + "dataValidations") for x in _validations(sheet["name"], box, X14))]
        found += [*(x for box in tail.findall(S + "conditionalFormatting") for x in _conditions(sheet["name"], box, S)), *(x for box in tail.iter(X14 + "conditionalFormatting") for x in _conditions(sheet["name"], box, X14))]
        found += [x for box in tail.findall(S + "autoFilter") for x in _filters(sheet["name"], box)]
        for x in found:
            yield {"ord": n, **x}
            n += 1


# ---------------------------------------------------------------- styles


def styles(package: Package) -> Iterator[dict]:
    """Each cell style (and differential style) with its number format, font, fill and protection."""
    book = Workbook(package)
    for link in package.linked(book.part, "styles"):
        root = package.xml(link.resolved)
        if root is None:
            return
        codes = {lenient_number(e.get("numFmtId"), 0): e.get("formatCode", "General") for e in root.iterfind(f"{S}numFmts/{S}numFmt")}
        fonts, fills = root.findall(f"{S}fonts/{S}font"), root.findall(f"{S}fills/{S}fill")
        scheme = book.theme()
        controls = _controls(package, book)

        def font(e: ET.Element | None) -> dict:
            if e is None:
                return {}
            on = {name: True for name, tag in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("strike", "strike")) if (x := e.find(S + tag)) is not None and lenient_flag(x.get("val"), True)}  # noqa: B023
            color = e.find(S + "color")
            return {**on, "color": spreadsheet_color(color.attrib, scheme) if color is not None else None}

        def fill(e: ET.Element | None) -> dict:
            box = e.find(f"{S}patternFill/{S}fgColor") if e is not None else None
            solid = e is not None and e.find(S + "patternFill") is not None and e.find(S + "patternFill").get("patternType", "none") != "none"
            return {"fill": spreadsheet_color(box.attrib, scheme)} if box is not None and solid else {}

        for n, xf in enumerate(root.iterfind(f"{S}cellXfs/{S}xf")):
            number = lenient_number(xf.get("numFmtId"), 0)
            f, b = lenient_number(xf.get("fontId"), -1), lenient_number(xf.get("fillId"), -1)
            guard = xf.find(S + "protection")
            look = {**font(fonts[f] if 0 <= f < len(fonts) else None), **fill(fills[b] if 0 <= b < len(fills) else None)}
            yield {"kind": "cell", "style": n, "code": codes.get(number) or built_in_code(number), "look": told(look), "locked": lenient_flag(guard.get("locked"), True) if guard is not None else True, "hidden": lenient_flag(guard.get("hidden")) if guard is not None else False, "control": controls.get(n)}
        for n, e in enumerate(root.iterfind(f"{S}dxfs/{S}dxf")):
            look = {**font(e.find(S + "font")), **fill(e.find(S + "fill"))}
            yield {"kind": "differential", "style": n, "code": None, "look": told(look), "locked": None, "hidden": None, "control": None}


def _controls(package: Package, book: Workbook) -> dict[int, str]:
    """Cell styles that show a control (a checkbox) in place of a value."""
    out, boxes = {}, []
    for r in package.linked(book.part, "FeaturePropertyBag"):
        root = package.xml(r.resolved)
        if root is not None:
            kinds = {lenient_number(e.get("id"), n): e.get("type", "") for n, e in enumerate(x for x in root if local(x) == "bag")}
            boxes = [n for n, kind in kinds.items() if kind == "Checkbox"]
    if not boxes:
        return out
    for link in package.linked(book.part, "styles"):
        root = package.xml(link.resolved)
        for n, xf in enumerate(root.iterfind(f"{S}cellXfs/{S}xf") if root is not None else ()):
            if any(local(x) == "xfComplement" for x in xf.iter()):
                out[n] = "checkbox"
    return out


# ---------------------------------------------------------------- pivots


def pivot_caches(package: Package) -> Iterator[dict]:
    """Caches in the workbook's order; an id that occurs twice is ambiguous and joins nothing."""
    book = Workbook(package)
    root = package.xml(book.part)
    entries = [e for e in root.iter() if local(e) == "pivotCache" and e.get("cacheId") is not None]
    counts: dict[str, int] = {}
    for e in entries:
        counts[e.get("cacheId")] = counts.get(e.get("cacheId"), 0) + 1
    for n, e in enumerate(entries, 1):
        link = package.link(book.part, e.get(R + "id"))
        cache = package.xml(link.resolved) if link else None
        source = next((x for x in cache.iter() if local(x) == "worksheetSource"), None) if cache is not None else None
        fields = [x.get("name", "") for x in cache.iter() if local(x) == "cacheField"] if cache is not None else []
        yield {"id": f"cache{n}", "cache_id": e.get("cacheId"), "ambiguous": counts[e.get("cacheId")] > 1, "missing": cache is None, "source_sheet": source.get("sheet") if source is not None else None, "source_ref": source.get("ref") if source is not None else None, "fields": fields, "records": lenient_number(cache.get("recordCount"), None) if cache is not None else None}


def pivots(package: Package) -> Iterator[dict]:
    """Pivot tables by sheet, their axes as field indices into their cache."""
    book, n = Workbook(package), 0
    for sheet in book.worksheets():
        for r in package.linked(sheet["part"], "pivotTable"):
            root = package.xml(r.resolved)
            if root is None:
                continue
            n += 1
            place = root.find(S + "location")
            axis = lambda name, tag, key: [lenient_number(x.get(key), -3) for x in root.iterfind(f"{S}{name}/{S}{tag}")]  # noqa: E731, B023
            data = [(x.get("name", ""), lenient_number(x.get("fld"), -3), x.get("subtotal", "sum")) for x in root.iterfind(f"{S}dataFields/{S}dataField")]
            yield {"id": f"pivot{n}", "sheet": sheet["name"], "name": root.get("name", ""), "cache_id": root.get("cacheId"), "ref": place.get("ref") if place is not None else None, "rows": axis("rowFields", "field", "x"), "columns": axis("colFields", "field", "x"), "pages": axis("pageFields", "pageField", "fld"), "data": [{"name": a, "field": b, "function": c} for a, b, c in data]}


def slicers(package: Package) -> Iterator[dict]:
    """Slicers and timelines with the cache they select in."""
    for name in sorted(package.names):
        low = name.lower()
        if "/slicercaches/" not in low and "/timelinecaches/" not in low or not low.endswith(".xml"):
            continue
        root = package.xml(name)
        tables = [x.get("name", "") for x in root.iter() if local(x) == "pivotTable"]
        cache = next((x.get("pivotCacheId") for x in root.iter() if x.get("pivotCacheId")), None)
        yield {"kind": "timeline" if "timeline" in low else "slicer", "name": root.get("name", ""), "source": root.get("sourceName"), "cache_id": cache, "tables": tables}


# ---------------------------------------------------------------- drawings and threads


def drawings(package: Package) -> Iterator[dict]:
    """Images, charts, shapes, groups and connectors with the cells they are anchored at."""
    book, n = Workbook(package), 0
    for sheet in book.sheets:
        if not sheet["part"]:
            continue
        for r in package.linked(sheet["part"], "drawing"):
            root = package.xml(r.resolved)
            for anchor in root if root is not None else ():
                start, end = anchor.find(XDR + "from"), anchor.find(XDR + "to")
                spot = lambda e, tag: None if e is None else lenient_number(e.findtext(XDR + tag), 0) + 1
                for e, group in _objects(anchor, None):
                    n += 1
                    about = next((x for x in e.iter() if local(x) == "cNvPr"), None)
                    kind = {"pic": "image", "sp": "shape", "grpSp": "group", "cxnSp": "connector", "graphicFrame": "chart"}[local(e)]
                    embed = next((x.get(R + "embed") for x in e.iter() if x.tag == A + "blip"), None) or next((x.get(R + "id") for x in e.iter() if x.tag == C + "chart"), None)
                    link = package.link(r.resolved, embed) if embed and kind in ("image", "chart") else None
                    ends = [next((x.get("id") for x in e.iter() if local(x) == name), None) for name in ("stCxn", "endCxn")]
                    text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in e.iter(A + "p")) if kind == "shape" else None
                    yield {"sheet": sheet["name"], "ord": n, "kind": kind, "object_id": about.get("id") if about is not None else None, "name": about.get("name") if about is not None else None, "alt": about.get("descr") if about is not None else None, "text": text or None, "target": link.resolved if link else None, "group_id": group, "from_id": ends[0], "to_id": ends[1], "top": spot(start, "row"), "left": spot(start, "col"), "bottom": spot(end, "row") or spot(start, "row"), "right": spot(end, "col") or spot(start, "col")}


def _objects(node: ET.Element, group: str | None) -> Iterator[tuple[ET.Element, str | None]]:
    for e in node:
        name = local(e)
        if name in ("pic", "sp", "grpSp", "cxnSp", "graphicFrame"):
            yield e, group
        if name == "grpSp":
            about = next((x for x in e.iter() if local(x) == "cNvPr"), None)
            yield from _objects(e, about.get("id") if about is not None else None)


def people(package: Package) -> dict[str, str]:
    out = {}
    for name in sorted(n for n in package.names if n.startswith("xl/persons/") and n.endswith(".xml")):
        root = package.xml(name)
        out |= {e.get("id"): e.get("displayName") for e in root.iter() if local(e) == "person" and e.get("id") and e.get("displayName")}
    return out


def threads(package: Package) -> Iterator[dict]:
    """Comments of conversations in the order of their parts; links between them are as they stand."""
    book, names = Workbook(package), people(package)
    for sheet in book.worksheets():
        for r in package.linked(sheet["part"], "threadedComment"):
            root = package.xml(r.resolved)
            for n, e in enumerate(x for x in root if local(x) == "threadedComment") if root is not None else ():
                done = e.get("done", "0").lower()
                status = "resolved" if done in ("1", "true", "on") else "active" if done in ("0", "false", "off") else "unknown"
                text = next((x.text or "" for x in e if local(x) == "text"), "")
                mentions = [names[x.get("mentionpersonId")] for x in e.iter() if local(x) == "mention" and x.get("mentionpersonId") in names]
                yield {"sheet": sheet["name"], "ord": n, "ref": e.get("ref", ""), "raw_id": e.get("id"), "parent_raw_id": e.get("parentId"), "person_id": e.get("personId"), "author": names.get(e.get("personId", "")), "date": e.get("dT"), "status": status, "mentions": mentions, "text": text}


def rich_values(package: Package) -> Iterator[dict]:
    """Values that cells name by ``vm`` (from 1): entities and pictures, by the keys of their structure."""
    named = {n.rsplit("/", 1)[-1].lower(): n for n in sorted(package.names) if "/richdata/" in n.lower()}
    values, shapes, web = (package.xml(named[k]) if k in named else None for k in ("rdrichvalue.xml", "rdrichvaluestructure.xml", "rdrichvaluewebimage.xml"))
    book = Workbook(package)
    meta = [root for r in package.linked(book.part, "sheetMetadata") if (root := package.xml(r.resolved)) is not None]
    if values is None or not meta:
        return
    structures = [(s.get("t", ""), [k.get("n", "") for k in s]) for s in (shapes if shapes is not None else ()) if local(s) == "s"]
    rows = [(lenient_number(rv.get("s"), -1), [v.text or "" for v in rv if local(v) == "v"], next((x.text for x in rv if local(x) == "fb"), None)) for rv in values if local(rv) == "rv"]
    rel_part = named.get("richvaluerel.xml")
    rels = [x.get(R + "id") for x in package.xml(rel_part).iter() if local(x) == "rel"] if rel_part else []
    future = [next((lenient_number(x.get("i"), -1) for x in bk.iter() if local(x) == "rvb"), -1) for f in meta[0].findall(S + "futureMetadata") if f.get("name") == "XLRICHVALUE" for bk in f.findall(S + "bk")]
    for n, bk in enumerate(meta[0].iterfind(f"{S}valueMetadata/{S}bk"), 1):
        place = lenient_number(next((rc.get("v") for rc in bk.findall(S + "rc")), None), -1)
        at = future[place] if 0 <= place < len(future) else -1
        if not 0 <= at < len(rows):
            continue
        shape, given, fallback = rows[at]
        kind, keys = structures[shape] if 0 <= shape < len(structures) else ("", [])
        held = dict(zip(keys, given))
        picture, url = None, None
        if "_rvRel:LocalImageIdentifier" in held:
            k = lenient_number(held["_rvRel:LocalImageIdentifier"], -1)
            link = package.link(rel_part, rels[k]) if rel_part and 0 <= k < len(rels) else None
            picture = link.resolved if link else None
        if "WebImageIdentifier" in held and web is not None:
            k = lenient_number(held["WebImageIdentifier"], -1)
            sources = [x for x in web.iter() if local(x) == "webImageSrd"]
            link = package.link(named["rdrichvaluewebimage.xml"], next((x.get(R + "id") for x in sources[k].iter() if local(x) == "address"), None)) if 0 <= k < len(sources) else None
            url = link.target if link else None
        yield {"vm": n, "kind": kind, "display": held.get("_DisplayString"), "alt": held.get("Text"), "fallback": fallback, "image_part": picture, "image_url": url, "fields": told({k: v for k, v in held.items() if not k.startswith("_")})}


def content_types(package: Package) -> Iterator[dict]:
    """Each part's content type: that of the part itself, else of its extension."""
    by_name, by_end = package.content_types()
    for e in package.entries:
        name = e.filename
        if name != "[Content_Types].xml":
            own = by_name.get(name.lower())
            yield {"name": name, "content_type": own or by_end.get(name.rsplit(".", 1)[-1].lower() if "." in name else ""), "declared": "part" if own else "extension"}


def external_links(package: Package) -> Iterator[dict]:
    """Other workbooks that formulas name by number (from 1)."""
    book = Workbook(package)
    for n, r in enumerate(package.linked(book.part, "externalLink"), 1):
        target = next((x for x in package.links(r.resolved) if x.external), None)
        root = package.xml(r.resolved)
        sheets = [x.get("val", "") for x in root.iter() if local(x) == "sheetName"] if root is not None else []
        yield {"n": n, "part": r.resolved, "target": target.target if target else None, "sheets": sheets}


__all__ = ["content_types", "data_table_formula", "drawings", "dynamic_arrays", "external_links", "people", "pivot_caches", "pivots", "plain_text", "ranges", "rich_values", "rules", "slicers", "styles", "threads"]
