"""Charts and diagrams of any office package: series, axes, nodes, links."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lexigrain.sources.package import Package

C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
#: A point's number above this is a damaged file, not a longer array.
MOST_POINTS = 1_000_000


def points(node: ET.Element | None) -> list[str]:
    """Cached points as a dense array: gaps empty, a repeated place as it is last; levels of categories joined by ` / `."""
    if node is None:
        return []
    levels = node.findall(f".//{C}lvl")
    if levels:
        dense = [_dense(level) for level in levels[::-1]]
        size = max(map(len, dense))
        rows = [[level[k] if k < len(level) else "" for level in dense] for k in range(size)]
        return [" / ".join(x for x in row if x) for row in rows]
    return _dense(node)


def _dense(node: ET.Element) -> list[str]:
    found = {}
    for p in node.iter(C + "pt"):
        at = p.get("idx", "")
        if at.isdigit() and int(at) < MOST_POINTS:
            found[int(at)] = p.findtext(C + "v") or ""
    return [found.get(k, "") for k in range(max(found) + 1)] if found else []


def _words(node: ET.Element | None) -> str | None:
    if node is None:
        return None
    rich = "".join(t.text or "" for t in node.iter(A + "t"))
    return rich or next((v.text for v in node.iter(C + "v")), None)


def charts(package: Package) -> Iterator[dict]:
    """One row a series: the chart's part, title and types, the series' name and parallel arrays."""
    for part in sorted(n for n in package.names if "/charts/chart" in n and n.endswith(".xml")):
        root = package.xml(part)
        plot = root.find(f"{C}chart/{C}plotArea") if root is not None else None
        if plot is None:
            continue
        title = _words(root.find(f"{C}chart/{C}title"))
        groups = [g for g in plot if g.find(C + "ser") is not None]
        kinds = list(dict.fromkeys(g.tag.removeprefix(C) for g in groups))
        axes = {x.find(C + "axId").get("val", ""): _words(x.find(C + "title")) or "" for x in plot if x.tag.endswith("Ax") and x.find(C + "axId") is not None}
        n = 0
        for g in groups:
            for s in g.findall(C + "ser"):
                arrays = {name: points(s.find(C + tag)) for name, tag in (("categories", "cat"), ("values", "val"), ("x", "xVal"), ("y", "yVal"), ("size", "bubbleSize"))}
                yield {"part": part, "title": title, "type": kinds[0] if len(kinds) == 1 else "combination", "series": n, "name": _words(s.find(C + "tx")), "plot": g.tag.removeprefix(C), "axes": list(axes.items()), **arrays}
                n += 1


def _model(package: Package) -> Iterator[tuple[str, ET.Element]]:
    for part in sorted(n for n in package.names if "/diagrams/data" in n and n.endswith(".xml")):
        root = package.xml(part)
        if root is not None:
            yield part, root


def _numbers(root: ET.Element) -> dict[str, int]:
    """Nodes' numbers from 1 in source order; of a repeated id the first counts."""
    out: dict[str, int] = {}
    for e in root.iterfind(f"{D}ptLst/{D}pt"):
        out.setdefault(e.get("modelId", ""), len(out) + 1)
    return out


def diagram_nodes(package: Package) -> Iterator[dict]:
    """Nodes that can be read: those with a label, and endpoints of links."""
    for part, root in _model(package):
        ends = {c.get(k) for c in root.iterfind(f"{D}cxnLst/{D}cxn") for k in ("srcId", "destId")}
        numbers, told = _numbers(root), set()
        for e in root.iterfind(f"{D}ptLst/{D}pt"):
            key = e.get("modelId", "")
            text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in e.iter(A + "p")).strip()
            if key not in told and (text or key in ends):
                told.add(key)
                yield {"part": part, "node": numbers[key], "kind": e.get("type", "node"), "text": text}


def diagram_links(package: Package) -> Iterator[dict]:
    """All links with their kind; an endpoint that isn't there is null."""
    for part, root in _model(package):
        numbers = _numbers(root)
        for e in root.iterfind(f"{D}cxnLst/{D}cxn"):
            yield {"part": part, "kind": e.get("type", "parOf"), "from_node": numbers.get(e.get("srcId", "")), "to_node": numbers.get(e.get("destId", ""))}
