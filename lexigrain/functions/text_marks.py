"""Marks in texts: symbol fonts, field instructions, markers for what text can't show."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of symbol fonts (by their low byte) that readers know.
SYMBOL = {0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2D: "−", 0x40: "≅", 0x41: "Α", 0x42: "Β", 0x43: "Χ", 0x44: "Δ", 0x46: "Φ", 0x47: "Γ", 0x4C: "Λ", 0x50: "Π", 0x51: "Θ", 0x53: "Σ", 0x57: "Ω", 0x58: "Ξ", 0x59: "Ψ", 0x61: "α", 0x62: "β", 0x63: "χ", 0x64: "δ", 0x65: "ε", 0x66: "φ", 0x67: "γ", 0x68: "η", 0x69: "ι", 0x6B: "κ", 0x6C: "λ", 0x6D: "μ", 0x6E: "ν", 0x70: "π", 0x71: "θ", 0x72: "ρ", 0x73: "σ", 0x74: "τ", 0x77: "ω", 0x78: "ξ", 0x79: "ψ", 0x7A: "ζ", 0xA3: "≤", 0xA5: "∞", 0xAB: "↔", 0xAC: "←", 0xAD: "↑", 0xAE: "→", 0xAF: "↓", 0xB0: "°", 0xB1: "±", 0xB3: "≥", 0xB4: "×", 0xB7: "•", 0xB8: "÷", 0xB9: "≠", 0xBA: "≡", 0xBB: "≈", 0xC5: "⊕", 0xC7: "∩", 0xC8: "∪", 0xCC: "⊂", 0xCE: "∈", 0xD1: "∇", 0xD6: "√", 0xDB: "⇔", 0xDE: "⇒", 0xE5: "∑", 0xF2: "∫"}
WINGDINGS = {0x6C: "●", 0x6E: "■", 0x6F: "□", 0x71: "❑", 0x72: "❒", 0x73: "⬧", 0x75: "◆", 0x76: "❖", 0x9F: "•", 0xA7: "▪", 0xA8: "◻", 0xD8: "➢", 0xDF: "←", 0xE0: "→", 0xE1: "↑", 0xE2: "↓", 0xFB: "✗", 0xFC: "✓", 0xFD: "☒", 0xFE: "☑"}
# Switches of fields that take an argument, and those that don't.
WITH_ARGUMENT = {"HYPERLINK": "lotm", "REF": "d", "PAGEREF": "", "NOTEREF": "", "CITATION": "lpvfsm"}
WITHOUT = {"HYPERLINK": "nh", "REF": "fhnprtw", "PAGEREF": "hp", "NOTEREF": "fhp", "CITATION": "nty"}


def symbol(font: str, code: int) -> str:
    """The character that a symbol font draws for a code, in or out of the private area; a bullet where it isn't known, the code's own for other fonts."""
    table = SYMBOL if font.lower() == "symbol" else WINGDINGS if font.lower().startswith("wingdings") else None
    if table is None:
        return "•" if 0xE000 <= code <= 0xF8FF else chr(code) if 0x20 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else ""
    return table.get(code & 0xFF, "•")


_PART = re.compile(r'\s+|\\(?P<switch>[^"\\])|"(?P<quoted>(?:[^"\\]|\\["\\]|\\)*)"|(?P<word>(?:[^\s"\\]|\\["\\])+)')


def field(instruction: str) -> dict[str, str] | None:
    """What a reference field points to: kind (hyperlink, reference, citation), href, anchor or key; null for other fields.

    ValueError for an instruction that can't be read: an open quote, an unknown
    switch, a switch without its argument, more than one target.
    """
    parts, at = [], 0
    while at < len(instruction):
        m = _PART.match(instruction, at)
        if m is None:
            raise ValueError(f"{instruction!r} can't be read from place {at}")
        at = m.end()
        if m["switch"]:
            parts.append((True, m["switch"].lower()))
        elif m["quoted"] is not None or m["word"]:
            parts.append((False, re.sub(r'\\(["\\])', r"\1", m["quoted"] if m["quoted"] is not None else m["word"])))
    if not parts or parts[0][0] or parts[0][1].upper() not in WITH_ARGUMENT:
        return None
    kind, targets, given, waiting = parts[0][1].upper(), [], {}, None
    for is_switch, value in parts[1:]:
        if waiting is not None:
            if is_switch:
                break
            given[waiting], waiting = value, None
        elif not is_switch:
            targets.append(value)
        elif value in WITH_ARGUMENT[kind] + "*#@":
            waiting = value
        elif value not in WITHOUT[kind]:
            raise ValueError(f"{kind} has no switch {value!r}")
    if waiting is not None:
        raise ValueError(f"the switch {waiting!r} has no argument")
    if len(targets) > 1:
        raise ValueError(f"{kind} has one target")
    target = targets[0] if targets else ""
    if kind == "CITATION":
        return {"kind": "citation", "key": target} if target else None
    anchor = given.get("l", "") if kind == "HYPERLINK" else target
    out = {"kind": "hyperlink" if kind == "HYPERLINK" else "reference", "href": target if kind == "HYPERLINK" else "", "anchor": anchor}
    return {k: v for k, v in out.items() if v} if target or anchor else None


def readable(*values: Column) -> Column:
    """The first value that isn't blank, as it is."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def own_name(name: Column, defaults: list[str]) -> Column:
    """A name, null where it is one that programs give by themselves (`Picture 3`)."""
    made = "^(" + "|".join(re.escape(d) for d in defaults) + r") [1-9][0-9]*$"
    return F.when(~name.rlike(made), name)


def image_marker(description: Column) -> Column:
    return F.when(readable(description).isNotNull(), F.concat(F.lit("[Image "), description, F.lit("]"))).otherwise("[Image]")


def chart_marker(identity: Column, title: Column, kind: Column, series: Column, names: Column) -> Column:
    """`[Chart id: title (kind, n series); names]`, eight names at most, labels cut at 160 characters."""
    short = lambda c: F.when(F.length(c) > 160, F.concat(F.substring(c, 1, 159), F.lit("…"))).otherwise(c)
    label = F.concat(F.lit("[Chart"), F.coalesce(F.concat(F.lit(" "), identity), F.lit("")), F.coalesce(F.concat(F.lit(": "), short(title)), F.lit("")), F.lit(" ("), kind, F.lit(", "), series.cast("string"), F.lit(" series)"))
    listed = F.array_join(F.transform(F.slice(F.filter(names, lambda n: n != ""), 1, 8), short), ", ")
    long = (F.size(names) > 8) | (F.length(title) > 160) | F.exists(names, lambda n: F.length(n) > 160)
    return F.concat(label, F.when(listed != "", F.concat(F.lit("; "), listed)).otherwise(""), F.when(F.coalesce(long, F.lit(False)), "; truncated").otherwise(""), F.lit("]"))


def ocr_marker(status: Column, text: Column, low: Column) -> Column:
    """Recognised text between markers; a failure is told, no result is nothing."""
    head = F.when(low, "[OCR low-confidence]").otherwise("[OCR]")
    return F.when((status == "success") & (text != ""), F.concat(head, F.lit("\n"), text, F.lit("\n[/OCR]"))).when(status == "error", "[OCR failed]").otherwise("")


def control_marker(kind: Column, label: Column, checked: Column, text: Column) -> Column:
    """A content control around its text: a checkbox's state, else its label where it has one."""
    box = F.concat(F.lit("[Checkbox "), checked.cast("string"), F.lit("]"))
    named = F.concat(F.lit("["), label, F.lit(": "), text, F.lit("]"))
    return F.when((kind == "checkbox") & checked.isNotNull(), box).when(readable(label).isNotNull(), named).otherwise(text)


def unsupported_marker(kind: Column, description: Column) -> Column:
    """What is there but can't be read, never silently dropped."""
    return F.concat(F.lit("[Unparsed "), kind, F.coalesce(F.concat(F.lit(": "), readable(description)), F.lit("")), F.lit("]"))
