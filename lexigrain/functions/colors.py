"""Colors of drawings and sheets: adjustments of luminance, tint and shade."""

from __future__ import annotations

import colorsys

# Default theme slots and preset names.
THEME = {"dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6", "accent1": "4472C4", "accent2": "ED7D31", "accent3": "A5A5A5", "accent4": "FFC000", "accent5": "5B9BD5", "accent6": "70AD47", "hlink": "0563C1", "folHlink": "954F72"}
ALIASES = {"tx1": "dk1", "bg1": "lt1", "tx2": "dk2", "bg2": "lt2"}
PRESETS = {"black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "lime": "00FF00", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF", "magenta": "FF00FF", "gray": "808080"}

# The indexed palette of sheets (8 to 63; 0 to 7 repeat 8 to 15), and the order of theme slots there.
INDEXED = "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF 000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333".split()
SHEET_SLOTS = "lt1 dk1 lt2 dk2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split()
# Names of word theme colors that differ from the slots', and named highlights.
WORD_SLOTS = {"dark1": "dk1", "light1": "lt1", "dark2": "dk2", "light2": "lt2", "text1": "dk1", "background1": "lt1", "text2": "dk2", "background2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink"}


def _parts(color: str) -> list[float]:
    return [int(color[i : i + 2], 16) / 255 for i in (0, 2, 4)]


def _text(parts) -> str:
    return "".join(f"{round(min(1, max(0, p)) * 255):02X}" for p in parts)


def with_luminance(color: str, factor: float = 1.0, offset: float = 0.0) -> str:
    """Its lightness times ``factor`` plus ``offset``, hue and saturation kept."""
    h, l, s = colorsys.rgb_to_hls(*_parts(color))
    return _text(colorsys.hls_to_rgb(h, min(1, max(0, l * factor + offset)), s))


def with_tint(color: str, tint: float) -> str:
    """A sheet's tint: negative darkens the lightness, positive moves it towards white."""
    return with_luminance(color, 1 + tint) if tint < 0 else with_luminance(color, 1 - tint, tint)


def adjusted(color: str, steps: list[tuple[str, float]]) -> str:
    """Adjustments in order: lumMod, lumOff, tint and shade, each as a share of 1."""
    for name, amount in steps:
        if name == "lumMod":
            color = with_luminance(color, amount)
        elif name == "lumOff":
            color = with_luminance(color, 1, amount)
        elif name == "shade":
            color = _text(p * amount for p in _parts(color))
        elif name == "tint":
            color = _text(p * amount + 1 - amount for p in _parts(color))
        elif name in ("satMod", "satOff", "hueMod", "hueOff", "hue", "sat", "lum"):
            h, l, s = colorsys.rgb_to_hls(*_parts(color))
            if name.startswith("hue"):
                h = (h * amount if name == "hueMod" else h + amount if name == "hueOff" else amount) % 1
            elif name.startswith("sat"):
                s = min(1, max(0, s * amount if name == "satMod" else s + amount if name == "satOff" else amount))
            else:
                l = min(1, max(0, amount))
            color = _text(colorsys.hls_to_rgb(h, l, s))
        elif name == "inv":
            color = _text(1 - p for p in _parts(color))
        elif name == "comp":
            h, l, s = colorsys.rgb_to_hls(*_parts(color))
            color = _text(colorsys.hls_to_rgb((h + 0.5) % 1, l, s))
        elif name == "gray":
            r, g, b = _parts(color)
            color = _text([0.3 * r + 0.59 * g + 0.11 * b] * 3)
    return color


def resolve(kind: str, value: str, steps: list[tuple[str, float]] = (), theme: dict[str, str] | None = None) -> str | None:
    """`#RRGGBB` of a color given as srgb, scheme, preset or sys; null where the name isn't known."""
    slots = THEME | (theme or {})
    base = {"srgb": value, "sys": value, "scheme": slots.get(ALIASES.get(value, value)), "preset": PRESETS.get(value)}.get(kind)
    return "#" + adjusted(base.upper(), list(steps)) if base and len(base) == 6 else None


def from_hsl(hue: float, saturation: float, luminance: float) -> str:
    """RRGGBB of a hue in degrees and shares of 1."""
    return _text(colorsys.hls_to_rgb(hue / 360 % 1, min(1, max(0, luminance)), min(1, max(0, saturation))))


def from_linear(r: float, g: float, b: float) -> str:
    """RRGGBB of linear shares of 1, as scRGB gives them."""
    return _text(12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055 for x in (max(0.0, r), max(0.0, g), max(0.0, b)))


def spreadsheet_color(attributes: dict[str, str], theme: dict[str, str] | None = None) -> str | None:
    """`#RRGGBB` of a sheet's color element: rgb, indexed or theme, with its tint; null for automatic ones and unknown numbers."""
    slots = THEME | (theme or {})
    base = None
    if attributes.get("rgb"):
        base = attributes["rgb"][-6:]
    elif attributes.get("indexed", "").isdigit():
        n = int(attributes["indexed"])
        base = INDEXED[n - 8 if n >= 8 else n] if n < 64 else {64: "000000", 65: "FFFFFF"}.get(n)
    elif attributes.get("theme", "").isdigit():
        n = int(attributes["theme"])
        base = slots[SHEET_SLOTS[n]] if n < len(SHEET_SLOTS) else None
    if not base or len(base) != 6:
        return None
    try:
        tint = float(attributes.get("tint", 0))
        return "#" + (with_tint(base.upper(), tint) if tint else base.upper())
    except ValueError:
        return None


def word_color(value: str | None, theme_color: str | None = None, tint: str | None = None, shade: str | None = None, theme: dict[str, str] | None = None) -> str | None:
    """`#RRGGBB` of a word color: the theme's slot where it is named, lightened or darkened by a byte, else the plain value; null for `auto`."""
    slots = THEME | (theme or {})
    base = slots.get(WORD_SLOTS.get(theme_color, theme_color)) if theme_color else None
    if base is None:
        return "#" + value.upper() if value and value != "auto" and len(value) == 6 else None
    if shade:
        base = with_luminance(base, int(shade, 16) / 255)
    if tint:
        share = int(tint, 16) / 255
        base = with_luminance(base, share, 1 - share)
    return "#" + base.upper()
