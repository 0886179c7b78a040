"""Text that a metafile's records draw."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from lexigrain.sources.package import Package

# Record types, the signature of a header, charsets by code page, and bounds.
HEADER, END_OF_FILE, SELECT, FONT, DELETE, TEXT_A, TEXT_W = 1, 14, 37, 82, 40, 83, 84
SIGNATURE = b" EMF"
CHARSETS = {0: "cp1252", 2: "symbol", 128: "cp932", 129: "cp949", 134: "cp936", 136: "cp950", 161: "cp1253", 162: "cp1254", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
MOST_RECORDS, MOST_CHARS = 100_000, 16_000


def drawn(data: bytes) -> list[str]:
    """The texts of a metafile's text records in order; ValueError where the bytes are none."""
    if len(data) < 44 or struct.unpack_from("<I", data)[0] != HEADER or data[40:44] != SIGNATURE:
        raise ValueError("the bytes are no metafile")
    fonts: dict[int, str] = {}
    out, at, charset, left = [], 0, "cp1252", MOST_CHARS
    for _ in range(MOST_RECORDS):
        if at + 8 > len(data) or not left:
            break
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or size % 4 or at + size > len(data) or kind == END_OF_FILE:
            break
        body = data[at : at + size]
        if kind == FONT and size >= 12 + 24:
            fonts[struct.unpack_from("<I", body, 8)[0]] = CHARSETS.get(body[12 + 23], "cp1252")
        elif kind == SELECT and size >= 12:
            charset = fonts.get(struct.unpack_from("<I", body, 8)[0], charset)
        elif kind == DELETE and size >= 12:
            fonts.pop(struct.unpack_from("<I", body, 8)[0], None)
        elif kind in (TEXT_A, TEXT_W) and size >= 52:
            count, place = struct.unpack_from("<II", body, 44)
            width = 2 if kind == TEXT_W else 1
            raw = body[place : place + count * width] if 52 <= place <= size else b""
            text = "" if charset == "symbol" and kind == TEXT_A else raw.decode("utf-16-le" if kind == TEXT_W else charset, "replace")
            text = text.rstrip("\0")[:left]
            if text:
                out.append(text)
                left -= len(text)
        at += size
    return out


def texts(package: Package) -> Iterator[dict]:
    """The texts of every metafile of a package; one that can't be read has none."""
    for name in sorted(n for n in package.names if n.lower().endswith(".emf")):
        try:
            found = drawn(package.read(name))
        except ValueError:
            continue
        yield from ({"part": name, "ord": n, "text": t} for n, t in enumerate(found))
