"""Compound files and the binary workbooks in them: stored values with their displayed text."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from lexigrain.functions.number_format import BUILT_IN, format_value
from lexigrain.functions.references import letters_of
from lexigrain.sources.package import PackageError

# Fixed values of the formats: signature, chain ends, limits, record types, error codes.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
MAX_FILE_BYTES, MAX_STREAM_BYTES, MAX_DIRECTORY = 256 << 20, 128 << 20, 32_768
MAX_RECORDS, MAX_STRINGS, MAX_CELLS, MAX_SHEETS = 1_000_000, 500_000, 500_000, 256
BOF, EOF, CONTINUE, BOUNDSHEET, SST, FORMAT, XF, DATEMODE = 0x0809, 0x000A, 0x003C, 0x0085, 0x00FC, 0x041E, 0x00E0, 0x0022
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0x00FD, 0x0204, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class CompoundFile:
    """Root-level streams by name; PackageError where chains are broken or limits passed."""

    def __init__(self, data: bytes):
        if len(data) > MAX_FILE_BYTES or len(data) < 512 or data[:8] != SIGNATURE:
            raise PackageError("not a compound file, or too large")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise PackageError("odd sector sizes")
        self.size = 1 << shift
        directory, self.cutoff, mini_first = struct.unpack_from("<I4xII", data, 48)
        difat_at, difat_count = struct.unpack_from("<II", data, 68)
        tables = list(struct.unpack_from("<109I", data, 76))
        per = self.size // 4
        for _ in range(difat_count):
            if difat_at >= END:
                break
            more = struct.unpack(f"<{per}I", self._sector(difat_at))
            tables += more[:-1]
            difat_at = more[-1]
        self.fat: list[int] = []
        for s in tables:
            if s < 0xFFFFFFFA:
                self.fat += struct.unpack(f"<{per}I", self._sector(s))
        raw = self._chain(directory, None)
        if len(raw) // 128 > MAX_DIRECTORY:
            raise PackageError("too many directory entries")
        self.entries = {}
        root = None
        for a in range(0, len(raw) - 127, 128):
            length, kind = struct.unpack_from("<HB", raw, a + 64)
            start, size = struct.unpack_from("<IQ", raw, a + 116)
            name = raw[a : a + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = start, size
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF if shift == 9 else size))
        if root is None:
            raise PackageError("no root entry")
        self.mini = self._chain(root[0], root[1]) if root[1] else b""
        packed = self._chain(mini_first, None) if mini_first < END else b""
        self.mini_fat = struct.unpack(f"<{len(packed) // 4}I", packed)

    def _sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if not out:
            raise PackageError("a sector lies outside the file")
        return out.ljust(self.size, b"\x00")

    def _chain(self, start: int, size: int | None) -> bytes:
        out, seen, at = [], set(), start
        while at < 0xFFFFFFFA and (size is None or len(out) * self.size < size):
            if at in seen or at >= len(self.fat):
                raise PackageError("a chain of sectors is broken")
            seen.add(at)
            out.append(self._sector(at))
            at = self.fat[at]
        return b"".join(out)[:size]

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise PackageError(f"no stream {name}")
        start, size = self.entries[name]
        if size > MAX_STREAM_BYTES:
            raise PackageError(f"{name} is too large")
        if size >= self.cutoff:
            out = self._chain(start, size)
        else:
            parts, seen, at = [], set(), start
            while at < 0xFFFFFFFA and len(parts) * 64 < size:
                if at in seen or at >= len(self.mini_fat):
                    raise PackageError("a chain of small sectors is broken")
                seen.add(at)
                parts.append(self.mini[64 * at : 64 * at + 64])
                at = self.mini_fat[at]
            out = b"".join(parts)[:size]
        if len(out) < size:
            raise PackageError(f"{name} is cut short")
        return out


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, payload and its continuations) from ``at`` on."""
    n, kind, parts = 0, None, []
    while at + 4 <= len(data):
        own, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) < size or (n := n + 1) > MAX_RECORDS:
            raise PackageError("a record is cut short, or there are too many")
        at += 4 + size
        if own == CONTINUE and kind is not None:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = own, [body]
    if kind is not None:
        yield kind, parts


class _Reader:
    """Reads values and strings over continued payloads."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.k >= len(self.parts):
                raise PackageError("a string is cut short")
            piece = self.parts[self.k][self.at : self.at + n - len(out)]
            out += piece
            self.at += len(piece)
            if self.at >= len(self.parts[self.k]) and len(out) < n:
                self.k, self.at = self.k + 1, 0
        return out

    def _next(self) -> None:
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0

    def text(self, short: bool = False) -> str:
        """A string with its own length and flags; where it goes on in the next payload, new flags come first."""
        self._next()
        count = self.take(1)[0] if short else struct.unpack("<H", self.take(2))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count:
            if self.k >= len(self.parts):
                raise PackageError("a string is cut short")
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
                continue
            room = (len(self.parts[self.k]) - self.at) // (2 if wide else 1)
            n = min(count, room)
            if not n:
                raise PackageError("a character is cut in two")
            raw = self.take(n * (2 if wide else 1))
            out += raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")
            count -= n
        self.take(4 * runs + extra)
        return out


def rk_number(raw: int) -> float:
    """A packed number: 30 bits of an integer or of a double, at times a hundredth of it."""
    value = float((raw >> 2) - (1 << 30 if raw & 0x80000000 else 0)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def number_text(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


class BinaryWorkbook:
    """Sheets and cells of a binary workbook."""

    def __init__(self, data: bytes):
        self.data = CompoundFile(data).stream("Workbook")
        self.sheets, self.strings, self.codes, self.styles, self.date_1904 = [], [], dict(BUILT_IN), [], False
        first = True
        for kind, parts in records(self.data):
            body = parts[0]
            if first and (kind != BOF or len(body) < 4 or struct.unpack_from("<H", body)[0] != 0x0600):
                raise PackageError("not a workbook of the last binary version")
            first = False
            if kind == EOF:
                break
            if kind == BOUNDSHEET:
                at, state, what = struct.unpack_from("<IBB", body)
                self.sheets.append({"ord": len(self.sheets), "name": _Reader(parts, 6).text(True), "state": ("visible", "hidden", "veryHidden")[min(state & 3, 2)], "kind": "worksheet" if what == 0 else "other", "at": at})
            elif kind == SST:
                reader, n = _Reader(parts, 8), struct.unpack_from("<I", body, 4)[0]
                if n > MAX_STRINGS:
                    raise PackageError("too many strings")
                self.strings = [reader.text() for _ in range(n)]
            elif kind == FORMAT:
                self.codes[struct.unpack_from("<H", body)[0]] = _Reader(parts, 2).text()
            elif kind == XF:
                self.styles.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == DATEMODE:
                self.date_1904 = struct.unpack_from("<H", body)[0] == 1
        if len(self.sheets) > MAX_SHEETS:
            raise PackageError("too many sheets")

    def _shown(self, value: float, style: int) -> tuple[str, str, str]:
        raw = number_text(value)
        code = self.codes.get(self.styles[style] if style < len(self.styles) else 0, "General")
        return format_value(raw, code, self.date_1904), raw, "number"

    def cells(self) -> Iterator[dict]:
        for sheet in self.sheets:
            if sheet["kind"] == "worksheet":
                for row, column, (text, raw, kind) in self._sheet(sheet["at"]):
                    yield {"sheet": sheet["name"], "row": row + 1, "col": column + 1, "ref": f"{letters_of(column + 1)}{row + 1}", "text": text, "raw": raw, "type": kind}

    def _sheet(self, at: int) -> Iterator[tuple[int, int, tuple[str, str, str]]]:
        seen: set[tuple[int, int]] = set()
        waiting = None  # a formula whose text comes in the next record
        for n, (kind, parts) in enumerate(records(self.data, at)):
            body = parts[0]
            if n == 0 and kind != BOF:
                raise PackageError("a sheet doesn't start where the workbook says")
            if kind == EOF:
                return
            found = []
            if kind in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA):
                row, column, style = struct.unpack_from("<HHH", body)
            if kind == LABELSST:
                k = struct.unpack_from("<I", body, 6)[0]
                found = [(column, (self.strings[k] if k < len(self.strings) else "", str(k), "string"))]
            elif kind == LABEL:
                text = _Reader(parts, 6).text()
                found = [(column, (text, text, "string"))]
            elif kind == NUMBER:
                found = [(column, self._shown(struct.unpack_from("<d", body, 6)[0], style))]
            elif kind == RK:
                found = [(column, self._shown(rk_number(struct.unpack_from("<I", body, 6)[0]), style))]
            elif kind == MULRK:
                found = [(column + k, self._shown(rk_number(struct.unpack_from("<I", body, 6 + 6 * k)[0]), struct.unpack_from("<H", body, 4 + 6 * k)[0])) for k in range((len(body) - 6) // 6)]
            elif kind == BOOLERR:
                value, error = body[6], body[7]
                found = [(column, (ERRORS.get(value, "#N/A"), str(value), "error") if error else ("TRUE" if value else "FALSE", str(value), "boolean"))]
            elif kind == FORMULA:
                if body[12:14] != b"\xff\xff":
                    found = [(column, self._shown(struct.unpack_from("<d", body, 6)[0], style))]
                elif body[6] == 1:
                    found = [(column, ("TRUE" if body[8] else "FALSE", str(body[8]), "boolean"))]
                elif body[6] == 2:
                    found = [(column, (ERRORS.get(body[8], "#N/A"), str(body[8]), "error"))]
                elif body[6] == 0:
                    waiting = row, column
                    continue
                else:
                    found = [(column, ("", "", "string"))]
            elif kind == STRING and waiting:
                row, column = waiting
                text = _Reader(parts).text()
                found = [(column, (text, text, "string"))]
                waiting = None
            for column, value in found:
                if (row, column) in seen or len(seen) >= MAX_CELLS:
                    raise PackageError("a cell is there twice, or there are too many")
                seen.add((row, column))
                yield row, column, value
