"""Compound files and binary workbooks, from bytes made here."""

import struct

import pytest

from lexigrain.sources import legacy, office
from lexigrain.sources.package import PackageError


def compound(name, data):
    """One stream in a compound file: in sectors of 512 bytes, or in small ones below 4,096 bytes."""
    small = len(data) < 4096
    held = data.ljust(-(-len(data) // 64) * 64, b"\x00") if small else data
    body = [held[a : a + 512].ljust(512, b"\x00") for a in range(0, len(held), 512)]
    fat = [0xFFFFFFFD, 0xFFFFFFFE]  # the table itself, the directory
    first = 2
    fat += [first + k + 1 for k in range(len(body) - 1)] + [legacy.END]
    mini = b""
    if small:
        n = len(held) // 64
        mini = struct.pack(f"<{n}I", *range(1, n), legacy.END).ljust(512, b"\xff")
        fat.append(legacy.END)
    entry = lambda text, kind, start, size: text.encode("utf-16-le").ljust(64, b"\x00") + struct.pack("<HB", 2 * len(text) + 2, kind) + b"\x00" * 49 + struct.pack("<IQ", start, size)
    root = entry("Root Entry", 5, first if small else legacy.END, len(held) if small else 0)
    directory = (root + entry(name, 2, 0 if small else first, len(data))).ljust(512, b"\x00")
    head = legacy.SIGNATURE + b"\x00" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\x00" * 6 + struct.pack("<III", 0, 1, 1) + b"\x00" * 4
    head += struct.pack("<III", 4096, first + len(body) if small else legacy.END, int(small)) + struct.pack("<II", legacy.END, 0)
    head += struct.pack("<109I", 0, *[legacy.FREE] * 108)
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + b"".join(body) + mini


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(t, wide=False):
    return struct.pack("<HB", len(t), int(wide)) + t.encode("utf-16-le" if wide else "latin-1")


def workbook(pad=0):
    cell = lambda kind, r, c, rest, xf=0: record(kind, struct.pack("<HHH", r, c, xf) + rest)
    sheet = record(legacy.BOF, struct.pack("<HH", 0x0600, 0x10))
    sheet += cell(legacy.LABELSST, 0, 0, struct.pack("<I", 1)) + cell(legacy.NUMBER, 0, 1, struct.pack("<d", 0.256), 1) + cell(legacy.RK, 1, 0, struct.pack("<I", 44927 << 2 | 2), 2)
    sheet += record(legacy.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, 1234 << 2 | 3) + struct.pack("<HI", 0, (-5 & 0x3FFFFFFF) << 2 | 2) + struct.pack("<H", 1))
    sheet += cell(legacy.BOOLERR, 3, 0, b"\x01\x00") + cell(legacy.BOOLERR, 3, 1, b"\x07\x01")
    sheet += cell(legacy.FORMULA, 4, 0, b"\x00" * 6 + b"\xff\xff" + b"\x00" * 8) + record(legacy.STRING, text("made", True)) + cell(legacy.FORMULA, 4, 1, struct.pack("<d", 7.5) + b"\x00" * 8)
    sheet += record(legacy.EOF)
    strings = text("first") + text("cut here")[:6]
    shared = record(legacy.SST, struct.pack("<II", 2, 2) + strings) + record(legacy.CONTINUE, b"\x01" + " here".encode("utf-16-le"))
    globals_ = lambda at: record(legacy.BOF, struct.pack("<HH", 0x0600, 5)) + record(legacy.FORMAT, struct.pack("<H", 164) + text("0.0%")) + b"".join(record(legacy.XF, struct.pack("<HH", 0, f)) for f in (0, 164, 14)) + record(legacy.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + b"\x04\x00Data") + shared + record(legacy.EOF)
    return globals_(len(globals_(0))) + sheet + b"\x00" * pad


WANT = {"A1": "cut here", "B1": "25.6%", "A2": "1/1/2023", "A3": "12.34", "B3": "-5", "A4": "TRUE", "B4": "#DIV/0!", "A5": "made", "B5": "7.5"}


@pytest.mark.parametrize("pad", [0, 5000])
def test_cells(pad):
    data = compound("Workbook", workbook(pad))
    assert {c["ref"]: c["text"] for c in legacy.BinaryWorkbook(data).cells()} == WANT


def test_files(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(compound("Workbook", workbook()))
    (tmp_path / "b.xls").write_bytes(b"\xd0\xcf")
    found = office.read_office(spark, str(tmp_path), "xls_cells").collect()
    assert {r["ref"]: r["text"] for r in found} == WANT
    assert [r["name"] for r in office.read_office(spark, str(tmp_path), "xls_sheets").collect()] == ["Data"]
    assert [r["doc_id"][-5:] for r in office.read_office(spark, str(tmp_path), "warnings").collect()] == ["b.xls"]
    assert office.read_office(spark, str(tmp_path), "package_entries").count() == 0


def test_broken_files():
    good = compound("Workbook", workbook(5000))
    for bad in (b"", good[:700], good.replace(legacy.SIGNATURE, b"\x00" * 8), compound("Other", workbook())):
        with pytest.raises(PackageError):
            legacy.BinaryWorkbook(bad)
    looped = bytearray(good)
    struct.pack_into("<I", looped, 512 + 4 * 3, 2)  # a sector that leads back
    with pytest.raises(PackageError):
        legacy.BinaryWorkbook(bytes(looped))


def test_packed_numbers():
    assert [legacy.rk_number(x) for x in (100 << 2 | 2, 100 << 2 | 3, 0x3FF00000, 0x3FF00001)] == [100.0, 1.0, 1.0, 0.01]
