"""MPEG transport streams as a media column: write, parse, reassemble.

A payload becomes one program: a program association table, a program map
table and one elementary stream of private data, cut into elementary packets
with presentation timestamps; every ``RANDOM_EVERY``-th access unit is a
random-access point that carries a clock reference. Reading checks sync bytes,
table checksums and continuity counters, and gives the elementary bytes back.
Packets are laid out as rows of a 188-column byte array, so headers are built
and parsed a stream at a time.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column

# Fixed values of the format (ISO/IEC 13818-1).
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PRIVATE_PES = 0x06  # stream type: private data in elementary packets
PRIVATE_STREAM_1 = 0xBD  # stream id
CLOCK = 90_000  # timestamp units a second

# Choices of this writer.
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES = 32_640  # of an access unit; a multiple of the 64-byte blocks
UNIT_TICKS = 3_600  # 1/25 s
RANDOM_EVERY = 8


class StreamError(ValueError):
    """The bytes aren't a transport stream this module can read whole."""


@functools.lru_cache(maxsize=256)
def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own checksum."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    data = head + body
    return data + section_crc(data).to_bytes(4, "big")


@functools.lru_cache(maxsize=4)
def _tables() -> tuple[bytes, bytes]:
    """Packets of the two tables, continuity counters 0."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    packets = [bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return packets[0].ljust(PACKET, b"\xff"), packets[1].ljust(PACKET, b"\xff")


def _timestamp(mark: int, pts: int) -> bytes:
    return bytes([mark << 4 | (pts >> 29 & 0x0E) | 1, pts >> 22 & 0xFF, (pts >> 14 & 0xFE) | 1, pts >> 7 & 0xFF, (pts << 1 & 0xFE) | 1])


def _clock_reference(ticks: int) -> bytes:
    base = ticks & (1 << 33) - 1
    return (base << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream; no bytes give the tables alone."""
    out, counter, tables = [], 0, 0
    for unit, a in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[a : a + UNIT_BYTES]
        random = unit % RANDOM_EVERY == 0
        pts = unit * UNIT_TICKS & (1 << 33) - 1
        if random:
            for packet in _tables():
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + data
        field_bytes = b"\x50" + _clock_reference(pts) if random else b""
        room = PACKET - 4 - (1 + len(field_bytes) if random else 0)
        first = pes[:room]
        stuffing = room - len(first)
        if random or stuffing:
            extra = field_bytes
            if not random and stuffing:
                stuffing -= 1
                if stuffing:
                    extra, stuffing = b"\x00", stuffing - 1
            extra += b"\xff" * stuffing
            adapt = bytes([len(extra)]) + extra
            control = 0x30
        else:
            adapt, control = b"", 0x10
        out.append(bytes([SYNC]) + (0x4000 | ES_PID).to_bytes(2, "big") + bytes([control | counter]) + adapt + first)
        counter = counter + 1 & 15
        rest = pes[room:]
        full = len(rest) // (PACKET - 4)
        if full:
            rows = np.empty((full, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            rows[:, 3] = 0x10 | (counter + np.arange(full) & 15)
            rows[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(rows.tobytes())
            counter = counter + full & 15
        if tail := rest[full * (PACKET - 4) :]:
            stuffing = PACKET - 5 - len(tail)
            adapt = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC]) + ES_PID.to_bytes(2, "big") + bytes([0x30 | counter]) + adapt + tail)
            counter = counter + 1 & 15
    if not out:
        out = list(_tables())
    return b"".join(out)


@dataclass
class Parsed:
    """``data``: the elementary stream's bytes; timestamps and, by index into them, the random-access points with their packet numbers."""

    data: bytes = b""
    packets: int = 0
    continuity_errors: int = 0
    pts: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int, int]] = field(default_factory=list)  # (unit, packet, clock reference)


def _first_section(rows: np.ndarray, pids: np.ndarray, starts: np.ndarray, pid: int, table_id: int) -> bytes:
    """The section at the first packet of the pid, checked; later packets of it must hold the same section."""
    at = np.flatnonzero((pids == pid) & starts)
    if not len(at):
        raise StreamError(f"no table on pid {pid}")
    found = None
    for packet in sorted({row.tobytes() for row in rows[at, 4:]}):
        data = packet[1 + packet[0] :]
        data = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
        if data[0] != table_id or section_crc(data):
            raise StreamError(f"table {table_id} on pid {pid} is damaged")
        found = found or data
    return found


def demux(stream: bytes) -> Parsed:
    """Reads the first program's first elementary stream. StreamError where bytes, tables or elementary packets are damaged."""
    if not stream or len(stream) % PACKET:
        raise StreamError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise StreamError("a packet has no sync byte")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts = (rows[:, 1] & 0x40) != 0
    pat = _first_section(rows, pids, starts, PAT_PID, 0x00)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(pat) - 4, 4)]
    pmt_pid = next((pid for number, pid in programs if number), None)
    if pmt_pid is None:
        raise StreamError("no program")
    pmt = _first_section(rows, pids, starts, pmt_pid, 0x02)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    if at >= len(pmt) - 4:
        raise StreamError("no elementary stream")
    es_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    own = np.flatnonzero(pids == es_pid)
    out = Parsed(packets=len(rows))
    for pid in (PAT_PID, pmt_pid, es_pid):
        counters = rows[(pids == pid) & ((rows[:, 3] & 0x10) != 0), 3] & 15
        out.continuity_errors += int((((counters[1:].astype(np.int16) - counters[:-1]) & 15) != 1).sum())
    if not len(own):
        return out
    mine = rows[own]
    adapt = (mine[:, 3] & 0x20) != 0
    skip = np.where(adapt, 5 + mine[:, 4].astype(np.int64), 4)
    if (skip > PACKET).any():
        raise StreamError("an adaptation field is too long")
    skip[(mine[:, 3] & 0x10) == 0] = PACKET
    data = mine[np.arange(PACKET) >= skip[:, None]].tobytes()
    begins = np.concatenate([[0], np.cumsum(PACKET - skip)])
    heads = np.flatnonzero(starts[own])
    if not len(heads) or begins[heads[0]]:
        raise StreamError("the elementary stream starts inside a packet")
    parts = []
    bounds = [*begins[heads].tolist(), len(data)]
    for unit, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if data[a : a + 3] != b"\x00\x00\x01" or b - a < 9:
            raise StreamError("an elementary packet has no start code")
        size = int.from_bytes(data[a + 4 : a + 6], "big")
        if size and size != b - a - 6:
            raise StreamError("an elementary packet is cut short")
        if data[a + 7] & 0x80:
            p = data[a + 9 : a + 14]
            out.pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(data[a + 9 + data[a + 8] : b])
        row = mine[heads[unit]]
        if row[3] & 0x20 and row[4] and row[5] & 0x40:
            clock = int.from_bytes(row[6:12].tobytes(), "big") >> 15 if row[5] & 0x10 else -1
            out.random_access.append((unit, int(own[heads[unit]]), clock))
    out.data = b"".join(parts)
    return out


def pad_payload(text: str, block: int = 64) -> tuple[int, bytes]:
    """The text's UTF-8 and its length, zero bytes after it up to a positive multiple of ``block``."""
    raw = text.encode()
    return len(raw), raw.ljust(max(block, -(-len(raw) // block) * block), b"\x00")


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores every text as a transport stream, reads the stream back and describes what was read.

    One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256 and
    tail_crc32 (last 64 bytes) of the elementary bytes read back, media_bytes and
    media_sha256 of the stream, feature, pts (timestamps of the access units),
    random_access (unit, packet, clock) and, on request, media. A null text is
    empty; a null doc_id stays null; repeated rows are stored each; an empty
    table gives no rows; other columns are ignored. Equal texts give equal
    values. A continuity error or any other damage raises StreamError. No
    shuffle; memory is a few times the longest text.
    """
    access = pa.list_(pa.struct([("unit", pa.int32()), ("packet", pa.int64()), ("clock", pa.int64())]))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("random_access", access)]
    fields += [("media", pa.binary())] * with_media
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<struct<unit:int,packet:long,clock:long>>" + ", media binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, payload = pad_payload(text)
                media = mux(payload)
                got = demux(media)
                if got.continuity_errors or got.data != payload:
                    raise StreamError(f"document {doc_id} can't be read back")
                levels = np.frombuffer(got.data, np.uint8)
                feature = f"packets={got.packets};units={len(got.pts)};random_access={len(got.random_access)};pts={got.pts[0]}-{got.pts[-1]};clock={CLOCK};mean={levels.mean():.4f};zeros={int((levels == 0).sum())}"
                row = (doc_id, n, len(got.data), hashlib.sha256(got.data).hexdigest(), zlib.crc32(got.data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, got.pts, [dict(zip(("unit", "packet", "clock"), r)) for r in got.random_access])
                rows.append(row + (media,) * with_media)
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, schema)
