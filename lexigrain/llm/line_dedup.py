"""Near-duplicate lines by a segment-partition edit join.

How many edits two linked lines may differ by grows with the shorter one's
length. Lengths are divided into cells; in a cell with t edits a line's first
t + 1 segments have one length. Of two lines within t edits one segment of the
shorter stands unchanged in the longer, moved by no more places than segments
before it, with no more edits behind it than segments after it. So a line's keys
are its own segments and, for its cell and a shorter neighbour cell, its
substrings at the places where such a segment can lie; lines that share a key are
candidates, and a banded bit-parallel edit distance decides.

Keys are found in numpy, a buffer of lines at a time, and travel as packed
arrays to buckets that give back only keys that different lines share. Equal
lines are one line. Where many lines share a key, the rest of each line behind it
is divided into segments again, as many as edits are left and one more, and lines
are candidates only if they share one of these too. A pair is checked at the
smallest key it shares; keys that still have many lines are checked block against
block. What comes back is each line's number of links and a forest of links, so
no row for each pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_small, slices, text_column
from .linkage import attach, components, semi
from .words import CHUNK, MASK, _powers, mix, seeds

_U = np.uint64
_BASE = 0xA0761D6478BD642F
_LETTER = seeds(1 << 16, 9)


@dataclass(frozen=True)
class Settings:
    """``edits``: between linked lines at least; ``per``: a line of ``per * t * t`` characters may have t edits (None: always ``edits``); ``most``: edits at most, 30 at most; ``least_chars``: shorter lines have no links; ``block``: lines of a key checked in one piece; ``refine``: lines of a key above which it is refined, ``rounds`` times at most (below, finer keys cost more than looking at the pairs); ``exact_chars``: shorter lines take no part, those from here to ``least_chars`` as exact copies only (None: there are none such)."""

    edits: int = 2
    least_chars: int = 20
    block: int = 256
    exact_chars: int | None = None
    per: int | None = 20
    most: int = 30
    refine: int = 4096
    rounds: int = 3

    @property
    def floor(self) -> int:
        """Code points of the shortest line that takes part."""
        return self.least_chars if self.exact_chars is None else min(self.exact_chars, self.least_chars)

    @functools.cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Least length and edits of each cell; a cell is wider than its edits."""
        low, edits = [max(1, self.least_chars)], []
        while low[-1] < 1 << 31:
            edits.append(max(self.edits, min(self.most, math.isqrt(low[-1] // self.per))) if self.per else self.edits)
            low.append(low[-1] + max(4 * edits[-1] + 4, low[-1] // 8))
        return np.array(low[:-1]), np.array(edits)

    def cell_of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cells[0], sizes, side="right") - 1

    def edits_of(self, sizes: np.ndarray) -> np.ndarray:
        """Edits that a line of so many code points may be away from a longer one."""
        return self.cells[1][self.cell_of(np.maximum(sizes, self.cells[0][0]))]


#: What the query and the stage use: every line that isn't empty takes part.
ALL_LINES = Settings(exact_chars=1)


# ---------------------------------------------------------------- lines and keys


class Lines:
    """Some texts' lines of ``least`` code points at least: owner (text), number (line), code points and running hash."""

    def __init__(self, texts: list[str], first: int, least: int, number: int = 0):
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        breaks = np.flatnonzero(self.codes == 10)
        starts, ends = np.append(0, breaks + 1), np.append(breaks, len(self.codes))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        owner = np.searchsorted(begins, starts, side="right") - 1
        first_line = np.searchsorted(starts, begins)
        keep = ends - starts >= least
        self.owner = first + owner[keep]
        self.number = (np.arange(len(starts)) - first_line[owner])[keep] + number
        self.starts, self.sizes = starts[keep], (ends - starts)[keep]
        low = _LETTER[self.codes & _U(0xFFFF)]
        if len(self.codes) and self.codes.max() > 0xFFFF:
            low = low + _LETTER[self.codes >> 16] * _U(3)
        n = len(self.codes) + 1
        with np.errstate(over="ignore"):
            self._inverse = powers(n)[1]
            self._total = np.zeros(n, np.uint64)
            np.cumsum(low * powers(n)[0][: n - 1], out=self._total[1:])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of substrings, equal for equal ones wherever they stand."""
        with np.errstate(over="ignore"):
            return (self._total[starts + sizes] - self._total[starts]) * self._inverse[starts]

    def ids(self) -> np.ndarray:
        """63-bit hashes of the lines, as even signed integers."""
        with np.errstate(over="ignore"):
            h = mix(self.hashes(self.starts, self.sizes) + self.sizes.astype(np.uint64) * _U(_BASE))
        return (h & _U(MASK - 1)).view(np.int64)

    def keys(self, settings: Settings) -> Iterator[tuple[np.ndarray, ...]]:
        """(lines, keys, own, places behind the segments, edits left, least length left) of segments of the lines themselves (own) and of substrings that may be a shorter line's segment."""
        low, edits = settings.cells
        home = settings.cell_of(self.sizes)
        for back in (0, 1):
            cell = home - back
            ready = np.flatnonzero(cell >= 0)
            if back:  # only lines that a line of the cell below can be near to
                ready = ready[self.sizes[ready] - edits[cell[ready]] < low[cell[ready] + 1]]
            for t in np.unique(edits[cell[ready]]).tolist():
                number, shift = _places(t)
                every = ready[edits[cell[ready]] == t]
                for a in range(0, len(every), max(1, (1 << 20) // len(number))):
                    some = every[a : a + max(1, (1 << 20) // len(number))]
                    length = low[cell[some]] // (t + 1)
                    start = length[:, None] * number + shift
                    row, column = np.nonzero((start >= 0) & (start + length[:, None] <= self.sizes[some][:, None]))
                    at, begin, size, i = some[row], start[row, column], length[row], number[column]
                    with np.errstate(over="ignore"):
                        key = mix(self.hashes(self.starts[at] + begin, size) + cell[at].astype(np.uint64) * _U(0x8EBC6AF09C88C6E3) + (i + 1).astype(np.uint64) * _U(0x589965CC75374CC3))
                    yield at, key.view(np.int64), (shift[column] == 0) & (not back), begin + size, t - i, low[cell[at]] - (i + 1) * size


@functools.lru_cache(maxsize=64)
def _places(edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, shift) of every substring of a line that may be a shorter line's segment."""
    found = [(i, shift) for i in range(edits + 1) for shift in range(-min(i, edits - i), i + 1)]
    return tuple(np.array(c, np.int64) for c in zip(*found))


def by_key(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by key, and by value where keys are equal."""
    order = np.argsort(key)
    key, value = key[order], value[order]
    same = key[1:] == key[:-1]
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))
    value[several] = value[several][np.lexsort((value[several], key[several]))]
    return key, value


def refine(lines: Lines, at: np.ndarray, key: np.ndarray, own: np.ndarray, place: np.ndarray, edits: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """Finer keys for entries of ``lines``: (entry, key, own, place, edits, left), each with a segment of the line behind ``place`` in it.

    ``edits`` may lie behind ``place``, where a line that owns its key has
    ``left`` code points at least. Without edits all of the rest is the segment;
    where the segments would be too short, the entry stays as it is, without edits.
    """
    rest, out = lines.sizes[at] - place, []

    def add(entry: np.ndarray, j: int, own: np.ndarray, start: np.ndarray, size: np.ndarray, edits: np.ndarray, left: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            raw = lines.hashes(lines.starts[at[entry]] + start, size) + size.astype(np.uint64) * _U(_BASE)
            new = mix(mix(raw + _U(j + 1) * _U(0x589965CC75374CC3)) ^ key[entry].view(np.uint64))
        out.append((entry, new.view(np.int64), own, start + size, edits, left))

    entries, none = np.arange(len(at)), np.zeros(len(at), np.int64)
    whole = edits == 0
    add(entries[whole], 0, own[whole], place[whole], rest[whole], none[whole], none[whole] - 1)
    length = left // (edits + 1)
    stay = ~whole & (length < LEAST_SEGMENT)
    out.append((entries[stay], key[stay], own[stay], place[stay], none[stay], none[stay] - 1))
    for t in np.unique(edits[~whole & ~stay]).tolist():
        some = entries[~whole & ~stay & (edits == t)]
        for j in range(t + 1):
            for shift in range(-j, j + 1):
                start, size = j * length[some] + shift, length[some]
                fine = (start >= 0) & (start + size <= rest[some])
                entry, begin, n = some[fine], start[fine] + place[some[fine]], size[fine]
                add(entry, j, own[entry] & (shift == 0), begin, n, np.full(len(entry), t - j), left[entry] - (j + 1) * n)
    return tuple(np.concatenate(c) for c in zip(*out))


#: Segments of fewer code points don't tell lines apart.
LEAST_SEGMENT = 4


_POWERS: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _POWERS[0], _POWERS[1]


def lines_of(texts: list[str], least: int) -> Iterator[Lines]:
    """The texts' lines, in buffers of about CHUNK code points; longer texts are cut at line feeds."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size + len(texts[last]) < CHUNK:
            size += len(texts[last]) + 1
            last += 1
        if last > first:
            yield Lines(texts[first:last], first, least)
            first = last
            continue
        text, at, number = texts[first], 0, 0
        while at <= len(text):
            end = len(text) if len(text) - at <= CHUNK else text.rfind("\n", at, at + CHUNK)
            if end < at:
                end = text.find("\n", at + CHUNK)
                end = len(text) if end < 0 else end
            part = text[at:end]
            yield Lines([part], first, least, number)
            number += part.count("\n") + 1
            at = end + 1
        first += 1


# ---------------------------------------------------------------- edit distance


def _padded(arrays: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), np.uint32)
    for row, a in zip(out, arrays):
        row[: len(a)] = a
    return out


def near_pairs(codes: list[np.ndarray], x: np.ndarray, y: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether lines x[i] and y[i] of the list are at most edits[i] edits apart: what they begin and end with alike is cut off, the rest goes through the band."""
    out = np.zeros(len(x), bool)
    sizes = np.array(list(map(len, codes)), np.int64)
    order = np.argsort(np.maximum(sizes[x], sizes[y]), kind="stable")
    at = 0
    while at < len(order):
        widths = np.maximum(sizes[x[order[at:]]], sizes[y[order[at:]]]) * np.arange(1, len(order) - at + 1)
        some = order[at : at + max(1, int(np.searchsorted(widths, 1 << 21)))]
        at += len(some)
        used, back = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
        p, q, t, own = back[: len(some)], back[len(some) :], edits[some], sizes[used]
        texts = [codes[k] for k in used]
        least = np.minimum(own[p], own[q])
        head = _alike(_padded(texts, int(own.max())), p, q, least)
        tail = np.minimum(_alike(_padded([c[::-1] for c in texts], int(own.max())), p, q, least), least - head)
        rest_p, rest_q = own[p] - head - tail, own[q] - head - tail
        mine = (np.minimum(rest_p, rest_q) == 0) & (np.maximum(rest_p, rest_q) <= t)
        todo = np.flatnonzero((np.minimum(rest_p, rest_q) > 0) & (np.abs(rest_p - rest_q) <= t))
        for k in np.unique(t[todo]).tolist():
            few = todo[t[todo] == k]
            sides = [[texts[i][h : h + n] for i, h, n in zip(side[few].tolist(), head[few].tolist(), rest[few].tolist())] for side, rest in ((p, rest_p), (q, rest_q))]
            mine[few] = within(*sides, k)
        out[some] = mine
    return out


def _alike(rows: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many elements, ``most`` at most, rows p and q begin with alike."""
    if not rows.shape[1]:
        return np.zeros(len(p), np.int64)
    same = rows[p] == rows[q]
    return np.minimum(np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)), most)


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether each pair of code point arrays is at most ``edits`` edits apart.

    One bit of a 64-bit word stands for one diagonal of the band of
    2 * edits + 1 around the main one; all pairs advance together, a column at a
    time. ``edits`` is 30 at most.
    """
    out = np.zeros(len(left), bool)
    long = [a if len(a) >= len(b) else b for a, b in zip(left, right)]
    short = [b if len(a) >= len(b) else a for a, b in zip(left, right)]
    n, m = np.array(list(map(len, long)), np.int64), np.array(list(map(len, short)), np.int64)
    todo = np.flatnonzero(n - m <= edits)
    tiny = todo[n[todo] <= edits]
    out[tiny] = True
    todo = todo[n[todo] > edits]
    todo = todo[np.argsort(n[todo], kind="stable")]
    at = 0
    while at < len(todo):
        widths = n[todo[at:]] * np.arange(1, len(todo) - at + 1)
        end = at + max(1, int(np.searchsorted(widths, 1 << 20)))
        some = todo[at:end]
        out[some] = _band([long[i] for i in some], [short[i] for i in some], n[some], m[some], edits)
        at = end
    return out


def _band(long: list[np.ndarray], short: list[np.ndarray], n: np.ndarray, m: np.ndarray, edits: int) -> np.ndarray:
    k, one, top = edits, _U(1), _U(63)
    width = int(n.max()) + 2 * k + 1
    rows = np.zeros((len(long), width + k), np.uint32)
    for row, a in zip(rows, long):
        row[k : k + len(a)] = a + 1
    columns = _padded(short, int(m.max()) if len(m) else 0)
    dist = np.full(len(long), k, np.int64)
    vp = np.full(len(long), (MASK << (63 - k)) & MASK, np.uint64)
    vn = np.zeros(len(long), np.uint64)
    limit = k + m - (n - k)
    alive = np.arange(len(long))
    for j in range(columns.shape[1]):
        alive = alive[(j < m[alive]) & (dist[alive] <= limit[alive])] if j % 8 == 0 else alive[j < m[alive]]
        if not len(alive):
            break
        c = columns[alive, j] + 1
        eq = np.zeros(len(alive), np.uint64)
        for d in range(2 * k + 1):
            eq |= (rows[alive, j + d] == c).astype(np.uint64) << _U(63 - 2 * k + d)
        p, q = vp[alive], vn[alive]
        d0 = (((eq & p) + p) ^ p) | eq | q
        hp, hn = q | ~(d0 | p), d0 & p
        diagonal = j < n[alive] - k
        down = np.minimum(np.maximum(j - (n[alive] - k), 0), 62).astype(np.uint64)
        bit = _U(62) - down
        step = np.where(diagonal, 1 - (d0 >> top).astype(np.int64), (hp >> bit & one).astype(np.int64) - (hn >> bit & one).astype(np.int64))
        dist[alive] += step
        x = d0 >> one
        vp[alive], vn[alive] = hn | ~(x | hp), x & hp
    return dist <= k


# ---------------------------------------------------------------- the join

#: Keys that so many lines of one flush share are known to be shared; only two of them go to the bucket.
_MANY = 32


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))


def occurrences(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, line_no, line, chars): every line long enough, by the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            for lines in lines_of(b.column(1).to_pylist(), settings.floor):
                columns = [b.column(0).take(pa.array(lines.owner)), pa.array(lines.number.astype(np.int64)), pa.array(lines.ids()), pa.array(lines.sizes.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "line", "chars"])

    return _texts(docs).mapInArrow(run, "doc_id long, line_no long, line long, chars long")


#: Characters of lines whose keys go to one bucket, about: a task holds its bucket's keys.
BUCKET_CHARS = 8 << 20


def _shared_keys(docs: DataFrame, settings: Settings, chars: int) -> DataFrame:
    """(key, line) for keys that are some line's segment and that two different lines have at least; rows may repeat. ``chars``: of all lines."""
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held, turn = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, turn
            key, value = np.concatenate(keys), np.concatenate(values)
            keys.clear(), values.clear()
            held = 0
            key, value = by_key(key, value)
            fresh = np.append(True, (key[1:] != key[:-1]) | (value[1:] != value[:-1]))
            key, value = key[fresh], value[fresh]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            big = np.repeat(sizes >= _MANY, sizes)
            some = ~big
            # of a key known to be shared a segment's line, if any, and the last go to the bucket
            own = np.flatnonzero(value & 1)
            owned = own[np.unique(key[own], return_index=True)[1]]
            some[owned] = True
            some[np.append(starts[1:], len(key)) - 1] = True
            some[starts] = True
            bucket = ((key.view(np.uint64) >> _U(33)) % _U(buckets)).astype(np.int32)
            rows = [(int(n), False, a, v) for n, a, v in _split(bucket[some], key[some], value[some])]
            for a in range(0, int(big.sum()), 8192):
                turn += 1
                at = np.flatnonzero(big)[a : a + 8192]
                rows.append(((turn * 7919) % buckets, True, key[at].tobytes(), value[at].tobytes()))
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["bucket", "known", "keys", "lines"])

        for b in (s for x in batches for s in slices(x)):
            for lines in lines_of(b.column(1).to_pylist(), settings.least_chars):
                ids = lines.ids()
                for at, key, own, *_ in lines.keys(settings):
                    keys.append(key)
                    values.append(ids[at] | own)
                    held += len(key)
                if held > 600_000:
                    yield flush()
        if held:
            yield flush()

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, known = [], [], []
        for b in batches:
            for sure, k, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if sure:
                    known.append((np.frombuffer(k, np.int64), np.frombuffer(v, np.int64) & -2))
                else:
                    keys.append(np.frombuffer(k, np.int64))
                    values.append(np.frombuffer(v, np.int64))
                if len(known) > 8:
                    yield _pairs_batch(known)
                    known = []
        if keys:
            key, value = np.concatenate(keys), np.concatenate(values)
            key, value = by_key(key, value)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            own = np.add.reduceat(value & 1, starts) > 0
            line = value & -2
            several = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
            live = np.repeat(own & several, sizes)
            known.append((key[live], line[live]))
        if known:
            yield _pairs_batch(known)

    packed = _texts(docs).mapInArrow(pack, "bucket int, known boolean, keys binary, lines binary")
    return packed.repartition(buckets, "bucket").mapInArrow(detect, "key long, line long")


def _split(bucket: np.ndarray, key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, key, value = bucket[order], key[order], value[order]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, z in zip(edges, edges[1:]):
        if z > a:
            yield bucket[a], key[a:z].tobytes(), value[a:z].tobytes()


def _pairs_batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["key", "line"])


def _line_texts(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            for lines in lines_of(b.column(1).to_pylist(), settings.least_chars):
                raw = lines.codes
                said = [raw[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(lines.starts.tolist(), lines.sizes.tolist())]
                ids, at = np.unique(lines.ids(), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([said[i] for i in at], pa.string())], names=["line", "text"])

    return _texts(docs).mapInArrow(run, "line long, text string")


ENTRIES = "key long, line long, own boolean, place int, edits int, room int"


def _refined(entries: DataFrame, texts: DataFrame, settings: Settings, first: bool) -> DataFrame:
    """Finer entries for those of hot keys. ``first``: the entries are (key, line) of the lines' own keys, to be found in them again."""
    names = ["key"] if first else ["key", "own", "place", "edits", "room"]
    held = entries.groupBy("line").agg(F.collect_list(F.struct(*names)).alias("held")).join(texts, "line").select("line", "text", *(F.col(f"held.{n}").alias(n) for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            ids = b.column(0).to_numpy()
            owners = [np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())]
            columns = [np.asarray(b.column(i).flatten()) for i in range(2, b.num_columns)]
            for lines in lines_of(b.column(1).to_pylist(), 0):
                base, count = int(lines.owner[0]), len(lines.owner)
                mine = np.flatnonzero((owners[0] >= base) & (owners[0] < base + count))
                at, key = owners[0][mine] - base, columns[0][mine]
                if first:
                    asked = set(zip(at.tolist(), key.tolist()))
                    hot, parts = np.unique(key), []
                    for found, keys, own, place, edits, left in lines.keys(settings):
                        hit = np.flatnonzero(np.isin(keys, hot))
                        hit = hit[[pair in asked for pair in zip(found[hit].tolist(), keys[hit].tolist())]] if len(hit) else hit
                        if len(hit):
                            parts.append((found[hit], keys[hit], own[hit], place[hit], edits[hit], left[hit]))
                    if not parts:
                        continue
                    given = tuple(np.concatenate(c) for c in zip(*parts))
                else:
                    own, place, edits, left = (columns[i][mine] for i in range(1, 5))
                    given = (at, key, own.astype(bool), place.astype(np.int64), edits.astype(np.int64), left.astype(np.int64))
                entry, key, own, place, edits, left = refine(lines, *given)
                line = ids[base + given[0][entry]]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
                for a in range(0, len(line), 200_000):
                    z = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(c[z], t) for c, t in zip((key, line, own, place, edits, left), kinds)], names=[n.split()[0] for n in ENTRIES.split(", ")])

    return held.mapInArrow(run, ENTRIES).distinct()


def _sparse(entries: DataFrame, marks: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The hot keys (``marks``: key, n) of whose lines, by a sample of about SAMPLED of each, few are near each other.

    Only these are worth refining: where most lines are near each other, their
    links have to be counted pair by pair in any case. What is found doesn't
    depend on it.
    """
    few = F.pmod(F.xxhash64("line", "key"), F.greatest(F.lit(1), (F.col("n") / SAMPLED).cast("long"))) == 0
    some = attach(entries.select("key", "line"), marks, "key").where(few).select("key", "line").join(texts, "line").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: int, lines: list[str]) -> list[int]:
            codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in lines[: 2 * SAMPLED]]
            x, y = np.triu_indices(len(codes), 1)
            sizes = np.array(list(map(len, codes)))
            edits = settings.edits_of(np.minimum(sizes[x], sizes[y])) if len(x) else x
            return [] if len(x) and near_pairs(codes, x, y, edits).mean() >= DENSE else [key]

        at, held, out = None, [], []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != at:
                    out += told(at, held) if held else []
                    at, held = key, []
                held.append(text)
        out += told(at, held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["key"])

    return some.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long")


#: Lines of a hot key looked at to see whether refining helps, and the share of near pairs from which it doesn't.
SAMPLED, DENSE = 24, 0.1


def _leaves(shared: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """(key, line, n): what is checked together, n the lines of the key. Keys of more than ``refine`` lines are refined as long as edits are left."""
    count = [F.count("*").alias("n"), F.sum(F.xxhash64("line") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("x")]
    marks = cut_small(shared.groupBy("key").agg(*count))
    hot = cut_small(marks.where(F.col("n") > settings.refine).select("key"))
    if not settings.rounds or not hot.limit(1).count():
        return _one_of_equal(shared, marks)
    texts = cut(semi(_line_texts(docs, settings), cut_small(attach(shared, hot, "key").select("line").distinct()), "line").dropDuplicates(["line"]))
    entries, pairs, asked = shared, shared, marks.where(F.col("n") > settings.refine).select("key", "n")
    leaves, told = None, None
    for number in range(settings.rounds + 1):
        again = cut_small(_sparse(pairs, asked, texts, settings)) if number < settings.rounds else hot.limit(0)
        kept, final = semi(pairs.select("key", "line"), again, "key", "left_anti"), semi(marks.select("key", "n", "s", "x"), again, "key", "left_anti")
        leaves, told = (kept, final) if leaves is None else (leaves.union(kept), told.union(final))
        if number == settings.rounds or not again.limit(1).count():
            break
        entries = cut_small(_refined(attach(entries, again, "key"), texts, settings, number == 0))
        pairs = cut_small(entries.groupBy("key", "line").agg(F.max("own").alias("own"), F.max("edits").alias("edits")))
        marks = cut_small(pairs.groupBy("key").agg(*count, F.max("own").alias("own"), F.max("edits").alias("edits")).where("own and n > 1"))
        asked = cut_small(marks.where((F.col("n") > settings.refine) & (F.col("edits") > 0)).select("key", "n"))
    return _one_of_equal(leaves, cut_small(told))


def _one_of_equal(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """The entries of marked keys; keys with the same lines say the same: one of them stays."""
    kept = cut_small(marks.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n"))
    many = cut_small(kept.where(F.col("n") >= MANY_LINES))
    if not many.limit(1).count():
        return entries.join(kept, "key").select("key", "line", "n")
    rest = semi(entries, many.select("key"), "key", "left_anti").join(kept.where(F.col("n") < MANY_LINES), "key")
    return attach(entries, many, "key").select("key", "line", "n").union(rest.select("key", "line", "n"))


#: Lines of a key from which on its entries aren't brought together to be joined.
MANY_LINES = 5_000
#: Lines of a block from which on its pairs are looked at as arrays.
ARRAYS_FROM = 12


def block_pairs(key: tuple, rows: list[tuple], codes: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block (rows of part, line, own keys) that may be near and whose smallest common key this is."""
    entry, i, j = key
    chars, part = np.array(list(map(len, codes))), np.array([r[0] for r in rows])
    x, y = np.triu_indices(len(rows), 1)
    apart = np.abs(chars[x] - chars[y])
    edits = settings.edits_of(np.minimum(chars[x], chars[y]))
    fine = (apart <= edits) & ((part[x] != part[y]) if i != j else True)
    x, y, edits = x[fine], y[fine], edits[fine]
    if len(rows) < ARRAYS_FROM:
        keys = [set(r[2]) for r in rows]
        some = np.array([min(keys[a] & keys[b]) == entry for a, b in zip(x.tolist(), y.tolist())], bool)
        return x[some], y[some]
    # an edit changes two of the counts of letters at most
    letters = np.stack([np.bincount(c & 31, minlength=32) for c in codes]).astype(np.int32)
    near = np.concatenate([np.abs(letters[x[a : a + 65_536]] - letters[y[a : a + 65_536]]).sum(axis=1) <= 2 * edits[a : a + 65_536] for a in range(0, max(1, len(x)), 65_536)])
    x, y = x[near], y[near]
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    flat = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    owner, flat = owner[flat < entry], flat[flat < entry]
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.zeros((len(rows), len(rows)), bool)
    common = times[place] > 1
    owner, place = owner[common], place[common]
    names = np.unique(place)
    for a in range(0, len(names), 4096):
        some = (place >= names[a]) & (place <= names[min(len(names), a + 4096) - 1])
        has = np.zeros((len(rows), min(4096, len(names) - a)), np.float32)
        has[owner[some], np.searchsorted(names, place[some]) - a] = 1
        shared |= has @ has.T > 0
    some = ~shared[x, y]
    return x[some], y[some]


def _check(dealt: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, n): a's links found (b null), or a link of the forest (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        codes: list[np.ndarray] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def take(key: tuple, rows: list[tuple]) -> None:
            """The block's pairs are put with those that wait."""
            nonlocal waiting
            if len(rows) < 2:
                return
            own = [np.frombuffer(r[3].encode("utf-32-le"), np.uint32) for r in rows]
            x, y = block_pairs(key, rows, own, settings)
            if not len(x):
                return
            pairs.append((x + len(ids), y + len(ids)))
            ids.extend(r[1] for r in rows)
            codes.extend(own)
            waiting += len(x)

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            rows: list[tuple] = []
            if pairs:
                x, y = (np.concatenate(c) for c in zip(*pairs))
                sizes = np.array(list(map(len, codes)))
                near = near_pairs(codes, x, y, settings.edits_of(np.minimum(sizes[x], sizes[y])))
                line = np.array(ids)
                a, b = line[x[near]], line[y[near]]
                found, times = np.unique(np.concatenate([a, b]), return_counts=True)
                root: dict[int, int] = {}

                def find(v: int) -> int:
                    while root.setdefault(v, v) != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                for p, q in zip(a.tolist(), b.tolist()):
                    if (u := find(p)) != (v := find(q)):
                        root[u] = v
                        rows.append((p, q, None))
                rows += [(v, None, n) for v, n in zip(found.tolist(), times.tolist())]
            for held in (ids, codes, pairs):
                held.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], names=["a", "b", "n"])

        at, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != at:
                    take(at, held)
                    if waiting >= 4096:
                        yield flush()
                    at, held = row[:3], []
                held.append(row[3:])
        take(at, held)
        yield flush()

    keys = ["key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def link_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per line of ``settings.floor`` code points at least: doc_id, line_no, chars, class_doc_id, class_line_no, n_links, kept.

    Lines are what line feeds part, numbered from 0. Equal lines are one line;
    n_links is the number of different lines within as many edits of it as
    ``Settings.edits_of`` the shorter one's length, none for a line under
    ``least_chars``, whose class is its exact copies. A line's
    class holds all lines reachable by links; class_doc_id and class_line_no are
    the class's first line by (doc_id, line_no), which alone is kept. Code points
    are what is counted. Lines stand as 63-bit hashes; keys as 64-bit ones.

    Null texts and texts without lines of that length have no rows; rows with a null doc_id
    take no part; rows that repeat an id and a text repeat their lines, kept or
    not as one. An empty table gives no rows; other columns are ignored; texts
    and lines are read whole.
    """
    docs = docs.where("doc_id is not null")
    found = cut(occurrences(docs, settings))
    chars = found.where(F.col("chars") >= settings.least_chars).agg(F.sum("chars")).first()[0] or 0
    shared = cut_small(_shared_keys(docs, settings, chars).distinct())
    entries = cut_small(_leaves(shared, docs, settings))
    own_keys = cut_small(entries.groupBy("line").agg(F.collect_list("key").alias("own_keys")))
    texts = semi(_line_texts(docs, settings), own_keys.select("line"), "line").dropDuplicates(["line"])
    blocks = entries.select("key", "line", (F.col("n") / settings.block).cast("int").alias("top")).withColumn("part", F.pmod(F.xxhash64("line"), F.col("top") + 1).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), "top"))).join(texts.join(own_keys, "line"), "line")
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "line", "own_keys", "text")
    checked = cut_small(_check(dealt, settings))
    labels = components(checked.where("b is not null").select("a", "b"))
    counts = checked.where("b is null").groupBy(F.col("a").alias("line")).agg(F.sum("n").alias("n_links"))
    first = found.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    placed = first.join(labels.select(F.col("id").alias("line"), "component"), "line", "left").withColumn("class", F.coalesce("component", "line"))
    heads = placed.groupBy("class").agg(F.min("first").alias("head"))
    told = placed.join(heads, "class").join(counts, "line", "left").select("line", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    kept = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    return found.join(told, "line").select("doc_id", "line_no", "chars", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))


def drop_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the lines that ``link_lines`` doesn't keep, all columns kept; n_chars, if there, is counted anew.

    The lines that stay are joined by line feeds as before. A document left
    without any text by this is dropped, one that was empty before stays, as do
    rows with a null doc_id.
    """
    names, lost = docs.columns, "lost"
    while lost in names:
        lost += "_"
    gone = cut_small(link_lines(docs, settings).where("not kept").groupBy("doc_id").agg(F.collect_list("line_no").alias(lost)))
    plain = docs.where("doc_id is null")
    touched = semi(docs, gone.select("doc_id"), "doc_id").join(gone, "doc_id").select(*names, lost)
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x, text_at)):
            texts, blank = [], []
            for text, lost in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist()):
                lost = set(lost)
                blank.append(not (text or "").strip())
                texts.append("\n".join(line for k, line in enumerate((text or "").split("\n")) if k not in lost or len(line) < settings.floor))
            columns = list(b.columns[: len(names)])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array(list(map(len, texts)), columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([was or bool(t.strip()) for t, was in zip(texts, blank)], pa.bool_()))

    rest = semi(docs.where("doc_id is not null"), gone.select("doc_id"), "doc_id", "left_anti").select(*names)
    return rest.union(plain).union(touched.mapInArrow(run, docs.schema))
