"""Words and shingles of many texts as 64-bit hashes, computed a buffer at a time.

A word is a run of bytes other than space and U+0009..U+000D, with A-Z in lower
case. Its hash is a polynomial over its bytes read off one running sum for the
whole buffer, then mixed; equal words have equal hashes, and different ones
differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts go in pieces cut at white space.
CHUNK = 1 << 19
MASK = (1 << 64) - 1

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(_BASE) + _U(salt * 0xD1B54A32D192ED03 & MASK))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.ones(1, np.uint64)
    step = _U(base)
    while len(out) < n:
        out = np.concatenate([out, out * step])
        step = step * step
    return out[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OF_BYTE = seeds(256, 1)[_LOWER]
with np.errstate(over="ignore"):
    _POW = _powers(_BASE, CHUNK + 1)
    _INV = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)


def _hash_buffer(buffer: np.ndarray, prefix: int = 0, ending: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a buffer of CHUNK bytes at most; of their first ``prefix`` or last ``ending`` bytes only."""
    inside = ~_SPACE[buffer]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    if ending:
        starts = np.maximum(starts, ends - ending)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_OF_BYTE[buffer] * _POW[: len(buffer)], out=total[1:])
    raw = (total[ends] - total[starts]) * _INV[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(_BASE)), starts, ends


def _hash_long_word(data: bytes) -> np.uint64:
    """The same hash for a word longer than a buffer."""
    base, power, total = _BASE, 1, 0
    for a in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8)[a : a + CHUNK]
        total += int((_OF_BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64)) * power
        power = power * pow(base, len(part), 1 << 64) & MASK
    return mix(np.array([(total + len(data) * _BASE) & MASK], np.uint64))[0]


def _hash_long(data: bytes, prefix: int = 0) -> np.ndarray:
    """Hashes of the words of a text longer than a buffer."""
    out, a = [], 0
    space = _SPACE[np.frombuffer(data, np.uint8)]
    while a < len(data):
        b = min(a + CHUNK, len(data))
        if b < len(data):
            back = np.flatnonzero(space[a:b])
            if len(back):
                b = a + int(back[-1]) + 1
            else:
                rest = np.flatnonzero(space[b:])
                b = b + int(rest[0]) if len(rest) else len(data)
                out.append(np.array([_hash_long_word(data[a : min(b, a + (prefix or b))])], np.uint64))
                a = b
                continue
        out.append(_hash_buffer(np.frombuffer(data, np.uint8)[a:b], prefix)[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes], prefix: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, hashes, bounds) for runs of texts: text first + i has hashes[bounds[i]:bounds[i + 1]].

    With ``prefix`` only so many bytes of each word count.
    """
    first = 0
    with np.errstate(over="ignore"):
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size + len(texts[last]) + 1 <= CHUNK:
                size += len(texts[last]) + 1
                last += 1
            if last == first:
                hashes = _hash_long(texts[first], prefix)
                yield first, first + 1, hashes, np.array([0, len(hashes)])
                first += 1
                continue
            some = texts[first:last]
            hashes, starts, _ = _hash_buffer(np.frombuffer(b"\n".join(some), np.uint8), prefix)
            begins = np.cumsum([0, *(len(t) + 1 for t in some)])
            yield first, last, hashes, np.searchsorted(starts, begins)
            first = last


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of every run of ``width`` words, by their hashes; the order of the words counts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out *= _U(0xD6E8FEB86659FD93)
            out += hashes[k : k + n]
        return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted.

    With fewer words than ``width`` the whole sequence is the one shingle; a
    text without words has none.
    """
    for first, last, hashes, bounds in word_hashes(texts):
        rolled = shingle_hashes(hashes, width)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a >= width:
                yield distinct(rolled[a : b - width + 1])
            elif b > a:
                yield shingle_hashes(hashes[a:b], b - a) ^ _U(b - a)
            else:
                yield np.zeros(0, np.uint64)


#: For ``bytes.translate``: ASCII punctuation as space.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_and_endings(texts: list[bytes], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``word_hashes``, with the hashes of the words' last ``size`` bytes before the bounds."""
    for first, last, hashes, bounds in word_hashes(texts):
        if last - first == 1 and len(texts[first]) >= CHUNK:
            text = texts[first]
            inside = ~_SPACE[np.frombuffer(text, np.uint8)]
            stops = np.flatnonzero(np.diff(inside, prepend=False, append=False))[1::2]
            begins = np.maximum(np.flatnonzero(np.diff(inside, prepend=False, append=False))[::2], stops - size)
            tails = b"\n".join(text[a:b] for a, b in zip(begins.tolist(), stops.tolist()))
            endings = _hash_long(tails)
        else:
            with np.errstate(over="ignore"):
                endings = _hash_buffer(np.frombuffer(b"\n".join(texts[first:last]), np.uint8), 0, size)[0]
        yield first, last, hashes, endings, bounds
