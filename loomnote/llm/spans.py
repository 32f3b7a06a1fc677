"""Whole-column text primitives on the UTF-8 bytes of an Arrow batch.

Nothing here loops over words: a batch is cut into chunks of about ``CHUNK`` bytes (always whole texts) and each
step is one numpy pass over the chunk's bytes. A single text of more than ``CHUNK`` bytes is a chunk of its own.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_RNG = np.random.default_rng(20240601)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << (n - 1).bit_length())
        p = np.full(size, _ODD, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: spreads each bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets, valid) of a string column; a null is an empty text that is not valid."""
    valid = np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets, valid


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of successive runs of whole texts."""
    data, offsets, _ = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte; other characters stay."""
    out = data.copy()
    up = (data >= 65) & (data <= 90)
    out[up] += 32
    if len(data) > 1:
        lat = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = data[lat]
        lat = lat[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        out[lat] += 32
    return out


_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def word_mask(data: np.ndarray) -> np.ndarray:
    """True on bytes of words: ASCII letters and digits, and all that isn't ASCII but for common punctuation and spaces."""
    m = _WORD[data]
    if len(data) > 1:
        i = np.flatnonzero(data[:-1] == 0xC2)
        i = i[data[i + 1] <= 0xBF]
        i = i[~np.isin(data[i + 1], (0xAA, 0xB5, 0xBA))]
        m[i] = m[i + 1] = False
    if len(data) > 2:
        i = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        j = np.flatnonzero((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] <= 0x91))
        for k in (i, j):
            m[k] = m[k + 1] = m[k + 2] = False
    return m


_WIDE_WHITE = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A, 0x80), *((0xE2, 0x80, c) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)]


def white_mask(data: np.ndarray) -> np.ndarray:
    """True on the bytes of Unicode white space and of ASCII controls."""
    m = data <= 32
    n = len(data)
    for lead in sorted({w[0] for w in _WIDE_WHITE}):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        second = data[np.minimum(at + 1, n - 1)]
        third = data[np.minimum(at + 2, n - 1)]
        for w in _WIDE_WHITE:
            if w[0] == lead:
                hit = at[(second == w[1]) & (third == w[2])] if len(w) == 3 else at[second == w[1]]
                for k in range(len(w)):
                    m[hit + k] = True
    return m


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which goes from one text to the next."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    heads = offsets[:-1][offsets[:-1] < len(mask)]
    before[heads] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    # an empty text shares its tail with the text before, which ends there anyway
    return starts, np.flatnonzero(mask & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; the spans are sorted and don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    if int(lens.sum()) == len(data):
        v, at = BYTE_HASH[data], starts
    else:
        at = np.zeros(len(starts), dtype=np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        v = BYTE_HASH[data[np.arange(int(lens.sum())) + np.repeat(starts - at, lens)]]
    pos = np.arange(len(v)) - np.repeat(at, lens)
    v *= powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(v, at) + lens.astype(np.uint64))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each span."""
    return np.searchsorted(offsets, starts, side="right") - 1


_classes: np.ndarray | None = None
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """Of each code point: letter (L*), number (N*), white space or other."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
        t[_WHITE] = SPACE
        _classes = t
    return _classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters beyond ASCII: place of the first byte, length in bytes, code point."""
    lead = np.flatnonzero(data >= 0xC0)
    b = data[lead].astype(np.int32)
    n = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
    cp = np.where(n == 2, b & 0x1F, np.where(n == 3, b & 0x0F, b & 0x07))
    for k in (1, 2, 3):
        has = n > k
        cont = data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
        cp = np.where(has, (cp << 6) | cont, cp)
    return lead, n, np.minimum(cp, sys.maxunicode)


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the character that each byte belongs to; whether a character starts there."""
    table = classes()
    first = (data & 0xC0) != 0x80
    c = table[:256][data]
    lead, n, cp = code_points(data)
    if len(lead):
        k = table[cp]
        c[lead] = k
        for i in (1, 2, 3):
            at = lead[n > i] + i
            ok = at < len(data)
            c[at[ok]] = k[n > i][ok]
    return c, first


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces into which the byte-level BPE pattern cuts each text.

    The pattern: the contractions 's 't 're 've 'm 'll 'd; an optional space and a run of letters, of numbers or of
    others; white space, whose last character goes with what follows it or stands alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    c, first = byte_classes(data)
    doc = np.zeros(n + 1, dtype=bool)
    doc[offsets] = True
    start = doc[:n].copy()
    start[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(start & (c != SPACE))
    head = head[head > 0]
    head = head[(c[head - 1] == SPACE) & ~doc[head]]
    blank = data[head - 1] == 32
    start[head[blank]] = False
    start[head[blank] - 1] = True
    other = head[~blank] - 1
    while len(other):  # to the first byte of that white-space character
        done = first[other]
        start[other[done]] = True
        other = other[~done] - 1
    a = np.flatnonzero((data == 39) & start)
    a = a[a + 1 < n]
    a = a[~doc[a + 1]]
    if len(a):
        b1 = data[a + 1]
        one = np.isin(b1, np.frombuffer(b"stmd", dtype=np.uint8))
        p = np.minimum(a + 2, n - 1)
        b2 = np.where((a + 2 < n) & ~doc[np.minimum(a + 2, n)], data[p], 0)
        two = ((b1 == ord("r")) & (b2 == ord("e"))) | ((b1 == ord("v")) & (b2 == ord("e"))) | ((b1 == ord("l")) & (b2 == ord("l")))
        for hit, k in ((one, 2), (two & ~one, 3)):
            x = a[hit]
            start[x + 1] = False
            y = x + k
            y = y[y < n]
            y = y[c[y] == LETTER]
            start[y] = True
    return np.flatnonzero(start)
