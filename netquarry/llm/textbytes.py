"""Whole texts as numpy byte arrays: words, word hashes, shingles and windows.

Text columns arrive in tasks as Arrow string arrays; their buffers are used
without making a Python object for each row. A word is a maximal run of
characters other than space, tab, newline, vertical tab, form feed and carriage
return, after A-Z are lower-cased; all of these are single bytes in UTF-8, so
bytes can be worked on directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and len(column) + 1 offsets into them; a null row is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row stands alone."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from s to e; takes 16 bytes of memory for each byte of data."""
    up, down = _power(max(SEGMENT_BYTES + 1, len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first): byte spans and 64-bit hashes of all words; row i has the words first[i]:first[i + 1]."""
    starts, ends, found = [], [], []
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + SEGMENT_BYTES)
        if stop < n:  # cut where no word is cut: at a row's start or before white space
            row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if row > at:
                stop = row
            else:
                spaces = np.flatnonzero(_SPACE[data[stop : int(offsets[np.searchsorted(offsets, stop, "right")])]])
                stop = stop + int(spaces[0]) if len(spaces) else int(offsets[np.searchsorted(offsets, stop, "right")])
        part = _LOWER[data[at:stop]]
        inside = ~_SPACE[part]
        fresh = np.zeros(len(part) + 1, bool)
        lo, hi = np.searchsorted(offsets, [at, stop], "left")
        fresh[offsets[lo : hi + 1][offsets[lo : hi + 1] <= stop] - at] = True
        fresh[0] = fresh[-1] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | fresh[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        found.append(hashes(part, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
        if len(_powers["up"]) > 4 * SEGMENT_BYTES:
            _powers.clear()
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    starts.clear()  # the pieces of one array are not needed beside the next
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    ends.clear()
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    found.clear()
    return s, e, h, np.searchsorted(s, offsets)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True) of unsigned 64-bit numbers, in less time if their high bits tell them apart: a plain sort with places in the low bits."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    low = len(x).bit_length()
    lost = np.uint64(max(0, int(x.max()).bit_length() + low - 64))
    key = x >> lost << np.uint64(low) | np.arange(len(x), dtype=np.uint64)
    key.sort()
    place = (key & np.uint64((1 << low) - 1)).view(np.int64)
    key >>= np.uint64(low)
    full = x[place]
    fresh = np.concatenate([[True], full[1:] != full[:-1]])
    if lost and (fresh[1:] & (key[1:] == key[:-1])).any():
        return np.unique(x, return_inverse=True)
    back = np.empty(len(x), np.int64)
    back[place] = np.cumsum(fresh) - 1
    return full[fresh], back


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of one row's n-word shingles, in order; fewer words make one shingle of all, no word none."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    out = np.full(len(hashes) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - width + 1 + k])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct n-word shingles' hashes, sorted."""
    _, _, hashes, first = words(data, offsets)
    full = np.full(max(0, len(hashes) - n + 1), np.uint64(n), np.uint64)
    for k in range(n):
        full = mix(full * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(full)])
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(full[lo : hi - n + 1]) if hi - lo >= n else shingles(hashes[lo:hi], n)
